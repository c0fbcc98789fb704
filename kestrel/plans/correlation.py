"""Queries over correlation joins, hubs and entity resolution, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from kestrel.functions.geo import grid_join, haversine
from kestrel.operators import correlate as J
from kestrel.operators import resolve as E
from kestrel.operators import rings as K
from kestrel.operators.components import components
from kestrel.plans.rings import parts
from kestrel.plans.rings import sql as ringed
from kestrel.sources.bindings import oracle, view

#: The eight printed features of a note.
FEATURES = ["security_thread", "watermark", "microlettering", "intaglio", "see_through", "color_shift_ink", "latent_image", "serial_font"]
HAV = "2 * 6371.0e0 * asin(sqrt(least(1.0e0, power(sin((radians({c}) - radians({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) * power(sin((radians({d}) - radians({b})) / 2), 2))))"


def hav(a, b, c, d):
    return HAV.format(a=a, b=b, c=c, d=d)


def ring_inflows(spark, sf):
    """Transfers into the detected rings from outside them, as in j01."""
    tx, _, rings = parts(spark, sf)
    return K.inflows(tx, rings)


def ring_places(spark, sf):
    _, scores, rings = parts(spark, sf)
    return rings.join(scores, "account_id", "left").select("ring_id", "account_id", "district", "score")


def j02_money_trails(spark, sf):
    found = J.money_trails(view(spark, sf, "scams"), ring_inflows(spark, sf))
    return found.select("event_id", "tx_id", "source", "target", F.col("paid").cast("double").alias("paid"), F.col("edge_amount").cast("double").alias("edge_amount"), "lag_s")


TRAILS_SQL = """tr AS (SELECT event_id, tx_id, source, target, paid, amount AS edge_amount, e.t - s.t AS lag_s,
  row_number() OVER (PARTITION BY event_id ORDER BY e.t, target, tx_id) AS r FROM scams s JOIN infl e ON paid > 0 AND abs(amount - paid) * 100 <= paid AND e.t - s.t BETWEEN -7200 AND 345600)"""


def j03_scam_rings(spark, sf):
    rings = ring_places(spark, sf).select("ring_id", "district").distinct()
    return J.by_district(view(spark, sf, "scams").where("verdict <> 'legit'"), rings, "event_id", "ring_id")


def j04_scam_notes(spark, sf):
    return J.scam_notes(view(spark, sf, "scams").where("verdict = 'scam'"), view(spark, sf, "notes").where("verdict = 'fake'"))


def j05_note_rings(spark, sf):
    rings = ring_places(spark, sf).select("ring_id", "district").distinct()
    return J.by_district(view(spark, sf, "notes").where("verdict = 'fake'"), rings, "event_id", "ring_id")


def j06_distances(spark, sf):
    p = view(spark, sf, "points").select("district", "lat", "lon").distinct()
    return p.select("district", F.round("lat", 4).alias("lat"), F.round("lon", 4).alias("lon"), F.round(haversine(F.col("lat"), F.col("lon"), F.lit(28.61), F.lit(77.21)), 3).alias("km"))


def j07_j09_threat(spark, sf):
    scams, notes = view(spark, sf, "scams").where("verdict <> 'legit'"), view(spark, sf, "notes").where("verdict = 'fake'")
    return J.linked_domains(scams, notes, ring_places(spark, sf), J.money_trails(scams, ring_inflows(spark, sf)))


def district_places(spark, sf):
    return view(spark, sf, "points").groupBy("district").agg(F.min("lat").alias("lat"), F.min("lon").alias("lon"))


def all_points(spark, sf):
    rings = ring_places(spark, sf).groupBy("ring_id", "district").agg(F.avg("score").alias("risk"))
    return J.map_points(view(spark, sf, "scams"), view(spark, sf, "notes"), rings, district_places(spark, sf))


POINTS_SQL = """mp AS (SELECT 'scam' AS type, lat, lon, risk_score AS weight, district FROM scams WHERE verdict IN ('scam', 'suspicious')
  UNION ALL SELECT 'counterfeit', lat, lon, 0.7e0, district FROM notes WHERE verdict = 'fake'
  UNION ALL SELECT 'ring', lat, lon, risk, district FROM (SELECT ring_id, district, avg(score) AS risk FROM rm JOIN members USING (account_id) GROUP BY 1, 2)
    JOIN (SELECT district, min(lat) AS lat, min(lon) AS lon FROM points GROUP BY 1) USING (district))"""


def j10_map_points(spark, sf):
    return all_points(spark, sf).groupBy("type", "district").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 4).alias("weight"), F.round(F.avg("lat"), 6).alias("lat"), F.round(F.avg("lon"), 6).alias("lon"))


def j11_input_hash(spark, sf):
    return J.input_hash(view(spark, sf, "scams").select("event_id", "verdict", "district", "t"))


def h01_hubs(spark, sf):
    made = E.hubs(all_points(spark, sf))
    return made.select("hub_id", "n_points", F.round("lat", 4).alias("lat"), F.round("lon", 4).alias("lon"), F.round("intensity", 3).alias("intensity"), "domains", "cross_domain", "tier", "district")


HUBS_SQL = f"""pl AS (SELECT DISTINCT lat, lon, printf('%.6f', lat) || '|' || printf('%.6f', lon) AS place FROM mp),
nb AS (SELECT a.place AS x, b.place AS y FROM pl a JOIN pl b ON {hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 25),
touch(x, y) AS (SELECT x, y FROM nb UNION SELECT touch.x, nb.y FROM touch JOIN nb ON touch.y = nb.x),
lb AS (SELECT x AS place, min(y) AS hub_id FROM touch GROUP BY x),
jp AS (SELECT mp.*, hub_id FROM mp JOIN pl USING (lat, lon) JOIN lb USING (place)),
md AS (SELECT hub_id, district, row_number() OVER (PARTITION BY hub_id ORDER BY count(*) DESC, district) AS r FROM jp WHERE district IS NOT NULL GROUP BY 1, 2),
hb AS (SELECT hub_id, count(*) AS n_points, avg(lat) AS lat, avg(lon) AS lon, sum(coalesce(weight, 0.5)) AS intensity, string_agg(DISTINCT type, ',' ORDER BY type) AS domains, count(DISTINCT type) AS nd FROM jp GROUP BY 1 HAVING count(*) >= 2)"""


def h04_hub_summary(spark, sf):
    return E.hubs(all_points(spark, sf)).agg(F.count("*").alias("hubs"), F.sum(F.col("cross_domain").cast("long")).alias("cross_domain"), F.sum("n_points").alias("points"))


def h05_near_places(spark, sf):
    p = view(spark, sf, "points").select("district", "lat", "lon").distinct()
    return grid_join(p, p, 25).where("l.lat < r.lat").groupBy("l.district").agg(F.count("*").alias("pairs"), F.round(F.max("km"), 3).alias("km"))


def e01_plate_links(spark, sf):
    return E.plate_links(view(spark, sf, "notes"), FEATURES)


BITS_SQL = "list_filter([" + ", ".join(f"CASE WHEN k & {1 << i} > 0 THEN '{n}' END" for i, n in enumerate(FEATURES)) + "], lambda x: x IS NOT NULL)"
CLASSES_SQL = f"""st AS (SELECT event_id, denomination, list_sort({BITS_SQL}) AS f, district, lat, lon, t FROM notes WHERE verdict = 'fake'),
cl AS (SELECT denomination, f, count(*) AS notes, min(event_id) AS id FROM st GROUP BY 1, 2),
pr AS (SELECT a.denomination, a.id AS a, b.id AS b, len(list_intersect(a.f, b.f)) AS shared, len(list_distinct(list_concat(a.f, b.f))) AS all_ FROM cl a JOIN cl b ON a.denomination = b.denomination AND a.id < b.id)"""


def e02_plate_families(spark, sf):
    return E.plate_families(view(spark, sf, "notes"), FEATURES).withColumn("span_km", F.round("span_km", 3))


def e02_family_notes(spark, sf):
    made = E.plate_members(view(spark, sf, "notes"), FEATURES)
    return made.select("family", "event_id", "denomination", F.array_join("f", ",").alias("defects"), "district", "t")


FAMILIES_SQL = f"""ed AS (SELECT a AS x, b AS y FROM pr WHERE shared > 0), sy AS (SELECT x, y FROM ed UNION SELECT y, x FROM ed UNION SELECT id, id FROM cl),
reach(x, y) AS (SELECT x, y FROM sy UNION SELECT reach.x, sy.y FROM reach JOIN sy ON reach.y = sy.x), lb AS (SELECT x AS id, min(y) AS family FROM reach GROUP BY 1),
mb AS (SELECT st.*, family FROM st JOIN cl USING (denomination, f) JOIN lb USING (id)),
sz AS (SELECT family, count(*) AS notes, min(denomination) AS denomination, count(DISTINCT district) AS districts, string_agg(DISTINCT district, ',' ORDER BY district) AS places, min(t) AS first_seen, max(t) AS last_seen FROM mb GROUP BY 1 HAVING count(*) >= 2),
cm AS (SELECT family, string_agg(x, ',' ORDER BY x) AS common FROM (SELECT family, x, count(*) AS n FROM (SELECT family, unnest(f) AS x FROM mb) GROUP BY 1, 2) JOIN sz USING (family) WHERE n = notes GROUP BY 1),
pp AS (SELECT DISTINCT family, lat, lon FROM mb), sp AS (SELECT a.family, max({hav('a.lat', 'a.lon', 'b.lat', 'b.lon')}) AS span_km FROM pp a JOIN pp b ON a.family = b.family GROUP BY 1),
te AS (SELECT a, CASE WHEN shared / all_::DOUBLE >= 0.5 THEN 1 ELSE 2 END AS r FROM pr WHERE shared > 0 UNION ALL SELECT id, 0 FROM cl WHERE notes > 1),
tf AS (SELECT family, ['high', 'probable', 'possible'][min(r) + 1] AS tier, count(*) AS links FROM te JOIN lb ON lb.id = te.a GROUP BY 1)
SELECT sz.*, tier, links, coalesce(common, '') AS common, round(span_km, 3) AS span_km FROM sz JOIN tf USING (family) LEFT JOIN cm USING (family) LEFT JOIN sp USING (family)"""


def e03_family_summary(spark, sf):
    return E.plate_families(view(spark, sf, "notes"), FEATURES).agg(
        F.count("*").alias("families"), F.sum("notes").alias("linked_notes"), F.sum((F.col("districts") > 1).cast("long")).alias("multi_district")
    )


def scripts(spark, sf):
    return view(spark, sf, "messages").select(F.col("doc_id").alias("event_id"), "text")


def e04_script_links(spark, sf):
    return E.script_links(scripts(spark, sf)).select("a", "b", F.round("jaccard", 6).alias("jaccard"), "tier")


SCRIPTS_SQL = """sw AS (SELECT doc_id AS event_id, regexp_extract_all(lower(text), '([a-z]{3,})', 1) AS v FROM messages),
sc AS (SELECT event_id, list_sort(list_distinct(v)) AS w, list_sort(list_distinct(list_transform(generate_series(1, len(v) - 1), lambda i: v[i] || ' ' || v[i + 1]))) AS g FROM sw),
cs AS (SELECT w, g, min(event_id) AS id FROM sc WHERE len(w) > 0 GROUP BY 1, 2), ex AS (SELECT id, len(w) AS n, unnest(w) AS x FROM cs),
jr AS (SELECT a.id AS a, b.id AS b, count(*) / (max(a.n) + max(b.n) - count(*))::DOUBLE AS jaccard FROM ex a JOIN ex b ON a.x = b.x AND a.id < b.id GROUP BY 1, 2 HAVING count(*) / (max(a.n) + max(b.n) - count(*))::DOUBLE >= 0.3),
jj AS (SELECT a, b, jaccard FROM jr JOIN cs p ON p.id = a JOIN cs q ON q.id = b WHERE jaccard >= 0.5 OR len(list_intersect(p.g, q.g)) >= 3)"""


def told(spark, sf):
    return view(spark, sf, "reports").where("verdict <> 'legit'")


def e05_campaigns(spark, sf):
    return E.campaigns(told(spark, sf))[0]


def e05_campaign_events(spark, sf):
    return E.campaigns(told(spark, sf))[1]


CAMPAIGNS_SQL = """ev AS (SELECT *, regexp_extract_all(lower(text), '([a-z]{3,})', 1) AS v FROM reports WHERE verdict <> 'legit'),
sc AS (SELECT event_id, phone, list_sort(list_distinct(v)) AS w, list_sort(list_distinct(list_transform(generate_series(1, len(v) - 1), lambda i: v[i] || ' ' || v[i + 1]))) AS g FROM ev),
cs AS (SELECT w, g, min(event_id) AS id, count(*) AS copies FROM sc WHERE len(w) > 0 GROUP BY 1, 2), ex AS (SELECT id, len(w) AS n, unnest(w) AS x FROM cs),
jr AS (SELECT a.id AS a, b.id AS b, count(*) / (max(a.n) + max(b.n) - count(*))::DOUBLE AS jaccard FROM ex a JOIN ex b ON a.x = b.x AND a.id < b.id GROUP BY 1, 2 HAVING count(*) / (max(a.n) + max(b.n) - count(*))::DOUBLE >= 0.3),
jj AS (SELECT a, b, jaccard FROM jr JOIN cs p ON p.id = a JOIN cs q ON q.id = b WHERE jaccard >= 0.5 OR len(list_intersect(p.g, q.g)) >= 3),
pl AS (SELECT sc.event_id, sc.phone, coalesce(cs.id, sc.event_id) AS id FROM sc LEFT JOIN cs ON sc.w = cs.w AND sc.g = cs.g WHERE len(sc.w) > 0 OR phone IS NOT NULL),
ph AS (SELECT phone, min(id) AS least FROM pl WHERE phone IS NOT NULL GROUP BY 1 HAVING count(*) > 1), di AS (SELECT DISTINCT id, least FROM pl JOIN ph USING (phone)),
sy AS (SELECT a AS x, b AS y FROM jj UNION SELECT b, a FROM jj UNION SELECT id, least FROM di UNION SELECT least, id FROM di UNION SELECT id, id FROM cs WHERE copies > 1),
reach(x, y) AS (SELECT x, x FROM sy UNION SELECT reach.x, sy.y FROM reach JOIN sy ON reach.y = sy.x), lb AS (SELECT x AS id, min(y) AS campaign FROM reach GROUP BY 1),
mb AS (SELECT campaign, ev.event_id, ev.district, ev.t, ev.phone, ev.scam_type, left(ev.text, 180) AS text FROM pl JOIN lb USING (id) JOIN ev USING (event_id)),
tw AS (SELECT a AS id, CASE WHEN jaccard >= 0.7 THEN 0 WHEN jaccard >= 0.5 THEN 1 ELSE 2 END AS r, 1 AS w FROM jj UNION ALL SELECT id, 0, 0 FROM cs WHERE copies > 1 UNION ALL SELECT id, 0, 0 FROM di),
tr AS (SELECT campaign, ['high', 'probable', 'possible'][min(r) + 1] AS tier, CAST(sum(w) AS BIGINT) AS word_links FROM tw JOIN lb USING (id) GROUP BY 1),
sp AS (SELECT campaign, string_agg(district, '>' ORDER BY t, event_id) AS district_spread FROM (SELECT campaign, district, t, event_id, row_number() OVER (PARTITION BY campaign, district ORDER BY t, event_id) AS r FROM mb WHERE district IS NOT NULL) WHERE r = 1 GROUP BY 1),
kd AS (SELECT campaign, scam_type, row_number() OVER (PARTITION BY campaign ORDER BY count(*) DESC, scam_type) AS r FROM mb WHERE scam_type IS NOT NULL GROUP BY 1, 2),
wh AS (SELECT campaign, count(*) AS n_events, min(t) AS first_seen, max(t) AS last_seen, arg_min(text, (t, event_id)) AS sample_text, coalesce(string_agg(DISTINCT phone, ',' ORDER BY phone), '') AS phones FROM mb GROUP BY 1)"""


QUERIES = {
    f.__name__: f
    for f in (
        j02_money_trails, j03_scam_rings, j04_scam_notes, j05_note_rings, j06_distances, j07_j09_threat, j10_map_points, j11_input_hash,
        h01_hubs, h04_hub_summary, h05_near_places, e01_plate_links, e02_plate_families, e02_family_notes, e03_family_summary, e04_script_links, e05_campaigns, e05_campaign_events,
    )
}
RING_D = "(SELECT DISTINCT ring_id, district FROM rm JOIN members USING (account_id))"
THREAT_SQL = f"""ts AS (SELECT district, count(*) AS scams FROM scams WHERE verdict <> 'legit' GROUP BY 1), tn AS (SELECT district, count(*) AS notes FROM notes WHERE verdict = 'fake' GROUP BY 1),
rr AS (SELECT district, count(DISTINCT ring_id) AS rings FROM {RING_D} GROUP BY 1), tm AS (SELECT district, count(*) AS trails FROM tr JOIN scams USING (event_id) WHERE r = 1 AND verdict <> 'legit' GROUP BY 1),
te AS (SELECT district, coalesce(scams, 0) AS scams, coalesce(notes, 0) AS notes, coalesce(rings, 0) AS rings, coalesce(trails, 0) AS trails FROM ts FULL JOIN tn USING (district) FULL JOIN rr USING (district) FULL JOIN tm USING (district)),
td AS (SELECT *, (scams > 0)::INT + (notes > 0)::INT + (rings > 0)::INT AS domains FROM te WHERE district IS NOT NULL),
th AS (SELECT district, scams, notes, rings, trails, concat_ws(',', CASE WHEN trails > 0 THEN 'money_trail' END, CASE WHEN rings > 0 AND scams > 0 THEN 'shared_district' END, CASE WHEN notes > 0 AND (scams > 0 OR rings > 0) THEN 'shared_location' END) AS basis,
  domains, CASE WHEN domains >= 3 THEN 'critical' WHEN domains >= 2 OR trails > 0 THEN 'high' WHEN domains >= 1 THEN 'medium' ELSE 'low' END AS threat,
  trails > 0 OR (scams > 0 AND rings > 0) AS take_to_move, notes > 0 AND (scams > 0 OR rings > 0) AS move_to_cash FROM td)"""
ORACLES = {
    "j02_money_trails": ringed(f"WITH {TRAILS_SQL} SELECT event_id, tx_id, source, target, CAST(paid AS DOUBLE) AS paid, CAST(edge_amount AS DOUBLE) AS edge_amount, lag_s FROM tr WHERE r = 1", "scams"),
    "j03_scam_rings": ringed(f"SELECT district, event_id, ring_id FROM scams JOIN {RING_D} USING (district) WHERE verdict <> 'legit'", "scams"),
    "j04_scam_notes": oracle(f"""SELECT s.event_id AS scam_id, n.event_id AS note_id, s.district = n.district AS same_district, abs(s.t - n.t) <= 345600 AS within_time
        FROM scams s JOIN notes n ON s.verdict = 'scam' AND n.verdict = 'fake' AND (s.district = n.district OR {hav('s.lat', 's.lon', 'n.lat', 'n.lon')} <= 30)""", "scams", "notes"),
    "j05_note_rings": ringed(f"SELECT district, event_id, ring_id FROM notes JOIN {RING_D} USING (district) WHERE verdict = 'fake'", "notes"),
    "j06_distances": oracle(f"SELECT district, round(lat, 4) AS lat, round(lon, 4) AS lon, round({hav('lat', 'lon', '28.61e0', '77.21e0')}, 3) AS km FROM (SELECT DISTINCT district, lat, lon FROM points)", "points"),
    "j07_j09_threat": ringed(f"WITH {TRAILS_SQL}, {THREAT_SQL} SELECT * FROM th", "scams", "notes"),
    "j10_map_points": ringed(f"WITH {POINTS_SQL} SELECT type, district, count(*) AS n, round(sum(weight), 4) AS weight, round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon FROM mp GROUP BY 1, 2", "scams", "notes"),
    "h01_hubs": ringed(f"""WITH {POINTS_SQL}, {HUBS_SQL} SELECT hb.hub_id, n_points, round(lat, 4) AS lat, round(lon, 4) AS lon, round(intensity, 3) AS intensity, domains, nd >= 2 AS cross_domain,
        CASE WHEN nd >= 3 THEN 'coordinated' WHEN nd = 2 THEN 'multi_signal' END AS tier, district FROM hb LEFT JOIN md ON md.hub_id = hb.hub_id AND r = 1""", "scams", "notes"),
    "h04_hub_summary": ringed(f"WITH {POINTS_SQL}, {HUBS_SQL} SELECT count(*) AS hubs, CAST(sum((nd >= 2)::INT) AS BIGINT) AS cross_domain, CAST(sum(n_points) AS BIGINT) AS points FROM hb", "scams", "notes"),
    "h05_near_places": oracle(f"""WITH p AS (SELECT DISTINCT district, lat, lon FROM points) SELECT a.district, count(*) AS pairs, round(max({hav('a.lat', 'a.lon', 'b.lat', 'b.lon')}), 3) AS km
        FROM p a JOIN p b ON a.lat < b.lat AND {hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 25 GROUP BY 1""", "points"),
    "e01_plate_links": oracle(f"""WITH {CLASSES_SQL} SELECT denomination, a, b, shared, CASE WHEN shared / all_::DOUBLE >= 0.5 THEN 'probable' ELSE 'possible' END AS tier FROM pr WHERE shared > 0
        UNION ALL SELECT denomination, id, id, len(f), 'high' FROM cl WHERE notes > 1""", "notes"),
    "e02_plate_families": oracle(f"WITH {CLASSES_SQL}, {FAMILIES_SQL}", "notes", recursive=True),
    "e03_family_summary": oracle(f"WITH {CLASSES_SQL}, fam AS (WITH {FAMILIES_SQL}) SELECT count(*) AS families, CAST(sum(notes) AS BIGINT) AS linked_notes, CAST(sum((districts > 1)::INT) AS BIGINT) AS multi_district FROM fam".replace("fam AS (WITH ed", "fam AS (WITH RECURSIVE ed"), "notes", recursive=True),
    "e04_script_links": oracle(f"WITH {SCRIPTS_SQL} SELECT a, b, round(jaccard, 6) AS jaccard, CASE WHEN jaccard >= 0.7 THEN 'high' WHEN jaccard >= 0.5 THEN 'probable' ELSE 'possible' END AS tier FROM jj", "messages"),
    "e02_family_notes": oracle(f"WITH {CLASSES_SQL}, fam AS (WITH {FAMILIES_SQL.replace('SELECT sz.*', 'SELECT mb.event_id, sz.*').replace('FROM sz JOIN tf', 'FROM sz JOIN mb USING (family) JOIN tf')}) SELECT fam.family, st.event_id, st.denomination, array_to_string(f, ',') AS defects, st.district, st.t FROM fam JOIN st USING (event_id)".replace("fam AS (WITH ed", "fam AS (WITH RECURSIVE ed"), "notes", recursive=True),
    "e05_campaigns": oracle(f"WITH {CAMPAIGNS_SQL} SELECT wh.*, tier, word_links, district_spread, coalesce(scam_type, 'other') AS scam_type FROM wh JOIN tr USING (campaign) LEFT JOIN sp USING (campaign) LEFT JOIN kd ON kd.campaign = wh.campaign AND kd.r = 1", "reports", recursive=True),
    "e05_campaign_events": oracle(f"WITH {CAMPAIGNS_SQL} SELECT campaign, event_id, district, t, phone FROM mb", "reports", recursive=True),
}
