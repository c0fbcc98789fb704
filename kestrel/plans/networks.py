"""Queries over corridors, communities' spectra and banks, with their SQL."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from kestrel.functions.geo import grid_join
from kestrel.operators import banks as B
from kestrel.operators import provenance as V
from kestrel.operators import routes as R
from kestrel.operators import spectral as P
from kestrel.operators import trail as T
from kestrel.plans.correlation import hav
from kestrel.session import materialise
from kestrel.sources.bindings import oracle, view


def nodes(spark, sf):
    from pyspark.sql import Window as W

    n = spark.read.parquet(f"{sf}/nation.parquet")
    k = F.col("n_nationkey")
    lat, lon = F.lit(8.0) + F.pmod(k * 37, F.lit(25)) * F.lit(1.1), F.lit(70.0) + F.pmod(k * 17, F.lit(25)) * F.lit(0.9)
    placed = n.select(F.col("n_regionkey").alias("corridor"), F.col("n_name").alias("name"), lat.alias("lat"), lon.alias("lon"), (k % 2 == 0).alias("hub"))
    return placed.withColumn("idx", F.row_number().over(W.partitionBy("corridor").orderBy("lat", "name")))


NODES_SQL = """nd AS (SELECT *, row_number() OVER (PARTITION BY corridor ORDER BY lat, name) AS idx FROM (SELECT n_regionkey AS corridor, n_name AS name, CAST(8 AS DOUBLE) + (n_nationkey * 37 % 25) * CAST(1.1 AS DOUBLE) AS lat,
  CAST(70 AS DOUBLE) + (n_nationkey * 17 % 25) * CAST(0.9 AS DOUBLE) AS lon, n_nationkey % 2 = 0 AS hub FROM nation)),
cm AS (SELECT *, sum(step) OVER (PARTITION BY corridor ORDER BY idx) AS cum FROM (SELECT *, coalesce(%s, 0) AS step FROM (SELECT *, lag(lat) OVER (PARTITION BY corridor ORDER BY idx) AS pl, lag(lon) OVER (PARTITION BY corridor ORDER BY idx) AS pn FROM nd)))""".replace("%s", hav("pl", "pn", "lat", "lon"))
SNAP_SQL = f"""sz AS (SELECT event_id, lat, lon, t FROM notes WHERE verdict = 'fake'),
fr AS (SELECT event_id, lat, lon FROM points WHERE event_type = 'click'),
sd AS (SELECT event_id, corridor, idx, s.lat, s.lon, s.t, {hav('s.lat', 's.lon', 'nd.lat', 'nd.lon')} AS km FROM sz s, nd),
sn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id, corridor ORDER BY km, idx) AS r FROM sd WHERE km <= 60) WHERE r = 1)"""


def seizures(spark, sf):
    return view(spark, sf, "notes").where("verdict = 'fake'").select("event_id", "lat", "lon", "t")


def reports(spark, sf):
    return view(spark, sf, "points").where("event_type = 'click'").select("event_id", "lat", "lon")


def w01_snapped(spark, sf):
    return T.snap(seizures(spark, sf), nodes(spark, sf)).select("event_id", "corridor", "idx", F.round("km", 4).alias("km"))


def w03_cumulative(spark, sf):
    return T.cumulative(nodes(spark, sf)).select("corridor", "idx", "name", F.round("cum", 3).alias("cum"))


def w02_w06_trails(spark, sf):
    t = T.trails(seizures(spark, sf), nodes(spark, sf), reports(spark, sf))
    return t.select("corridor", "n", F.round("radius_km", 3).alias("radius_km"), "origin", F.round("walked_km", 3).alias("walked_km"), "fir", "fir_origin", F.round("confidence", 4).alias("confidence"), "band")


def w07_flow(spark, sf):
    f = T.flow(T.snap(seizures(spark, sf), nodes(spark, sf)), nodes(spark, sf))
    return f.select("corridor", "n", F.round("slope", 3).alias("slope"), F.round("r2", 5).alias("r2"), "direction")


def w08_best_trail(spark, sf):
    t = T.trails(seizures(spark, sf), nodes(spark, sf), reports(spark, sf))
    return t.orderBy(F.desc("confidence"), "corridor").limit(1).select("corridor", F.round("confidence", 4).alias("confidence"), "band")


def scoped(spark, sf):
    """(snapped, nodes of tracks, trails) of all scopes."""
    seized = view(spark, sf, "notes").where("verdict = 'fake'").select("event_id", "lat", "lon", "t", "district")
    s, own = V.tracks(seized, nodes(spark, sf))
    return s, own, materialise(V.scoped_trails(s, own, nodes(spark, sf), reports(spark, sf)))


def modes(spark, sf):
    return stops(spark, sf).select(F.col("corridor").alias("base"), "mode").distinct()


def w07_forecast(spark, sf):
    s, own, trails = scoped(spark, sf)
    made = V.forecast(s, own, trails.where("origin IS NOT NULL"))
    return made.select("corridor", F.round("km_per_day", 3).alias("km_per_day"), F.round("r2", 5).alias("r2"), "n", "toward", "next_hub", *[F.round(c, 3).alias(c) for c in ("away_km", "days_min", "days_max")], "origin_behind")


def w08_by_mode(spark, sf):
    best = V.best_trails(scoped(spark, sf)[2], modes(spark, sf))
    return best.select("scope", "asked", "place", "base", "n", "origin", F.round("confidence", 4).alias("confidence"), "band")


def w09_evidence(spark, sf):
    s, own, trails = scoped(spark, sf)
    near = grid_join(reports(spark, sf), nodes(spark, sf), 80).select(F.col("r.corridor").alias("base"), "l.event_id")
    made = V.evidence(trails, V.forecast(s, own, trails.where("origin IS NOT NULL")), near)
    return made.select("corridor", F.posexplode("items").alias("place", "i")).select("corridor", "place", "i.*")


def w10_scoped(spark, sf):
    districts = view(spark, sf, "points").select("district")
    best = materialise(V.best_trails(scoped(spark, sf)[2], modes(spark, sf)))
    return V.with_fallback(best, districts).withColumn("confidence", F.round("confidence", 4))


def w18_provenance(spark, sf):
    cities, best, legs, _ = by_mode(spark, sf)
    top = V.best_trails(scoped(spark, sf)[2], modes(spark, sf)).where("asked = 'any'")
    return V.provenance(top, cities, (best, legs), reports(spark, sf)).withColumn("km", F.round("km", 3))


def w11_network(spark, sf):
    return T.network(nodes(spark, sf), 200).select("src", "dst", F.round("km", 3).alias("km"), "mode")


def w13_cheapest(spark, sf):
    n = nodes(spark, sf)
    start = n.select(F.concat_ws(":", "corridor", "idx").alias("id"))
    return T.cheapest(T.network(n, 200), start).select("start", "node", F.round("cost", 3).alias("cost"), F.round("km", 3).alias("km"), F.array_join("path", ">").alias("path"))


def stops(spark, sf):
    """The corridors' nodes with their modes; every hub also has a stop of the next corridor a few kilometres off."""
    from pyspark.sql import Window as W

    n = nodes(spark, sf).drop("idx")
    mode = F.array(*map(F.lit, CORRIDOR_MODES))[F.col("corridor")]
    second = n.where("hub").select(((F.col("corridor") + 1) % 5).alias("corridor"), F.concat("name", F.lit(" yard")).alias("name"), (F.col("lat") + 0.03).alias("lat"), (F.col("lon") + 0.02).alias("lon"), F.lit(False).alias("hub"))
    both = n.unionByName(second).withColumn("mode", mode)
    return both.withColumn("idx", F.row_number().over(W.partitionBy("corridor").orderBy("lat", "name")))


CORRIDOR_MODES = ["rail", "ship", "air", "rail", "road"]


def w11_cities(spark, sf):
    cities, _ = R.merged_network(stops(spark, sf), transfer_km=200)
    return cities.select("city", "name", F.round("lat", 4).alias("lat"), F.round("lon", 4).alias("lon"), F.array_join("modes", ",").alias("modes"), "hub", "stops")


def w11_merged(spark, sf):
    return R.merged_network(stops(spark, sf), transfer_km=200)[1].withColumn("km", F.round("km", 3))


def by_mode(spark, sf):
    cities, edges = R.merged_network(stops(spark, sf), transfer_km=200)
    best, legs = R.cheapest_by_mode(materialise(edges), cities.select(F.col("city").alias("id")))
    near = grid_join(reports(spark, sf), cities, 80).select(F.col("r.city").alias("at"), "l.event_id").distinct()
    return cities, best, materialise(legs), near


def w13_by_mode(spark, sf):
    _, best, legs, _ = by_mode(spark, sf)
    path = legs.groupBy("prefer", "start", "node").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("back")).alias("p"), "src"))), lambda x: x["src"]), ">").alias("path"))
    return best.join(path, ["prefer", "start", "node"]).select("prefer", "start", "node", F.round("cost", 3).alias("cost"), F.concat("path", F.lit(">"), "node").alias("path"))


def chosen(spark, sf):
    cities, _, legs, near = by_mode(spark, sf)
    return cities, R.alternatives(R.told(legs, near))


def w15_alternatives(spark, sf):
    return chosen(spark, sf)[1].select("start", "node", "place", "signature", F.round("km", 3).alias("km"), "legs", "fir", "plausibility")


def w16_entry_routes(spark, sf):
    cities, routes = chosen(spark, sf)
    tagged = view(spark, sf, "points").where("event_type = 'view' AND k = 13").select(F.col("district").alias("name")).distinct()
    presses = cities.join(tagged, "name", "left_semi").select(F.col("city").alias("start"))
    return R.entry_routes(routes, presses, cities).select("node", "place", "start", "signature", "plausibility")


def places(spark, sf):
    p = view(spark, sf, "points").select("district", "lat", "lon").distinct()
    return p.groupBy("district").agg(F.min(F.struct("lat", "lon")).alias("p")).select(F.col("district").alias("place"), F.col("p.lat").alias("lat"), F.col("p.lon").alias("lon"))


def named(spark, sf):
    return nodes(spark, sf).select(F.concat_ws(":", "corridor", "idx").alias("id"), "lat", "lon", "name")


def w12_access(spark, sf):
    return T.attach(places(spark, sf), named(spark, sf), 5).select("place", "node", F.round("km", 3).alias("km"))


def all_routes(spark, sf):
    n, net = named(spark, sf), T.network(nodes(spark, sf), 200)
    return T.routes(T.cheapest(net, n.select("id")), net, n, reports(spark, sf))


def w14_routes(spark, sf):
    return all_routes(spark, sf).select("start", "node", F.round("km", 3).alias("km"), "stops", "signature", "legs", "fir")


def w15_plausibility(spark, sf):
    return T.plausibility(all_routes(spark, sf)).select("start", "node", F.round("plausibility", 6).alias("plausibility"))


def presses(spark, sf):
    """Nodes of districts with a report that is tagged as a press."""
    tagged = view(spark, sf, "points").where("event_type = 'view' AND k = 13").select(F.col("district").alias("name")).distinct()
    return named(spark, sf).join(tagged, "name", "left_semi").select(F.col("id").alias("start"))


def w16_entries(spark, sf):
    return T.entries(all_routes(spark, sf), presses(spark, sf)).select("node", "place", "start", F.round("plausibility", 6).alias("plausibility"))


def w17_route_facts(spark, sf):
    return T.route_facts(T.entries(all_routes(spark, sf), presses(spark, sf))).select("node", "place", F.round("gap", 5).alias("gap"), "inseparable", "text")


def labels(spark, sf):
    return view(spark, sf, "members").select("account_id", F.col("district").alias("community"))


def p01_laplacian(spark, sf):
    lab = labels(spark, sf)
    return P.laplacian(P.community_edges(view(spark, sf, "p2p"), lab), lab).select("community", "i", "j", F.round("value", 8).alias("value"))


EDGES_SQL = """dr AS (SELECT source, target, count(*) AS n FROM p2p WHERE source <> target GROUP BY 1, 2), up AS (SELECT least(source, target) AS a, greatest(source, target) AS b, max(n)::DOUBLE AS w FROM dr GROUP BY 1, 2),
ce AS (SELECT x.district AS community, a, b, w FROM up JOIN members x ON a = x.account_id JOIN members y ON b = y.account_id WHERE x.district = y.district),
dg AS (SELECT x, sum(w) AS d FROM (SELECT a AS x, w FROM ce UNION ALL SELECT b, w FROM ce) GROUP BY 1),
sg AS (SELECT target AS account_id, CAST(sum(amount) AS DOUBLE) AS x FROM p2p GROUP BY 1), nm AS (SELECT district AS community, sum(coalesce(x, 0) * coalesce(x, 0)) AS xx, count(*) AS size FROM members LEFT JOIN sg USING (account_id) GROUP BY 1),
cr AS (SELECT ce.community, sum(coalesce(p.x, 0) * coalesce(q.x, 0) * w / sqrt(e.d * f.d)) AS c, count(*) AS edges FROM ce JOIN dg e ON a = e.x JOIN dg f ON b = f.x LEFT JOIN sg p ON p.account_id = a LEFT JOIN sg q ON q.account_id = b GROUP BY 1),
rq AS (SELECT community, size, coalesce(edges, 0) AS edges, CASE WHEN xx < 1e-12 THEN 0 ELSE (xx - 2 * coalesce(c, 0)) / xx END AS rq FROM nm LEFT JOIN cr USING (community))"""


def measured(spark, sf):
    tx, lab = view(spark, sf, "p2p"), labels(spark, sf)
    signal = tx.groupBy(F.col("target").alias("account_id")).agg(F.sum("amount").cast("double").alias("x"))
    return P.rayleigh(P.community_edges(tx, lab), lab, signal)


def p02_rayleigh(spark, sf):
    return measured(spark, sf).select("community", "size", "edges", F.round("rq", 8).alias("rq"))


def p03_report(spark, sf):
    return P.report(measured(spark, sf)).withColumn("rq", F.round("rq", 8))


def p04_spectrum(spark, sf):
    lab = labels(spark, sf)
    s = P.spectrum(P.laplacian(P.community_edges(view(spark, sf, "p2p"), lab), lab))
    return s.select("community", "nodes", *[F.round(c, 6).alias(c) for c in ("top", "gap", "upper_share")])


def p05_matched_shift(spark, sf):
    flagged = view(spark, sf, "members").where("is_illicit AND score > 0.6").select(F.col("district").alias("community"))
    m = P.matched_shift(measured(spark, sf), flagged)
    return m.select("community", "size", "clean", F.round("shift", 8).alias("shift"))


def p06_wavelets(spark, sf):
    lab, tx = labels(spark, sf), view(spark, sf, "p2p")
    signal = lab.select(F.col("account_id").alias("i"), (F.substring("account_id", 2, 9).cast("long") % 7).alias("x"))
    return P.wavelets(P.laplacian(P.community_edges(tx, lab), lab), signal).select("i", *[F.round(f"t{k}", 8).alias(f"t{k}") for k in range(4)])


def p06_bands(spark, sf):
    lab, tx = labels(spark, sf), view(spark, sf, "p2p")
    into = tx.groupBy(F.col("target").alias("account_id")).agg((F.sum("amount").cast("double") / 1000).alias("paid"), F.count("*").cast("double").alias("times"))
    signals = lab.join(into, "account_id", "left").select(F.col("account_id").alias("i"), F.array("paid", "times").alias("x"))
    made = P.band_filters(P.laplacian(P.community_edges(tx, lab), lab), signals)
    return made.select("i", *[(F.round(F.col("bands")[b][s], 6) + 0.0).alias(f"b{b}_{s}") for b in range(4) for s in range(2)])


def owners(spark, sf):
    sizes = labels(spark, sf).groupBy("community").agg(F.count("*").alias("size"))
    return labels(spark, sf).join(B.assign(sizes, 4), "community").select("account_id", "bank_id")


def b01_banks(spark, sf):
    return B.assign(labels(spark, sf).groupBy("community").agg(F.count("*").alias("size")), 4)


def b02_b03_cut(spark, sf):
    return B.cut(view(spark, sf, "p2p"), owners(spark, sf)).groupBy("bank_s", "bank_t", "cross").agg(F.count("*").alias("transfers"), F.countDistinct("source", "target").alias("pairs"))


def b04_local_features(spark, sf):
    f = B.local_features(B.cut(view(spark, sf, "p2p"), owners(spark, sf)))
    return f.select("bank_id", "account_id", *[F.round(c, 6).alias(c) for c in ("total_in", "n_in", "senders", "total_out", "n_out")])


def b05_embeddings(spark, sf):
    cut = B.cut(view(spark, sf, "p2p"), owners(spark, sf))
    made = B.neighbour_means(cut.where("NOT cross"), B.local_features(cut), ["total_in", "total_out"])
    return made.select("account_id", *[F.round(c, 6).alias(c) for c in made.columns if c != "account_id"])


def b07_pair_scores(spark, sf):
    return B.pair_scores(view(spark, sf, "boundary")).select("out_id", "in_id", F.round("score", 6).alias("score"))


def b08_matches(spark, sf):
    return B.one_to_one(B.pair_scores(view(spark, sf, "boundary")), 0.2).select("out_id", "in_id", F.round("score", 6).alias("score"))


def b09_match_quality(spark, sf):
    m = B.one_to_one(B.pair_scores(view(spark, sf, "boundary")), 0.3)
    return m.agg(F.count("*").alias("matched"), F.round(F.avg((F.abs(F.col("out_id") - F.col("in_id")) % 500 == 0).cast("double")), 6).alias("precision"))


def b11_b12_privacy(spark, sf):
    """Matches and their loss of quality against those without noise, for each epsilon of the sweep."""
    boundary = view(spark, sf, "boundary")
    sweep = (0.1, 0.5, 1.0, 2.0, 5.0, 10.0)
    made = boundary.withColumns({f"e{k}": B.noise("vec_id", eps) for k, eps in enumerate(sweep)})
    met = B.pair_scores(made, embeddings=("embedding", *(f"e{k}" for k in range(len(sweep)))))
    each = F.explode(F.arrays_zip(F.array(*[F.lit(eps) for eps in (0.0, *sweep)]).alias("epsilon"), F.col("score")))
    pairs = met.select("out_id", "in_id", each.alias("x")).select("out_id", "in_id", F.col("x.score").alias("score"), F.col("x.epsilon").alias("epsilon"))
    taken = B.one_to_one(pairs, 0.2, ("epsilon",))
    plain = taken.where("epsilon = 0").select("out_id", "in_id", F.lit(1).alias("same"))
    return taken.where("epsilon > 0").join(plain, ["out_id", "in_id"], "left").groupBy("epsilon").agg(F.count("*").alias("matched"), F.round(F.avg(F.coalesce("same", F.lit(0)).cast("double")), 6).alias("kept"))


QUERIES = {
    f.__name__: f
    for f in (
        w01_snapped, w03_cumulative, w02_w06_trails, w07_flow, w08_best_trail, w07_forecast, w08_by_mode, w09_evidence, w10_scoped, w18_provenance, w11_network, w12_access, w11_cities, w11_merged, w13_by_mode, w15_alternatives, w16_entry_routes, w13_cheapest, w14_routes, w15_plausibility, w16_entries, w17_route_facts, p01_laplacian, p02_rayleigh, p03_report, p04_spectrum, p05_matched_shift, p06_wavelets, p06_bands,
        b01_banks, b02_b03_cut, b04_local_features, b05_embeddings, b07_pair_scores, b08_matches, b09_match_quality, b11_b12_privacy,
    )
}
TRAIL_SQL = f"""ct AS (SELECT corridor, count(*) AS n, avg(lat) AS c_lat, avg(lon) AS c_lon, min(idx) AS lo, max(idx) AS hi, count(DISTINCT idx) AS nn FROM sn GROUP BY 1),
rd AS (SELECT corridor, max({hav('lat', 'lon', 'c_lat', 'c_lon')}) AS r FROM sn JOIN ct USING (corridor) GROUP BY 1),
en AS (SELECT corridor, min(idx) AS f, max(idx) AS l FROM cm GROUP BY 1),
wk AS (SELECT ct.corridor, s.side, c.*, abs(c.cum - o.cum) AS walked, row_number() OVER (PARTITION BY ct.corridor, s.side ORDER BY c.idx * s.side) AS r FROM ct JOIN en ON en.corridor = ct.corridor, (VALUES (-1), (1)) s(side), cm o, cm c
  WHERE nn >= 2 AND o.corridor = ct.corridor AND c.corridor = ct.corridor AND o.idx = CASE s.side WHEN -1 THEN lo ELSE hi END
  AND (((c.idx - o.idx) * s.side > 0 AND (abs(c.cum - o.cum) >= 150 OR c.hub OR c.idx = CASE s.side WHEN -1 THEN f ELSE l END)) OR (o.idx = CASE s.side WHEN -1 THEN f ELSE l END AND c.idx = o.idx))),
og AS (SELECT * FROM (SELECT corridor, name AS origin, lat AS o_lat, lon AS o_lon, walked, row_number() OVER (PARTITION BY corridor ORDER BY walked DESC, side) AS q FROM wk WHERE r = 1) WHERE q = 1),
fh AS (SELECT corridor, count(DISTINCT event_id) AS fir FROM fr JOIN nd ON {hav('fr.lat', 'fr.lon', 'nd.lat', 'nd.lon')} <= 80 GROUP BY 1),
fo AS (SELECT corridor, count(DISTINCT event_id) AS fir_origin FROM fr JOIN og ON {hav('fr.lat', 'fr.lon', 'o_lat', 'o_lon')} <= 80 GROUP BY 1),
tz AS (SELECT corridor, n, CASE WHEN n > 1 THEN r ELSE 0 END AS radius_km, origin, walked AS walked_km, coalesce(fir, 0) AS fir, coalesce(fir_origin, 0) AS fir_origin FROM ct JOIN rd USING (corridor) LEFT JOIN og USING (corridor) LEFT JOIN fh USING (corridor) LEFT JOIN fo USING (corridor)),
tc AS (SELECT *, least(0.35 * least(0.2 + (n - 1) * 0.2, 0.85) + 0.25 * CASE WHEN n < 2 THEN 0 WHEN radius_km > 0 THEN greatest(0, 1 - radius_km / 150) ELSE 1 END + 0.25 * least(fir * 0.5, 1.0)
  + 0.15 * CASE WHEN fir_origin > 0 THEN 1.0 WHEN origin IS NOT NULL THEN 0.3 ELSE 0 END, 0.85) AS cf FROM tz)"""
_SCOPED = re.sub(r"\b(sn|cm|ct|rd|en|wk|og|fh|fo|tz|tc)\b(?!\()", r"\g<1>_2", TRAIL_SQL)
SCOPED_SQL = f"""sn_2 AS (SELECT scope || '|' || corridor AS corridor, corridor AS base, scope, event_id, idx, lat, lon, t FROM (SELECT sn.*, unnest(['', district]) AS scope FROM sn JOIN (SELECT event_id, district FROM notes) USING (event_id))),
tk AS (SELECT DISTINCT corridor, base, scope FROM sn_2), cm_2 AS (SELECT tk.corridor, cm.* EXCLUDE (corridor) FROM tk JOIN cm ON cm.corridor = base), fa AS (SELECT DISTINCT corridor AS base, event_id FROM fr JOIN nd ON {hav('fr.lat', 'fr.lon', 'nd.lat', 'nd.lon')} <= 80),
{re.sub(r"fh_2 AS [^\n]*", "fh_2 AS (SELECT tk.corridor, count(*) AS fir FROM tk JOIN fa USING (base) GROUP BY 1),", _SCOPED)},
md_ AS (SELECT tk.*, tc_2.* EXCLUDE (corridor), ['rail', 'ship', 'air', 'rail', 'road'][base + 1] AS mode FROM tc_2 JOIN tk USING (corridor)),
bt AS (SELECT *, row_number() OVER (PARTITION BY scope, asked = 'any' ORDER BY round(cf, 9) DESC, asked) AS place FROM (SELECT *, row_number() OVER (PARTITION BY scope, asked ORDER BY round(cf, 9) DESC, base) AS r FROM (SELECT *, unnest(['any', mode]) AS asked FROM md_)) WHERE r = 1),
ft AS (SELECT corridor, regr_slope(cum, t / 86400.0e0) AS slope, regr_r2(cum, t / 86400.0e0) AS r2, count(t) AS n, min(idx) AS lo, max(idx) AS hi, min(cum) < max(cum) AND min(t) < max(t) AS ok FROM sn_2 JOIN cm_2 USING (corridor, idx) GROUP BY 1),
fm AS (SELECT ft.*, CASE WHEN slope > 0 THEN 1 ELSE -1 END AS sg, CASE WHEN slope > 0 THEN hi ELSE lo END AS edge, CASE WHEN slope > 0 THEN l ELSE f END AS end_ FROM ft JOIN en_2 USING (corridor) WHERE ok AND n >= 2 AND abs(slope) >= 5),
fn AS (SELECT fm.*, e.cum AS ec, z.name AS toward FROM fm JOIN cm_2 e ON e.corridor = fm.corridor AND e.idx = edge JOIN cm_2 z ON z.corridor = fm.corridor AND z.idx = end_),
nh AS (SELECT fn.corridor, c.name, abs(c.cum - ec) AS away, row_number() OVER (PARTITION BY fn.corridor ORDER BY (c.idx - edge) * sg) AS r FROM fn JOIN cm_2 c ON c.corridor = fn.corridor WHERE (c.idx - edge) * sg > 0 AND (c.hub OR c.idx = end_)),
fc_ AS (SELECT fn.corridor, slope, r2, n, toward, CASE WHEN away > 1 THEN nh.name END AS next_hub, CASE WHEN away > 1 THEN away END AS away, CASE WHEN away > 1 THEN away / abs(slope) END AS due, (o.cum - ec) * sg <= 0 AS behind
  FROM fn LEFT JOIN nh ON nh.corridor = fn.corridor AND nh.r = 1 LEFT JOIN (SELECT og_2.corridor, min(cum) AS cum FROM og_2 JOIN cm_2 ON cm_2.corridor = og_2.corridor AND name = origin GROUP BY 1) o ON o.corridor = fn.corridor)"""
NET_SQL = f"""ni AS (SELECT *, corridor || ':' || idx AS id FROM nd), e1 AS (SELECT a.id AS src, b.id AS dst, {hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS km, 'rail' AS mode FROM ni a JOIN ni b ON a.corridor = b.corridor AND b.idx = a.idx + 1
  UNION ALL SELECT a.id, b.id, {hav('a.lat', 'a.lon', 'b.lat', 'b.lon')}, 'road' FROM ni a JOIN ni b ON a.corridor < b.corridor AND {hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 200),
ne AS (SELECT src, dst, km, mode FROM e1 UNION ALL SELECT dst, src, km, mode FROM e1)"""
CITY_SQL = f"""sp0 AS (SELECT corridor, name, lat, lon, hub FROM nd UNION ALL SELECT (corridor + 1) % 5, name || ' yard', lat + 0.03e0, lon + 0.02e0, false FROM nd WHERE hub),
sp AS (SELECT *, corridor || ':' || row_number() OVER (PARTITION BY corridor ORDER BY lat, name) AS id, row_number() OVER (PARTITION BY corridor ORDER BY lat, name) AS idx, ['rail', 'ship', 'air', 'rail', 'road'][corridor + 1] AS mode FROM sp0),
mn AS (SELECT a.id AS x, b.id AS y FROM sp a JOIN sp b ON {hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 8), mr(x, y) AS (SELECT x, y FROM mn UNION SELECT mr.x, mn.y FROM mr JOIN mn ON mr.y = mn.x),
mc AS (SELECT sp.*, city FROM sp JOIN (SELECT x AS id, min(y) AS city FROM mr GROUP BY 1) USING (id)), cg AS (SELECT city, list_sort(list(DISTINCT mode)) AS modes, bool_or(hub) AS hub, count(*) AS stops FROM mc GROUP BY 1),
ct_ AS (SELECT cg.*, name, lat, lon FROM cg JOIN sp ON sp.id = city), hs AS (SELECT city AS src, lead(city) OVER (PARTITION BY corridor ORDER BY idx) AS dst, mode FROM mc),
g1 AS (SELECT src, dst, {hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS km, mode, 'haul' AS kind FROM hs JOIN ct_ a ON a.city = src JOIN ct_ b ON b.city = dst WHERE src <> dst
  UNION ALL SELECT a.city, b.city, {hav('a.lat', 'a.lon', 'b.lat', 'b.lon')}, 'road', 'transfer' FROM ct_ a JOIN ct_ b ON a.city < b.city AND a.modes <> b.modes AND {hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 200),
mg AS (SELECT src, dst, km, mode, kind FROM g1 UNION SELECT dst, src, km, mode, kind FROM g1)"""
MODES_SQL = """ek AS (SELECT prefer, mg.*, km * rk AS own, km * rk * CASE WHEN prefer <> 'any' AND mode <> prefer AND kind = 'haul' THEN 4 ELSE 1 END AS c, rk FROM (SELECT *, CASE mode WHEN 'rail' THEN 1.0e0 WHEN 'ship' THEN 0.9e0 WHEN 'road' THEN 1.3e0 ELSE 2.6e0 END AS rk FROM mg) mg, (VALUES ('any'), ('rail'), ('ship'), ('air'), ('road')) pf(prefer)),
bf(h, prefer, start, node, cost) AS (SELECT 0, prefer, city, city, 0.0e0 FROM ct_, (VALUES ('any'), ('rail'), ('ship'), ('air'), ('road')) pf(prefer) UNION ALL SELECT h + 1, bf.prefer, start, dst, min(cost + c) FROM bf JOIN ek ON ek.prefer = bf.prefer AND src = node WHERE h < 40 GROUP BY 1, 2, 3, 4),
bs AS (SELECT prefer, start, node, min(cost) AS cost FROM bf GROUP BY 1, 2, 3),
pd AS (SELECT * FROM (SELECT b.prefer, b.start, b.node, ek.src, ek.mode, ek.kind, ek.km, ek.own, ek.rk, row_number() OVER (PARTITION BY b.prefer, b.start, b.node ORDER BY ek.src, ek.mode, ek.kind) AS r FROM bs b JOIN ek ON ek.prefer = b.prefer AND ek.dst = b.node JOIN bs a ON a.prefer = b.prefer AND a.start = b.start AND a.node = ek.src WHERE b.node <> b.start AND a.cost + ek.c <= b.cost + 1e-9) WHERE r = 1),
lg(prefer, start, node, back, src, dst, mode, kind, km, own, rk) AS (SELECT prefer, start, node, 0, src, node, mode, kind, km, own, rk FROM pd UNION ALL SELECT lg.prefer, lg.start, lg.node, back + 1, pd.src, pd.node, pd.mode, pd.kind, pd.km, pd.own, pd.rk FROM lg JOIN pd ON pd.prefer = lg.prefer AND pd.start = lg.start AND pd.node = lg.src)"""
CHOICE_SQL = f"""nc AS (SELECT DISTINCT city AS at_, event_id FROM points p JOIN ct_ ON event_type = 'click' AND {hav('p.lat', 'p.lon', 'ct_.lat', 'ct_.lon')} <= 80),
fc AS (SELECT prefer, start, node, count(DISTINCT event_id) AS fir FROM (SELECT prefer, start, node, src AS at_ FROM lg UNION SELECT prefer, start, node, dst FROM lg) JOIN nc USING (at_) GROUP BY 1, 2, 3),
sr AS (SELECT prefer, start, node, string_agg(mode, '>' ORDER BY back DESC) AS signature FROM (SELECT *, lag(mode) OVER (PARTITION BY prefer, start, node ORDER BY back DESC) AS prev FROM lg WHERE kind = 'haul') WHERE prev IS NULL OR prev <> mode GROUP BY 1, 2, 3),
rs AS (SELECT prefer, start, node, sum(km) AS km, sum(own) AS own, count(*) AS legs, avg(rk) FILTER (WHERE kind = 'haul') AS rk FROM lg GROUP BY 1, 2, 3),
rr_ AS (SELECT rs.*, coalesce(signature, 'road') AS signature, coalesce(fir, 0) AS fir, round(least(0.9e0, 0.45e0 / (1 + km / 600) + 0.35e0 * CASE WHEN rk IS NULL THEN 0.4e0 ELSE greatest(0, least(1, (2.9e0 - rk) / 2)) END + 0.2e0 * least(1.0e0, coalesce(fir, 0) / 4.0e0)), 6) AS plausibility
  FROM rs LEFT JOIN sr USING (prefer, start, node) LEFT JOIN fc USING (prefer, start, node)),
r1_ AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY start, node, signature ORDER BY round(own, 6), prefer) AS r FROM rr_) WHERE r = 1),
al AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY start, node ORDER BY plausibility DESC, signature) AS place FROM r1_) WHERE place <= 4)"""
OWNERS_SQL = """co AS (SELECT district AS community, count(*) AS size FROM members GROUP BY 1), sq AS (SELECT *, row_number() OVER (ORDER BY size DESC, community) - 1 AS n FROM co),
bk AS (SELECT community, size, CAST(CASE WHEN n // 4 % 2 = 0 THEN n % 4 ELSE 3 - n % 4 END AS INT) AS bank_id FROM sq), ow AS (SELECT account_id, bank_id FROM members JOIN bk ON district = community),
cu AS (SELECT p.*, a.bank_id AS bank_s, b.bank_id AS bank_t, a.bank_id <> b.bank_id AS cross_ FROM p2p p JOIN ow a ON source = a.account_id JOIN ow b ON target = b.account_id)"""
COS = "list_dot_product(o.embedding::DOUBLE[], i.embedding::DOUBLE[]) / greatest(sqrt(list_dot_product(o.embedding::DOUBLE[], o.embedding::DOUBLE[]) * list_dot_product(i.embedding::DOUBLE[], i.embedding::DOUBLE[])), 1e-12)"
_T = "SELECT n.i, {c}coalesce(sum(m * x.t{p}), 0){m} AS t{k} FROM w{p} n LEFT JOIN lb ON lb.i = n.i LEFT JOIN (SELECT i AS j, t{p} FROM w{p}) x ON x.j = lb.j GROUP BY n.i"
#: The bands' coefficients from their definition, and the recursion term by term for two signals.
BANDS_SQL = """zs AS (SELECT cos(pi() * (2 * n + 1) / 128) AS z FROM range(64) t(n)), hb AS (SELECT band, z, pow((z + 1) / 2, 1 + 2.0e0 * band) * pow(1 - (z + 1) / 2, 7 - 2.0e0 * band) AS h FROM zs, range(4) t(band)),
hn AS (SELECT band, z, h / max(h) OVER (PARTITION BY band) AS h FROM hb), cf AS (SELECT band, k, sum(h * cos(k * acos(z))) * CASE k WHEN 0 THEN 1 ELSE 2 END / 64 AS c FROM hn, range(9) t(k) GROUP BY band, k),
ob AS (SELECT a, b, -w / sqrt(e.d * f.d) AS m FROM ce JOIN dg e ON a = e.x JOIN dg f ON b = f.x), lb AS (SELECT a AS i, b AS j, m FROM ob UNION ALL SELECT b, a, m FROM ob),
ip AS (SELECT target AS account_id, CAST(sum(amount) AS DOUBLE) / 1000 AS paid, count(*)::DOUBLE AS times FROM p2p GROUP BY 1),
y0 AS (SELECT account_id AS i, coalesce(paid, 0) AS u, coalesce(times, 0) AS v FROM members LEFT JOIN ip USING (account_id)), """ + ", ".join(
    f"z{k} AS (SELECT n.i, coalesce(sum(m * x.u), 0) AS u, coalesce(sum(m * x.v), 0) AS v FROM y{k - 1} n LEFT JOIN lb ON lb.i = n.i LEFT JOIN (SELECT i AS j, u, v FROM y{k - 1}) x ON x.j = lb.j GROUP BY n.i), "
    + (f"y{k} AS (SELECT * FROM z{k})" if k == 1 else f"y{k} AS (SELECT i, 2 * z.u - p.u AS u, 2 * z.v - p.v AS v FROM z{k} z JOIN y{k - 2} p USING (i))")
    for k in range(1, 9)
) + ", ya AS (" + " UNION ALL ".join(f"SELECT {k} AS k, * FROM y{k}" for k in range(9)) + ")"
LOCAL_SQL = """lc AS (SELECT * FROM cu WHERE NOT cross_), li AS (SELECT bank_t AS bank_id, target AS account_id, CAST(sum(amount) AS DOUBLE) AS ti, count(*) AS ni, count(DISTINCT source) AS us FROM lc GROUP BY 1, 2),
lo AS (SELECT bank_s AS bank_id, source AS account_id, CAST(sum(amount) AS DOUBLE) AS ot, count(*) AS no_ FROM lc GROUP BY 1, 2),
lf AS (SELECT bank_id, account_id, coalesce(ti, 0) AS ti, coalesce(ni, 0) AS ni, coalesce(us, 0) AS us, coalesce(ot, 0) AS ot, coalesce(no_, 0) AS no_ FROM li FULL JOIN lo USING (bank_id, account_id)),
ln AS (SELECT bank_id, account_id, ti / greatest(max(ti) OVER b, 1e-9) AS total_in, ni / greatest(max(ni) OVER b, 1e-9) AS n_in, us / greatest(max(us) OVER b, 1e-9) AS senders, ot / greatest(max(ot) OVER b, 1e-9) AS total_out, no_ / greatest(max(no_) OVER b, 1e-9) AS n_out FROM lf WINDOW b AS (PARTITION BY bank_id))"""
MEANS_SQL = """np AS (SELECT source AS a, target AS o FROM lc UNION SELECT target, source FROM lc), m1 AS (SELECT a AS account_id, avg(total_in) AS i1, avg(total_out) AS o1 FROM np JOIN ln ON o = account_id GROUP BY 1),
g1 AS (SELECT account_id, total_in, total_out, coalesce(i1, 0) AS i1, coalesce(o1, 0) AS o1 FROM ln LEFT JOIN m1 USING (account_id)),
m2 AS (SELECT a AS account_id, avg(total_in) AS i2, avg(total_out) AS o2, avg(i1) AS i12, avg(o1) AS o12 FROM np JOIN g1 ON o = account_id GROUP BY 1)"""
WALK_SQL = """wl(start, node, cost, km, path, modes) AS (SELECT id, id, 0.0e0, 0.0e0, [id], []::VARCHAR[] FROM ni
        UNION ALL SELECT start, dst, cost + e.km * CASE mode WHEN 'road' THEN 1.3e0 ELSE 1 END, wl.km + e.km, list_append(path, dst), list_append(modes, mode) FROM wl JOIN ne e ON src = node WHERE NOT list_contains(path, dst)),
rt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY start, node ORDER BY cost, path) AS r FROM wl) WHERE r = 1 AND start <> node)"""
ROUTE_SQL = f"""nr AS (SELECT DISTINCT id AS at_, event_id FROM points JOIN ni ON event_type = 'click' AND {hav('points.lat', 'points.lon', 'ni.lat', 'ni.lon')} <= 80),
rf AS (SELECT start, node, count(DISTINCT event_id) AS fir FROM (SELECT start, node, unnest(path) AS at_ FROM rt) JOIN nr USING (at_) GROUP BY 1, 2),
ro AS (SELECT start, node, km, len(path) AS stops, CASE WHEN list_contains(modes, 'rail') THEN 'rail' ELSE 'road' END AS signature, len(modes) AS legs, coalesce(fir, 0) AS fir,
  least(0.9e0, 0.45e0 / (1 + km / 600) + 0.35e0 * CASE WHEN list_contains(modes, 'rail') THEN 1.0e0 ELSE 0.4e0 END + 0.20e0 * least(1.0e0, coalesce(fir, 0) / 4.0e0)) AS plausibility FROM rt LEFT JOIN rf USING (start, node))"""
ENTRY_SQL = """ps AS (SELECT DISTINCT id FROM ni JOIN points ON district = name WHERE event_type = 'view' AND k = 13),
en AS (SELECT * FROM (SELECT ro.*, row_number() OVER (PARTITION BY node ORDER BY round(plausibility, 6) DESC, start) AS place FROM ro WHERE start IN (SELECT id FROM ps)) WHERE place <= 3)"""
ORACLES = {
    "w07_forecast": oracle(f"WITH {NODES_SQL}, {SNAP_SQL}, {SCOPED_SQL} SELECT corridor, round(slope, 3) AS km_per_day, round(r2, 5) AS r2, n, toward, next_hub, round(away, 3) AS away_km, round(due * 0.7e0, 3) AS days_min, round(due * 1.5e0, 3) AS days_max, behind AS origin_behind FROM fc_", "notes"),
    "w08_by_mode": oracle(f"WITH {NODES_SQL}, {SNAP_SQL}, {SCOPED_SQL} SELECT scope, asked, CAST(place AS INT) AS place, base, n, origin, round(cf, 4) AS confidence, CASE WHEN cf >= 0.6 THEN 'high' WHEN cf >= 0.35 THEN 'medium' ELSE 'low' END AS band FROM bt", "notes"),
    "w09_evidence": oracle(f"""WITH {NODES_SQL}, {SNAP_SQL}, {SCOPED_SQL}, ei AS (SELECT corridor, 0 AS o, 'corridor_snap' AS type, n || ' seizures lie on the corridor' AS detail, 0.35e0 AS weight FROM md_
        UNION ALL SELECT corridor, 1, 'seizure_cluster', n || ' seizures within ' || CAST(round(radius_km, 0) AS BIGINT) || ' km', 0.25e0 FROM md_ WHERE n >= 2 UNION ALL SELECT corridor, 2, 'corridor_terminus', 'none seized towards ' || origin, 0.15e0 FROM md_ WHERE origin IS NOT NULL
        UNION ALL SELECT corridor, 3, 'temporal_flow', 'moves towards ' || toward || ' by ' || CAST(round(abs(slope), 0) AS BIGINT) || ' km a day', 0.15e0 FROM fc_ WHERE r2 >= 0.5
        UNION ALL SELECT corridor, 3 + q, 'fir_mention', 'report ' || event_id, round(0.25e0 / fir, 4) FROM md_ JOIN (SELECT *, row_number() OVER (PARTITION BY base ORDER BY event_id) AS q FROM fa) USING (base) WHERE q <= 3)
        SELECT corridor, CAST(row_number() OVER (PARTITION BY corridor ORDER BY o) - 1 AS INT) AS place, type, detail, weight FROM ei""", "notes"),
    "w10_scoped": oracle(f"""WITH {NODES_SQL}, {SNAP_SQL}, {SCOPED_SQL}, wt AS (SELECT DISTINCT district, asked AS mode FROM points, bt WHERE asked <> 'any'),
        lv AS (SELECT wt.*, v.turn, v.level, CASE WHEN turn < 2 THEN district ELSE '' END AS scope, CASE WHEN turn % 2 = 0 THEN mode ELSE 'any' END AS asked FROM wt, (VALUES (0, 'district'), (1, 'district any mode'), (2, 'all'), (3, 'all any mode')) v(turn, level)),
        f1 AS (SELECT lv.district, lv.mode, level, bt.base, n, origin, cf, row_number() OVER (PARTITION BY lv.district, lv.mode ORDER BY turn) AS r FROM lv JOIN bt USING (scope, asked) WHERE origin IS NOT NULL)
        SELECT district, mode, level, base, n, origin, round(cf, 4) AS confidence, CASE WHEN cf >= 0.6 THEN 'high' WHEN cf >= 0.35 THEN 'medium' WHEN cf IS NOT NULL THEN 'low' END AS band FROM wt LEFT JOIN (SELECT * FROM f1 WHERE r = 1) USING (district, mode)""", "notes"),
    "w18_provenance": oracle(f"""WITH {NODES_SQL}, {SNAP_SQL}, {SCOPED_SQL}, {CITY_SQL}, {MODES_SQL}, bw AS (SELECT bt.scope, bt.origin, o_lat, o_lon, c_lat, c_lon FROM bt JOIN og_2 USING (corridor) JOIN ct_2 USING (corridor) WHERE asked = 'any'),
        fs AS (SELECT scope, arg_min(city, ({hav('o_lat', 'o_lon', 'lat', 'lon')}, city)) AS start FROM bw, ct_ GROUP BY 1), ak AS (SELECT scope, city, {hav('c_lat', 'c_lon', 'lat', 'lon')} AS km FROM bw, ct_),
        ac AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY km, city) AS r FROM ak) WHERE km <= 70 OR r = 1),
        cd AS (SELECT * FROM (SELECT prefer, scope, bs.start, city, km, row_number() OVER (PARTITION BY prefer, scope ORDER BY round(cost + km * 1.3e0, 9), city) AS q FROM fs JOIN ac USING (scope) JOIN bs ON bs.start = fs.start AND bs.node = city) WHERE q = 1),
        l2 AS (SELECT lg.prefer, scope, back + 1 AS back, src, dst, mode, kind, lg.km, own, rk FROM cd JOIN lg ON lg.prefer = cd.prefer AND lg.start = cd.start AND lg.node = city UNION ALL SELECT prefer, scope, 0, city, '*' || scope, 'road', 'access', km, km * 1.3e0, 1.3e0 FROM cd),
        pt AS (SELECT city AS id, lat, lon FROM ct_ UNION ALL SELECT '*' || scope, c_lat, c_lon FROM bw), nc AS (SELECT DISTINCT id AS at_, event_id FROM fr JOIN pt ON {hav('fr.lat', 'fr.lon', 'pt.lat', 'pt.lon')} <= 80),
        fc AS (SELECT prefer, scope, count(DISTINCT event_id) AS fir FROM (SELECT prefer, scope, src AS at_ FROM l2 UNION SELECT prefer, scope, dst FROM l2) JOIN nc USING (at_) GROUP BY 1, 2),
        sr AS (SELECT prefer, scope, string_agg(mode, '>' ORDER BY back DESC) AS signature FROM (SELECT *, lag(mode) OVER (PARTITION BY prefer, scope ORDER BY back DESC) AS prev FROM l2 WHERE kind = 'haul') WHERE prev IS NULL OR prev <> mode GROUP BY 1, 2),
        rs AS (SELECT prefer, scope, sum(km) AS km, sum(own) AS own, count(*) AS legs, avg(rk) FILTER (WHERE kind = 'haul') AS rk FROM l2 GROUP BY 1, 2),
        rr_ AS (SELECT rs.*, coalesce(signature, 'road') AS signature, coalesce(fir, 0) AS fir, round(least(0.9e0, 0.45e0 / (1 + km / 600) + 0.35e0 * CASE WHEN rk IS NULL THEN 0.4e0 ELSE greatest(0, least(1, (2.9e0 - rk) / 2)) END + 0.2e0 * least(1.0e0, coalesce(fir, 0) / 4.0e0)), 6) AS plausibility FROM rs LEFT JOIN sr USING (prefer, scope) LEFT JOIN fc USING (prefer, scope)),
        r1_ AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scope, signature ORDER BY round(own, 6), prefer) AS r FROM rr_) WHERE r = 1), al AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY plausibility DESC, signature) AS place FROM r1_) WHERE place <= 4),
        ot AS (SELECT scope, string_agg(signature, '; ' ORDER BY place) AS others FROM al WHERE place > 1 GROUP BY 1)
        SELECT scope, CAST(place AS INT) AS place, origin, signature, round(km, 3) AS km, legs, fir, plausibility, CASE WHEN place = 1 THEN 'likeliest from ' || origin || ' by ' || signature || ', ' || CAST(round(km, 0) AS BIGINT) || ' km' || CASE WHEN fir > 0 THEN ', ' || fir || ' reports on the way' ELSE '' END || coalesce('; else ' || others, '') END AS line
        FROM al JOIN bw USING (scope) LEFT JOIN ot USING (scope)""", "notes", recursive=True),
    "w11_cities": oracle(f"WITH {NODES_SQL}, {CITY_SQL} SELECT city, name, round(lat, 4) AS lat, round(lon, 4) AS lon, array_to_string(modes, ',') AS modes, hub, stops FROM ct_", "points", recursive=True),
    "w11_merged": oracle(f"WITH {NODES_SQL}, {CITY_SQL} SELECT src, dst, round(km, 3) AS km, mode, kind FROM mg", "points", recursive=True),
    "w13_by_mode": oracle(f"WITH {NODES_SQL}, {CITY_SQL}, {MODES_SQL} SELECT prefer, start, node, round(cost, 3) AS cost, path || '>' || node AS path FROM bs JOIN (SELECT prefer, start, node, string_agg(src, '>' ORDER BY back DESC) AS path FROM lg GROUP BY 1, 2, 3) USING (prefer, start, node)", "points", recursive=True),
    "w15_alternatives": oracle(f"WITH {NODES_SQL}, {CITY_SQL}, {MODES_SQL}, {CHOICE_SQL} SELECT start, node, CAST(place AS INT) AS place, signature, round(km, 3) AS km, legs, fir, plausibility FROM al", "points", recursive=True),
    "w16_entry_routes": oracle(f"""WITH {NODES_SQL}, {CITY_SQL}, {MODES_SQL}, {CHOICE_SQL}, pr_ AS (SELECT DISTINCT city FROM ct_ JOIN points ON district = name WHERE event_type = 'view' AND k = 13)
        SELECT node, CAST(place AS INT) AS place, start, signature, plausibility FROM (SELECT al.* EXCLUDE (place), row_number() OVER (PARTITION BY node ORDER BY plausibility DESC, start, signature) AS place FROM al JOIN ct_ a ON a.city = start JOIN ct_ b ON b.city = node
        WHERE start IN (SELECT city FROM pr_) AND {hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} >= 5) WHERE place <= 4""", "points", recursive=True),
    "w12_access": oracle(f"""WITH {NODES_SQL}, ni AS (SELECT *, corridor || ':' || idx AS id FROM nd), pl AS (SELECT district AS place, min(struct_pack(a := lat, b := lon)) AS p FROM points GROUP BY 1),
        ds AS (SELECT place, id AS node, {hav('p.a', 'p.b', 'lat', 'lon')} AS km FROM pl, ni) SELECT place, node, round(km, 3) AS km FROM (SELECT *, row_number() OVER (PARTITION BY place ORDER BY km, node) AS r, min(km) OVER (PARTITION BY place) AS least_ FROM ds)
        WHERE km <= 5 OR (least_ > 5 AND r = 1)""", "points"),
    "w14_routes": oracle(f"WITH {NODES_SQL}, {NET_SQL}, {WALK_SQL}, {ROUTE_SQL} SELECT start, node, round(km, 3) AS km, CAST(stops AS INT) AS stops, signature, CAST(legs AS INT) AS legs, fir FROM ro", "points", recursive=True),
    "w15_plausibility": oracle(f"WITH {NODES_SQL}, {NET_SQL}, {WALK_SQL}, {ROUTE_SQL} SELECT start, node, round(plausibility, 6) AS plausibility FROM ro", "points", recursive=True),
    "w16_entries": oracle(f"WITH {NODES_SQL}, {NET_SQL}, {WALK_SQL}, {ROUTE_SQL}, {ENTRY_SQL} SELECT node, CAST(place AS INT) AS place, start, round(plausibility, 6) AS plausibility FROM en", "points", recursive=True),
    "w17_route_facts": oracle(f"""WITH {NODES_SQL}, {NET_SQL}, {WALK_SQL}, {ROUTE_SQL}, {ENTRY_SQL}, g AS (SELECT *, round(plausibility - lead(plausibility) OVER (PARTITION BY node ORDER BY place), 6) AS gap FROM en)
        SELECT node, CAST(place AS INT) AS place, round(gap, 5) AS gap, coalesce(gap < 0.05, false) AS inseparable, start || ' to ' || node || ' by ' || signature || ' over ' || stops || ' stops' || CASE WHEN coalesce(gap < 0.05, false) THEN ', as likely as the next' ELSE '' END AS text FROM g""", "points", recursive=True),
    "b04_local_features": oracle(f"WITH {OWNERS_SQL}, {LOCAL_SQL} SELECT bank_id, account_id, round(total_in, 6) AS total_in, round(n_in, 6) AS n_in, round(senders, 6) AS senders, round(total_out, 6) AS total_out, round(n_out, 6) AS n_out FROM ln", "p2p", "members"),
    "b05_embeddings": oracle(f"""WITH {OWNERS_SQL}, {LOCAL_SQL}, {MEANS_SQL} SELECT account_id, round(total_in, 6) AS total_in, round(total_out, 6) AS total_out, round(i1, 6) AS total_in_m1, round(o1, 6) AS total_out_m1,
        round(coalesce(i2, 0), 6) AS total_in_m2, round(coalesce(o2, 0), 6) AS total_out_m2, round(coalesce(i12, 0), 6) AS total_in_m1_m2, round(coalesce(o12, 0), 6) AS total_out_m1_m2 FROM g1 LEFT JOIN m2 USING (account_id)""", "p2p", "members"),
    "p05_matched_shift": oracle(f"""WITH {EDGES_SQL}, tg AS (SELECT *, community IN (SELECT district FROM members WHERE is_illicit AND score > 0.6) AS f FROM rq),
        aw AS (SELECT *, (SELECT struct_pack(s := c.size, q := c.rq, m := c.community) FROM tg c WHERE NOT c.f AND (c.size, c.community) < (a.size, a.community) ORDER BY c.size DESC, c.community DESC LIMIT 1) AS lo,
          (SELECT struct_pack(s := c.size, q := c.rq, m := c.community) FROM tg c WHERE NOT c.f AND (c.size, c.community) > (a.size, a.community) ORDER BY c.size, c.community LIMIT 1) AS hi FROM tg a WHERE f),
        nx AS (SELECT community, size, rq, CASE WHEN lo IS NULL OR hi.s - size < size - lo.s THEN hi ELSE lo END AS near_ FROM aw) SELECT community, size, near_.m AS clean, round(rq - near_.q, 8) AS shift FROM nx""", "p2p", "members"),
    "w01_snapped": oracle(f"WITH {NODES_SQL}, {SNAP_SQL} SELECT event_id, corridor, idx, round(km, 4) AS km FROM sn", "notes"),
    "w03_cumulative": oracle(f"WITH {NODES_SQL} SELECT corridor, idx, name, round(cum, 3) AS cum FROM cm"),
    "w02_w06_trails": oracle(f"WITH {NODES_SQL}, {SNAP_SQL}, {TRAIL_SQL} SELECT corridor, n, round(radius_km, 3) AS radius_km, origin, round(walked_km, 3) AS walked_km, fir, fir_origin, round(cf, 4) AS confidence, CASE WHEN cf >= 0.6 THEN 'high' WHEN cf >= 0.35 THEN 'medium' ELSE 'low' END AS band FROM tc", "notes"),
    "w07_flow": oracle(f"""WITH {NODES_SQL}, {SNAP_SQL}, f AS (SELECT corridor, count(*) AS n, regr_slope(cum, sn.t / 86400.0e0) AS slope, regr_r2(cum, sn.t / 86400.0e0) AS r2 FROM sn JOIN cm USING (corridor, idx) GROUP BY 1)
        SELECT corridor, n, round(slope, 3) AS slope, round(r2, 5) AS r2, CASE WHEN abs(slope) < 5 THEN 'stationary' WHEN slope > 0 THEN 'forward' ELSE 'backward' END AS direction FROM f""", "notes"),
    "w08_best_trail": oracle(f"WITH {NODES_SQL}, {SNAP_SQL}, {TRAIL_SQL} SELECT corridor, round(cf, 4) AS confidence, CASE WHEN cf >= 0.6 THEN 'high' WHEN cf >= 0.35 THEN 'medium' ELSE 'low' END AS band FROM tc ORDER BY cf DESC, corridor LIMIT 1", "notes"),
    "w11_network": oracle(f"WITH {NODES_SQL}, {NET_SQL} SELECT src, dst, round(km, 3) AS km, mode FROM ne"),
    "w13_cheapest": f"""WITH RECURSIVE {NODES_SQL}, {NET_SQL}, wl(start, node, cost, km, path, h) AS (SELECT id, id, 0.0e0, 0.0e0, [id], 0 FROM ni
        UNION ALL SELECT start, dst, cost + e.km * CASE mode WHEN 'road' THEN 1.3e0 ELSE 1 END, wl.km + e.km, list_append(path, dst), h + 1 FROM wl JOIN ne e ON src = node WHERE NOT list_contains(path, dst))
        SELECT start, node, round(cost, 3) AS cost, round(km, 3) AS km, array_to_string(path, '>') AS path FROM (SELECT *, row_number() OVER (PARTITION BY start, node ORDER BY cost, path) AS r FROM wl) WHERE r = 1""",
    "p01_laplacian": oracle(f"""WITH {EDGES_SQL}, of AS (SELECT community, a, b, -w / sqrt(e.d * f.d) AS value FROM ce JOIN dg e ON a = e.x JOIN dg f ON b = f.x)
        SELECT community, a AS i, b AS j, round(value, 8) AS value FROM of UNION ALL SELECT community, b, a, round(value, 8) FROM of UNION ALL SELECT district, account_id, account_id, 1.0 FROM members""", "p2p", "members"),
    "p02_rayleigh": oracle(f"WITH {EDGES_SQL} SELECT community, size, edges, round(rq, 8) AS rq FROM rq", "p2p", "members"),
    "p03_report": oracle(f"""WITH {EDGES_SQL}, bg AS (SELECT * FROM rq WHERE size >= 5 AND edges >= 2) SELECT community, size, edges, round(rq, 8) AS rq, CAST(rank() OVER (ORDER BY rq DESC) AS INT) AS rank,
        rq - (SELECT quantile_cont(rq, 0.5) FROM bg) > 0.15 AS anomaly FROM bg""", "p2p", "members"),
    "p06_wavelets": oracle(f"""WITH {EDGES_SQL}, of AS (SELECT a, b, -w / sqrt(e.d * f.d) AS m FROM ce JOIN dg e ON a = e.x JOIN dg f ON b = f.x), lb AS (SELECT a AS i, b AS j, m FROM of UNION ALL SELECT b, a, m FROM of),
        w0 AS (SELECT account_id AS i, (CAST(substr(account_id, 2) AS BIGINT) % 7)::DOUBLE AS t0 FROM members), w1 AS ({_T.format(c='', p=0, m='', k=1)}), w2s AS ({_T.format(c='2 * ', p=1, m='', k=2)}), w2 AS (SELECT i, t2 - t0 AS t2 FROM w2s JOIN w0 USING (i)),
        w3s AS ({_T.format(c='2 * ', p=2, m='', k=3)}), w3 AS (SELECT i, t3 - t1 AS t3 FROM w3s JOIN w1 USING (i))
        SELECT i, round(t0, 8) AS t0, round(t1, 8) AS t1, round(t2, 8) AS t2, round(t3, 8) AS t3 FROM w0 JOIN w1 USING (i) JOIN w2 USING (i) JOIN w3 USING (i)""", "p2p", "members"),
    "p06_bands": oracle(f"WITH {EDGES_SQL}, {BANDS_SQL} SELECT i, " + ", ".join(f"round(sum(c * {x}) FILTER (WHERE band = {b}), 6) + 0.0e0 AS b{b}_{n}" for b in range(4) for n, x in enumerate("uv")) + " FROM ya JOIN cf USING (k) GROUP BY i", "p2p", "members"),
    "b01_banks": oracle(f"WITH {OWNERS_SQL} SELECT community, size, bank_id FROM bk", "p2p", "members"),
    "b02_b03_cut": oracle(f"WITH {OWNERS_SQL} SELECT bank_s, bank_t, cross_ AS \"cross\", count(*) AS transfers, count(DISTINCT source || '>' || target) AS pairs FROM cu GROUP BY 1, 2, 3", "p2p", "members"),
    "b07_pair_scores": oracle(f"""SELECT o.vec_id AS out_id, i.vec_id AS in_id, round(0.2 * {COS} + 0.4 * greatest(0, 1 - 0.3 * abs(o.amount_cents - i.amount_cents)) + 0.4 * greatest(0, 1 - 0.1 * abs(o.time_sec - i.time_sec)), 6) AS score
        FROM boundary o JOIN boundary i ON o.direction = 'out' AND i.direction = 'in' AND o.bank_id <> i.bank_id AND abs(o.amount_cents - i.amount_cents) <= 3 AND abs(o.time_sec - i.time_sec) <= 9""", "boundary"),
}
