"""Queries over evaluation, serials, actions, predicates and summaries, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from kestrel.operators import correlate as J
from kestrel.operators import evaluate as M
from kestrel.operators import records as A
from kestrel.operators import rings as K
from kestrel.operators.features import is_round
from kestrel.plans.correlation import THREAT_SQL, TRAILS_SQL, j07_j09_threat, ring_inflows
from kestrel.plans.rings import parts
from kestrel.plans.rings import sql as ringed
from kestrel.sources.bindings import oracle, view

lab = lambda spark, sf: view(spark, sf, "labelled")
SCORES_SQL = """bs AS (SELECT score, sum(label) AS pos, count(*) AS n FROM labelled GROUP BY 1),
tt AS (SELECT score, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS called FROM bs),
pr AS (SELECT score, tp / called::DOUBLE AS precision, tp / greatest((SELECT sum(label) FROM labelled), 1)::DOUBLE AS recall FROM tt)"""


def m03_group_split(spark, sf):
    return M.group_split(lab(spark, sf), "source").groupBy("split").agg(F.count("*").alias("n"), F.countDistinct("source").alias("groups"))


def m04_precision_floor(spark, sf):
    return M.precision_floor(lab(spark, sf), 0.86).select(F.col("score").alias("threshold"), F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), "ok")


def m05_two_sided(spark, sf):
    return M.two_sided(lab(spark, sf).withColumn("label", 1 - F.col("label")), floor=0.2, share=0.2).select("upper", "lower")


def m06_auc(spark, sf):
    return M.auc(lab(spark, sf)).select(F.round("auc", 9).alias("auc"))


def m07_average_precision(spark, sf):
    return M.average_precision(lab(spark, sf)).select(F.round("average_precision", 9).alias("average_precision"))


def m08_confusion(spark, sf):
    return M.confusion(lab(spark, sf), 0.5).select("tp", "fp", "fn", "tn", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


def m09_recall_by_family(spark, sf):
    return lab(spark, sf).where("label = 1").groupBy("source").agg(F.round(F.avg((F.col("score") >= 0.5).cast("double")), 6).alias("recall"), F.count("*").alias("n"))


def m12_latest(spark, sf):
    return M.latest(view(spark, sf, "points"), "user_id", F.struct("t", "event_id"), F.col("event_type").isin("error", "signup")).select("user_id", "event_id", "event_type")


def m13_before_after(spark, sf):
    before, after = F.col("score") >= 0.5, F.col("score") >= 0.35
    rows = M.alternating(lab(spark, sf), "source", "doc_id").where("side = 'held_out'")
    right = lambda c: F.round(F.avg((c == (F.col("label") == 1)).cast("double")), 6)
    return rows.groupBy("source").agg(right(before).alias("before"), right(after).alias("after"))


def m14_alternating(spark, sf):
    return M.alternating(lab(spark, sf), "source", "doc_id").select("doc_id", "side")


def m16_balanced(spark, sf):
    return M.balanced(lab(spark, sf), "doc_id").select("doc_id", "label")


def q01_serials(spark, sf):
    return view(spark, sf, "serials").select("event_id", "serial", A.serial_status(F.col("serial")).alias("status"))


def q02_sightings(spark, sf):
    return A.sightings(view(spark, sf, "serials")).select("event_id", "serial", "prior", "last_places", "status")


def rings_of(spark, sf):
    return K.summarise(*parts(spark, sf)).select("ring_id", "risk", "account_ids")


def actions(spark, sf):
    scams = view(spark, sf, "scams").withColumns({"phone": F.when(F.col("k") % 2 == 0, F.concat(F.lit("U"), F.col("user_id"))), "reported": F.col("k") % 3 > 0})
    return A.derive_actions(scams, J.money_trails(scams, ring_inflows(spark, sf)), rings_of(spark, sf), j07_j09_threat(spark, sf))


ACTIONS_SQL = f"""{TRAILS_SQL}, rg AS (SELECT ring_id, avg(score) AS risk, list_sort(list(account_id)) AS ids FROM rm JOIN members USING (account_id) GROUP BY 1),
tp AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY risk DESC, ring_id) AS n FROM rg) WHERE n <= 3 AND risk >= 0.7), {THREAT_SQL},
ev AS (SELECT 1 AS rule, 'account_freeze' AS action_type, target AS raw, 'critical' AS priority FROM tr WHERE r = 1
  UNION ALL SELECT 2, 'account_freeze', unnest(ids[1:3]), 'high' FROM tp
  UNION ALL SELECT 3, 'telecom_block', 'U' || CAST(user_id AS VARCHAR), 'high' FROM scams WHERE risk_score >= 0.6 AND verdict <> 'legit' AND k % 2 = 0
  UNION ALL SELECT 4, 'citizen_intercept', CAST(event_id AS VARCHAR), 'critical' FROM scams WHERE risk_score >= 0.6 AND verdict <> 'legit' AND k % 3 = 0
  UNION ALL SELECT 5, 'mha_alert', 'national', CASE WHEN bool_or(threat = 'critical') THEN 'critical' ELSE 'high' END FROM th WHERE threat IN ('high', 'critical') HAVING count(*) > 0),
ac AS (SELECT action_type || ':' || target AS action_id, action_type, target, CAST(min(rule) AS INT) AS rule, arg_min(priority, rule) AS priority
  FROM (SELECT *, regexp_replace(raw, '[^\\p{{L}}\\p{{N}}._+-]', '_', 'g') AS target FROM ev) GROUP BY action_type, target)"""


def a01_a02_actions(spark, sf):
    return actions(spark, sf)


def current_actions(made):
    held = made.where("length(target) % 2 = 0").select("action_id", F.when(F.col("rule") == 3, "approved").otherwise("proposed").alias("status"), F.lit("low").alias("priority"))
    return held


def a03_merged_actions(spark, sf):
    made = actions(spark, sf)
    return A.merge_actions(current_actions(made), made.where("rule <> 4"))


def a04_transitions(spark, sf):
    made = actions(spark, sf).select("action_id", F.lit("proposed").alias("status"))
    steps = made.select("action_id", F.posexplode(F.array(F.lit("approved"), F.lit("dispatched"))).alias("seq", "status")).where("length(action_id) % 3 > seq")
    return A.transitions(made, steps.withColumn("seq", F.col("seq").cast("long")))


def a05_queue(spark, sf):
    return actions(spark, sf).groupBy("action_type", "priority").agg(F.count("*").alias("n"))


def v01_validation(spark, sf):
    rules = {
        "risk_range": F.col("risk_score").between(0, 0.9),
        "verdict_enum": F.col("verdict").isin("scam", "suspicious"),
        "paid_positive": F.col("paid") > 100,
    }
    return A.validated(view(spark, sf, "scams"), rules).select("event_id", F.array_join("errors", ",").alias("errors"))


def v02_round_amounts(spark, sf):
    return view(spark, sf, "tx").where(is_round(F.col("amount"))).groupBy("source").agg(F.count("*").alias("n"))


def v03_v06_filters(spark, sf):
    s = view(spark, sf, "scams")
    return s.where("verdict IN ('scam', 'suspicious') AND lower(trim(district)) = 'nation_3'").select("event_id", F.contains(F.lit("NATION_3 NORTH"), F.col("district")).alias("tolerant"), (F.coalesce("lat", F.lit(0.0)) != 0).alias("trail_place"), F.col("lat").isNotNull().alias("hub_place"))


def v07_v12_bands(spark, sf):
    s, n = F.col("risk_score"), F.col("k")
    return view(spark, sf, "scams").select(
        "event_id",
        F.when(s >= 0.5343, "scam").when(s >= 0.3, "suspicious").when(n % 5 >= 3, "suspicious").otherwise("legit").alias("verdict"),
        F.when(s >= 0.7, "high").when(s >= 0.4, "medium").otherwise("low").alias("band"),
        F.when(s >= 0.7, "block").when(s >= 0.4, "review").otherwise("monitor").alias("decision"),
        F.when(s >= 0.6, "fake").when(s <= 0.2, "genuine").otherwise("uncertain").alias("note"),
        F.when((n >= 40) & n.between(35, 235), "pass").otherwise("unscannable").alias("triage"),
    )


def u01_snapshot(spark, sf):
    return view(spark, sf, "scams").groupBy("scam_type").agg(
        F.count("*").alias("n"), F.sum((F.col("verdict") != "legit").cast("long")).alias("flagged"), F.countDistinct("district").alias("districts"),
        F.round(F.max("risk_score"), 3).alias("max_risk"), F.round(F.avg("risk_score"), 3).alias("avg_risk"),
    )


def u02_shared_districts(spark, sf):
    seen = view(spark, sf, "scams").where("verdict = 'scam'").select("district").union(view(spark, sf, "notes").where("verdict = 'fake'").select("district"))
    _, scores, rings = parts(spark, sf)
    return seen.intersect(rings.join(scores, "account_id").select("district"))


def u04_dossiers(spark, sf):
    s = view(spark, sf, "scams").groupBy("district").agg(F.sum((F.col("verdict") != "legit").cast("long")).alias("scams"), F.round(F.max("risk_score"), 4).alias("worst"))
    n = view(spark, sf, "notes").where("verdict = 'fake'").groupBy("district").agg(F.count("*").alias("notes"), F.max("t").alias("last_note"))
    r = view(spark, sf, "members").groupBy("district").agg(F.count("*").alias("accounts"), F.sum(F.col("is_illicit").cast("long")).alias("illicit"))
    return r.join(s, "district", "left").join(n, "district", "left").na.fill(0, ["scams", "notes"])


def u05_timeline(spark, sf):
    a = view(spark, sf, "scams").where("verdict = 'scam'").select("district", "t", F.lit("scam").alias("kind"), F.col("event_id").alias("ref"))
    b = view(spark, sf, "notes").where("verdict = 'fake'").select("district", "t", F.lit("note").alias("kind"), F.col("event_id").alias("ref"))
    return a.unionByName(b).orderBy("t", "ref").limit(500)


def u07_alerts(spark, sf):
    from pyspark.sql import Window as W

    s = view(spark, sf, "scams").where("verdict <> 'legit'").groupBy("district").agg(F.countDistinct("scam_type").alias("corroboration"), F.sum("risk_score").alias("intensity"))
    scored = s.withColumn("score", F.round(F.col("intensity") / F.max("intensity").over(W.partitionBy(F.lit(0))), 6))
    return scored.orderBy(F.desc("corroboration"), F.desc("score"), "district").limit(3).select("district", "corroboration", "score")


def u08_totals(spark, sf):
    a = view(spark, sf, "scams").select(F.col("risk_score").alias("c"))
    b = view(spark, sf, "notes").select((F.col("k") / 100).alias("c"))
    c = view(spark, sf, "members").select(F.col("score").alias("c"))
    return a.union(b).union(c).agg(F.round(F.avg("c"), 6).alias("confidence"), F.count("*").alias("n"))


def sr12_latest_events(spark, sf):
    from pyspark.sql import Window as W

    newest = W.partitionBy("event_type").orderBy(F.desc("t"), F.desc("event_id"))
    return view(spark, sf, "points").withColumn("r", F.row_number().over(newest)).where("r <= 500").select("event_type", "event_id", "r")


def sr06_training_frame(spark, sf):

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    first = docs.groupBy(F.sha2("text", 256).alias("digest")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))
    return first.select("doc_id", "copies")


QUERIES = {
    f.__name__: f
    for f in (
        m03_group_split, m04_precision_floor, m05_two_sided, m06_auc, m07_average_precision, m08_confusion, m09_recall_by_family, m12_latest, m13_before_after, m14_alternating,
        m16_balanced, q01_serials, q02_sightings, a01_a02_actions, a03_merged_actions, a04_transitions, a05_queue, v01_validation, v02_round_amounts, v03_v06_filters, v07_v12_bands,
        u01_snapshot, u02_shared_districts, u04_dossiers, u05_timeline, u07_alerts, u08_totals, sr12_latest_events, sr06_training_frame,
    )
}
STATUS_SQL = """CASE WHEN NOT regexp_full_match(serial, '[0-9][A-Z]{2}[0-9]{6}') OR regexp_matches(substr(serial, 2, 2), '[IO]') THEN 'nonsense'
  WHEN substr(serial, 4, 6) = repeat(substr(serial, 4, 1), 6) OR contains('01234567890', substr(serial, 4, 6)) OR contains('09876543210', substr(serial, 4, 6)) THEN 'suspicious' ELSE 'valid' END"""
SIDE_SQL = "SELECT *, CASE WHEN (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) % 2 = 0 THEN 'adapt' ELSE 'held_out' END AS side FROM labelled"
ORACLES = {
    "m03_group_split": oracle("""WITH b AS (SELECT source, CAST('0x' || substr(md5(source), 1, 8) AS BIGINT) % 100 AS band FROM labelled)
        SELECT CASE WHEN band < 60 THEN 'train' WHEN band < 80 THEN 'validation' ELSE 'test' END AS split, count(*) AS n, count(DISTINCT source) AS groups FROM b GROUP BY 1""", "labelled"),
    "m04_precision_floor": oracle(f"""WITH {SCORES_SQL}, o AS (SELECT *, precision >= 0.86 AS ok FROM pr) SELECT score AS threshold, round(precision, 6) AS precision, round(recall, 6) AS recall, ok FROM o
        ORDER BY ok DESC, CASE WHEN ok THEN recall ELSE precision END DESC, score LIMIT 1""", "labelled"),
    "m05_two_sided": oracle("""WITH l AS (SELECT score, 1 - label AS label FROM labelled), b AS (SELECT score, sum(label) AS pos, count(*) AS n FROM l GROUP BY 1),
        t AS (SELECT score, sum(pos) OVER d AS tp, sum(n) OVER d AS called, sum(pos) OVER u AS p, sum(n) OVER u AS m FROM b WINDOW d AS (ORDER BY score DESC), u AS (ORDER BY score)),
        x AS (SELECT coalesce(min(score), 1.0) AS upper FROM t WHERE tp / called::DOUBLE >= 0.2 AND score >= 0.5)
        SELECT (SELECT upper FROM x) AS upper, (SELECT max(score) FROM t WHERE m >= 10 AND p <= 0.2 * m AND score <= (SELECT upper FROM x) - 0.05) AS lower""", "labelled"),
    "m06_auc": oracle("""WITH r AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0e0 AS k FROM labelled)
        SELECT round((sum(CASE WHEN label = 1 THEN k END) - sum(label) * (sum(label) + 1) / 2.0e0) / (sum(label) * sum(1 - label)), 9) AS auc FROM r""", "labelled"),
    "m07_average_precision": oracle(f"WITH {SCORES_SQL} SELECT round(sum(s * precision), 9) AS average_precision FROM (SELECT precision, recall - coalesce(lag(recall) OVER (ORDER BY score DESC), 0) AS s FROM pr)", "labelled"),
    "m08_confusion": oracle("""WITH c AS (SELECT count(*) FILTER (WHERE score >= 0.5 AND label = 1) AS tp, count(*) FILTER (WHERE score >= 0.5 AND label = 0) AS fp, count(*) FILTER (WHERE score < 0.5 AND label = 1) AS fn,
        count(*) FILTER (WHERE score < 0.5 AND label = 0) AS tn FROM labelled) SELECT *, round(tp / (tp + fp)::DOUBLE, 6) AS precision, round(tp / (tp + fn)::DOUBLE, 6) AS recall FROM c""", "labelled"),
    "m09_recall_by_family": oracle("SELECT source, round(avg((score >= 0.5)::INT), 6) AS recall, count(*) AS n FROM labelled WHERE label = 1 GROUP BY 1", "labelled"),
    "m12_latest": oracle("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t DESC, event_id DESC) AS r FROM points) WHERE r = 1 AND event_type IN ('error', 'signup')", "points"),
    "m13_before_after": oracle(f"SELECT source, round(avg(((score >= 0.5) = (label = 1))::INT), 6) AS before, round(avg(((score >= 0.35) = (label = 1))::INT), 6) AS after FROM ({SIDE_SQL}) WHERE side = 'held_out' GROUP BY 1", "labelled"),
    "m14_alternating": oracle(f"SELECT doc_id, side FROM ({SIDE_SQL})", "labelled"),
    "m16_balanced": oracle("SELECT doc_id, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY doc_id) AS r FROM labelled) WHERE r <= (SELECT min(n) FROM (SELECT count(*) AS n FROM labelled GROUP BY label))", "labelled"),
    "q01_serials": oracle(f"SELECT event_id, serial, {STATUS_SQL} AS status FROM serials", "serials"),
    "q02_sightings": oracle(f"""WITH w AS (SELECT *, count(*) OVER p AS prior, coalesce(string_agg(CAST(user_id AS VARCHAR), ',') OVER (PARTITION BY serial ORDER BY t, event_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), '') AS last_places, {STATUS_SQL} AS own FROM serials
        WINDOW p AS (PARTITION BY serial ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT event_id, serial, prior, last_places, CASE WHEN own <> 'nonsense' AND prior > 0 THEN 'duplicate' ELSE own END AS status FROM w""", "serials"),
    "a01_a02_actions": ringed(f"WITH {ACTIONS_SQL} SELECT * FROM ac", "scams", "notes"),
    "a03_merged_actions": ringed(f"""WITH {ACTIONS_SQL}, c AS (SELECT action_id, CASE WHEN rule = 3 THEN 'approved' ELSE 'proposed' END AS held FROM ac WHERE length(target) % 2 = 0), d AS (SELECT action_id, priority AS new FROM ac WHERE rule <> 4)
        SELECT action_id, CASE WHEN held <> 'proposed' THEN held ELSE 'proposed' END AS status, CASE WHEN held <> 'proposed' THEN 'low' ELSE new END AS priority FROM c FULL JOIN d USING (action_id) WHERE held <> 'proposed' OR new IS NOT NULL""", "scams", "notes"),
    "a04_transitions": ringed(f"WITH {ACTIONS_SQL} SELECT action_id, CASE length(action_id) % 3 WHEN 0 THEN 'proposed' WHEN 1 THEN 'approved' ELSE 'dispatched' END AS status, CASE length(action_id) % 3 WHEN 0 THEN '' WHEN 1 THEN 'approved' ELSE 'approved>dispatched' END AS audit FROM ac", "scams", "notes"),
    "a05_queue": ringed(f"WITH {ACTIONS_SQL} SELECT action_type, priority, count(*) AS n FROM ac GROUP BY 1, 2", "scams", "notes"),
    "v01_validation": oracle("SELECT event_id, concat_ws(',', CASE WHEN NOT (risk_score BETWEEN 0 AND 0.9) THEN 'risk_range' END, CASE WHEN verdict NOT IN ('scam', 'suspicious') THEN 'verdict_enum' END, CASE WHEN NOT paid > 100 THEN 'paid_positive' END) AS errors FROM scams", "scams"),
    "v02_round_amounts": oracle("SELECT source, count(*) AS n FROM tx WHERE CAST(amount AS DOUBLE) % 1000 < 1 OR CAST(amount AS DOUBLE) % 1000 > 999 GROUP BY 1", "tx"),
    "v03_v06_filters": oracle("SELECT event_id, contains('NATION_3 NORTH', district) AS tolerant, coalesce(lat, 0) <> 0 AS trail_place, lat IS NOT NULL AS hub_place FROM scams WHERE verdict IN ('scam', 'suspicious') AND lower(trim(district)) = 'nation_3'", "scams"),
    "v07_v12_bands": oracle("""SELECT event_id, CASE WHEN risk_score >= 0.5343 THEN 'scam' WHEN risk_score >= 0.3 THEN 'suspicious' WHEN k % 5 >= 3 THEN 'suspicious' ELSE 'legit' END AS verdict,
        CASE WHEN risk_score >= 0.7 THEN 'high' WHEN risk_score >= 0.4 THEN 'medium' ELSE 'low' END AS band, CASE WHEN risk_score >= 0.7 THEN 'block' WHEN risk_score >= 0.4 THEN 'review' ELSE 'monitor' END AS decision,
        CASE WHEN risk_score >= 0.6 THEN 'fake' WHEN risk_score <= 0.2 THEN 'genuine' ELSE 'uncertain' END AS note, CASE WHEN k BETWEEN 40 AND 235 THEN 'pass' ELSE 'unscannable' END AS triage FROM scams""", "scams"),
    "u01_snapshot": oracle("SELECT scam_type, count(*) AS n, count(*) FILTER (WHERE verdict <> 'legit') AS flagged, count(DISTINCT district) AS districts, round(max(risk_score), 3) AS max_risk, round(avg(risk_score), 3) AS avg_risk FROM scams GROUP BY 1", "scams"),
    "u02_shared_districts": ringed("(SELECT district FROM scams WHERE verdict = 'scam' UNION SELECT district FROM notes WHERE verdict = 'fake') INTERSECT SELECT district FROM rm JOIN members USING (account_id)", "scams", "notes"),
    "u04_dossiers": oracle("""WITH s AS (SELECT district, count(*) FILTER (WHERE verdict <> 'legit') AS scams, round(max(risk_score), 4) AS worst FROM scams GROUP BY 1), n AS (SELECT district, count(*) AS notes, max(t) AS last_note FROM notes WHERE verdict = 'fake' GROUP BY 1),
        r AS (SELECT district, count(*) AS accounts, count(*) FILTER (WHERE is_illicit) AS illicit FROM members GROUP BY 1)
        SELECT district, accounts, illicit, coalesce(scams, 0) AS scams, worst, coalesce(notes, 0) AS notes, last_note FROM r LEFT JOIN s USING (district) LEFT JOIN n USING (district)""", "scams", "notes", "members"),
    "u05_timeline": oracle("SELECT district, t, 'scam' AS kind, event_id AS ref FROM scams WHERE verdict = 'scam' UNION ALL SELECT district, t, 'note', event_id FROM notes WHERE verdict = 'fake' ORDER BY t, ref LIMIT 500", "scams", "notes"),
    "u07_alerts": oracle("""WITH s AS (SELECT district, count(DISTINCT scam_type) AS corroboration, sum(risk_score) AS intensity FROM scams WHERE verdict <> 'legit' GROUP BY 1)
        SELECT district, corroboration, round(intensity / (SELECT max(intensity) FROM s), 6) AS score FROM s ORDER BY corroboration DESC, score DESC, district LIMIT 3""", "scams"),
    "u08_totals": oracle("SELECT round(avg(c), 6) AS confidence, count(*) AS n FROM (SELECT risk_score AS c FROM scams UNION ALL SELECT k / 100.0e0 FROM notes UNION ALL SELECT score FROM members)", "scams", "notes", "members"),
    "sr12_latest_events": oracle("SELECT event_type, event_id, CAST(r AS INT) AS r FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY t DESC, event_id DESC) AS r FROM points) WHERE r <= 500", "points"),
    "sr06_training_frame": "SELECT min(doc_id) AS doc_id, count(*) AS copies FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents) GROUP BY text",
}
