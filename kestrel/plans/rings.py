"""Queries over rings, with their SQL. Rings come from the user-to-user transfers of users that score 0.9 or more."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from kestrel.operators import features as G
from kestrel.operators import rings as K
from kestrel.operators.components import components
from kestrel.plans.features import SIDES_SQL
from kestrel.session import materialise
from kestrel.sources.bindings import oracle, view

LEAST = 0.9
#: Communities split what is one component from here on.
LOW = 0.5
RINGS_SQL = """hi AS (SELECT account_id FROM members WHERE score >= 0.9),
he AS (SELECT p.* FROM p2p p WHERE source IN (SELECT account_id FROM hi) AND target IN (SELECT account_id FROM hi)),
sym AS (SELECT source AS x, target AS y FROM he WHERE source <> target UNION SELECT target, source FROM he WHERE source <> target),
reach(x, y) AS (SELECT x, x FROM sym UNION SELECT reach.x, sym.y FROM reach JOIN sym ON reach.y = sym.x),
comp AS (SELECT x AS account_id, min(y) AS root FROM reach GROUP BY x),
rank_ AS (SELECT root, count(*) AS size, row_number() OVER (ORDER BY count(*) DESC, root) AS n FROM comp GROUP BY root HAVING count(*) >= 3),
rm AS (SELECT 'ring_' || lpad(CAST(n AS VARCHAR), 2, '0') AS ring_id, account_id FROM comp JOIN rank_ USING (root)),
intra AS (SELECT a.ring_id, he.* FROM he JOIN rm a ON he.source = a.account_id JOIN rm b ON he.target = b.account_id WHERE a.ring_id = b.ring_id),
infl AS (SELECT p.*, ring_id FROM p2p p JOIN rm ON p.target = rm.account_id WHERE p.source NOT IN (SELECT account_id FROM rm))"""


def sql(body: str, *more: str) -> str:
    """The rings' SQL, then further named parts in ``body`` if it starts with WITH."""
    tail = body.strip()
    if tail.startswith("WITH "):
        return oracle(f"WITH {RINGS_SQL}, {tail[5:]}", "p2p", "members", *more, recursive=True)
    return oracle(f"WITH {RINGS_SQL} {tail}", "p2p", "members", *more, recursive=True)


def parts(spark, sf):
    tx, members = view(spark, sf, "p2p"), view(spark, sf, "members")
    return tx, members, K.ring_members(tx, members, LEAST)


def k01_induced_edges(spark, sf):
    edges = K.induced(view(spark, sf, "p2p"), view(spark, sf, "members"), LEAST)
    return edges.select("tx_id", "source", "target", F.col("amount").cast("double").alias("amount"))


def k02_components(spark, sf):
    found = components(K.induced(view(spark, sf, "p2p"), view(spark, sf, "members"), LEAST), "source", "target")
    return found.select(F.col("node").alias("account_id"), "component")


def k03_communities(spark, sf):
    return K.communities(view(spark, sf, "p2p"))


def k04_ring_members(spark, sf):
    return parts(spark, sf)[2]


def k04_community_rings(spark, sf):
    return K.community_rings(view(spark, sf, "p2p"), view(spark, sf, "members"), LOW)


def k05_community_rings(spark, sf):
    """K5 to K8 over the rings that communities give."""
    tx, scores = view(spark, sf, "p2p"), view(spark, sf, "members")
    rings = materialise(K.community_rings(tx, scores, LOW))
    made = K.summarise(tx, scores, rings).join(K.topology(tx, rings), "ring_id")
    return made.select("ring_id", "size", F.round("risk", 6).alias("risk"), "account_ids", "total_amount", "district", "label")


def k05_rings(spark, sf):
    tx, scores, rings = parts(spark, sf)
    made = K.summarise(tx, scores, rings)
    return made.select("ring_id", "size", F.round("risk", 6).alias("risk"), "account_ids", "total_amount", "district")


def k06_ring_degrees(spark, sf):
    tx, _, rings = parts(spark, sf)
    return K.ring_degrees(tx, rings)


def k07_cyclic_rings(spark, sf):
    tx, _, rings = parts(spark, sf)
    return K.cyclic_rings(tx, rings)


def k08_topology(spark, sf):
    tx, _, rings = parts(spark, sf)
    return K.topology(tx, rings)


def k09_account_rings(spark, sf):
    _, scores, rings = parts(spark, sf)
    return scores.join(rings, "account_id", "left").select("account_id", "score", "ring_id")


def k10_export_edges(spark, sf):
    tx, _, rings = parts(spark, sf)
    return K.export_edges(tx, rings).select("source", "target", F.col("amount").cast("double").alias("amount"), "kind")


def k11_ringed_accounts(spark, sf):
    tx, scores, rings = parts(spark, sf)
    evidence = G.flows(tx).select(
        "account_id", *[F.round(c, 4).alias(c) for c in ("total_in", "total_out", "net_flow", "throughput", "avg_amount", "max_amount", "round_amount_ratio", "fan_in_ratio", "fan_out_ratio")]
    )
    return rings.join(scores.select("account_id", "score", "district"), "account_id").join(evidence, "account_id", "left")


def truth(members):
    return members.where("is_illicit").select(F.col("district").alias("true_id"), "account_id")


def k12_ring_recovery(spark, sf):
    _, scores, rings = parts(spark, sf)
    return K.recovery(rings, truth(scores)).withColumn("overlap", F.round("overlap", 6))


def k14_submitted_hits(spark, sf):
    _, scores, rings = parts(spark, sf)
    return K.submitted_hits(rings, scores.where("score >= 0.95").select("account_id"))


def k15_ring_view(spark, sf):
    from pyspark.sql import Window as W

    tx, _, rings = parts(spark, sf)
    traced = (F.col("amount") >= 400).cast("int")
    order = W.partitionBy("ring_id").orderBy(F.desc(traced), F.desc("amount"), "tx_id")
    top = K.inflows(tx, rings).withColumn("place", F.row_number().over(order)).where("place <= 10")
    return top.select("ring_id", "place", "tx_id", "source", "target", F.col("amount").cast("double").alias("amount"))


def k16_new_rings(spark, sf):
    tx, scores, rings = parts(spark, sf)
    half = tx.where("tx_id % 2 = 0")
    before = K.signatures(K.ring_members(half, scores, LEAST)).select("signature")
    return K.signatures(rings).join(before, "signature", "left_anti").select("ring_id", "signature")


def j01_ring_inflows(spark, sf):
    tx, _, rings = parts(spark, sf)
    return K.inflows(tx, rings).select("tx_id", "source", "target", F.col("amount").cast("double").alias("amount"), "t", "ring_id")


QUERIES = {
    f.__name__: f
    for f in (
        k01_induced_edges, k02_components, k03_communities, k04_ring_members, k04_community_rings, k05_rings, k05_community_rings, k06_ring_degrees, k07_cyclic_rings, k08_topology,
        k09_account_rings, k10_export_edges, k11_ringed_accounts, k12_ring_recovery, k14_submitted_hits, k15_ring_view, k16_new_rings, j01_ring_inflows,
    )
}
DEGREES_SQL = """e AS (SELECT DISTINCT ring_id, source, target FROM intra WHERE source <> target),
dg AS (SELECT rm.ring_id, rm.account_id, (SELECT count(*) FROM e WHERE e.ring_id = rm.ring_id AND e.target = rm.account_id) AS in_degree,
  (SELECT count(*) FROM e WHERE e.ring_id = rm.ring_id AND e.source = rm.account_id) AS out_degree FROM rm)"""
#: A strongly connected set has a longer cycle unless it is a tree with every edge both ways.
CYCLES_SQL = """way(ring_id, x, y) AS (SELECT ring_id, source, target FROM intra WHERE source <> target UNION SELECT w.ring_id, w.x, i.target FROM way w JOIN intra i ON i.ring_id = w.ring_id AND i.source = w.y WHERE i.source <> i.target),
sc AS (SELECT a.ring_id, a.x AS node, min(a.y) AS root FROM way a JOIN way b ON a.ring_id = b.ring_id AND a.x = b.y AND a.y = b.x GROUP BY 1, 2),
se AS (SELECT DISTINCT i.ring_id, p.root, source, target FROM intra i JOIN sc p ON p.ring_id = i.ring_id AND p.node = source JOIN sc q ON q.ring_id = i.ring_id AND q.node = target AND q.root = p.root WHERE source <> target),
sn_ AS (SELECT ring_id, root, count(*) AS nodes FROM sc GROUP BY 1, 2), sm AS (SELECT ring_id, root, count(*) AS arcs, count(DISTINCT least(source, target) || '>' || greatest(source, target)) AS pairs FROM se GROUP BY 1, 2),
cy AS (SELECT DISTINCT ring_id FROM sn_ JOIN sm USING (ring_id, root) WHERE NOT (arcs = 2 * pairs AND pairs = nodes - 1))"""
EVIDENCE_SQL = SIDES_SQL.replace("FROM tx", "FROM p2p").replace("\ni AS", "fi AS").replace("\no AS", "fo AS").replace("\nf AS", "ff AS").replace("FROM i FULL JOIN o", "FROM fi FULL JOIN fo")
#: The same parts over the even transfers, each name with a 2.
EVEN_SQL = re.sub(r"\b(hi|he|sym|reach|comp|rank_|rm|intra|infl)\b", r"\g<1>2", RINGS_SQL).replace("FROM p2p p", "FROM (SELECT * FROM p2p WHERE tx_id % 2 = 0) p")
ORACLES = {
    "k11_ringed_accounts": sql(f"""WITH {EVIDENCE_SQL} SELECT ring_id, account_id, score, district, round(ti, 4) AS total_in, round(ot, 4) AS total_out, round(ti - ot, 4) AS net_flow,
        round(least(ti, ot) / greatest(greatest(ti, ot), 1e-9), 4) AS throughput, round((ti + ot) / greatest(ni + no_, 1), 4) AS avg_amount, round(greatest(mi, mo), 4) AS max_amount, round((ri + ro) / 2, 4) AS round_amount_ratio,
        round(ui / greatest(ui + uo, 1)::DOUBLE, 4) AS fan_in_ratio, round(uo / greatest(ui + uo, 1)::DOUBLE, 4) AS fan_out_ratio FROM rm JOIN members USING (account_id) LEFT JOIN ff USING (account_id)"""),
    "k16_new_rings": sql(f"""WITH {EVEN_SQL}, now_ AS (SELECT ring_id, string_agg(DISTINCT account_id, ',' ORDER BY account_id) AS signature FROM rm GROUP BY 1),
        before_ AS (SELECT string_agg(DISTINCT account_id, ',' ORDER BY account_id) AS signature FROM rm2 GROUP BY ring_id) SELECT ring_id, signature FROM now_ WHERE signature NOT IN (SELECT signature FROM before_)"""),
    "k01_induced_edges": sql("SELECT tx_id, source, target, CAST(amount AS DOUBLE) AS amount FROM he"),
    "k02_components": sql("SELECT account_id, root AS component FROM comp"),
    "k04_ring_members": sql("SELECT ring_id, account_id FROM rm"),
    "k05_rings": sql("""WITH b AS (SELECT ring_id, count(*) AS size, round(avg(score), 6) AS risk, string_agg(account_id, ',' ORDER BY account_id) AS account_ids FROM rm JOIN members USING (account_id) GROUP BY 1),
        d AS (SELECT ring_id, district, row_number() OVER (PARTITION BY ring_id ORDER BY count(*) DESC, district) AS r FROM rm JOIN members USING (account_id) GROUP BY 1, 2)
        SELECT b.*, coalesce((SELECT CAST(sum(amount) AS DOUBLE) FROM intra WHERE intra.ring_id = b.ring_id), 0) AS total_amount, district FROM b LEFT JOIN d ON b.ring_id = d.ring_id AND r = 1"""),
    "k06_ring_degrees": sql(f"WITH {DEGREES_SQL} SELECT * FROM dg"),
    "k07_cyclic_rings": sql(f"WITH {CYCLES_SQL} SELECT ring_id FROM cy"),
    "k08_topology": sql(f"""WITH {DEGREES_SQL}, {CYCLES_SQL}, s AS (SELECT dg.*, count(*) OVER (PARTITION BY ring_id) AS n FROM dg),
        a AS (SELECT ring_id, n, sum(CASE WHEN greatest(in_degree, out_degree) >= greatest(3, n // 3) THEN 1 ELSE 0 END) AS hubs, max(greatest(in_degree, out_degree)) AS most,
              sum(CASE WHEN in_degree <= 1 AND out_degree <= 1 THEN 1 ELSE 0 END) AS links FROM s GROUP BY 1, 2)
        SELECT ring_id, CASE WHEN ring_id IN (SELECT ring_id FROM cy) THEN 'round-tripping cycle' WHEN hubs >= 2 THEN 'multi-hub laundering network'
          WHEN most >= greatest(3, n - 2) THEN 'mule collection hub' WHEN links >= n - 1 THEN 'layering chain' ELSE 'mixed laundering network' END AS label FROM a"""),
    "k09_account_rings": sql("SELECT account_id, score, ring_id FROM members LEFT JOIN rm USING (account_id)"),
    "k10_export_edges": sql("""SELECT * FROM (SELECT source, target, CAST(amount AS DOUBLE) AS amount, 'intra' AS kind FROM intra ORDER BY intra.amount DESC, source, target LIMIT 500)
        UNION ALL SELECT * FROM (SELECT source, target, CAST(amount AS DOUBLE) AS amount, 'inflow' AS kind FROM infl ORDER BY infl.amount DESC, source, target LIMIT 200)"""),
    "k12_ring_recovery": sql("""WITH tr AS (SELECT district AS true_id, account_id FROM members WHERE is_illicit), sz AS (SELECT true_id, count(*) AS size FROM tr GROUP BY 1),
        b AS (SELECT true_id, ring_id, count(*) AS shared, row_number() OVER (PARTITION BY true_id ORDER BY count(*) DESC, ring_id) AS r FROM tr JOIN rm USING (account_id) GROUP BY 1, 2)
        SELECT sz.true_id, size, ring_id, round(coalesce(shared, 0) / size::DOUBLE, 6) AS overlap, coalesce(shared, 0) / size::DOUBLE >= 0.5 AS recovered FROM sz LEFT JOIN b ON sz.true_id = b.true_id AND r = 1"""),
    "k14_submitted_hits": sql("SELECT ring_id, count(*) AS hits FROM rm JOIN members USING (account_id) WHERE score >= 0.95 GROUP BY 1 HAVING count(*) >= 3"),
    "k15_ring_view": sql("""SELECT * FROM (SELECT ring_id, row_number() OVER (PARTITION BY ring_id ORDER BY CASE WHEN amount >= 400 THEN 1 ELSE 0 END DESC, amount DESC, tx_id) AS place,
        tx_id, source, target, CAST(amount AS DOUBLE) AS amount FROM infl) WHERE place <= 10"""),
    "j01_ring_inflows": sql("SELECT tx_id, source, target, CAST(amount AS DOUBLE) AS amount, t, ring_id FROM infl"),
}
