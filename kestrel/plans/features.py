"""Queries over account features, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from kestrel.operators import features as G
from kestrel.sources.bindings import oracle, view

R = lambda *names: [F.round(n, 6).alias(n) for n in names]


def g01_g05_flows(spark, sf):
    return G.flows(view(spark, sf, "tx")).select(
        "account_id", "n_in", "unique_in", "n_out", "unique_out",
        *R("total_in", "total_out", "net_flow", "throughput", "avg_amount", "max_amount", "round_amount_ratio", "fan_in_ratio", "fan_out_ratio"),
    )


SIDES_SQL = """
i AS (SELECT target AS account_id, CAST(sum(amount) AS DOUBLE) AS ti, count(*) AS ni, count(DISTINCT source) AS ui, CAST(max(amount) AS DOUBLE) AS mi,
      avg(CASE WHEN CAST(amount AS DOUBLE) % 1000 < 1 OR CAST(amount AS DOUBLE) % 1000 > 999 THEN 1.0e0 ELSE 0.0e0 END) AS ri FROM tx GROUP BY 1),
o AS (SELECT source AS account_id, CAST(sum(amount) AS DOUBLE) AS ot, count(*) AS no_, count(DISTINCT target) AS uo, CAST(max(amount) AS DOUBLE) AS mo,
      avg(CASE WHEN CAST(amount AS DOUBLE) % 1000 < 1 OR CAST(amount AS DOUBLE) % 1000 > 999 THEN 1.0e0 ELSE 0.0e0 END) AS ro FROM tx GROUP BY 1),
f AS (SELECT account_id, coalesce(ti, 0) AS ti, coalesce(ni, 0) AS ni, coalesce(ui, 0) AS ui, coalesce(mi, 0) AS mi, coalesce(ri, 0) AS ri,
      coalesce(ot, 0) AS ot, coalesce(no_, 0) AS no_, coalesce(uo, 0) AS uo, coalesce(mo, 0) AS mo, coalesce(ro, 0) AS ro FROM i FULL JOIN o USING (account_id))"""
FLOWS_SQL = f"""WITH {SIDES_SQL}
SELECT account_id, ni AS n_in, ui AS unique_in, no_ AS n_out, uo AS unique_out, round(ti, 6) AS total_in, round(ot, 6) AS total_out,
  round(ti - ot, 6) AS net_flow, round(least(ti, ot) / greatest(greatest(ti, ot), 1e-9), 6) AS throughput,
  round((ti + ot) / greatest(ni + no_, 1), 6) AS avg_amount, round(greatest(mi, mo), 6) AS max_amount, round((ri + ro) / 2, 6) AS round_amount_ratio,
  round(ui / greatest(ui + uo, 1)::DOUBLE, 6) AS fan_in_ratio, round(uo / greatest(ui + uo, 1)::DOUBLE, 6) AS fan_out_ratio FROM f"""


def g06_g09_timing(spark, sf):
    return G.timing(view(spark, sf, "p2p")).select("account_id", *R("burst_ratio", "median_hold_minutes"))


TIMING_SQL = """
e AS (SELECT source AS account_id, t FROM {0} UNION ALL SELECT target, t FROM {0}),
gaps AS (SELECT account_id, (t - lag(t) OVER (PARTITION BY account_id ORDER BY t)) / 60.0e0 AS gap FROM e),
tm AS (SELECT account_id, sum(CASE WHEN gap < 60 THEN 1 ELSE 0 END) / count(*)::DOUBLE AS burst_ratio,
       coalesce(quantile_cont(gap, 0.5), 0) AS median_hold_minutes FROM gaps GROUP BY 1)"""


def top_mules(spark, sf):
    scored = G.behaviour(view(spark, sf, "tx")).select("account_id", *R("throughput", "burst_ratio", "fan_in_ratio", "mule_score"))
    return scored.orderBy(F.desc("mule_score"), "account_id").limit(50)


MULES_SQL = f"""WITH {SIDES_SQL}, {TIMING_SQL.format('tx')},
s AS (SELECT account_id, least(ti, ot) / greatest(greatest(ti, ot), 1e-9) AS throughput, coalesce(burst_ratio, 0) AS burst_ratio,
  ui / greatest(ui + uo, 1)::DOUBLE AS fan_in_ratio FROM f LEFT JOIN tm USING (account_id))
SELECT account_id, round(throughput, 6) AS throughput, round(burst_ratio, 6) AS burst_ratio, round(fan_in_ratio, 6) AS fan_in_ratio,
  round(0.5 * throughput + 0.3 * burst_ratio + 0.2 * fan_in_ratio, 6) AS mule_score FROM s ORDER BY mule_score DESC, account_id LIMIT 50"""


def g12_degree_centrality(spark, sf):
    return G.degree_centrality(view(spark, sf, "p2p"), view(spark, sf, "members")).select("account_id", *R("degree_centrality"))


DEGREE_SQL = """WITH e AS (SELECT DISTINCT source, target FROM p2p),
d AS (SELECT account_id, count(*) AS d FROM (SELECT source AS account_id FROM e UNION ALL SELECT target FROM e) GROUP BY 1),
n AS (SELECT count(DISTINCT account_id) AS n FROM members)
SELECT account_id, round(coalesce(d, 0) / greatest(n - 1, 1)::DOUBLE, 6) AS degree_centrality
FROM (SELECT DISTINCT account_id FROM members) LEFT JOIN d USING (account_id), n"""


def g13_pagerank(spark, sf):
    ranked = G.pagerank(view(spark, sf, "p2p"), view(spark, sf, "members"))
    return ranked.select("account_id", F.round("pagerank", 7).alias("pagerank"))


_ROUND = """r{1} AS MATERIALIZED (SELECT account_id, deg, 0.15e0 / n + 0.85e0 * (coalesce(got, 0) + (SELECT coalesce(sum(CASE WHEN deg IS NULL THEN rank END), 0) FROM r{0}) / n) AS rank
  FROM v LEFT JOIN (SELECT target AS account_id, sum(rank / deg) AS got FROM e JOIN r{0} ON account_id = source GROUP BY 1) USING (account_id), n)"""
PAGERANK_SQL = (
    "WITH e AS (SELECT DISTINCT source, target FROM p2p), n AS (SELECT count(DISTINCT account_id) AS n FROM members), "
    "v AS (SELECT account_id, deg FROM (SELECT DISTINCT account_id FROM members) LEFT JOIN "
    "(SELECT source AS account_id, count(*) AS deg FROM e GROUP BY 1) USING (account_id)), "
    "r0 AS (SELECT account_id, deg, 1.0e0 / n AS rank FROM v, n), "
    + ", ".join(_ROUND.format(k, k + 1) for k in range(40))
    + " SELECT account_id, round(rank, 7) AS pagerank FROM r40"
)


def g14_clustering(spark, sf):
    return G.clustering(view(spark, sf, "p2p")).select("account_id", *R("clustering"))


CLUSTERING_SQL = """WITH p AS (SELECT DISTINCT least(source, target) AS a, greatest(source, target) AS b FROM p2p WHERE source <> target),
s AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p), d AS (SELECT a, count(*) AS d FROM s GROUP BY 1),
t AS (SELECT x.a, count(*) AS n FROM s x JOIN s y ON x.a = y.a AND x.b < y.b JOIN p ON p.a = x.b AND p.b = y.b GROUP BY 1)
SELECT d.a AS account_id, round(CASE WHEN d < 2 THEN 0 ELSE 2 * coalesce(n, 0) / (d * (d - 1))::DOUBLE END, 6) AS clustering FROM d LEFT JOIN t ON d.a = t.a"""


def g15_core_numbers(spark, sf):
    return G.core_numbers(view(spark, sf, "p2p"))


def g16_features(spark, sf):
    columns = ["total_in", "total_out", "net_flow", "throughput", "avg_amount", "max_amount", "round_amount_ratio", "fan_in_ratio",
               "fan_out_ratio", "burst_ratio", "median_hold_minutes", "mule_score", "degree_centrality", "clustering"]
    made = G.assemble(view(spark, sf, "p2p"), view(spark, sf, "members"))
    return made.select("account_id", "district", "is_illicit", "n_in", "n_out", "unique_in", "unique_out", *R(*columns))


FEATURES_SQL = f"""WITH {SIDES_SQL.replace('FROM tx', 'FROM p2p')}, {TIMING_SQL.format('p2p')},
dc AS ({DEGREE_SQL.replace('WITH e AS', 'WITH e2 AS').replace('FROM e UNION', 'FROM e2 UNION').replace('FROM e)', 'FROM e2)')}), cc AS ({CLUSTERING_SQL}),
j AS (SELECT m.account_id, district, is_illicit, coalesce(ni, 0) AS n_in, coalesce(no_, 0) AS n_out, coalesce(ui, 0) AS unique_in, coalesce(uo, 0) AS unique_out,
  coalesce(ti, 0) AS ti, coalesce(ot, 0) AS ot, coalesce(mi, 0) AS mi, coalesce(mo, 0) AS mo, coalesce(ri, 0) AS ri, coalesce(ro, 0) AS ro,
  coalesce(burst_ratio, 0) AS burst, coalesce(median_hold_minutes, 0) AS hold, coalesce(degree_centrality, 0) AS degree_centrality, coalesce(clustering, 0) AS clustering
  FROM members m LEFT JOIN f USING (account_id) LEFT JOIN tm USING (account_id) LEFT JOIN dc USING (account_id) LEFT JOIN cc USING (account_id)),
k AS (SELECT *, least(ti, ot) / greatest(greatest(ti, ot), 1e-9) AS tp, unique_in / greatest(unique_in + unique_out, 1)::DOUBLE AS fi, unique_out / greatest(unique_in + unique_out, 1)::DOUBLE AS fo FROM j)
SELECT account_id, district, is_illicit, n_in, n_out, unique_in, unique_out, round(ti, 6) AS total_in, round(ot, 6) AS total_out, round(ti - ot, 6) AS net_flow,
  round(tp, 6) AS throughput, round((ti + ot) / greatest(n_in + n_out, 1), 6) AS avg_amount, round(greatest(mi, mo), 6) AS max_amount, round((ri + ro) / 2, 6) AS round_amount_ratio,
  round(fi, 6) AS fan_in_ratio, round(fo, 6) AS fan_out_ratio, round(burst, 6) AS burst_ratio, round(hold, 6) AS median_hold_minutes,
  round(0.5 * tp + 0.3 * burst + 0.2 * fi, 6) AS mule_score, degree_centrality, clustering FROM k"""


def g17_parallel_edges(spark, sf):
    return G.parallel_edges(view(spark, sf, "tx"))


QUERIES = {f.__name__: f for f in (top_mules, g01_g05_flows, g06_g09_timing, g12_degree_centrality, g13_pagerank, g14_clustering, g15_core_numbers, g16_features, g17_parallel_edges)}
ORACLES = {
    "top_mules": oracle(MULES_SQL, "tx"),
    "g01_g05_flows": oracle(FLOWS_SQL, "tx"),
    "g06_g09_timing": oracle(f"WITH {TIMING_SQL.format('p2p')} SELECT account_id, round(burst_ratio, 6) AS burst_ratio, round(median_hold_minutes, 6) AS median_hold_minutes FROM tm", "p2p"),
    "g12_degree_centrality": oracle(DEGREE_SQL, "p2p", "members"),
    "g13_pagerank": oracle(PAGERANK_SQL, "p2p", "members"),
    "g14_clustering": oracle(CLUSTERING_SQL, "p2p"),
    "g16_features": oracle(FEATURES_SQL, "p2p", "members"),
    "g17_parallel_edges": oracle("SELECT source, target, CAST(sum(amount) AS DOUBLE) AS total, count(*) AS n FROM tx GROUP BY 1, 2", "tx"),
}
