"""URL filters by a sorted sweep over reversed hosts (operator 8). DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kestrel.llm.common import without

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """Up to `/`, `?`, `#` or the end after the first `://`, A-Z lower-cased; empty without one or for null."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def reversed_host(host: Column) -> Column:
    """`a.b.org` -> `org.b.a.`: a host and its subdomains fill the interval [key, key with its last `.` made `/`)."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def rules_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """(verdict, host, path) triples as a table."""
    rows = [F.struct(F.lit(v).alias("verdict"), F.lit(h).alias("rule_host"), F.lit(p).alias("rule_path")) for v, h, p in rules]
    return spark.range(1).select(F.inline(F.array(*rows))) if rows else spark.sql("select '' verdict, '' rule_host, '' rule_path where false")


def boundaries(rules: DataFrame) -> DataFrame:
    """(at, stack): where the set of active host intervals changes, and the rules active from there on.

    Host intervals nest or are disjoint, so the stack at the start of a host's interval holds the rules of the host and
    of its parents, and at its end those of its parents: an equi-join on the parents' names, linear in the rules.
    """
    by_host = rules.groupBy("rule_host").agg(F.collect_set(F.struct("rule_host", "rule_path", "verdict")).alias("own"))
    labels = F.split("rule_host", r"\.")
    up = by_host.select(
        "rule_host",
        F.posexplode(
            F.transform(
                F.sequence(F.lit(1), F.size(labels)),
                lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
            )
        ).alias("depth", "parent"),
    )
    active = up.join(by_host.select(F.col("rule_host").alias("parent"), "own"), "parent")
    stacks = active.groupBy("rule_host").agg(
        F.flatten(F.collect_list("own")).alias("inside"),
        F.flatten(F.collect_list(F.when(F.col("depth") > 0, F.col("own")))).alias("outside"),
    )
    start = reversed_host(F.col("rule_host"))
    end = F.concat(F.expr("substring(_start, 1, length(_start) - 1)"), F.lit("/"))
    edges = stacks.withColumn("_start", start).withColumn("_end", end)
    return edges.select(F.col("_start").alias("at"), F.col("inside").alias("stack")).unionByName(
        edges.select(F.col("_end").alias("at"), F.col("outside").alias("stack"))
    )


def judge_urls(df: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", lanes: int | None = None) -> DataFrame:
    """Append host, path, rule and verdict to ``df``.

    ``rules`` is (verdict, rule_host, rule_path). URLs are dealt at random into ``lanes``; every lane gets all interval
    boundaries, sorts both by the reversed host, and sweeps once, each URL taking the stack of the last boundary at or
    before it. A host with a third of all rows is spread over all lanes, and nothing is broadcast. Of the active rules
    whose path starts the URL's path the longest rule string wins, then the longer host. ``default`` holds where no
    rule fits. Null or malformed URLs have an empty host and path and no rule; rows repeat as they come; an empty table
    or an empty rule set is fine; input columns named like an output are replaced.
    """
    made = ["host", "path", "rule", "verdict"]
    spark = df.sparkSession
    lanes = lanes or int(spark.conf.get("spark.sql.shuffle.partitions"))
    kept = without(df, made)
    source = F.col(f"`{url}`")
    rows = df.select(
        F.struct(*[F.col(f"`{c}`") for c in kept.columns]).alias("row"), host_of(source).alias("host"), path_of(source).alias("path")
    ).select(
        (F.floor(F.rand(8) * lanes)).cast("int").alias("lane"),
        reversed_host(F.col("host")).alias("at"),
        F.lit(1).alias("kind"),
        "row",
        "host",
        "path",
    )
    edges = boundaries(rules).withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1)))).withColumn("kind", F.lit(0))
    sweep = W.partitionBy("lane").orderBy("at", "kind").rowsBetween(W.unboundedPreceding, W.currentRow)
    swept = rows.unionByName(edges, allowMissingColumns=True).withColumn("stack", F.last("stack", ignorenulls=True).over(sweep))
    fits = F.filter("stack", lambda r: F.startswith(F.col("path"), r["rule_path"]))
    ranked = F.transform(
        fits,
        lambda r: F.struct(
            (F.length(r["rule_host"]) + F.length(r["rule_path"])).alias("size"),
            F.length(r["rule_host"]).alias("host_size"),
            F.concat(r["rule_host"], r["rule_path"]).alias("rule"),
            r["verdict"].alias("verdict"),
        ),
    )
    best = swept.where("kind = 1").withColumn("best", F.array_max(ranked))
    return best.select(
        "row.*", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )
