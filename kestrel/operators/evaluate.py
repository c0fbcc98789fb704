"""Evaluation of scored rows (label 0/1, score): thresholds, curves, splits. Scores are counted once each first, so cumulative
windows run over distinct scores and not over rows."""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kestrel.session import materialise


#: Ranges that scores are cut into, of about as many distinct scores each.
RANGES = 1024


def by_score(df: DataFrame) -> DataFrame:
    return df.groupBy("score").agg(F.sum(F.col("label").cast("long")).alias("pos"), F.count("*").alias("n"))


def cumulated(t: DataFrame, columns: list[str], down: bool) -> DataFrame:
    """Append the running sum of each column (as name_c) over the distinct scores of ``t`` from the highest down or the lowest up. Scores are cut
    into ranges at approximate quantiles of themselves, so that nearly equal scores fill no range either; sums run inside a range and
    are shifted by a prefix sum over the ranges, so no task sees all scores. The cuts are at most RANGES numbers. Null scores have no row."""
    t = materialise(t.where("score IS NOT NULL"))
    score = F.col("score").cast("double")
    cuts = t.agg(F.percentile_approx(score, [k / RANGES for k in range(1, RANGES)], 10 * RANGES)).first()[0] or []
    splits = [-math.inf, *sorted({c for c in cuts if not math.isnan(c)} or {0.0}), math.inf]
    parted = Bucketizer(splits=splits, inputCol="_x", outputCol="_p", handleInvalid="keep").transform(t.withColumn("_x", score)).drop("_x")
    sums = parted.groupBy("_p").agg(*[F.sum(c).alias(c) for c in columns])
    order = (lambda c: F.desc(c)) if down else (lambda c: F.asc(c))
    before = W.orderBy(order("_p")).rowsBetween(W.unboundedPreceding, -1)  # one row a range
    starts = sums.select("_p", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_s_{c}") for c in columns])
    inside = W.partitionBy("_p").orderBy(order("score")).rowsBetween(W.unboundedPreceding, W.currentRow)
    out = parted.join(starts, "_p")
    return out.select(*t.columns, *[(F.sum(c).over(inside) + F.col(f"_s_{c}")).alias(f"{c}_c") for c in columns])


def threshold_table(df: DataFrame) -> DataFrame:
    """Precision and recall of every threshold: rows at or over it are called positive."""
    t = cumulated(by_score(df), ["pos", "n"], True)
    total = df.agg(F.sum(F.col("label").cast("long")).alias("total"))
    recall = lambda c: F.col(c) / F.greatest("total", F.lit(1))
    return t.crossJoin(F.broadcast(total)).select("score", F.col("pos_c").alias("tp"), F.col("n_c").alias("called"), (F.col("pos_c") / F.col("n_c")).alias("precision"), recall("pos_c").alias("recall"), recall("pos").alias("step"))


def precision_floor(df: DataFrame, floor: float) -> DataFrame:
    """M4: the threshold of the highest recall among those of at least the floor's precision (the lowest on ties); without
    one, the threshold of the highest precision."""
    t = threshold_table(df).withColumn("ok", F.col("precision") >= floor)
    rank = F.struct(F.col("ok"), F.when(F.col("ok"), F.col("recall")).otherwise(F.col("precision")), -F.col("score"))
    return t.agg(F.max_by(F.struct("score", "precision", "recall", "ok"), rank).alias("b")).select("b.*")


def auc(df: DataFrame) -> DataFrame:
    """M6: ROC-AUC by average ranks: for each positive the share of negatives below, ties half."""
    own = by_score(df).withColumn("neg", F.col("n") - F.col("pos"))
    t = cumulated(own, ["neg"], False).withColumn("lower", F.col("neg_c") - F.col("neg"))
    return t.agg((F.sum(F.col("pos") * (F.col("lower") + F.col("neg") / 2)) / (F.sum("pos") * F.sum("neg"))).alias("auc"))


def average_precision(df: DataFrame) -> DataFrame:
    """M7: precision summed over the steps of recall."""
    return threshold_table(df).agg(F.sum(F.col("step") * F.col("precision")).alias("average_precision"))


def confusion(df: DataFrame, threshold: float) -> DataFrame:
    """M8: counts and precision, recall at a threshold; 0 where undefined."""
    hit, real = F.col("score") >= threshold, F.col("label") == 1
    c = df.agg(*[F.sum((a & b).cast("long")).alias(n) for n, a, b in (("tp", hit, real), ("fp", hit, ~real), ("fn", ~hit, real), ("tn", ~hit, ~real))])
    ratio = lambda a, b: F.when(F.col(a) + F.col(b) > 0, F.col(a) / (F.col(a) + F.col(b))).otherwise(0.0)
    return c.select("*", ratio("tp", "fp").alias("precision"), ratio("tp", "fn").alias("recall"))


def two_sided(df: DataFrame, floor: float = 0.97, least: float = 0.5, rows: int = 10, share: float = 0.05, gap: float = 0.05) -> DataFrame:
    """M5: (upper, lower): the lowest cut from ``least`` on with the floor's precision above it, and the widest band from
    below with at least ``rows`` rows and at most ``share`` positives that stays ``gap`` under it."""
    upper = threshold_table(df).where((F.col("precision") >= floor) & (F.col("score") >= least)).agg(F.coalesce(F.min("score"), F.lit(1.0)).alias("upper"))
    low = cumulated(by_score(df), ["pos", "n"], False).where((F.col("n_c") >= rows) & (F.col("pos_c") <= share * F.col("n_c")))
    return low.crossJoin(F.broadcast(upper)).where(F.col("score") <= F.col("upper") - gap).agg(F.max("score").alias("lower")).crossJoin(upper)


def group_split(df: DataFrame, group: str) -> DataFrame:
    """M3: train, validation or test by a digest of the group, so that no group is on two sides."""
    band = F.conv(F.substring(F.md5(F.col(group).cast("string").cast("binary")), 1, 8), 16, 10).cast("long") % 100
    return df.withColumn("split", F.when(band < 60, "train").when(band < 80, "validation").otherwise("test"))


def alternating(df: DataFrame, family: str, order: str) -> DataFrame:
    """Even rows of each family adapt, odd ones evaluate."""
    return df.withColumn("side", F.when((F.row_number().over(W.partitionBy(family).orderBy(order)) - 1) % 2 == 0, "adapt").otherwise("held_out"))


def balanced(df: DataFrame, order: str) -> DataFrame:
    """As many rows of each label as the smaller class has, first by ``order``."""
    sizes = df.groupBy("label").count().agg(F.min("count").alias("least"))
    ranked = df.withColumn("_r", F.row_number().over(W.partitionBy("label").orderBy(order)))
    return ranked.crossJoin(F.broadcast(sizes)).where(F.col("_r") <= F.col("least")).drop("_r", "least")


def latest(df: DataFrame, key: str, order: Column, keep: Column) -> DataFrame:
    """The last snapshot of each key, of the rows to keep."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(order.desc()))).where("_r = 1").drop("_r").where(keep)
