"""Matching of transfers across banks that publish only their boundary."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kestrel.session import materialise


def assign(communities: DataFrame, banks: int) -> DataFrame:
    """B1: communities in order of size dealt back and forth over the banks, which keeps the banks' sizes close."""
    n = F.row_number().over(W.orderBy(F.desc("size"), "community")) - 1  # one row a community
    turn, place = F.floor(n / banks), n % banks
    return communities.withColumn("bank_id", F.when(turn % 2 == 0, place).otherwise(banks - 1 - place).cast("int"))


def cut(tx: DataFrame, owners: DataFrame) -> DataFrame:
    """Transfers with both ends' banks; ``cross`` where they differ."""
    a = owners.select(F.col("account_id").alias("source"), F.col("bank_id").alias("bank_s"))
    b = owners.select(F.col("account_id").alias("target"), F.col("bank_id").alias("bank_t"))
    return tx.join(a, "source").join(b, "target").withColumn("cross", F.col("bank_s") != F.col("bank_t"))


def local_features(edges: DataFrame) -> DataFrame:
    """Per account of a bank five sums over its local transfers, each over the bank's largest."""
    local = edges.where(~F.col("cross"))
    ins = local.groupBy(F.col("bank_t").alias("bank_id"), F.col("target").alias("account_id")).agg(F.sum(F.col("amount").cast("double")).alias("total_in"), F.count("*").alias("n_in"), F.countDistinct("source").alias("senders"))
    outs = local.groupBy(F.col("bank_s").alias("bank_id"), F.col("source").alias("account_id")).agg(F.sum(F.col("amount").cast("double")).alias("total_out"), F.count("*").alias("n_out"))
    both = ins.join(outs, ["bank_id", "account_id"], "full").na.fill(0)
    most = lambda c: F.greatest(F.max(c).over(W.partitionBy("bank_id")), F.lit(1e-9))
    return both.select("bank_id", "account_id", *[(F.col(c) / most(c)).alias(c) for c in ("total_in", "n_in", "senders", "total_out", "n_out")])


def neighbour_means(edges: DataFrame, features: DataFrame, columns: list[str], rounds: int = 2) -> DataFrame:
    """Each account's features and the mean of its neighbours', ``rounds`` times, side by side."""
    pairs = edges.select(F.col("source").alias("account_id"), F.col("target").alias("other")).union(edges.select("target", "source")).distinct()
    out, names = features.select("account_id", *columns), list(columns)
    for k in range(rounds):
        means = pairs.join(out.select(F.col("account_id").alias("other"), *names), "other").groupBy("account_id").agg(*[F.avg(c).alias(f"{c}_m{k + 1}") for c in names])
        out = out.join(means, "account_id", "left").na.fill(0.0)
        names = names + [f"{c}_m{k + 1}" for c in names]
    return out


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)


def pair_scores(boundary: DataFrame, cents: int = 3, seconds: int = 9, embeddings: tuple[str, ...] = ("embedding",)) -> DataFrame:
    """Outgoing and incoming boundary records of different banks within ``cents`` and ``seconds``, with their score. A
    band join: both axes are cut into cells as wide as the band, and a record asks the 3 x 3 cells around it. Records meet once for
    all columns of ``embeddings``: more than one gives an array of scores in their order. Squares of lengths are summed once a record."""
    cell = lambda c, w: F.floor(F.col(c) / (w + 1))
    known = boundary.withColumns({f"_n{k}": dot(F.col(c), F.col(c)) for k, c in enumerate(embeddings)})
    kept = F.struct("vec_id", "bank_id", "amount_cents", "time_sec", *embeddings, *[f"_n{k}" for k in range(len(embeddings))])
    out = known.where("direction = 'out'").select(kept.alias("o"), F.explode(F.sequence(cell("amount_cents", cents) - 1, cell("amount_cents", cents) + 1)).alias("_a"), cell("time_sec", seconds).alias("_t0"))
    out = out.withColumn("_t", F.explode(F.sequence(F.col("_t0") - 1, F.col("_t0") + 1)))
    into = known.where("direction = 'in'").select(kept.alias("i"), cell("amount_cents", cents).alias("_a"), cell("time_sec", seconds).alias("_t"))
    d_c, d_t = F.abs(F.col("o.amount_cents") - F.col("i.amount_cents")), F.abs(F.col("o.time_sec") - F.col("i.time_sec"))
    met = out.join(into, ["_a", "_t"]).where((F.col("o.bank_id") != F.col("i.bank_id")) & (d_c <= cents) & (d_t <= seconds))
    cosine = lambda k, c: dot(F.col(f"o.{c}"), F.col(f"i.{c}")) / F.greatest(F.sqrt(F.col(f"o._n{k}") * F.col(f"i._n{k}")), F.lit(1e-12))
    near = 0.4 * F.greatest(F.lit(0.0), 1 - 0.3 * d_c), 0.4 * F.greatest(F.lit(0.0), 1 - 0.1 * d_t)
    scores = [0.2 * cosine(k, c) + near[0] + near[1] for k, c in enumerate(embeddings)]
    return met.select(F.col("o.vec_id").alias("out_id"), F.col("i.vec_id").alias("in_id"), (scores[0] if len(scores) == 1 else F.array(*scores)).alias("score"))


def one_to_one(pairs: DataFrame, least: float, by: tuple[str, ...] = ()) -> DataFrame:
    """Mutually best pairs, again on what is left until no pair is; greedy, equal to the optimum where best matches are
    unique. The best pair left is always mutual, so every round takes one or more. With ``by`` each of its values is matched by itself."""
    known = pairs.where((F.col("score") >= least) & F.col("out_id").isNotNull() & F.col("in_id").isNotNull())
    left, taken = materialise(known.groupBy(*by, "out_id", "in_id").agg(F.max("score").alias("score"))), None
    while taken is None or left.limit(1).count():
        best = lambda k, o: F.row_number().over(W.partitionBy(*by, k).orderBy(F.desc("score"), o))
        mutual = materialise(left.withColumn("a", best("out_id", "in_id")).withColumn("b", best("in_id", "out_id")).where("a = 1 AND b = 1").select(*by, "out_id", "in_id", "score"))
        taken = mutual if taken is None else taken.unionByName(mutual)
        left = materialise(left.join(mutual.select(*by, "out_id"), [*by, "out_id"], "left_anti").join(mutual.select(*by, "in_id"), [*by, "in_id"], "left_anti"))
    return taken


def noise(key: str, epsilon: float, delta: float = 1e-5, seed: int = 7) -> Column:
    """The embedding clipped to unit length with Gaussian noise of the (epsilon, delta) mechanism. The noise of a component follows
    from the row's key, its place and the seed, so a task that runs again adds the same."""
    sigma = 2 * math.sqrt(2 * math.log(1.25 / delta)) / epsilon
    length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, e: s + e.cast("double") * e.cast("double")))
    even = lambda d, k: (F.shiftrightunsigned(F.xxhash64(F.col(key), d, F.lit(seed), F.lit(k)), 11) + 0.5) / float(1 << 53)
    normal = lambda d: F.sqrt(-2 * F.log(even(d, 0))) * F.cos(2 * math.pi * even(d, 1))
    return F.transform("embedding", lambda e, d: e.cast("double") / F.greatest(length, F.lit(1.0)) + sigma * normal(d))


def noisy(boundary: DataFrame, key: str, epsilon: float, delta: float = 1e-5, seed: int = 7) -> DataFrame:
    return boundary.withColumn("embedding", noise(key, epsilon, delta, seed))
