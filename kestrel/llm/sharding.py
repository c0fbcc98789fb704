"""Sharding by jump consistent hashing (operator 10)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kestrel.llm.common import without

#: Fixed values of the published jump hash: the multiplier of its linear congruential step.
MULTIPLIER = 2862933555777941757
#: Slots are counted first in this many parts of a shard, so that no task numbers a whole shard.
PARTS = 4096


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key among ``shards``, for all keys at once."""
    key = keys.astype(np.int64).view(np.uint64).copy()
    at, ahead = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
    live = np.ones(len(key), bool)
    while live.any():
        at[live] = ahead[live]
        key[live] = key[live] * np.uint64(MULTIPLIER) + np.uint64(1)
        step = float(1 << 31) / ((key[live] >> np.uint64(33)).astype(np.float64) + 1.0)
        ahead[live] = ((at[live] + 1) * step).astype(np.int64)
        live &= ahead < shards
    return at


def shard_of(key: Column, shards: int) -> Column:
    """``key`` is a long column without nulls."""

    @F.pandas_udf(T.IntegerType())
    def udf(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.to_numpy(dtype=np.int64), shards).astype(np.int32))

    return udf(key)


def long_key(df: DataFrame, key: str) -> Column:
    """Integer keys stand for themselves; others are hashed. A null key counts as 0."""
    kind = df.schema[key].dataType
    own = F.col(f"`{key}`").cast("long") if isinstance(kind, T.IntegralType) else F.xxhash64(F.col(f"`{key}`"))
    return F.coalesce(own, F.lit(0).cast("long"))


def assign_shards(df: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 8) -> DataFrame:
    """Append size, text_crc32, law, shard, slot and grown_shard to ``df``.

    ``shard`` depends on the key and the shard count alone; with one more shard (``grown_shard``) a row either stays or
    moves to the new shard. ``slot`` is gapless from 0 in each shard, ordered by (key mod PARTS, key, size, crc): rows
    are numbered inside (shard, part) and shifted by a prefix sum over the parts' counts, a table of at most
    ``shards * PARTS`` rows, which is why broadcasting it is safe.

    Null text counts as empty (size 1, crc of nothing), a null key as 0, repeated rows each get a slot of their own,
    an empty table gives an empty table, and input columns named like an output are replaced.
    """
    made = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    kept = [F.col(f"`{c}`") for c in without(df, made).columns]
    # The input's columns travel inside one, so that no name of theirs meets one of these.
    keyed = df.select(F.struct(*kept).alias("row"), long_key(df, key).alias("key"), (F.octet_length(body).cast("long") + 1).alias("size"), F.crc32(body.cast("binary")).alias("crc"))
    keyed = keyed.withColumns({"part": F.pmod("key", F.lit(PARTS)).cast("int"), "shard": shard_of(F.col("key"), shards), "grown": shard_of(F.col("key"), shards + 1)})
    from pyspark.sql import Window as W

    counts = keyed.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = W.partitionBy("shard").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = W.partitionBy("shard", "part").orderBy("key", "size", "crc")
    slotted = keyed.withColumn("rank", F.row_number().over(inside) - 1).join(F.broadcast(starts), ["shard", "part"])
    return slotted.select(
        "row.*", "size", F.col("crc").alias("text_crc32"), F.lit("key").alias("law"), "shard", (F.col("start") + F.col("rank")).alias("slot"), F.col("grown").alias("grown_shard")
    )


def write_shards(df: DataFrame, path: str, **options) -> None:
    """Write one folder a shard, rows in slot order inside each file."""
    placed = assign_shards(df, **options)
    placed.repartition("shard", F.floor(F.col("slot") / 1_000_000)).sortWithinPartitions("shard", "slot").write.partitionBy(
        "shard"
    ).parquet(path)
