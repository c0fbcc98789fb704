"""Connected components of an edge table (K2), by alternating large-star and small-star steps.

Each part of the edge table is first contracted by itself. Then every step is a shuffle by vertex followed by a minimum, so no task
ever holds a component, and the number of rounds grows with the logarithm of the longest chain. Lineage is cut each round in
the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from kestrel.session import materialise, reachable

#: Nodes that one task holds while it contracts its part of the edges.
HELD = 1_000_000


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """edges(u, v). Large star: every larger neighbour of u links to the least of u and its neighbours.
    Small star: u and its smaller neighbours do."""
    if larger:
        around = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        around = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    moved = around.join(least, "u")
    if larger:
        moved = moved.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))
        )
    return moved.where("u <> v").distinct()


def _contracted(pairs: DataFrame) -> DataFrame:
    """Edges (u, v), u > v, that join the same nodes as ``pairs``: each part of the table gives a tree a component, no shuffle."""
    kind = to_arrow_type(pairs.schema["u"].dataType)

    def edges(parent: dict) -> pa.RecordBatch:
        ends = [(x, root(parent, x)) for x, p in parent.items() if p != x]
        return pa.RecordBatch.from_arrays([pa.array([e[k] for e in ends], kind) for k in (0, 1)], names=["u", "v"])

    def root(parent: dict, x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict = {}
        for batch in batches:
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = root(parent, parent.setdefault(x, x)), root(parent, parent.setdefault(y, y))
                parent[max(a, b)] = min(a, b)
            if len(parent) > HELD:
                yield edges(parent)
                parent = {}
        yield edges(parent)

    return pairs.mapInArrow(run, pairs.schema).distinct()


def _unsettled(now: DataFrame) -> bool:
    """Whether some node has two parents, or a parent that has one itself."""
    ends = now.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        now.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    return bool(ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR (up = 1 AND down = 1)").limit(1).count())


def components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node that occurs in an edge; component is the least node reachable.

    Nulls on either side and self-loops are ignored (a node met only in a self-loop has no row); repeated edges count
    once. An empty edge table gives an empty result. Nodes may be of any orderable type. Rounds that do not settle are an error.
    """
    reachable(edges.sparkSession)
    pairs = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u <> v")
    now = materialise(_contracted(pairs))
    for _ in range(max_rounds):
        if not _unsettled(now):
            break
        now = materialise(_star(_star(now, True), False))
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    least = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        least.select("node", F.col("node").alias("component"))
    )
