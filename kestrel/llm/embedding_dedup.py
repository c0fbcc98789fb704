"""Embedding near-duplicates by NN-descent (operator 6)."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from kestrel.llm.common import with_columns_in_arrow
from kestrel.operators.components import components
from kestrel.session import materialise

#: Length of a neighbour list, rows of a leaf, trees a pass, queries of the recall audit, the recall that ends the passes.
NEIGHBOURS, LEAF, TREES, AUDITED, RECALL = 10, 256, 6, 256, 0.97
#: Passes that meet no link between saturated components before none is taken to be left.
QUIET = 2
#: Rows of one side of an exact block.
BLOCK = 1000


def unit(blobs: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(blobs), "<f8").reshape(len(blobs), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v): the components as doubles; null for vectors that link with nothing."""

    def start():
        def step(rows):
            out = []
            for r in rows:
                x = None if r is None or any(c is None for c in r) else np.array(r, "<f8")
                out.append(x.tobytes() if x is not None and len(x) and np.isfinite(x).all() and np.linalg.norm(x) > 0 else None)
            return [out]

        return step

    raw = df.select(F.col(f"`{key}`").alias("id"), F.col(f"`{vector}`").alias("e"))
    return with_columns_in_arrow(raw, ["e"], [T.StructField("v", T.BinaryType())], start).drop("e")


def leaves(nodes: DataFrame, total: int, seeds: range) -> DataFrame:
    """(leaf, members) of random-projection trees: a leaf is a sign pattern, cut at random where more than LEAF rows share it.
    Members carry their component where ``nodes`` has it."""
    own = [c for c in ("id", "v", "component") if c in nodes.columns]
    depth = max(0, math.ceil(math.log2(max(1, total / LEAF))))
    fields = [T.StructField("codes", T.ArrayType(T.LongType()))]

    def start():
        planes: dict[tuple[int, int], np.ndarray] = {}

        def step(blobs):
            codes: list = [None] * len(blobs)
            dims = np.array([len(b) // 8 for b in blobs])
            for d in np.unique(dims):
                own = np.flatnonzero(dims == d)
                x = unit([blobs[k] for k in own])
                made = []
                for seed in seeds:
                    if (d, seed) not in planes:
                        planes[d, seed] = np.random.default_rng([seed, int(d)]).standard_normal((int(d), max(1, depth)))
                    bits = (x @ planes[d, seed] > 0) if depth else np.zeros((len(x), 1))
                    made.append((bits * (1 << np.arange(bits.shape[1]))).sum(1).astype(np.int64))
                for row, k in zip(np.stack(made, 1), own):
                    codes[k] = row
            return [codes]

        return step

    coded = with_columns_in_arrow(nodes.select(*own), ["v"], fields, start)
    placed = coded.select(*own, F.octet_length("v").alias("dim"), F.posexplode("codes").alias("tree", "code"))
    sizes = placed.groupBy("tree", "dim", "code").agg(F.count("*").alias("n"))
    cut = placed.join(sizes, ["tree", "dim", "code"]).withColumn(
        "part", F.pmod(F.xxhash64("id", "tree", F.lit(seeds.start)), F.ceil(F.col("n") / LEAF))
    )
    return cut.groupBy("tree", "dim", "code", "part").agg(F.collect_list(F.struct(*own)).alias("members"))


def edges_type(id_type: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("src", id_type), T.StructField("dst", id_type), T.StructField("sim", T.DoubleType())])


def compared(groups: DataFrame, id_type: T.DataType, keep: int, bounded: bool, foreign: float | None = None) -> DataFrame:
    """Edges (src, dst, sim) from all pairs of each group's few members: the best ``keep`` of each member, or with
    ``bounded`` those that beat the member's own list. With ``foreign`` only pairs of different components count, from that
    similarity on."""
    arrow = to_arrow_type(id_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            src, dst, sim = [], [], []
            for members in batch.column(0).to_pylist():
                if len(members) < 2:
                    continue
                ids = [m["id"] for m in members]
                x = unit([m["v"] for m in members])
                s = x @ x.T
                np.fill_diagonal(s, -2.0)
                if foreign is not None:
                    group = np.unique([m["component"] for m in members], return_inverse=True)[1]
                    s[group[:, None] == group] = -2.0
                if bounded:
                    a, b = np.nonzero(s > np.array([m["least"] for m in members])[:, None])
                else:
                    k = min(keep, len(ids) - 1)
                    b = np.argpartition(-s, k - 1, axis=1)[:, :k].ravel()
                    a = np.repeat(np.arange(len(ids)), k)
                    if foreign is not None:
                        near = s[a, b] >= foreign
                        a, b = a[near], b[near]
                src += [ids[i] for i in a]
                dst += [ids[i] for i in b]
                sim += s[a, b].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(src, arrow), pa.array(dst, arrow), pa.array(sim, pa.float64())], names=["src", "dst", "sim"])

    return groups.select("members").mapInArrow(run, edges_type(id_type))


def best(edges: DataFrame, keep: int) -> DataFrame:
    """The ``keep`` most similar neighbours of each node; Spark prunes on the map side before the shuffle."""
    once = edges.groupBy("src", "dst").agg(F.max("sim").alias("sim"))
    ranked = once.withColumn("_r", F.row_number().over(W.partitionBy("src").orderBy(F.desc("sim"), "dst")))
    return ranked.where(F.col("_r") <= keep).drop("_r")


def descend(graph: DataFrame, nodes: DataFrame, id_type: T.DataType, floor: float) -> DataFrame:
    """One round: every node introduces its neighbours, and those that list it, to each other."""
    near = graph.where(F.col("sim") >= floor)
    back = near.withColumn("_r", F.row_number().over(W.partitionBy("dst").orderBy(F.desc("sim"), "src"))).where(F.col("_r") <= NEIGHBOURS)
    around = near.select(F.col("src").alias("at"), F.col("dst").alias("id")).unionByName(
        back.select(F.col("dst").alias("at"), F.col("src").alias("id"))
    ).distinct()
    least = graph.groupBy("src").agg(F.when(F.count("*") >= NEIGHBOURS, F.min("sim")).otherwise(F.lit(-2.0)).alias("least"))
    member = nodes.select("id", "v").join(least.withColumnRenamed("src", "id"), "id").withColumn("least", F.greatest("least", F.lit(floor)))
    groups = around.join(member, "id").groupBy("at").agg(F.collect_list(F.struct("id", "v", "least")).alias("members"))
    return compared(groups, id_type, NEIGHBOURS, True)


def dense_counts(crowd: DataFrame, id_type: T.DataType, threshold: float) -> DataFrame:
    """(id, links) inside each component of ``crowd`` (id, v, copies, component), exactly.

    This enlarges saturated neighbour lists to the whole component without listing pairs. Members within half the
    threshold's angle of the component's mean direction are all linked by the triangle inequality, so they are counted
    by subtraction; only the members outside that cone meet the component, in blocks of BLOCK rows.
    """
    cone = math.cos(math.acos(threshold) / 2) + 1e-9
    fields = [T.StructField("component", id_type), T.StructField("d", T.IntegerType()), T.StructField("s", T.ArrayType(T.DoubleType()))]
    key_type = to_arrow_type(id_type)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            for c, x in zip(batch.column(0).to_pylist(), unit(batch.column(1).to_pylist()) if batch.num_rows else ()):
                sums[c] = sums[c] + x if c in sums else x
            if len(sums) > 20_000:
                yield flush(sums)
                sums = {}
        yield flush(sums)

    def flush(sums: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(sums), key_type), pa.array([0] * len(sums), pa.int32()), pa.array([x.tolist() for x in sums.values()], pa.list_(pa.float64()))],
            names=["component", "d", "s"],
        )

    parts = crowd.select("component", "v").mapInArrow(partial, T.StructType(fields))
    means = (
        parts.select("component", F.posexplode("s").alias("d", "x"))
        .groupBy("component", "d").agg(F.sum("x").alias("x"))
        .groupBy("component").agg(F.transform(F.sort_array(F.collect_list(F.struct("d", "x"))), lambda p: p["x"]).alias("mean"))
    )

    def start():
        def step(blobs, mean):
            x, m = (unit(blobs), np.array(mean)) if len(blobs) else (np.zeros((0, 1)), np.zeros((0, 1)))
            size = np.linalg.norm(m, axis=1)
            return [((x * m).sum(1) >= cone * np.maximum(size, 1e-300)).tolist()]

        return step

    marked = materialise(
        with_columns_in_arrow(crowd.join(means, "component"), ["v", "mean"], [T.StructField("inner", T.BooleanType())], start).drop("mean")
    )
    sizes = marked.groupBy("component").agg(
        F.sum(F.when(F.col("inner"), F.col("copies")).otherwise(0)).alias("cone"),
        F.count("*").alias("rows"),
        F.sum(F.when(~F.col("inner"), 1).otherwise(0)).alias("outer"),
    )
    sized = marked.join(sizes, "component")
    certain = sized.select("id", F.when(F.col("inner"), F.col("cone") - F.col("copies")).otherwise(0).alias("links"))
    open_ = sized.where("outer > 0")
    n_rows, n_outer = F.ceil(F.col("rows") / BLOCK).cast("int"), F.ceil(F.col("outer") / BLOCK).cast("int")
    every = open_.withColumn("i", F.pmod(F.xxhash64("id"), n_rows).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), n_outer - 1)))
    outer = open_.where(~F.col("inner")).withColumn("j", F.pmod(F.xxhash64("id"), n_outer).cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), n_rows - 1)))
    columns = ["component", "i", "j", "id", "v", "copies", "inner"]
    cells = (
        every.select(*columns, F.lit(False).alias("asks")).unionByName(outer.select(*columns, F.lit(True).alias("asks")))
        .groupBy("component", "i", "j").agg(F.collect_list(F.struct("id", "v", "copies", "inner", "asks")).alias("members"))
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, links = [], []
            for members in batch.column(0).to_pylist():
                ask, all_ = [m for m in members if m["asks"]], [m for m in members if not m["asks"]]
                if not ask or not all_:
                    continue
                hit = unit([m["v"] for m in ask]) @ unit([m["v"] for m in all_]).T >= threshold
                place = {m["id"]: k for k, m in enumerate(all_)}
                for k, m in enumerate(ask):
                    if m["id"] in place:
                        hit[k, place[m["id"]]] = False
                ids += [m["id"] for m in ask]
                links += (hit @ np.array([m["copies"] for m in all_], np.int64)).tolist()
                inner = np.array([m["inner"] for m in all_])
                ids += [m["id"] for m in all_ if m["inner"]]
                links += (np.array([m["copies"] for m in ask], np.int64) @ hit[:, inner]).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(ids, key_type), pa.array(links, pa.int64())], names=["id", "links"])

    counted = cells.select("members").mapInArrow(count, T.StructType([T.StructField("id", id_type), T.StructField("links", T.LongType())]))
    return certain.unionByName(counted).groupBy("id").agg(F.sum("links").alias("links"))


def joined_crowds(links: DataFrame, full: DataFrame, nodes: DataFrame, id_type: T.DataType, threshold: float, first_seed: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(links, components, components with a saturated list, their members) after links between saturated components are added.

    A link that neither end's list holds has two saturated ends, so only components with such nodes can lack one. Their members are
    dealt into leaves of new trees and compared with members of other components alone, which no list of their own can
    crowd out; what is met joins the components, until nothing is met in QUIET passes running.
    """
    quiet = 0
    for turn in itertools.count():
        found = materialise(components(links))
        crowded = materialise(found.join(full, "node", "left_semi").select("component").distinct())
        crowd = materialise(found.join(crowded, "component", "left_semi").withColumnRenamed("node", "id").join(nodes, "id"))
        if crowded.limit(2).count() < 2:
            return links, found, crowded, crowd
        seeds = range(first_seed + turn * TREES, first_seed + (turn + 1) * TREES)
        met = materialise(compared(leaves(crowd, crowd.count(), seeds), id_type, NEIGHBOURS, False, threshold).distinct())
        quiet = 0 if met.limit(1).count() else quiet + 1
        if quiet == QUIET:
            return links, found, crowded, crowd
        links = links.unionByName(met)


def audit(nodes: DataFrame, found: DataFrame, threshold: float) -> float:
    """Share of the true links of AUDITED nodes and of AUDITED that have links (the first by hash) that ``found`` (id, links to
    other nodes) has; their vectors are compared with every row."""
    first = lambda df: df.orderBy(F.xxhash64("id", F.lit(77)), "id").limit(AUDITED)
    linked = nodes.join(found.where("links > 0").select("id").distinct(), "id", "left_semi")
    asked = first(nodes.select("id", "v")).unionByName(first(linked.select("id", "v"))).distinct()
    rows = [(r.id, bytes(r.v)) for r in asked.select("id", "v").collect()]
    sent = nodes.sparkSession.sparkContext.broadcast(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(len(sent.value), np.int64)
        for batch in batches:
            ids, blobs, copies = (batch.column(i).to_pylist() for i in range(3))
            lengths = np.array([len(b) for b in blobs])
            for d in {len(v) for _, v in sent.value}:
                own, ask = np.flatnonzero(lengths == d), [k for k, (_, v) in enumerate(sent.value) if len(v) == d]
                if not len(own):
                    continue
                hit = unit([sent.value[k][1] for k in ask]) @ unit([blobs[k] for k in own]).T >= threshold
                place = {ids[k]: n for n, k in enumerate(own)}
                for n, k in enumerate(ask):
                    if sent.value[k][0] in place:
                        hit[n, place[sent.value[k][0]]] = False
                sums[ask] += hit @ np.array([copies[k] for k in own], np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums), dtype=np.int32)), pa.array(sums)], names=["q", "links"])

    true = {r.q: r.links for r in nodes.select("id", "v", "copies").mapInArrow(run, "q int, links long").groupBy("q").agg(F.sum("links").alias("links")).collect()}
    spark = nodes.sparkSession
    wanted = spark.createDataFrame([(i,) for i, _ in rows], T.StructType([nodes.schema["id"]])) if rows else nodes.select("id").limit(0)
    have = {r.id: r.links for r in found.join(F.broadcast(wanted), "id").collect()}
    total = sum(true.values())
    return sum(min(true.get(k, 0), have.get(i, 0)) for k, (i, _) in enumerate(rows)) / total if total else 1.0


def near_duplicates(
    df: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = 0.9, max_passes: int = 5
) -> DataFrame:
    """(key, n_links, component_id, kept): links are pairs with cosine of at least ``threshold``, in double precision.

    Equal vectors form a class with one node. A neighbour graph starts from the leaves of random-projection trees and is refined by
    rounds of NN-descent until few lists change. Edges over the threshold make components; a component with a
    saturated list (NEIGHBOURS links and so perhaps more) is joined with others like it, see joined_crowds, and counted exactly, see
    dense_counts. The recall is audited against brute force, and while it is under RECALL another pass with more trees
    refines the graph; after ``max_passes`` this is an error.

    Null, zero, and non-finite vectors link with nothing, nor do vectors of different lengths; repeated ids of equal vectors count as
    copies. Other columns are ignored. An empty table gives an empty table.
    """
    rows = materialise(vectors(df, key, vector))
    id_type = rows.schema["id"].dataType
    nodes = materialise(rows.where("v is not null").groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("copies")))
    # Two classes may share a repeated id; the id then stands for the first of them.
    total, floor = nodes.count(), 2 * threshold**2 - 1
    graph, joined = None, None
    for turn in range(max_passes):
        start = compared(leaves(nodes, total, range(turn * TREES, (turn + 1) * TREES)), id_type, NEIGHBOURS, False)
        graph = materialise(best(start if graph is None else start.unionByName(graph), NEIGHBOURS))
        for _ in range(3):
            improved = materialise(descend(graph, nodes, id_type, floor))
            new = improved.join(graph.select("src", "dst"), ["src", "dst"], "left_anti").distinct()
            changed = new.count()
            graph = materialise(best(graph.unionByName(improved), NEIGHBOURS))
            if changed < 0.005 * NEIGHBOURS * max(1, total):
                break
        links = graph.where(F.col("sim") >= threshold)
        links = materialise(links if joined is None else links.unionByName(joined).dropDuplicates(["src", "dst"]))
        both = links.select("src", "dst").unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
        full = materialise(links.groupBy("src").count().where(F.col("count") >= NEIGHBOURS).select(F.col("src").alias("node")))
        joined, found, crowded, crowd = joined_crowds(links, full, nodes, id_type, threshold, (max_passes + turn) * 1000)
        sparse = (
            both.join(found.join(crowded, "component", "left_anti").select(F.col("node").alias("src")), "src", "left_semi")
            .join(nodes.select(F.col("id").alias("dst"), "copies"), "dst")
            .groupBy(F.col("src").alias("id")).agg(F.sum("copies").alias("links"))
        )
        counts = materialise(sparse.unionByName(dense_counts(crowd.select("id", "v", "copies", "component"), id_type, threshold)))
        recall = audit(nodes, counts, threshold)
        if recall >= RECALL:
            break
    else:
        raise RuntimeError(f"recall of links is {recall:.3f} after {max_passes} passes, under {RECALL}")
    rep = nodes.select("v", F.col("id").alias("rep"), "copies")
    done = (
        rows.join(rep, "v", "left")
        .join(counts.select(F.col("id").alias("rep"), "links"), "rep", "left")
        .join(found.withColumnRenamed("node", "rep"), "rep", "left")
    )
    component = F.coalesce("component", "rep", "id")
    return done.select(
        F.col("id").alias(key),
        (F.coalesce("links", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))).cast("long").alias("n_links"),
        component.alias("component_id"),
        (F.col("id") == component).alias("kept"),
    )
