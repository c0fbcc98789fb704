"""Merkle manifest of a dataset (operator 12).

Rows are leaves, put in order inside their group; the trees of the groups end in subroots, and the tree of these in the root. A
parent keeps a copy of its hash's state before each child's slot, so that folding a changed child starts from the state at its
slot and takes only the child and what stands right of it.

No task holds a group: leaves are numbered by range partitions and prefix sums, blocks of BLOCK leaves grow their lower levels
each in a task, and rounds over the blocks' digests, BLOCK times fewer each, grow the rest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from kestrel.session import materialise, reachable

#: Levels of a tree that one task grows, and nodes that it meets for that.
LEVELS = 10
BLOCK = 1 << LEVELS
EMPTY = hashlib.sha256()
#: One step from a node to its parent: what stands left and right of the node there.
PATH = T.ArrayType(T.StructType([T.StructField("left", T.BinaryType()), T.StructField("right", T.BinaryType())]))


def digest(fields: Sequence[Column]) -> Column:
    """SHA-256 of the fields in a row: each is `-` if null, else its count of UTF-8 bytes, `:` and itself; numbers are decimal."""
    texts = [f.cast("string") for f in fields]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def grow(nodes: list[bytes], levels: int | None) -> tuple[bytes, list[tuple[list[bytes], list[list]]]]:
    """The node (hex) on top of ``nodes`` after ``levels`` levels (None: as many as leave one node), and for each level its nodes and, for each
    parent, the states of its hash before each slot. A lone node is hashed too as long as levels are left."""
    tree = []
    while len(nodes) > 1 if levels is None else len(tree) < levels:
        parents, above = [], []
        for i in range(0, len(nodes), 2):
            state, before = EMPTY, []
            for child in nodes[i : i + 2]:
                before.append(state)
                state = state.copy()
                state.update(child)
            parents.append(before)
            above.append(state.hexdigest().encode())
        tree.append((nodes, parents))
        nodes = above
    return nodes[0], tree


def fold(node: bytes, at: int, tree: list[tuple[list[bytes], list[list]]]) -> bytes:
    """The node on top if ``node`` stood at place ``at``: every parent resumes the state before its slot."""
    for nodes, parents in tree:
        state = parents[at >> 1][at & 1].copy()
        state.update(node)
        if not at & 1 and at + 1 < len(nodes):
            state.update(nodes[at + 1])
        node = state.hexdigest().encode()
        at >>= 1
    return node


def siblings(at: int, tree: list[tuple[list[bytes], list[list]]]) -> Iterator[tuple[bytes | None, bytes | None]]:
    """(left, right) of the node at ``at`` and of those above it; at most one is there."""
    for nodes, _ in tree:
        other = nodes[at ^ 1] if at ^ 1 < len(nodes) else None
        yield (other, None) if at & 1 else (None, other)
        at >>= 1


def numbered(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """``rows`` (a table that reads the same each time) with their place ``at`` in their group, gapless from 0, and the group's count ``n``.

    Rows are dealt by ranges of (group, order), numbered inside each range and shifted by a prefix sum over the ranges, so a
    group of any size is spread over tasks. ``order`` should tell all rows apart, else a run of equal ones is one range.
    """
    reachable(rows.sparkSession)
    by = [F.col(group), *[F.col(c) for c in order]]
    schema = T.StructType([*rows.schema.fields, T.StructField("_range", T.IntegerType()), T.StructField("_in", T.LongType())])
    arrow, place = to_arrow_schema(schema), rows.columns.index(group)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = batch.column(place).dictionary_encode()
            code = codes.indices.to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
            first = codes.dictionary[int(code[0])].as_py()
            at = np.arange(len(code)) - np.repeat(starts, np.diff([*starts, len(code)]))
            held = seen if first == last else 0
            at[: starts[1] if len(starts) > 1 else len(at)] += held
            last, seen = codes.dictionary[int(code[-1])].as_py(), int(at[-1]) + 1
            columns = [batch.column(i).cast(arrow.field(i).type) for i in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.full(len(at), own, np.int32)), pa.array(at.astype(np.int64))], schema=arrow)

    placed = materialise(rows.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(number, schema))
    counts = placed.groupBy(group, "_range").agg(F.count("*").alias("_count"))
    before = W.partitionBy(group).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(
        group, "_range", F.coalesce(F.sum("_count").over(before), F.lit(0)).alias("_start"), F.sum("_count").over(W.partitionBy(group)).alias("n")
    )
    return placed.join(starts, [group, "_range"]).select(*rows.columns, (F.col("_start") + F.col("_in")).alias("at"), "n")


def in_blocks(n: int) -> int:
    return -(-n // BLOCK)


def hexed(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    return [x.hex().encode() for x in column.to_pylist()]


def climb(nodes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """nodes(group, at, digest, n) to roots(group, digest), and the tables of the rounds between them: for each block of a round its
    digest and the paths of its members."""
    schema = T.StructType.fromDDL("group string, at long, n long, digest binary").add(
        "members", T.ArrayType(T.StructType([T.StructField("at", T.LongType()), T.StructField("path", PATH)]))
    )
    arrow = to_arrow_schema(schema)

    def block(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("at")
        n, held = rows["n"][0].as_py(), hexed(rows["digest"])
        root, tree = grow(held, LEVELS if in_blocks(n) > 1 else None)
        bare = lambda x: x and bytes.fromhex(x.decode())
        members = [
            {"at": at, "path": [{"left": bare(a), "right": bare(b)} for a, b in siblings(i, tree)]} for i, at in enumerate(rows["at"].to_pylist())
        ]
        values = [[key[0].as_py()], [key[1].as_py()], [in_blocks(n)], [bytes.fromhex(root.decode())], [members]]
        return pa.Table.from_arrays([pa.array(v, f.type) for v, f in zip(values, arrow)], schema=arrow)

    rounds, now = [], nodes
    while (now.agg(F.max("n")).first()[0] or 0) > 1:
        up = now.select("group", "at", "n", "digest").withColumn("block", F.shiftright("at", LEVELS))
        now = materialise(up.groupBy("group", "block").applyInArrow(block, schema))
        rounds.append(now)
    return now.select("group", "digest"), rounds


def paths(rounds: Sequence[DataFrame], top: DataFrame) -> DataFrame:
    """(group, at, ..., path) of the nodes below ``rounds``, where ``top`` has a path for each group: every node's own steps, then its parent's."""
    known = top.withColumn("at", F.lit(0).cast("long"))
    for up in reversed(rounds):
        own = up.select("group", F.col("at").alias("_parent"), F.explode("members").alias("m"))
        above = known.withColumnsRenamed({"at": "_parent", "path": "_above"})
        known = own.join(above, ["group", "_parent"]).withColumns({"at": F.col("m.at"), "path": F.concat("m.path", "_above")}).drop("m", "_parent", "_above")
    return known


def manifest(leaves: DataFrame, key: str = "doc_id", group: str = "lang") -> DataFrame:
    """leaves(key, group, leaf, changed) to one row each: key, group, leaf, subroot, root, proof_sha256, folded_root, verified.

    ``leaf`` and ``changed`` are binary digests (null ``changed``: the leaf itself). Leaves ascend by key in their group (nulls first,
    rows of one key by their leaf); groups ascend by their text's bytes, nulls first. Every two consecutive nodes become
    the hash of their hex digests, a lone last one too, until one is left: the subroot, and over subroots the root. A lone leaf is its
    group's subroot. ``proof_sha256`` hashes the siblings from the leaf to the root; ``folded_root`` is the root that ``changed`` gives
    at the leaf's place with the siblings as they are, and ``verified`` whether it is the root.

    Repeated rows are leaves of their own; an empty table gives an empty table; other columns are not carried. Digests go to rounds
    of tables in the shared folder, BLOCK times fewer rows each.
    """
    kind = leaves.schema[key].dataType
    # A group's name starts with a sign, so that no name is the null group's and bytes keep their order.
    rows = materialise(
        leaves.select(
            F.coalesce(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")), F.lit("")).alias("group"),
            F.col(f"`{key}`").alias("key"),
            "leaf",
            "changed",
            F.monotonically_increasing_id().alias("row"),
        )
    )
    at = numbered(rows, "group", ["key", "leaf", "row"])
    schema = T.StructType.fromDDL("group string, at long, n long, digest binary, leaves array<binary>, changed array<binary>").add(
        "keys", T.ArrayType(kind)
    )
    arrow = to_arrow_schema(schema)

    def block(name: tuple, own: pa.Table) -> pa.Table:
        own = own.sort_by("at")
        blocks = in_blocks(own["n"][0].as_py())
        root, _ = grow(hexed(own["leaf"]), LEVELS if blocks > 1 else None)
        lists = [own[c].to_pylist() for c in ("leaf", "changed", "key")]
        values = [[name[0].as_py()], [name[1].as_py()], [blocks], [bytes.fromhex(root.decode())], *[[x] for x in lists]]
        return pa.Table.from_arrays([pa.array(v, f.type) for v, f in zip(values, arrow)], schema=arrow)

    dealt = at.withColumn("block", F.shiftright("at", LEVELS)).select("group", "block", "at", "n", "leaf", "changed", "key")
    blocks = materialise(dealt.groupBy("group", "block").applyInArrow(block, schema))
    subroots, lower = climb(blocks)
    tops = materialise(subroots.select(F.lit("").alias("group"), F.col("group").alias("name"), "digest"))
    ordered = materialise(numbered(tops, "group", ["name"]))
    roots, upper = climb(ordered)
    start = roots.select("group", F.array().cast(PATH).alias("path"), F.lower(F.hex("digest")).alias("root"))
    named = ordered.select("at", F.col("name").alias("group"), F.lower(F.hex("digest")).alias("subroot"))
    top = paths(upper, start).drop("group").join(named, "at").drop("at")
    climbs = blocks.join(paths(lower, top), ["group", "at"])
    out = T.StructType(
        [
            T.StructField(key, kind),
            T.StructField(group, T.StringType()),
            *[T.StructField(c, T.StringType()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")],
            T.StructField("verified", T.BooleanType()),
        ]
    )
    names, to = climbs.columns, to_arrow_schema(out)

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = dict(zip(names, (c[0].as_py() for c in batch.slice(i, 1).columns)))
                held = [x.hex().encode() for x in r["leaves"]]
                _, tree = grow(held, LEVELS if r["n"] > 1 else None)
                steps = [[s[k] and s[k].hex().encode() for k in ("left", "right")] for s in r["path"]]
                above = b"".join(x for s in steps for x in s if x)
                states = [(hashlib.sha256(left or b""), right) for left, right in steps]
                proofs, tops_ = [], []
                for k, node in enumerate(held):
                    own = b"".join(x for s in siblings(k, tree) for x in s if x)
                    proofs.append(hashlib.sha256(own + above).hexdigest())
                    now = fold(r["changed"][k].hex().encode() if r["changed"][k] else node, k, tree)
                    for before, right in states:
                        state = before.copy()
                        state.update(now)
                        if right:
                            state.update(right)
                        now = state.hexdigest().encode()
                    tops_.append(now.decode())
                m = len(held)
                name = r["group"][1:] if r["group"] else None
                values = [r["keys"], [name] * m, [x.decode() for x in held], [r["subroot"]] * m, [r["root"]] * m, proofs, tops_, [x == r["root"] for x in tops_]]
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, to)], schema=to)

    return climbs.mapInArrow(folded, out)
