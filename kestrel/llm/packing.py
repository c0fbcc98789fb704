"""Packing of documents into fixed-size token sequences by fitted patterns (operator 4)."""

from __future__ import annotations

import json
import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from kestrel.llm.common import releasing, without
from kestrel.session import materialise

#: Fixed value: the split pattern of public byte-level vocabularies, which a file names by its ByteLevel pre-tokenizer.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Fraction of a repeat from which it counts as a whole one.
ROUND_UP = 0.8
#: Pairs leave at most one part in so many of a sequence, triples so many tokens; cost of a gap of a whole sequence, in highest counts.
PAIR_GAP, TRIPLE_GAP, GAP_COST = 8, 1, 0.3
#: Rows that one task numbers at a time when pieces of one length are ranked.
PART_ROWS = 1000


def byte_letters() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the rest for code points from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


def byte_level(model: dict) -> bool:
    """Whether a vocabulary file is plain byte-pair encoding over bytes with the split pattern above and merges in the order of
    their ids, which the faster engine does the same way."""
    split, pairs = model.get("pre_tokenizer") or {}, model["model"]
    if model.get("normalizer") or pairs.get("type") != "BPE" or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
        return False
    if any(pairs.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback")):
        return False
    if any(t.get(k) for t in model.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip", "normalized")):
        return False
    merged = [pairs["vocab"].get("".join(m if isinstance(m, list) else m.split(" "))) for m in pairs["merges"]]
    return None not in merged and merged == sorted(merged)


@lru_cache(maxsize=2)
def encoder(path: str):
    """text -> ids, equal to those of the tokenizers library for the vocabulary file at ``path`` with add_special_tokens=False;
    special tokens that a text spells out are ids of their own, as there. Files that are plain byte-level vocabularies (byte_level)
    go through a faster byte-pair engine, others through the library."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    if not byte_level(model):
        from tokenizers import Tokenizer

        plain = Tokenizer.from_file(path)
        return lambda text: plain.encode(text, add_special_tokens=False).ids
    import tiktoken

    letters = byte_letters()
    special = {t["content"]: t["id"] for t in model.get("added_tokens", [])}
    ranks = {bytes(letters[c] for c in word): i for word, i in model["model"]["vocab"].items() if word not in special}
    fast = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special)
    return lambda text: fast.encode(text, allowed_special="all", disallowed_special=())


def pieces(docs: DataFrame, tokenizer: str, key: str, text: str, size: int, end_id: int, keep_ids: bool) -> DataFrame:
    """One row a piece: key, piece, start, length, ids_crc32 and, where wanted, ids. Where a document is longer than
    ``size``, its first piece takes what is over full ones."""
    fields = [
        T.StructField(key, docs.schema[key].dataType),
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
    ]
    fields += [T.StructField("ids", T.ArrayType(T.IntegerType()))] if keep_ids else []
    schema = T.StructType(fields)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            made: list[list] = [[] for _ in fields]
            for k, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.array([*encode(body or ""), end_id], dtype="<u4")
                cuts = [0, *range(len(ids) % size or size, len(ids) + 1, size)] if len(ids) > size else [0, len(ids)]
                for n, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    row = [k, n, a, b - a, zlib.crc32(ids[a:b].tobytes())] + ([ids[a:b].astype(np.int32)] if keep_ids else [])
                    for column, value in zip(made, row):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(made, arrow)], schema=arrow)

    return docs.select(F.col(f"`{key}`"), F.col(f"`{text}`")).mapInArrow(releasing(run), schema)


def patterns(counts: np.ndarray) -> np.ndarray:
    """Pairs and triples of lengths in use that nearly fill a sequence: pairs leave at most an eighth of it, triples TRIPLE_GAP; a pair has 0 as
    its third."""
    size = len(counts) - 1
    used = np.flatnonzero(counts[:size] > 0)
    used = used[used > 0]
    a, b = (x.ravel() for x in np.meshgrid(used, used, indexing="ij"))
    keep = a >= b
    a, b = a[keep], b[keep]
    rest = size - a - b
    two = (rest >= 0) & (rest <= size // PAIR_GAP)
    found = [np.stack([a[two], b[two], np.zeros_like(a[two])], 1)]
    for gap in range(TRIPLE_GAP + 1):
        c = rest - gap
        three = (c > 0) & (c <= b) & (counts[np.clip(c, 0, size)] > 0)
        found.append(np.stack([a[three], b[three], c[three]], 1))
    return np.concatenate(found)


def gap_costs(rows: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """What one repeat of each pattern costs in the fit: its gap as a share of the sequence, in terms of the highest count."""
    size = len(counts) - 1
    return GAP_COST * max(1, counts.max()) * (size - rows.sum(1)) / size


def fit(rows: np.ndarray, counts: np.ndarray, tolerance: float = 3e-3) -> tuple[np.ndarray, np.ndarray]:
    """Non-negative least squares of pattern repeats against the histogram: (pattern numbers, repeats), to its optimality conditions.

    Half the weighted squares of what is short or over in each length, plus the cost of the gaps, is least. An active-set method:
    each round admits the patterns of the largest gradients that share no length and solves on those held; patterns
    that would repeat a negative number of times are dropped at once, or, where that does not lower the objective,
    one at a time on the way to the solution, which always does. It ends when no pattern outside has a gradient over
    ``tolerance`` of the highest count. The solution has at most as many patterns as there are lengths. Longer lengths weigh
    more: short pieces fill gaps anyway.
    """
    size = len(counts) - 1
    weight = 0.2 + np.arange(size + 1) / size
    weight[0] = 0.0
    cost, least = gap_costs(rows, counts), tolerance * max(1, counts.max())

    def products(held):
        """Of every two held patterns, the weights of the lengths that they share."""
        own = rows[held]
        return sum((own[:, i, None] == own[None, :, j]) * weight[own[:, i], None] for i in range(3) for j in range(3))

    def solved(table, target):
        return np.linalg.solve(table + 1e-9 * np.eye(len(target)), target)

    def short(held, value):
        return counts - np.bincount(rows[held].ravel(), np.repeat(value, 3), size + 1)

    def objective(held, value):
        return (weight * short(held, value) ** 2).sum() / 2 + (cost[held] * value).sum()

    def dropped_at_once(table, target):
        at = np.arange(len(target))
        while True:
            value = solved(table[np.ix_(at, at)], target[at])
            if (value > 0).all():
                return at, value
            at = at[value > 0]

    def dropped_singly(table, target, value):
        at = np.arange(len(target))
        while True:
            to = solved(table[np.ix_(at, at)], target[at])
            bad = to <= 0
            if not bad.any():
                return at, to
            fresh = bad & (value == 0)
            if fresh.any():
                keep = ~fresh
            else:
                way = (value[bad] / (value[bad] - to[bad])).min()
                value = np.maximum(value + way * (to - value), 0)
                keep = value > 1e-9
            at, value = at[keep], value[keep]

    held, value, lowest = np.zeros(0, int), np.zeros(0), math.inf
    while True:
        gain = (short(held, value) * weight)[rows].sum(1) - cost
        gain[held] = 0
        good = np.flatnonzero(gain > least)
        if not len(good):
            return held, value
        taken, new = np.zeros(size + 1, bool), []
        for p in good[np.argsort(-gain[good], kind="stable")]:
            own = rows[p][rows[p] > 0]
            if not taken[own].any():
                taken[own] = True
                new.append(p)
        wider = np.concatenate([held, np.array(new, int)])
        table, target = products(wider), (weight * counts)[rows[wider]].sum(1) - cost[wider]
        at, found = dropped_at_once(table, target)
        now = objective(wider[at], found)
        if now >= lowest - 1e-9 * abs(lowest):
            at, found = dropped_singly(table, target, np.concatenate([value, np.zeros(len(new))]))
            now = objective(wider[at], found)
            if now >= lowest - 1e-12 * abs(lowest):
                return held, value  # as far as the arithmetic goes
        held, value, lowest = wider[at], found, now


def best_fit(counts: np.ndarray, opened: list[tuple[tuple[int, ...], int]] = ()) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over a histogram, beginning with the sequences ``opened``: whole classes of equal sequences at a time, so the work
    depends on the number of lengths and not on the number of pieces."""
    size = len(counts) - 1
    room: dict[int, list[list]] = {}  # capacity left -> [pattern, sequences]
    for pattern, n in opened:
        room.setdefault(size - sum(pattern), []).append([pattern, n])
    for length in range(size, 0, -1):
        left = int(counts[length])
        for capacity in sorted(c for c in room if c >= length):
            if not left:
                break
            classes, room[capacity] = room[capacity], []
            for pattern, n in classes:
                each = capacity // length
                full = min(n, left // each)
                part = left - full * each if full < n else 0
                part = part if part < each else 0
                for many, take in ((full, each), (1 if part else 0, part)):
                    if many:
                        room.setdefault(capacity - take * length, []).append([pattern + (length,) * take, many])
                        left -= many * take
                        n -= many
                if n:
                    room[capacity].append([pattern, n])
        each = size // length
        for many, take in ((left // each, each), (1 if left % each else 0, left % each)):
            if many:
                room.setdefault(size - take * length, []).append([(length,) * take, many])
    return [(p, n) for classes in room.values() for p, n in classes]


def fitted(counts: np.ndarray) -> tuple[list[tuple[tuple[int, ...], int]], np.ndarray]:
    """(pattern, repeats) by the fit, and the histogram left over. Repeats are rounded up from ROUND_UP on and else down, and held
    to what there is, patterns of most repeats first."""
    rows, left, made = patterns(counts), counts.copy(), []
    if not len(rows):
        return made, left
    chosen, value = fit(rows, counts)
    for v, pattern in sorted(((v, tuple(int(x) for x in rows[p] if x)) for p, v in zip(chosen, value)), key=lambda x: (-x[0], x[1])):
        need = {x: pattern.count(x) for x in pattern}
        n = min(int(v + 1 - ROUND_UP + 1e-6), min(int(left[x]) // m for x, m in need.items()))
        if n > 0:
            made.append((pattern, n))
            for x, m in need.items():
                left[x] -= n * m
    return made, left


def plan(counts: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, repeats) for a histogram of piece lengths: rounded repeats of fitted patterns, then the residual packed best-fit into
    what they leave and into sequences of its own."""
    size = len(counts) - 1
    rest = counts.copy()
    rest[size] = 0
    made, left = fitted(rest)
    return ([((size,), int(counts[size]))] if counts[size] else []) + best_fit(left, made)


def slots(planned: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """length -> (first rank, first sequence, offset) of each run of ranks that one place of a pattern takes."""
    out: dict[int, list[list[int]]] = {}
    at, sequence = {}, 0
    for pattern, n in planned:
        offset = 0
        for length in pattern:
            out.setdefault(length, []).append([at.get(length, 0), sequence, offset])
            at[length] = at.get(length, 0) + n
            offset += length
        sequence += n
    return {k: tuple(np.array(v, np.int64).T) for k, v in out.items()}


def pack(
    docs: DataFrame,
    tokenizer: str,
    key: str = "doc_id",
    text: str = "text",
    size: int = 1024,
    end_id: int = 2,
    keep_ids: bool = False,
) -> DataFrame:
    """Tokenize ``docs`` and pack them into as few sequences of ``size`` tokens as possible.

    Returns a row for each piece: key, piece, start, length, ids_crc32, (ids,) sequence_id, offset. Every text ends with
    ``end_id``; null text is empty, so it still has that one token. The pieces are written to the shared folder, their
    lengths are counted into a histogram of ``size`` numbers, and only that goes to the driver, which fits and rounds
    the patterns. A piece's place follows from its rank among pieces of its length: pieces are numbered inside parts of
    about PART_ROWS rows and shifted by a prefix sum over the parts, so equal lengths never meet in one task. The plan
    that is sent to the tasks has a few thousand rows, bounded by ``size``. Repeated rows are packed as often as they
    occur; other columns are not carried; an empty table gives an empty table.
    """
    cut = materialise(pieces(docs, tokenizer, key, text, size, end_id, keep_ids))
    spark = docs.sparkSession
    counts = np.zeros(size + 1, np.int64)
    for length, n in cut.groupBy("length").agg(F.count("*")).collect():  # at most `size` rows
        counts[length] = n
    sent = spark.sparkContext.broadcast(slots(plan(counts)))
    parts = spark.createDataFrame(
        [(int(k), int(-(-counts[k] // PART_ROWS))) for k in np.flatnonzero(counts)], "length long, _parts long"
    )
    dealt = cut.join(F.broadcast(parts), "length").withColumn(
        "_part", F.pmod(F.xxhash64(F.col(f"`{key}`"), "piece"), F.col("_parts"))
    )
    before = W.partitionBy("length").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = (
        dealt.groupBy("length", "_part")
        .agg(F.count("*").alias("_n"))
        .select("length", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    inside = W.partitionBy("length", "_part").orderBy(F.col(f"`{key}`"), "piece", "ids_crc32")
    ranked = dealt.withColumn("_in", F.row_number().over(inside) - 1).join(starts, ["length", "_part"])
    ranked = ranked.withColumn("_rank", F.col("_start") + F.col("_in")).select(*cut.columns, "_rank")
    kept = without(ranked, ["_rank"])
    schema = T.StructType([*kept.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    arrow = to_arrow_schema(schema)
    at = cut.columns.index("length")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        for batch in batches:
            lengths, ranks = batch.column(at).to_numpy(), batch.column(batch.num_columns - 1).to_numpy()
            sequence, offset = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
            for length in np.unique(lengths):
                own = lengths == length
                first, start, shift = table[int(length)]
                run = np.searchsorted(first, ranks[own], "right") - 1
                sequence[own], offset[own] = start[run] + ranks[own] - first[run], shift[run]
            columns = [batch.column(i).cast(arrow.field(i).type) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], schema=arrow)

    return ranked.mapInArrow(releasing(place), schema)
