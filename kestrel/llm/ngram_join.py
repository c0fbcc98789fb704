"""N-gram Jaccard join (operator 7): count vectors in an R-tree bound the overlap, surviving pairs are verified.

A count vector says how many of a document's shingles fall into each of its hash groups; the sum of the smaller
counts bounds the overlap of two sets from above. An R-tree over such vectors alone does not separate documents of like
size at corpus scale (in many dimensions all boxes meet), so the join is first cut into buckets of documents that share
one of their rarest shingles, which no pair over the threshold can avoid; inside a bucket the tree does the search.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kestrel.llm.common import members_of, releasing, with_columns_in_arrow
from kestrel.operators.components import components
from kestrel.session import materialise, tidied

#: Least number of groups; a set of n has the power of two from n / 4 on, which is what keeps sets without a common text apart.
#: Vectors of two sizes meet at the smaller one.
GROUPS = 64
#: Bits a value of the maps that keep single listings and unconcerned texts from being moved, and the most bits of a map. A
#: fuller map lets more through to the exact join behind it and loses none.
SPARE, MOST_BITS = 16, 1 << 28
#: Documents (about) whose shingles are counted to find the frequent ones, and how many of those are kept. Both only
#: set the order of shingles, so they decide the cost and never the result.
SAMPLE, FREQUENT = 4000, 500_000
#: Members and bytes of one block of a group; blocks of a larger group meet pair by pair.
BLOCK, BLOCK_BYTES = 400, 8 << 20
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Shingler:
    """text -> sorted distinct 64-bit shingle hashes. Words end at ASCII white space; only A-Z are lower-cased."""

    def __init__(self, width: int) -> None:
        self.width = width
        self.known: dict[bytes, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        import xxhash

        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        known = self.known
        if len(known) > 100_000:
            known.clear()
        for w in set(words):
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter((known[w] for w in words), np.uint64, len(words))
        width = min(self.width, len(words))
        out = np.full(len(words) - width + 1, width, np.uint64)
        for k in range(width):
            out = out * MULTIPLIER + h[k : len(h) - width + 1 + k]
        return np.unique(mixed(out))


def needed(n: int, percent: int) -> int:
    """Shingles of a set of n that any set as similar as asked must share."""
    return -(-percent * n // 100)


def least_overlap(n: np.ndarray | int, m: np.ndarray | int, percent: int):
    """From intersection / union >= percent / 100: the least intersection of sets of n and m."""
    return -(-percent * (n + m) // (100 + percent))


def count_vector(s: np.ndarray, per_group: int = 4) -> np.ndarray:
    """One byte a group; there are more groups where a count would not fit one."""
    groups = GROUPS
    while groups * per_group < len(s):
        groups *= 2
    while (counts := np.bincount((s & np.uint64(groups - 1)).astype(np.int64), minlength=groups)).max(initial=0) > 255:
        groups *= 2
    return counts.astype(np.uint8)


def to_bytes(counts: np.ndarray) -> bytes:
    """Two counts a byte after a 1 where none is over 15, which is the rule; one a byte after a 0 otherwise."""
    if counts.max(initial=0) > 15:
        return b"\0" + counts.tobytes()
    return b"\1" + (counts[0::2] << 4 | counts[1::2]).tobytes()


def from_bytes(x: np.ndarray) -> np.ndarray:
    if not x[0]:
        return x[1:]
    out = np.empty(2 * (len(x) - 1), np.uint8)
    out[0::2], out[1::2] = x[1:] >> 4, x[1:] & 15
    return out


def folded(counts: np.ndarray, groups: int) -> np.ndarray:
    """The same counts over fewer groups: a group keeps the low bits of its number."""
    return counts if len(counts) == groups else counts.reshape(-1, groups).sum(0, dtype=np.int64)


class CountTree:
    """An R-tree over count vectors, packed by sorting on size and then on the widest coordinate. A node keeps the largest count in
    each coordinate of up to ``fan`` nodes below it; sizes are in order, so a size range is a range of leaves."""

    def __init__(self, sizes: np.ndarray, counts: np.ndarray, fan: int = 16) -> None:
        if len(counts) > 2 * fan:
            self.order = np.lexsort((counts[:, int(np.argmax(counts.var(0)))], sizes))
        else:
            self.order = np.argsort(sizes, kind="stable")
        self.sizes, self.levels, self.fan = sizes[self.order], [counts[self.order]], fan
        while len(self.levels[-1]) > 2 * fan:
            self.levels.append(np.maximum.reduceat(self.levels[-1], np.arange(0, len(self.levels[-1]), fan)))

    def search(self, size: int, counts: np.ndarray, percent: int) -> np.ndarray:
        """Members whose bound allows the similarity with (size, counts)."""
        lo, hi = np.searchsorted(self.sizes, (-(-percent * size // 100), 100 * size // percent + 1))
        if lo == hi:
            return self.order[:0]
        depth = 0
        while depth + 1 < len(self.levels) and hi - lo > 2 * self.fan ** (depth + 1):
            depth += 1
        step = self.fan**depth
        at = np.arange(lo // step, -(-hi // step))
        for depth in range(depth, -1, -1):
            least = least_overlap(size, self.sizes[np.maximum(at * self.fan**depth, lo)], percent)
            at = at[np.minimum(self.levels[depth][at], counts).sum(1) >= least]
            if depth:
                step = self.fan ** (depth - 1)
                at = (at[:, None] * self.fan + np.arange(self.fan)).ravel()
                at = at[(at >= lo // step) & (at * step < hi)]
        return self.order[at]


def signatures(docs: DataFrame, key: str, text: str, width: int, percent: int) -> DataFrame:
    """(id, h, r, n, fp, counts, prefix): hash of the text, a number of the row, set size, digest of the set, count vector, and the
    rarest shingles of the set, of which every partner shares one. Row numbers hold once the table is written."""
    spark = docs.sparkSession
    body = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text"), F.xxhash64(f"`{text}`").alias("h"))
    every = max(1, docs.count() // SAMPLE)

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(width)
        for batch in batches:
            for t in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingle(t.as_py()).view(np.int64))], names=["s"])

    # Which documents are sampled follows from their text, so copies count once.
    some = body.where(F.pmod("h", F.lit(every)) == 0).select("text").distinct()
    common = some.mapInArrow(sampled, "s long").groupBy("s").count().where("count >= 3").orderBy(F.desc("count"), "s").limit(FREQUENT)
    frequent = np.sort(np.array([r.s for r in common.select("s").collect()], np.int64).view(np.uint64))
    sent = spark.sparkContext.broadcast(frequent)
    fields = [
        T.StructField("n", T.LongType()),
        T.StructField("fp", T.BinaryType()),
        T.StructField("counts", T.BinaryType()),
        T.StructField("prefix", T.ArrayType(T.LongType())),
    ]

    def start():
        import xxhash

        shingle, common_ = Shingler(width), sent.value

        def step(texts):
            made = [[], [], [], []]
            for t in texts:
                s = shingle(t)
                n = len(s)
                take = n - needed(n, percent) + 1 if n else 0
                if n and len(common_):
                    late = common_[np.minimum(np.searchsorted(common_, s), len(common_) - 1)] == s
                    s_ordered = np.concatenate([s[~late], s[late]])
                else:
                    s_ordered = s
                row = n, xxhash.xxh3_128_digest(s.tobytes()), to_bytes(count_vector(s)), s_ordered[:take].view(np.int64)
                for column, value in zip(made, row):
                    column.append(value)
            return made

        return step

    return with_columns_in_arrow(body, ["text"], fields, start).drop("text").withColumn("r", F.monotonically_increasing_id())


def bitmap(places: DataFrame, size: int) -> np.ndarray:
    """The bits at the distinct values of ``places`` (p, an integer under ``size``): size / 8 bytes on the driver."""
    maps = places.groupBy(F.floor(F.col("p") / 32768).alias("bucket")).agg(F.collect_set((F.col("p") % 32768).cast("int")).alias("at"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for at in batch.column(1):
                bits = np.zeros(32768, bool)
                bits[at.values.to_numpy()] = True
                made.append(np.packbits(bits).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["bucket", "bits"])

    whole = np.zeros(size // 8, np.uint8)
    with tidied(places.sparkSession):
        rows = maps.mapInArrow(packed, "bucket long, bits binary").collect()
    for r in rows:
        whole[r.bucket * 4096 : (r.bucket + 1) * 4096] = np.frombuffer(r.bits, np.uint8)
    return whole


def bits_for(values: int) -> int:
    """Bits of a map for so many values."""
    bits = 1 << 16
    while bits < min(MOST_BITS, SPARE * values):
        bits *= 2
    return bits


def set_in(bits: np.ndarray, p: np.ndarray) -> np.ndarray:
    return (bits[p >> 3] >> (7 - (p & 7)).astype(np.uint8)) & 1 == 1


def repeated_listings(sig: DataFrame) -> DataFrame:
    """(s, id): the listings of shingles that more than one class lists, and a few others; id is the number of the class.

    Most listed shingles occur once. They are counted by a hash of at most 28 bits, which is all that is shuffled, and the hashes
    met twice become a bitmap, sized to the number of listings; listings outside it cannot have a partner and are never moved.
    """
    size = bits_for(sig.agg(F.coalesce(F.sum(F.size("prefix")), F.lit(0))).first()[0])
    place = F.shiftrightunsigned("s", 20).bitwiseAND(size - 1)
    twice = sig.select(F.explode("prefix").alias("s")).select(place.cast("int").alias("p")).groupBy("p").count().where("count > 1")
    sent = sig.sparkSession.sparkContext.broadcast(bitmap(twice, size))

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            s = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            keep = set_in(sent.value, ((s.view(np.uint64) >> np.uint64(20)) & np.uint64(size - 1)).astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(s[keep]), batch.column(0).take(pa.array(row[keep]))], names=["s", "id"])

    listed = materialise(sig.select("r", "prefix").mapInArrow(releasing(kept), "s long, id long"))
    sent.destroy()  # what is written is not computed again
    return listed


def within(groups: DataFrame, payload: DataFrame) -> DataFrame:
    """Cells (i, j, members) of ``groups`` (g, id, size, bytes, lead): a group is dealt into blocks of at most about BLOCK members
    and BLOCK_BYTES, and its least member is in every block, so that the blocks of one hot group of copies hang together."""
    dealt = groups.withColumn("blocks", blocks_of(F.col("size"), F.col("bytes")))
    rows = dealt.select("g", "id", F.pmod(F.xxhash64("id", "g"), F.col("blocks")).cast("int").alias("i"))
    leads = dealt.where("blocks > 1 AND id = lead").select("g", "id", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"))
    held = rows.unionByName(leads).distinct().join(payload, "id")
    member = F.struct("id", F.col("id").alias("label"), F.lit(True).alias("asks"), "n", "x")
    return held.groupBy("g", "i").agg(F.collect_list(member).alias("members"))


def across(groups: DataFrame, labels: DataFrame, payload: DataFrame) -> DataFrame:
    """Cells of groups that hold members of several ``labels`` (node, component): a pair of different labels has a member
    outside the group's most frequent label, so only the others are compared, block by block, with the whole group."""
    held = groups.join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("component", "id"))
    by_label = held.groupBy("g", "label").agg(F.count("*").alias("c"))
    most = by_label.groupBy("g").agg(F.count("*").alias("labels"), F.max(F.struct("c", "label")).alias("most")).where("labels > 1")
    blocks = blocks_of(F.col("size"), F.col("bytes"))
    left = held.join(most, "g").withColumn("blocks", blocks)
    left = left.withColumn("other", F.col("label") != F.col("most.label")).withColumn(
        "asking", F.least(F.col("blocks"), F.ceil(F.col("blocks") * (F.col("size") - F.col("most.c")) / F.col("size")).cast("int"))
    )
    place = lambda by: F.pmod(F.xxhash64("id", "g"), F.col(by)).cast("int")
    every = left.withColumn("i", place("blocks")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("asking") - 1))).withColumn("asks", F.lit(False))
    asked = left.where("other").withColumn("j", place("asking")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("asks", F.lit(True))
    columns = ["g", "i", "j", "id", "label", "asks"]
    cells = every.select(*columns).unionByName(asked.select(*columns)).join(payload, "id")
    return cells.groupBy("g", "i", "j").agg(F.collect_list(F.struct("id", "label", "asks", "n", "x")).alias("members"))


def blocks_of(size: Column, nbytes: Column) -> Column:
    return F.greatest(F.ceil(size / BLOCK), F.ceil(nbytes / BLOCK_BYTES), F.lit(1)).cast("int")


def spanning(cells: DataFrame, percent: int, verify: bool) -> DataFrame:
    """(a, b): for each cell a spanning forest of its pairs of different labels, so fewer rows than it has members. A member that
    asks searches the R-trees of the cell's count vectors. Without ``verify`` x is a count vector and a pair is one that the bound
    lets through; with it x is the whole set, the vectors are as fine as the set, and a pair is one that holds on the sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for ids, labels, asks, n, x in members_of(batch.column(0)):
                if len(n) < 2:
                    continue
                # Edges join labels where they are links, and single members where they only may be.
                tag = (labels if verify else ids).copy()
                counts = [count_vector(v.view(np.uint64), 1) if verify else from_bytes(v) for v in x]
                lengths = np.array([len(c) for c in counts])
                around = np.flatnonzero(~asks) if not asks.all() else np.arange(len(n))
                held = {g: around[lengths[around] == g] for g in set(lengths[around].tolist())}
                ranges = [(g, int(n[own].min()), int(n[own].max())) for g, own in held.items()]
                trees: dict[tuple[int, int], tuple[np.ndarray, CountTree]] = {}
                for q in np.flatnonzero(asks).tolist():
                    h, size = int(lengths[q]), int(n[q])
                    for g, low, high in ranges:
                        if 100 * high < percent * size or 100 * size < percent * low or (len(held[g]) == 1 and held[g][0] == q):
                            continue
                        at = min(g, h)
                        if (g, at) not in trees:
                            own = held[g]
                            trees[g, at] = own, CountTree(n[own], np.stack([folded(counts[p], at) for p in own]))
                        own, tree = trees[g, at]
                        near = own[tree.search(size, folded(counts[q], at), percent)]
                        near = near[labels[near] != labels[q]]
                        while len(near := near[tag[near] != tag[q]]):
                            p, near = near[0], near[1:]
                            if verify:
                                both = len(np.intersect1d(x[p].view(np.uint64), x[q].view(np.uint64), assume_unique=True))
                                if not both or 100 * both < percent * (int(n[p]) + size - both):
                                    continue
                            tag[tag == tag[p]] = tag[q]
                            a.append(ids[p])
                            b.append(ids[q])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return cells.select("members").mapInArrow(releasing(run), "a long, b long")


def searched(groups: DataFrame, payload: DataFrame, percent: int, verify: bool, labels: DataFrame | None = None) -> DataFrame:
    """Edges of all groups, inside blocks first (unless ``labels`` say what these gave) and then between the blocks of groups that
    still hold several labels."""
    large = groups.where((F.col("size") > BLOCK) | (F.col("bytes") > BLOCK_BYTES))
    if labels is not None:
        return materialise(spanning(across(large, labels, payload), percent, verify))
    edges = materialise(spanning(within(groups, payload), percent, verify))
    if not verify or not large.limit(1).count():
        return edges
    rest = spanning(across(large, components(edges, "a", "b"), payload), percent, verify)
    return edges.unionByName(materialise(rest))


def verified(near: DataFrame, firsts: DataFrame, docs: DataFrame, text: str, width: int, percent: int) -> DataFrame:
    """Links (a, b) among the documents that ``near`` joins into candidate groups, from their whole sets: each set goes to its
    group once, and all pairs of a group are searched, whichever of them ``near`` names."""
    near = components(near, "a", "b").select(F.col("component").alias("g"), F.col("node").alias("id"))
    held = materialise(near.join(firsts.select(F.col("r").alias("id"), "fp", "n", "h", "copies"), "id"))
    # Texts are filtered where they are read, by a bitmap sized to their number; only the sets of documents concerned are moved.
    size = bits_for(held.count())
    place = F.col("h").bitwiseAND(size - 1)
    sent = docs.sparkSession.sparkContext.broadcast(bitmap(held.select(place.alias("p")), size))
    body = docs.select(F.col(f"`{text}`").alias("text"), F.xxhash64(f"`{text}`").alias("h"))

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        shingle, seen = Shingler(width), set()
        for batch in batches:
            made = [[], []]
            h = batch.column(1).to_numpy()
            for k in np.flatnonzero(set_in(sent.value, h & np.int64(size - 1))):
                if h[k] not in seen:
                    seen.add(h[k])
                    s = shingle(batch.column(0)[int(k)].as_py()).tobytes()
                    made[0].append(xxhash.xxh3_128_digest(s))
                    made[1].append(s)
            yield pa.RecordBatch.from_arrays([pa.array(m, pa.binary()) for m in made], names=["id", "x"])

    sets = body.mapInArrow(releasing(shingled), "fp binary, x binary").join(held.select("fp", "id", "n", "copies"), "fp")
    # Only texts of several rows can have been read more than once.
    once = sets.where("copies IS NULL").select("id", "n", "x")
    sets = materialise(once.unionByName(sets.where("copies > 1").groupBy("id", "n").agg(F.first("x").alias("x"))))
    sent.destroy()  # what is written is not computed again
    return searched(sized(held, F.col("n") * 8), sets, percent, True)


def sized(groups: DataFrame, nbytes: Column) -> DataFrame:
    """(g, id, size, bytes, lead) of groups (g, id, ...) with the bytes of each member."""
    sums = groups.groupBy("g").agg(F.count("*").alias("size"), F.sum(nbytes).alias("bytes"), F.min("id").alias("lead"))
    return materialise(groups.select("g", "id").join(sums.where("size > 1"), "g"))


def digest(text: str) -> Column:
    """128 bits of a text's SHA-256; null counts as the empty text."""
    return F.unhex(F.substring(F.sha2(F.coalesce(F.col(text), F.lit("")), 256), 1, 32))


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """(key, n_shingles, component_id): one row a document; documents with Jaccard similarity of at least ``percent`` /
    100 over their ``width``-word shingles are linked, and component_id is the least key reachable by links.

    No pair over the threshold is missed, whatever the skew:

    1. Documents of equal sets (by a digest of 128 bits) form a class; copies are not expanded.
    2. Each class lists its rarest n - ceil(0.8 n) + 1 shingles (frequent ones, found on a sample, come last in the order).
       Two linked sets share one of those. Classes that list a shingle form its bucket; buckets with equal members are one.
    3. A bucket is dealt into blocks, and R-trees of the members' count vectors tell which pairs of a block may be similar. A block
       gives out a spanning forest of these, so fewer rows than it has members; forests of all buckets join into candidate groups.
    4. Whole sets meet by candidate group, in blocks again, and are searched by finer vectors and verified; pairs that links join
       already are passed over, and a block gives out a spanning forest of its links.
    5. Where a bucket has several blocks and its members several components, the members outside its most frequent component
       meet the whole bucket in the same way.

    Texts with fewer words than ``width`` are one shingle; null and wordless texts have none and link with nothing.
    Rows are judged by their own text, so repeated rows repeat in the result, and rows of one id with different texts may be of
    different components. A component has the least id of its rows that is not null. Other columns are ignored. An empty table gives an
    empty table.
    """
    sig = materialise(signatures(docs, key, text, width, percent))
    copied = sig.where("n > 0").groupBy("fp").agg(F.min("r").alias("first"), F.min("id").alias("least"), F.count("*").alias("copies")).where("copies > 1")
    copied = materialise(copied)
    # Written, so that its size is known: a small one is broadcast and the signatures are not moved.
    later = materialise(sig.select("fp", "r").join(copied, "fp").where("r > first").select("r"))
    firsts = sig.where("n > 0").join(later, "r", "left_anti").join(copied.select(F.col("first").alias("r"), "copies"), "r", "left")
    listed = repeated_listings(sig.where("n > 0").join(later, "r", "left_anti"))
    same = [F.sum(F.xxhash64("id", F.lit(k)).cast("decimal(38,0)")).alias(f"h{k}") for k in (1, 2)]
    repeated = listed.join(listed.groupBy("s").count().where("count > 1").select("s"), "s")
    # Shingles of one passage have the same members; one of them stands for all.
    buckets = repeated.groupBy("s").agg(F.count("*").alias("members"), *same).groupBy("members", "h1", "h2").agg(F.min("s").alias("g")).select("g")
    shared = materialise(listed.withColumnRenamed("s", "g").join(buckets, "g"))
    points = firsts.select(F.col("r").alias("id"), "n", F.col("counts").alias("x")).join(shared.select("id").distinct(), "id", "left_semi")
    points = materialise(points)
    groups = sized(shared.join(points.select("id", F.octet_length("x").alias("b")), "id"), F.col("b"))
    links = verified(searched(groups, points, percent, False), firsts, docs, text, width, percent)
    labels = materialise(components(links, "a", "b"))
    if groups.where((F.col("size") > BLOCK) | (F.col("bytes") > BLOCK_BYTES)).limit(1).count():
        more = searched(groups, points, percent, False, labels)
        if more.limit(1).count():
            labels = components(links.unionByName(verified(more, firsts, docs, text, width, percent)), "a", "b")
    # Classes of several rows or with links; every other row is a component of its own.
    linked = labels.withColumnRenamed("node", "r").join(sig.select("r", "fp", F.col("id").alias("own")), "r").drop("r")
    joined = linked.join(copied.select("fp", "least"), "fp", "full").withColumn("least", F.coalesce("least", "own"))
    of_component = joined.where("component IS NOT NULL").groupBy("component").agg(F.min("least").alias("of_component"))
    named = joined.join(of_component, "component", "left").select("fp", F.coalesce("of_component", "least").alias("component_id"))
    return sig.select("id", "n", "fp").join(named, "fp", "left").select(
        F.col("id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id")
    )
