"""Grouping of spelling variants (operator 13).

Words are near if one letter inserted, deleted or replaced makes one of the other. As multisets of letters, that is binary vectors with a
place for the first, second, ... occurrence of each letter, near words are at most two places apart. PartEnum cuts the
places into three parts: two places touch two parts at most, so near words agree in one part entirely, and equality of a part joins
them. A part alone would join all words with common letters, so the key also holds the letters outside the zone of the word in which the edit
lies. The pairs met are verified by their distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from kestrel.session import materialise, reachable

#: Parts of the places: one more than near words differ in.
PARTS = 3
#: Zones of a word: at least, letters of one, and at most.
ZONES, WIDE, MANY = 4, 3, 16
#: Rounds in which forms are followed, each twice as far as the one before.
ROUNDS = 40


def keys(word: str, digest) -> tuple[list[int], list[int]]:
    """Signatures of ``word`` as the shorter or equal one of a pair, and as the one with a letter more."""
    seen: dict[str, int] = {}
    parts = [0] * PARTS
    for letter in word:
        k = seen[letter] = seen.get(letter, 0) + 1
        place = digest(f"{k}{letter}")
        parts[place % PARTS] += place >> 8  # order does not count
    signs = [f"{i}:{p}:" for i, p in enumerate(parts)]
    out = []
    for length in (len(word), len(word) - 1):
        own, cut = [], len(word) - length
        zones = min(MANY, max(ZONES, -(-length // WIDE)))
        for z in range(zones if length else 0):
            a, b = z * length // zones, (z + 1) * length // zones
            outside = f"{length}:{z}:{word[:a]}\0{word[b + cut:]}"
            own += [digest(s + outside) - (1 << 63) for s in signs]
        out.append(own)
    return out[0], out[1]


def signatures(words: DataFrame) -> DataFrame:
    """words(word, n) with the arrays ``own`` and ``longer`` of keys()."""
    reachable(words.sparkSession)
    schema = T.StructType.fromDDL("word string, n long, own array<long>, longer array<long>")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        for batch in batches:
            made = [keys(w, xxh3_64_intdigest) for w in batch.column(0).to_pylist()]
            columns = [batch.column(0).cast(arrow.field(0).type), batch.column(1), *(pa.array([m[k] for m in made], arrow.field(2 + k).type) for k in (0, 1))]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return words.select("word", F.col("n").cast("long").alias("n")).mapInArrow(run, schema)


def near(words: DataFrame) -> DataFrame:
    """Both directions of every pair of near words, once each: word, n, other, n_other."""
    signed = materialise(signatures(words))
    own = signed.select("word", "n", F.explode("own").alias("key"))
    right = own.withColumn("more", F.lit(False)).unionByName(signed.select("word", "n", F.explode("longer").alias("key"), F.lit(True).alias("more")))
    right = right.withColumnsRenamed({"word": "other", "n": "n_other"})
    met = own.join(right, "key").where("(more OR word < other) AND levenshtein(word, other, 1) = 1")
    pairs = met.select(F.explode(F.array(F.struct("word", "n", "other", "n_other"), F.struct(F.col("other").alias("word"), F.col("n_other").alias("n"), F.col("word").alias("other"), F.col("n").alias("n_other")))).alias("p")).select("p.*")
    return pairs.repartition("word").dropDuplicates(["word", "other"])


def roots(forms: DataFrame) -> DataFrame:
    """forms(word, form), no circles, to (word, root): the last form reached. Each round goes twice as far; a circle is an error."""
    now = materialise(forms.select("word", F.col("form").alias("root")))
    for _ in range(ROUNDS):
        to = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = materialise(now.join(to, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        now = further.drop("moved")
        if not further.where("moved").limit(1).count():
            return now
    raise RuntimeError(f"forms did not end in {ROUNDS} rounds")


def variants(words: DataFrame, ratio: int = 10) -> DataFrame:
    """words(word, n), each word once, to word, form, root, n, n_near, form_n.

    ``form`` is the near word of the largest count, the first in the order of code points among equal ones, if that count is ``ratio``
    times the word's own or more; ``root`` is where forms lead, the word itself without one. Null and empty words are near nothing
    and keep their row; an empty table gives an empty table; other columns are not carried. Counts rise with every form, so following them ends.
    """
    held = materialise(words.select("word", F.col("n").cast("long").alias("n")))
    best = near(held.where("word <> ''")).groupBy("word", "n").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("n_other")).alias("less"), F.col("other").alias("form"))).alias("b")
    )
    enough = F.col("b.less") <= -ratio * F.col("n")
    found = materialise(best.select("word", "n_near", F.when(enough, F.col("b.form")).alias("form"), F.when(enough, -F.col("b.less")).alias("form_n")))
    ends = roots(found.where("form IS NOT NULL"))
    return (
        held.join(found, "word", "left")
        .join(ends, "word", "left")
        .select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")
    )
