"""Licence scans by digests of canonical texts (operator 9)."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.llm.licence_texts import NOTICES, SPELLINGS, TEXTS

COPYRIGHT_LINE = r"(?m)^[^a-z0-9\n]*(copyright[^a-z\n]*(\([c]\)|©|[0-9])|\([c]\)|©)[^\n]*$"


def canonical(text: Column) -> Column:
    """Case, copyright lines, equivalent spellings, punctuation and white space made equal: words of a-z and 0-9 with one
    space between. A pattern is only tried where letters that it needs occur."""
    out = F.lower(F.coalesce(text, F.lit("")))
    for letters, pattern, to in [("copyright", COPYRIGHT_LINE, " "), ("(c)", COPYRIGHT_LINE, " "), ("©", COPYRIGHT_LINE, " "), *SPELLINGS]:
        # The lambda names the text so far; written out, each step would hold three copies of all steps before it.
        step = lambda x: F.when(F.contains(x, F.lit(letters)), F.regexp_replace(x, pattern, to)).otherwise(x)  # noqa: B023, E731
        out = F.get(F.transform(F.array(out), step), F.lit(0))
    return F.trim(F.regexp_replace(out, "[^a-z0-9]+", " "))


def plain(text: str) -> list[str]:
    """Words of a text that no spelling touches."""
    touched = "licen acknowledg infringement merchant version copyright and http".split()
    return [w for w in re.findall("[a-z0-9]+", text.lower()) if not any(t in w for t in touched)]


def anchors(texts: Sequence[tuple[str, str]]) -> str:
    """A pattern that every text equal to a known one holds: of each known text its longest plain word."""
    return "|".join(sorted({max(plain(body), key=lambda w: (len(w), w), default="") for _, body in texts}))


def digest(text: Column) -> Column:
    """Null where nothing is left of the text."""
    words = canonical(text)
    return F.when(words != "", F.sha2(words, 256))


def known(spark: SparkSession, texts: Sequence[tuple[str, str]]) -> DataFrame:
    """(digest, licence), one row a digest."""
    rows = spark.createDataFrame(list(texts), "licence string, body string")
    return rows.select(digest(F.col("body")).alias("digest"), "licence").groupBy("digest").agg(F.min("licence").alias("licence"))


def scan(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    texts: Sequence[tuple[str, str]] = TEXTS,
    notices: Sequence[tuple[str, str]] = NOTICES,
) -> DataFrame:
    """(key, canonical_sha256, licence, notices): one row a document.

    ``canonical_sha256`` is the digest of the entire canonical text, ``licence`` the known licence with that digest or null, and
    ``notices`` the licences, in order and comma-joined, that a line of the text states as a standard notice. Both are
    hash joins on the digest; the known side is a fixed list of the library, which is why broadcasting it is safe, and
    lines are joined before anything is shuffled, so only the few that match move.

    Null texts and texts without a word have a null digest and no licence; rows that repeat a key and text repeat in the result. Other
    columns are ignored. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    body = docs.select(F.col(f"`{key}`").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    anchor = anchors([*notices, *texts])
    stated = (
        body.where(F.lower("text").rlike(anchor))
        .select("id", F.xxhash64("text").alias("version"), F.explode(F.split("text", "\n")).alias("line"))
        .where(F.lower("line").rlike(anchor))
        .select("id", "version", digest(F.col("line")).alias("digest"))
        .join(F.broadcast(known(spark, [*notices, *texts])), "digest")
        .groupBy("id", "version")
        .agg(F.array_join(F.array_sort(F.collect_set("licence")), ",").alias("notices"))
    )
    whole = body.select("id", F.xxhash64("text").alias("version"), digest(F.col("text")).alias("digest"))
    found = whole.join(F.broadcast(known(spark, [*texts, *notices])), "digest", "left")
    return found.join(stated, ["id", "version"], "left").select(
        F.col("id").alias(key),
        F.col("digest").alias("canonical_sha256"),
        "licence",
        F.coalesce("notices", F.lit("")).alias("notices"),
    )
