"""The corpus pipeline: toxic documents go, one of each group of near-duplicates stays, contaminated documents go, the
rest is packed. Every stage's result is written and read again before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.llm import decontaminate, ngram_join, packing, toxicity
from kestrel.llm.common import table
from kestrel.llm.queries import vocabulary
from kestrel.session import materialise


def bare(docs: DataFrame) -> DataFrame:
    """``docs`` with all but doc_id and text inside one column, so that no name clashes with what an operator appends."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*rest, F.lit(0).alias("_none")).alias("rest"))


def whole(held: DataFrame, docs: DataFrame) -> DataFrame:
    """The rows of ``held`` with the columns of ``docs`` again."""
    return held.select(*[F.col(c) if c in ("doc_id", "text") else F.col(f"rest.`{c}`") for c in docs.columns])


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is under 0.5. Null and empty texts have no toxic word and stay where the labels' share allows, as every
    text without one; repeated rows stay or go together, whatever their ids; without usable labels all have one score."""
    scored = toxicity.score(bare(docs), toxicity.learn(docs, table(spark, sf_dir, "labels")))
    return whole(scored.where("toxicity < 0.5"), docs)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group linked by similar shingles. Where ids repeat or are null, a row's key is
    its id with its text's digest: of rows with one key one stays, and texts under one id are judged each by itself. Null and wordless
    texts have no copies but rows of their own key. Other columns are carried, whatever their names."""
    if not docs.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").limit(1).count():
        joined = ngram_join.join(docs)
        return docs.join(joined.where("doc_id <> component_id").select("doc_id"), "doc_id", "left_anti").select(docs.columns)
    own = docs.select("doc_id", "text", ngram_join.digest("text").alias("own"))
    linked = ngram_join.join(own, "own").groupBy("own").agg(F.first("n_shingles").alias("n"), F.first("component_id").alias("c"))
    rows = materialise(own.select("doc_id", "own").distinct().join(linked, "own"))
    first = rows.where("n > 0").groupBy("c").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "own")).alias("k"))
    kept = first.select("k.doc_id", "k.own").unionByName(rows.where("n = 0").select("doc_id", "own")).alias("k")
    held = bare(docs).withColumn("own", ngram_join.digest("text")).alias("d")
    same = (F.col("d.own") == F.col("k.own")) & F.col("d.doc_id").eqNullSafe(F.col("k.doc_id"))
    return whole(held.join(kept, same, "left_semi").dropDuplicates(["doc_id", "own"]), docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark doesn't contaminate. Null and wordless texts stay; an empty benchmark removes nothing."""
    found = decontaminate.decontaminate(bare(docs), table(spark, sf_dir, "benchmark"))
    return whole(found.where("NOT contaminated"), docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences of 1024; columns besides doc_id and text are not read. A null text is its end
    token alone, repeated rows are packed as often as they are left, and no documents give no pieces."""
    return packing.pack(docs, vocabulary())


STAGES = [("toxicity", clean), ("ngram_join", distinct), ("decontaminate", uncontaminated), ("packing", packed)]

#: The toxicity scorer is trained, which SQL cannot express; tests hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs)
    return docs
