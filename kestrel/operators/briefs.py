"""Checks of notes, and texts made from facts by templates: no model writes them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ADVICE = {"genuine": "accept", "fake": "reject and retain"}


def capped(notes: DataFrame) -> DataFrame:
    """V9: a genuine note whose serial (status) is not valid or whose review failed is uncertain at 0.75; others stay."""
    caps = (F.col("verdict") == "genuine") & ((F.col("status") != "valid") | ~F.coalesce("review_ok", F.lit(True)))
    return notes.withColumns({"verdict": F.when(caps, "uncertain").otherwise(F.col("verdict")), "confidence": F.when(caps, 0.75).otherwise(F.col("confidence"))})


def note_check(notes: DataFrame) -> DataFrame:
    """What a teller is told: passed or not, and what to do with the note."""
    told = F.when(F.col("verdict") == "genuine", ADVICE["genuine"]).when(F.col("verdict") == "fake", ADVICE["fake"]).otherwise("refer for inspection")
    return notes.withColumns({"passed": F.coalesce(F.col("verdict") == "genuine", F.lit(False)), "recommendation": told})


def first_of(options: list[tuple[Column, str | Column]], most: int) -> Column:
    """The texts whose condition holds, at most ``most`` of them, joined."""
    said = F.filter(F.array(*[F.when(c, t if isinstance(t, Column) else F.lit(t)) for c, t in options]), lambda x: x.isNotNull())
    return F.array_join(F.slice(said, 1, most), "; ")


def number(name: str) -> Column:
    return F.col(name).cast("string")


def threat_summary(threats: DataFrame, most: int = 5) -> DataFrame:
    """Summary and recommended actions of each district from its linked signals."""
    summary = F.concat(
        F.col("district"), F.lit(": threat "), F.col("threat"), F.lit(", "), number("scams"), F.lit(" scams, "), number("notes"), F.lit(" notes, "),
        number("rings"), F.lit(" rings, "), number("trails"), F.lit(" money trails"),
    )
    actions = first_of(
        [
            (F.col("trails") > 0, F.concat(F.lit("freeze the targets of "), number("trails"), F.lit(" trails"))),
            (F.col("rings") > 0, F.concat(F.lit("review the accounts of "), number("rings"), F.lit(" rings"))),
            (F.col("notes") > 0, "warn cash counters"),
            (F.col("scams") > 0, "warn the public"),
            (F.col("threat").isin("high", "critical"), "tell the national desk"),
            (F.col("threat") == "low", "keep watching"),
        ],
        most,
    )
    return threats.select("district", summary.alias("summary"), actions.alias("actions"))


def case_files(dossiers: DataFrame, most: int = 6) -> DataFrame:
    """The case file of each district (scams, notes, accounts, illicit, families, trails)."""
    summary = F.concat(F.col("district"), F.lit(": "), number("scams"), F.lit(" flagged scams, "), number("notes"), F.lit(" fake notes, "), number("illicit"), F.lit(" of "), number("accounts"), F.lit(" accounts illicit"))
    actions = first_of(
        [
            (F.col("illicit") > 0, F.concat(F.lit("ask for statements of "), number("illicit"), F.lit(" accounts"))),
            (F.col("scams") > 0, F.concat(F.lit("take down callers of "), number("scams"), F.lit(" scams"))),
            (F.col("notes") > 0, F.concat(F.lit("send "), number("notes"), F.lit(" notes to the laboratory"))),
            (F.col("notes") > 50, "search for a press"),
            (F.col("scams") > 50, "open a joint desk"),
            ((F.col("scams") > 0) & (F.col("notes") > 0), "compare places of scams and notes"),
            (F.col("accounts") > 0, "brief the banks"),
        ],
        most,
    )
    return dossiers.select("district", summary.alias("summary"), actions.alias("actions"))


def briefing(snapshot: DataFrame, notes: DataFrame) -> DataFrame:
    """One text from the snapshot (scam_type, n, flagged) and the notes (district): totals, the commonest type, notes."""
    s = snapshot.agg(F.sum("n").alias("n"), F.sum("flagged").alias("flagged"), F.max(F.struct("n", "scam_type")).alias("top"))
    c = notes.agg(F.count("*").alias("notes"), F.countDistinct("district").alias("districts"))
    said = F.concat(
        number("n"), F.lit(" reports, "), number("flagged"), F.lit(" flagged; most are "), F.col("top.scam_type"), F.lit(" ("), F.col("top.n").cast("string"),
        F.lit("). "), number("notes"), F.lit(" fake notes in "), number("districts"), F.lit(" districts."),
    )
    return s.crossJoin(c).select(said.alias("briefing"))  # one row each


def signatures(facts: DataFrame, key: str) -> DataFrame:
    """A digest of the facts of each key, in the order of their names."""
    names = sorted(c for c in facts.columns if c != key)
    return facts.select(key, F.sha2(F.concat_ws("|", *[F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in names]), 256).alias("signature"))


def changed(now: DataFrame, before: DataFrame, key: str) -> DataFrame:
    """Every key with whether its facts differ from the last batch; a new key has changed."""
    was = signatures(before, key).withColumnRenamed("signature", "was")
    return signatures(now, key).join(was, key, "left").select(key, "signature", (~F.col("signature").eqNullSafe(F.col("was"))).alias("changed"))


def calibration(history: DataFrame, key: str, order: str, high: float = 0.95, share: float = 0.8, low: float = 0.3) -> DataFrame:
    """Whether a history (escape, recall) is saturated, its escape at least ``high`` in ``share`` of the rows, and collapsed,
    its last recall under ``low``."""
    return history.groupBy(key).agg(
        (F.avg((F.col("escape") >= high).cast("double")) >= share).alias("saturated"), (F.max_by("recall", order) < low).alias("collapsed"), F.count("*").alias("generations")
    )


def retraining(base: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """The union of both account tables with the last row of each key; ``order`` tells which is later."""
    both = base.withColumn("origin", F.lit("base")).unionByName(new.withColumn("origin", F.lit("new")))
    rank = F.struct(order, "origin")
    return both.groupBy(key).agg(F.max_by(F.struct(*[c for c in both.columns if c != key]), rank).alias("r")).select(key, "r.*")
