"""Serial numbers, response actions, validation and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def serial_status(serial: Column) -> Column:
    """Q1: invalid format or I/O letters -> nonsense; one repeated digit or a run up or down -> suspicious; else valid."""
    s = F.upper(F.regexp_replace(serial, r"[\s-]", ""))
    digits = F.substring(s, 4, 6)
    run = F.contains(F.lit("01234567890"), digits) | F.contains(F.lit("09876543210"), digits)
    return F.when(~s.rlike("^[0-9][A-Z]{2}[0-9]{6}$") | F.substring(s, 2, 2).rlike("[IO]"), "nonsense").when(digits.rlike(r"^([0-9])\1{5}$") | run, "suspicious").otherwise("valid")


def sightings(df: DataFrame) -> DataFrame:
    """Q2: per sighting (event_id, t, user_id, serial) how often its serial was seen before and where last, at most three
    places; nonsense serials are never duplicates."""
    w = W.partitionBy("serial").orderBy("t", "event_id").rowsBetween(W.unboundedPreceding, -1)
    recent = W.partitionBy("serial").orderBy("t", "event_id").rowsBetween(-3, -1)
    status = serial_status(F.col("serial"))
    out = df.withColumn("prior", F.count("*").over(w)).withColumn("last_places", F.array_join(F.collect_list(F.col("user_id").cast("string")).over(recent), ","))
    return out.withColumn("status", F.when((status != "nonsense") & (F.col("prior") > 0), "duplicate").otherwise(status))


#: The kinds of response actions.
FREEZE, BLOCK, INTERCEPT, ALERT = "account_freeze", "telecom_block", "citizen_intercept", "mha_alert"


def derive_actions(scams: DataFrame, trails: DataFrame, rings: DataFrame, threats: DataFrame) -> DataFrame:
    """A1-A2: response actions by five rules, one of each id (the first rule wins): traced accounts and the first accounts of the
    three riskiest rings are frozen, phones of risky scams blocked, victims of those without a payment warned, and a national
    alert goes out at a high or critical threat. ``scams`` has phone and reported (whether a payment is), ``threats`` a threat."""
    target = lambda c: F.regexp_replace(c.cast("string"), r"[^\p{L}\p{N}._+-]", "_")

    def rule(df: DataFrame, n: int, kind: str, on: Column, priority: Column) -> DataFrame:
        return df.select(F.lit(n).alias("rule"), F.lit(kind).alias("action_type"), target(on).alias("target"), priority.alias("priority"))

    top = rings.withColumn("_r", F.row_number().over(W.orderBy(F.desc("risk"), "ring_id"))).where("_r <= 3 AND risk >= 0.7")  # one row a ring
    first = top.select("ring_id", F.explode(F.slice(F.array_sort(F.split("account_ids", ",")), 1, 3)).alias("account_id"))
    risky = scams.where("risk_score >= 0.6 AND verdict <> 'legit'")
    worst = threats.agg(F.max(F.when(F.col("threat") == "critical", 2).when(F.col("threat") == "high", 1).otherwise(0)).alias("level")).where("level > 0")
    every = (
        rule(trails, 1, FREEZE, F.col("target"), F.lit("critical"))
        .unionByName(rule(first, 2, FREEZE, F.col("account_id"), F.lit("high")))
        .unionByName(rule(risky.where("phone IS NOT NULL"), 3, BLOCK, F.col("phone"), F.lit("high")))
        .unionByName(rule(risky.where("NOT reported"), 4, INTERCEPT, F.col("event_id"), F.lit("critical")))
        .unionByName(rule(worst, 5, ALERT, F.lit("national"), F.when(F.col("level") == 2, "critical").otherwise("high")))
    )
    once = every.groupBy("action_type", "target").agg(F.min(F.struct("rule", "priority")).alias("f"))
    return once.select(F.concat_ws(":", "action_type", "target").alias("action_id"), "action_type", "target", "f.rule", "f.priority")


def merge_actions(current: DataFrame, derived: DataFrame) -> DataFrame:
    """A3: what officers have touched stays; a proposal is replaced by its new derivation or dropped without one."""
    c = current.select("action_id", F.col("status").alias("held"), F.col("priority").alias("old"))
    d = derived.select("action_id", F.col("priority").alias("new"))
    both = c.join(d, "action_id", "full")
    kept = F.col("held").isNotNull() & (F.col("held") != "proposed")
    return both.where(kept | F.col("new").isNotNull()).select("action_id", F.when(kept, F.col("held")).otherwise("proposed").alias("status"), F.when(kept, F.col("old")).otherwise(F.col("new")).alias("priority"))


def transitions(actions: DataFrame, log: DataFrame) -> DataFrame:
    """A4: fold a log (action_id, seq, status) into each action's status and audit trail."""
    folded = log.groupBy("action_id").agg(F.array_sort(F.collect_list(F.struct("seq", "status"))).alias("log"))
    out = actions.join(folded, "action_id", "left")
    trail = F.transform(F.coalesce("log", F.array().cast("array<struct<seq:bigint,status:string>>")), lambda x: x["status"])
    return out.withColumn("status", F.coalesce(F.try_element_at(trail, F.lit(-1)), "status")).withColumn("audit", F.array_join(trail, ">")).drop("log")


def validated(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """V1: append ``errors``, the names of the rules that a row breaks; a rule that is null counts as broken."""
    failed = F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()])
    return df.withColumn("errors", F.filter(failed, lambda e: e.isNotNull()))
