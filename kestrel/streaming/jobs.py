"""Structured Streaming forms of the operators that live on event streams (X1-X8). Each takes a streaming frame and returns a
streaming frame or a started query; `replay` runs one to the end of its input."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from kestrel.operators import contracts
from kestrel.operators import correlate as J
from kestrel.operators.messages import detect
from kestrel.operators.records import serial_status
from kestrel.session import reachable, shared_folder


def source(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """A stream over the Parquet files at ``path``, ``files`` of them a micro-batch."""
    reachable(spark)
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    # A pattern that only this name matches: a stream takes a single file by pattern, a folder either way.
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/[{name[0]}]{name[1:]}")


def replay(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over all of its input into a table of the shared folder and read that."""
    spark = stream.sparkSession
    path = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def store(df: DataFrame, epoch: int) -> None:  # the epoch names the folder, so a repeated batch replaces itself
        df.write.mode("overwrite").parquet(f"{path}/out/epoch={epoch}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(store).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema.add("epoch", "long")).parquet(f"{path}/out")


def ingest(events: DataFrame) -> DataFrame:
    """Every event with the names of the contract rules that it breaks; rows without any are valid, others quarantined."""
    rules = {"event_id": F.col("event_id").isNotNull(), "ts": F.col("ts").isNotNull(), "type": F.col("event_type").isin("click", "view", "purchase", "signup", "error"), "value": F.col("value").between(0, 20)}
    failed = F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in rules.items()])
    return events.select("event_id", "event_type", F.array_join(F.filter(failed, lambda e: e.isNotNull()), ",").alias("errors"))


def ingest_documents(stream: DataFrame, contract: contracts.Rule, path: str, body: str = "body") -> tuple[DataFrame, DataFrame]:
    """X1 on JSON documents: run the stream to the end of its input into two sinks of a table under ``path``, documents that keep the contract
    and those in quarantine with what they break. A batch names its folder, so one that runs again replaces itself."""
    spark = stream.sparkSession

    def store(batch: DataFrame, epoch: int) -> None:  # one pass: a filter for each sink would judge every document again, several times over
        found = contracts.checked(batch, contract, body).drop("document")
        found.withColumn("sink", F.when(F.size("errors") == 0, "valid").otherwise("quarantine")).write.mode("overwrite").partitionBy("sink").parquet(f"{path}/out/epoch={epoch}")

    stream.writeStream.option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(store).start().awaitTermination()
    kept = contracts.checked(spark.createDataFrame([], stream.schema), contract, body).drop("document").schema.add("epoch", "long").add("sink", "string")
    both = spark.read.schema(kept).parquet(f"{path}/out")
    return tuple(both.where(F.col("sink") == name).drop("sink") for name in ("valid", "quarantine"))


def version(spark: SparkSession, path: str, epoch: int, schema) -> DataFrame:
    """The table as the batch ``epoch`` left it; empty before the first one. A failed read is an error and never an empty table."""
    return spark.read.schema(schema).parquet(f"{path}/v{epoch}") if epoch >= 0 else spark.createDataFrame([], schema)


def newest_version(spark: SparkSession, path: str, schema) -> DataFrame:
    """The table as the last batch left it."""
    at = F.regexp_extract("path", "/v([0-9]+)/[^/]*$", 1).cast("int")
    last = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path).select(F.max(at)).first()[0]
    return version(spark, path, -1 if last is None else last, schema)


def upsert(events: DataFrame, path: str, key: str, order: str, keep: int = 500) -> Callable[[], None]:
    """A start function of a stream that holds the latest version of the ``keep`` newest keys in a table."""
    spark = events.sparkSession

    def merge(batch: DataFrame, epoch: int) -> None:
        held = version(spark, path, epoch - 1, batch.schema)
        both = held.unionByName(batch)
        late = F.struct(order, *[c for c in both.columns if c != order])  # ties by the whole row
        newest = both.groupBy(key).agg(F.max_by(F.struct(*[c for c in both.columns if c != key]), late).alias("r")).select(key, "r.*").select(*both.columns)
        newest.orderBy(F.desc(order), key).limit(keep).write.mode("overwrite").parquet(f"{path}/v{epoch}")

    return lambda: events.writeStream.option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(merge).start().awaitTermination()


def bursts(events: DataFrame, gap_s: int = 3600) -> DataFrame:
    """Running counters per account (account_id, t): events, events that follow another within ``gap_s``. State is the
    last time and two counters; input within a batch is put in order, later batches must not go back in time."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, n, close = state.get if state.exists else (None, 0, 0)
        for t in sorted(int(x) for f in frames for x in f.t):
            close += last is not None and t - last < gap_s
            last, n = t, n + 1
        state.update((last, n, close))
        yield pd.DataFrame({"account_id": [key[0]], "events": [n], "close": [close]})

    out, held = "account_id string, events long, close long", "last long, n long, close long"
    return events.groupBy("account_id").applyInPandasWithState(step, out, held, "update", GroupStateTimeout.NoTimeout)


def _ends(state: GroupState, last: int, silence_s: int) -> None:
    """Let the state end when the watermark has passed ``last`` by ``silence_s``."""
    state.setTimeoutTimestamp(max((last + silence_s) * 1000 + 1, state.getCurrentWatermarkMs() + 1))


def _timed(df: DataFrame, silence_s: int | None, late: str) -> tuple[DataFrame, str]:
    if silence_s is None:
        return df, GroupStateTimeout.NoTimeout
    return df.withColumn("at", F.timestamp_seconds("t")).withWatermark("at", late), GroupStateTimeout.EventTimeTimeout


def running_calls(turns: DataFrame, silence_s: int | None = None, late: str = "10 minutes") -> DataFrame:
    """Turns of conversations as they come, with all text so far; state is that text.

    With ``silence_s`` turns need a time ``t`` in seconds. A turn more than ``silence_s`` after the one before begins the call anew,
    whenever the state is dropped, which is when the watermark (``late`` behind the newest turn) has passed that time, so state holds
    calls that go on. Turns behind the watermark are left out. Without it state never ends, and turns need no time.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        said, last = state.get if state.exists else ("", None)
        made = []
        for t, turn, text in sorted((int(t), int(n), x or "") for f in frames for t, n, x in zip(f.t, f.turn, f.text)):
            if silence_s is not None and last is not None and t - last > silence_s:
                said = ""
            said, last = f"{said} {text}".strip() if said else text, t
            made.append((key[0], turn, said))
        state.update((said, last))
        if silence_s is not None:
            _ends(state, last, silence_s)
        yield pd.DataFrame(made, columns=["conv_id", "turn", "text"])

    timed, ends = _timed(turns if "t" in turns.columns else turns.withColumn("t", F.lit(0)), silence_s, late)
    return timed.groupBy("conv_id").applyInPandasWithState(step, "conv_id long, turn long, text string", "said string, last long", "append", ends)


def running_stages(turns: DataFrame, silence_s: int | None = None, late: str = "10 minutes") -> DataFrame:
    """X3 with the verdict of every turn: the markers in all text so far, and the stage they mean."""
    found = detect(running_calls(turns, silence_s, late))
    n = F.size("markers")
    stage = F.when(n >= 3, "scam_detected").when(n >= 1, "warning").otherwise("monitoring")
    return found.select("conv_id", "turn", F.array_join("markers", ",").alias("markers"), stage.alias("stage"))


def serial_sightings(events: DataFrame, keep_s: int | None = None, late: str = "1 hour") -> DataFrame:
    """Sightings (serial, event_id, t) with the number of earlier ones; state is a counter and the last time.

    With ``keep_s`` a serial that was not seen for longer counts as new, whenever its state is dropped, which is when the watermark
    (``late`` behind the newest sighting) has passed that time; sightings behind the watermark are left out. Without it state never ends.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, last = state.get if state.exists else (0, None)
        made = []
        for t, e in sorted((int(t), int(e)) for f in frames for t, e in zip(f.t, f.event_id)):
            if keep_s is not None and last is not None and t - last > keep_s:
                n = 0
            made.append((key[0], e, n))
            n, last = n + 1, t
        state.update((n, last))
        if keep_s is not None:
            _ends(state, last, keep_s)
        yield pd.DataFrame(made, columns=["serial", "event_id", "prior"])

    timed, ends = _timed(events, keep_s, late)
    seen = timed.groupBy("serial").applyInPandasWithState(step, "serial string, event_id long, prior long", "n long, last long", "append", ends)
    status = serial_status(F.col("serial"))
    return seen.withColumn("status", F.when((status != "nonsense") & (F.col("prior") > 0), "duplicate").otherwise(status))


def hourly(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Counts per type and hour of event time, given out when the watermark has passed the hour."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.unix_timestamp("w.start").alias("hour"), "event_type", "n", "total")


def trails(scams: DataFrame, edges: DataFrame, share: float = 0.01, late: str = "1 hour") -> DataFrame:
    """Stream-stream interval join of payments (event_id, paid, scam_at) and transfers (tx_id, amount, edge_at): amounts within
    ``share`` by cells of a logarithmic scale, times within -2..96 hours, both sides with a watermark of ``late``."""
    cell = lambda c: F.floor(F.log(F.col(c).cast("double")) / F.log(F.lit(1 + 1.05 * share)))
    left = scams.where("paid > 0").withWatermark("scam_at", late).withColumn("_a", F.explode(F.sequence(cell("paid") - 1, cell("paid") + 1)))
    right = edges.where("amount > 0").withWatermark("edge_at", late).withColumn("_b", cell("amount"))
    near = F.expr("_a = _b AND edge_at >= scam_at - INTERVAL 2 HOURS AND edge_at <= scam_at + INTERVAL 96 HOURS")
    return left.join(right, near).where(F.abs(F.col("amount") - F.col("paid")) <= share * F.col("paid")).drop("_a", "_b")


def trail_counts(scams: DataFrame, edges: DataFrame, path: str, share: float = 0.01, before_h: int = 2, after_h: int = 96, keep_s: int = 60 * 86400) -> DataFrame:
    """X5 without its pairs: run payments (event_id, paid, scam_at) and transfers (tx_id, amount, edge_at) to the end of their input. Every
    batch adds, for each payment that meets transfers by it, a row (event_id, first, second, n): the two earliest (t, tx_id), t in
    microseconds, and how many there are. Numbers add up over batches, and the earliest of all is among those of the batches.

    A batch asks its payments of all transfers so far and the earlier payments of its transfers. Rows stand in a version of the table
    under ``path`` until they are older than the newest by ``keep_s`` and the window. A batch that runs again replaces itself.
    """
    spark, micros = scams.sparkSession, 3_600_000_000
    row = lambda asks, key, amount, at: (F.lit(asks).alias("asks"), F.col(key).cast("long").alias("id"), J.hundredths(F.col(amount)).alias("x"), F.unix_micros(at).alias("t"))
    both = scams.select(*row(True, "event_id", "paid", "scam_at")).unionByName(edges.select(*row(False, "tx_id", "amount", "edge_at")))
    ask = lambda df: df.where("asks").select("id", "x", (F.col("t") - before_h * micros).alias("since"), (F.col("t") + after_h * micros).alias("until"))
    edge = lambda df: df.where("NOT asks").select("x", "t", F.col("id").alias("tx_id"))
    meet = lambda a, b: J.first_in_bands(ask(a), edge(b), ["tx_id"], share, 8 * (before_h + after_h) * micros, count=True).withColumnRenamed("id", "event_id")

    def store(batch: DataFrame, epoch: int) -> None:
        held = version(spark, path, epoch - 1, both.schema)
        every = held.unionByName(batch)
        newest = every.agg(F.max("t").alias("newest"))
        late = (keep_s * 1_000_000) + (before_h + after_h) * micros
        every.join(F.broadcast(newest)).where(F.col("t") >= F.col("newest") - late).drop("newest").write.mode("overwrite").parquet(f"{path}/v{epoch}")
        meet(batch, every).unionByName(meet(held, batch)).write.mode("overwrite").parquet(f"{path}/out/epoch={epoch}")

    both.writeStream.option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(store).start().awaitTermination()
    kind = "struct<t:bigint,tx_id:bigint>"
    return spark.read.schema(f"event_id long, first {kind}, second {kind}, n long, epoch long").parquet(f"{path}/out")


def action_queue(batch: DataFrame, epoch: int, path: str, derive: Callable[[DataFrame], DataFrame], merge: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
    """One micro-batch of the action queue for foreachBatch: derive, merge with the last version, write the next one. A
    batch that is run again reads the same version and writes the same one."""
    spark = batch.sparkSession
    derived = derive(batch)
    held = version(spark, path, epoch - 1, "action_id string, status string, priority string")
    merge(held, derived).write.mode("overwrite").parquet(f"{path}/v{epoch}")
