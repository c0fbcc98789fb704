"""Events written as JSON notes, some of them against the contract, judged as a table and as a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from kestrel.operators import contracts as C
from kestrel.session import shared_folder
from kestrel.streaming import jobs as X


def documents(events):
    """A JSON text an event. What is null is left out of the text, so it counts as missing."""
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    name = F.col("event_id").cast("string")
    fields = {
        "schema_version": F.lit("1.0"),
        "event_id": F.when(k % 11 != 0, name),
        "timestamp": F.when(F.col("event_type") == "error", "unknown").otherwise(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        "denomination": F.element_at(F.array(*map(F.lit, ("100", "200", "500", "50"))), k % 4 + 1),
        "verdict": F.lit("uncertain"),
        "confidence": F.col("value").cast("double") / 20,
        "missing_features": F.array(F.lit("microprint"), F.when(k % 13 == 0, "colour").otherwise("watermark")),
        "status": F.when(k % 7 == 0, "open"),
        "serial": F.struct(name.alias("value"), F.lit("valid").alias("status"), F.when(k % 5 != 0, "first seen").alias("detail")),
    }
    return events.select("event_id", F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()])).alias("body"))


def v01_contracts(spark, sf):
    found = C.checked(documents(spark.read.parquet(f"{sf}/events.parquet")), C.NOTE)
    return found.select("event_id", F.array_join("errors", ",").alias("errors"))


def x01_documents(spark, sf):
    stream = documents(X.source(spark, f"{sf}/events.parquet"))
    valid, quarantined = X.ingest_documents(stream, C.NOTE, f"{shared_folder(spark)}/ingest-{uuid.uuid4().hex}")
    both = valid.select(F.lit("valid").alias("sink"), "errors").unionByName(quarantined.select(F.lit("quarantine").alias("sink"), "errors"))
    return both.groupBy("sink", F.array_join("errors", ",").alias("errors")).agg(F.count("*").alias("n"))


ERRORS_SQL = """SELECT event_id, concat_ws(',', CASE WHEN value IS NULL THEN 'missing:confidence' END, CASE WHEN k % 11 = 0 THEN 'missing:event_id' END,
    CASE WHEN k % 5 = 0 THEN 'missing:serial.detail' END, CASE WHEN NOT value BETWEEN 0 AND 20 THEN 'range:confidence' END,
    CASE WHEN event_type = 'error' THEN 'time:timestamp' END, CASE WHEN k % 7 = 0 THEN 'unknown:status' END,
    CASE WHEN k % 4 = 3 THEN 'value:denomination' END, CASE WHEN k % 13 = 0 THEN 'value:missing_features[]' END) AS errors
    FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events)"""
QUERIES = {f.__name__: f for f in (v01_contracts, x01_documents)}
ORACLES = {
    "v01_contracts": ERRORS_SQL,
    "x01_documents": f"SELECT CASE WHEN errors = '' THEN 'valid' ELSE 'quarantine' END AS sink, errors, count(*) AS n FROM ({ERRORS_SQL}) GROUP BY 1, 2",
}
