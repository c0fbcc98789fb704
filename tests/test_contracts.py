"""Note events against their contract: literal documents, valid and broken."""

import json

from kestrel.operators import contracts as C
from kestrel.streaming import jobs as X

GOOD = {
    "schema_version": "1.0", "event_id": "n1", "timestamp": "2026-07-07T10:16:30Z", "denomination": "500", "verdict": "fake", "confidence": 0.91,
    "missing_features": ["security_thread", "microprint"], "image_ref": None, "location_hint": {"district": "Jamtara", "lat": 23.957, "lon": 86},
    "triage": {"decision": "pass", "checks": [{"name": "blur", "passed": True, "evidence": "sharp"}]},
}


def without(name):
    return {k: v for k, v in GOOD.items() if k != name}


CASES = [
    (json.dumps(GOOD), []),
    (json.dumps(without("event_id")), ["missing:event_id"]),
    (json.dumps(GOOD | {"status": "open", "tag": 1}), ["unknown:status", "unknown:tag"]),
    (json.dumps(GOOD | {"denomination": 500}), ["type:denomination"]),
    (json.dumps(GOOD | {"confidence": 1.5, "verdict": "forged"}), ["range:confidence", "value:verdict"]),
    (json.dumps(GOOD | {"timestamp": "yesterday"}), ["time:timestamp"]),
    (json.dumps(GOOD | {"missing_features": ["microprint", "colour"]}), ["value:missing_features[]"]),
    (json.dumps(GOOD | {"triage": {"checks": [{"name": "x", "passed": "no", "evidence": "", "by": 1}, {"name": "y"}]}}),
     ["missing:triage.checks[].evidence", "missing:triage.checks[].passed", "missing:triage.decision", "type:triage.checks[].passed", "unknown:triage.checks[].by"]),
    (json.dumps(GOOD | {"verdict": None}), ["type:verdict"]),
    ("[1, 2]", ["type:document"]),
    ('{"a": ', ["json"]),
    (None, ["json"]),
    ("", ["json"]),
]


def test_rules_broken(spark):
    df = spark.createDataFrame([(k, b, "old") for k, (b, _) in enumerate(CASES)], "k int, body string, errors string")
    found = {r.k: r.errors for r in C.checked(df, C.NOTE).select("k", "errors").collect()}
    assert found == {k: e for k, (_, e) in enumerate(CASES)}
    valid, quarantined = C.split(C.checked(df, C.NOTE))
    assert [r.k for r in valid.collect()] == [0] and quarantined.count() == len(CASES) - 1
    assert C.checked(df.limit(0), C.NOTE).count() == 0


def test_stream_into_two_sinks(spark, tmp_path):
    path = tmp_path / "in.parquet"
    path.mkdir()
    df = spark.createDataFrame([(k, b) for k, (b, _) in enumerate(CASES)], "k int, body string")
    for n in range(2):
        df.where(f"k % 2 = {n}").toPandas().to_parquet(path / f"part-{n}.parquet")
    valid, quarantined = X.ingest_documents(X.source(spark, str(path)), C.NOTE, str(tmp_path / "out"))
    assert [r.k for r in valid.collect()] == [0]
    assert {r.k: r.errors for r in quarantined.collect()} == {k: e for k, (_, e) in enumerate(CASES) if e}
