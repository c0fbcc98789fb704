"""Streams replayed in two batches equal their batch form."""

import pandas as pd

from kestrel.streaming import jobs as X


def test_bursts_over_two_batches(spark, tmp_path):
    path = tmp_path / "in.parquet"
    path.mkdir()
    for k, rows in enumerate(([("a", 0), ("a", 100), ("b", 5)], [("a", 200), ("a", 9000), ("b", 4000)])):
        pd.DataFrame(rows, columns=["account_id", "t"]).to_parquet(path / f"part-{k}.parquet")
    stream = X.source(spark, str(path))
    done = X.replay(X.bursts(stream), "update").collect()
    last = {}
    for r in sorted(done, key=lambda r: r.epoch):
        last[r.account_id] = (r.events, r.close)
    assert last == {"a": (4, 2), "b": (2, 0)}


def test_upsert_keeps_the_newest(spark, tmp_path):
    path = tmp_path / "ev.parquet"
    path.mkdir()
    pd.DataFrame({"event_id": [1, 2, 1], "t": [1, 2, 3]}).to_parquet(path / "a.parquet")
    X.upsert(X.source(spark, str(path)), str(tmp_path / "out"), "event_id", "t", keep=1)()
    assert [(r.event_id, r.t) for r in spark.read.parquet(str(tmp_path / "out/v0")).collect()] == [(1, 3)]


def replayed(spark, path, batches, columns, job):
    path.mkdir()
    for k, rows in enumerate(batches):
        df = pd.DataFrame(rows, columns=columns)
        df["t"] += 100_000  # a watermark begins at the epoch
        df.to_parquet(path / f"part-{k}.parquet")
    return X.replay(job(X.source(spark, str(path)))).collect()


def test_a_silent_call_begins_anew(spark, tmp_path):
    batches = [[(1, 0, "a", 0), (1, 1, "b", 50)], [(2, 0, "x", 5000)], [(2, 1, None, 5010), (1, 2, "c", 5020)], [(1, 3, "d", 5100), (1, 4, "late", 3)]]
    rows = replayed(spark, tmp_path / "in.parquet", batches, ["conv_id", "turn", "text", "t"], lambda s: X.running_calls(s, 100, "1 second"))
    assert sorted((r.conv_id, r.turn, r.text) for r in rows) == [(1, 0, "a"), (1, 1, "a b"), (1, 2, "c"), (1, 3, "c d"), (2, 0, "x"), (2, 1, "x")]


def test_a_serial_not_seen_for_long_counts_as_new(spark, tmp_path):
    batches = [[("1AB283746", 1, 0), ("1AB283746", 2, 10)], [("2AB283746", 3, 9000)], [("1AB283746", 4, 9001), ("1AB283746", 5, 9100), ("1AB283746", 6, 9900)]]
    rows = replayed(spark, tmp_path / "in.parquet", batches, ["serial", "event_id", "t"], lambda s: X.serial_sightings(s, 500, "1 second"))
    assert {r.event_id: (r.prior, r.status) for r in rows} == {1: (0, "valid"), 2: (1, "duplicate"), 3: (0, "valid"), 4: (0, "valid"), 5: (1, "duplicate"), 6: (0, "valid")}
