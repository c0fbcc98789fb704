import zlib

import numpy as np

from kestrel.llm import sharding as S


def slow_jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * S.MULTIPLIER + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_equals_the_plain_form():
    keys = np.array([0, 1, -1, 2**62, -(2**63), *range(100, 400)], np.int64)
    for n in (1, 8, 9, 100):
        assert S.jump(keys, n).tolist() == [slow_jump(int(k) % 2**64, n) for k in keys]


def test_rows(spark):
    texts = ["", None, "é" * 10, "same", "same", "x" * 100000] + ["t"] * 500
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)] + [(3, "same", "s"), (None, "n", "s")], "doc_id long, text string, slot string")
    rows = S.assign_shards(df).collect()
    assert len(rows) == len(texts) + 2
    by = {}
    for r in rows:
        body = "n" if r.doc_id is None else texts[r.doc_id] or ""
        assert (r.size, r.text_crc32) == (len(body.encode()) + 1, zlib.crc32(body.encode()))
        assert r.shard == slow_jump(r.doc_id or 0, 8) and r.grown_shard in (r.shard, 8) and r.law == "key"
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert S.assign_shards(df.limit(0)).count() == 0
    named = spark.createDataFrame([("a", "x"), ("b", None)], "name string, text string")
    assert {r.shard for r in S.assign_shards(named, key="name").collect()} <= set(range(8))


def test_names_of_the_input_stay(spark):
    df = spark.createDataFrame([(k, "t", k, "a", "b", 5) for k in range(20)] * 2, "doc_id long, text string, _size long, key string, row string, part int")
    rows = S.assign_shards(df).collect()
    assert len(rows) == 40 and all((r._size, r.key, r.row, r.part) == (r.doc_id, "a", "b", 5) for r in rows)
    assert sorted(rows[0].asDict()) == sorted([*df.columns, "size", "text_crc32", "law", "shard", "slot", "grown_shard"])


def test_ties_of_one_key(spark):
    df = spark.createDataFrame([(7, t) for t in ["same"] * 300 + ["other", None, "x" * 3_000_000]], "doc_id long, text string")
    rows = S.assign_shards(df).collect()
    assert len({r.shard for r in rows}) == 1 and sorted(r.slot for r in rows) == list(range(303)) and max(r.size for r in rows) == 3_000_001
