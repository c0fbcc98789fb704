import zlib

import numpy as np
import pytest

from kestrel.llm import packing

P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_50k.json")


def library_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_ids_equal_the_library():
    texts = ["", "a", "Hello  world\n\n\tx", "éèê ciónue 漢字 🙂", "it's we'll 12345 !!??", "<|endoftext|> x", "a<|endoftext|><|endoftext|>\n<|endoftext|", "a" * 5000, " " * 300, "\n" * 100_000, "漢" * 50_000]
    encode = packing.encoder(PATH)
    assert [encode(t) for t in texts] == library_ids(texts)


def check(rows, texts, size=1024):
    ids = [[*x, 2] for x in library_ids([t or "" for t in texts])]
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for k, own in enumerate(ids):
        at = 0
        for n, r in enumerate(sorted(by_doc[k], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (n, at)
            part = np.array(own[at : at + r.length], dtype="<u4")
            assert r.ids_crc32 == zlib.crc32(part.tobytes())
            at += r.length
        assert at == len(own)
        assert all(r.length == size for r in by_doc[k][1:]) if len(own) > size else len(by_doc[k]) == 1
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size
    return len(by_seq)


def test_round_trip(spark):
    rng = np.random.default_rng(1)
    texts = [" ".join(["word"] * int(n)) for n in rng.integers(1, 3000, 80)] + ["same text here"] * 60 + [None, "", "x" * 20000, "<|endoftext|> and more <|endoftext|>", "long text " * 300_000]
    docs = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, piece string")
    rows = packing.pack(docs, PATH).collect()
    n = check(rows, texts)
    total = sum(r.length for r in rows)
    assert -(-total // 1024) <= n <= -(-total // 1024) + 3


def test_ids_kept_and_empty_table(spark):
    docs = spark.createDataFrame([(0, "a b"), (1, None)], "doc_id long, text string")
    rows = {r.doc_id: r for r in packing.pack(docs, PATH, keep_ids=True).collect()}
    assert rows[0].ids == [*library_ids(["a b"])[0], 2] and rows[1].ids == [2]
    assert packing.pack(docs.limit(0), PATH).count() == 0


def test_plan_uses_every_piece_once():
    rng = np.random.default_rng(3)
    for scale in (1, 50):
        counts = rng.integers(0, 4 * scale, 513)
        counts[0] = 0
        used = np.zeros(513, int)
        planned = packing.plan(counts)
        for pattern, n in planned:
            assert sum(pattern) <= 512
            for x in pattern:
                used[x] += n
        assert (used == counts).all()
        assert sum(n for _, n in planned) <= 1.005 * sum(n for _, n in packing.best_fit(counts))


def test_the_fit_meets_its_optimality_conditions():
    rng = np.random.default_rng(5)
    for counts in (rng.integers(0, 3, 129), rng.poisson(40 * np.exp(-np.arange(129) / 40)), np.eye(129, dtype=int)[60] * 9):
        counts = counts.astype(np.int64)
        counts[[0, 128]] = 0
        rows = packing.patterns(counts)
        if not len(rows):
            continue
        held, value = packing.fit(rows, counts)
        weight = 0.2 + np.arange(129) / 128
        weight[0] = 0
        short = counts - np.bincount(rows[held].ravel(), np.repeat(value, 3), 129)
        gradient = (short * weight)[rows].sum(1) - packing.gap_costs(rows, counts)
        assert (value > 0).all() and np.abs(gradient[held]).max() < 1e-3 and gradient.max() <= 3.1e-3 * max(1, counts.max())


def sequences(made):
    return sum(n for _, n in made)


@pytest.fixture(scope="module")
def lengths(spark):
    """The histogram of the pieces of the given documents."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    counts = np.zeros(1025, np.int64)
    for length, n in packing.pieces(docs, PATH, "doc_id", "text", 1024, 2, False).groupBy("length").count().collect():
        counts[length] = n
    counts[1024] = 0
    return counts


@pytest.mark.parametrize("times", [1, 3, 10, 30])
def test_most_sequences_come_from_patterns(lengths, times):
    """Also where few lengths are in use, drawn again many times, so that long pieces have no partner that fills up exactly."""
    counts = np.random.default_rng(6).multinomial(lengths.sum() * times, lengths / lengths.sum()) if times > 1 else lengths
    made, left = packing.fitted(counts)
    total = sequences(packing.plan(counts))
    assert sequences(made) > 0.8 * total and total <= 1.005 * sequences(packing.best_fit(counts))
    assert all(1024 - 128 <= sum(p) <= 1024 and 2 <= len(p) <= 3 for p, _ in made) and (left >= 0).all()


def test_the_residual_fills_the_gaps_of_patterns():
    counts = np.zeros(1025, int)
    counts[[600, 350, 70]] = 5, 5, 5
    assert packing.fitted(counts)[0] == [((600, 350), 5)] and packing.plan(counts) == [((600, 350, 70), 5)]


def test_ties_repeats_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, "same"), (1, "same"), (1, "other"), (None, "same"), (None, None)] * 3, "doc_id long, text string")
    docs = docs.selectExpr("*", "1 AS length", "'x' AS _rank", "2 AS sequence_id", "3 AS _part", "4 AS _parts")
    rows = packing.pack(docs, PATH).collect()
    assert len(rows) == 15 and sum(r.length for r in rows) == sum(len(x) + 1 for x in library_ids(["same", "same", "other", "same", ""])) * 3
    places = sorted((r.sequence_id, r.offset, r.length) for r in rows)
    assert all(a[1] + a[2] == b[1] if a[0] == b[0] else b[1] == 0 for a, b in zip(places, places[1:]))
