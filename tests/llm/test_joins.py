import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kestrel.llm import embedding_dedup as E
from kestrel.llm import licences as L
from kestrel.llm import licence_texts as LT
from kestrel.llm import ngram_join as N


def shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(zip(*[words[k:] for k in range(5)])) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def test_ngram_join_against_brute_force(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefg", k=4))
    passage = " ".join(word() for _ in range(60))
    texts = [None, "", "  \n", "one two", "ONE two", "one\ttwo", "one two three"]
    for _ in range(12):
        base = [word() for _ in range(rng.randint(30, 160))]
        for _ in range(rng.randint(1, 5)):
            copy = list(base)
            for _ in range(rng.randint(0, 6)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    texts += [f"{passage} {' '.join(word() for _ in range(rng.randint(5, 40)))}" for _ in range(30)]
    hot = [word() for _ in range(80)]
    texts += [" ".join(hot)] * 40 + [" ".join(hot[:-1] + [word()]) for _ in range(40)]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(60, texts[60], "x")], "doc_id long, text string, n string")
    assert_join(N.join(df), texts, [60])
    assert N.join(df.limit(0)).count() == 0


def assert_join(joined, texts, again=()):
    """The join against all pairs of distinct sets."""
    sets = [shingles(t) for t in texts]
    first = {}
    for i, s in enumerate(sets):
        first.setdefault(s, i)
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        if s:
            parent[i] = first[s]
    own = [i for i, s in enumerate(sets) if s and first[s] == i]
    for i in own:
        for j in own:
            if j < i and 80 * len(sets[j]) <= 100 * len(sets[i]) and 80 * len(sets[i]) <= 100 * len(sets[j]):
                both = len(sets[i] & sets[j])
                if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                    a, b = find(i), find(j)
                    parent[max(a, b)] = min(a, b)
    rows = joined.collect()
    assert len(rows) == len(texts) + len(again)
    for r in rows:
        assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), find(r.doc_id))


def test_ngram_join_of_groups_over_many_blocks(spark):
    """Over a thousand near copies, and a second component that shares their words but not enough of them."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefg", k=5))
    base = [word() for _ in range(100)]
    other = base[:45] + [word() for _ in range(55)]
    texts = []
    for _ in range(1050):
        copy = list(base if rng.random() < 0.7 else other)
        copy[rng.randrange(len(copy))] = word()
        texts.append(" ".join(copy))
    texts += [" ".join(base[:-k]) for k in range(1, 60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert_join(N.join(df), texts)


def test_ngram_join_block_by_block(spark, monkeypatch):
    """Blocks of a few members, so that every pair of blocks matters."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefg", k=5))
    texts = []
    for _ in range(6):
        base = [word() for _ in range(60)]
        for _ in range(25):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
        texts += [" ".join(base[k:] + [word() for _ in range(k)]) for k in range(0, 40, 4)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(N, "BLOCK", 5)
    monkeypatch.setattr(N, "BLOCK_BYTES", 3000)
    assert_join(N.join(df), texts)


def test_counts_as_bytes():
    rng = np.random.default_rng(1)
    for top in (3, 16, 200):
        counts = rng.integers(0, top, 128).astype(np.uint8)
        assert (N.from_bytes(np.frombuffer(N.to_bytes(counts), np.uint8)) == counts).all()


def test_null_and_reused_ids_with_different_texts(spark):
    import corpus_pipeline

    word = lambda k, n=40: " ".join(f"w{k}x{j}" for j in range(n))
    a, b, c, d, e = (word(k) for k in range(5))
    rows = [(1, a), (2, b), (2, f"{a} more"), (3, f"{b} more"), (None, c), (None, d), (None, f"{a} again"), (4, f"{c} more"), (5, e), (5, e), (None, f"{e} end"), (6, ""), (7, None), (None, ""), (8, word(9)), (8, word(10))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("x"))
    got = sorted(map(str, ((r.doc_id, r.n_shingles, r.component_id) for r in N.join(df).collect())))
    least = {a: 1, b: 2, c: 4, d: None, e: 5}
    wanted = [(i, len(shingles(t)), next((v for k, v in least.items() if t and t.startswith(k)), i)) for i, t in rows]
    assert got == sorted(map(str, wanted))
    left = corpus_pipeline.distinct(spark, df, "").collect()
    kept = [(1, a), (2, b), (4, f"{c} more"), (None, d), (5, e), (6, ""), (7, None), (None, ""), (8, word(9)), (8, word(10))]
    assert sorted(map(str, ((r.doc_id, r.text) for r in left))) == sorted(map(str, kept))
    plain = df.where("doc_id IN (1, 3, 4)")
    assert {r.doc_id for r in corpus_pipeline.distinct(spark, plain, "").collect()} == {1, 3, 4}


def test_count_tree_finds_all_within_the_bound():
    rng = np.random.default_rng(0)
    counts = rng.integers(0, 4, (500, 8))
    sizes = counts.sum(1)
    tree = N.CountTree(sizes, counts)
    for k in range(0, 500, 25):
        bound = np.minimum(counts, counts[k]).sum(1)
        ok = (bound >= N.least_overlap(sizes[k], sizes, 80)) & (100 * sizes[k] >= 80 * sizes) & (100 * sizes >= 80 * sizes[k])
        assert sorted(tree.search(int(sizes[k]), counts[k], 80)) == np.flatnonzero(ok).tolist()


def test_embeddings_against_brute_force(spark):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((40, 16))
    x = [c + rng.standard_normal(16) * s for c in centres for s in (0.0, 0.1, 0.15)]
    x += [centres[0] * (1 + k / 100) + rng.standard_normal(16) * 0.12 for k in range(120)] + [x[0]] * 5
    rows = [(i, [float(v) for v in e], "x") for i, e in enumerate(x)]
    n = len(rows)
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] * 16, [None] * 16, [1.0, 0.0]]
    df = spark.createDataFrame(rows + [(n + k, e, "x") for k, e in enumerate(odd)], "vec_id long, embedding array<double>, kept string")
    u = np.array([e for _, e, _ in rows])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    hit = u @ u.T >= 0.9
    np.fill_diagonal(hit, False)
    label = np.arange(n)
    while True:
        new = np.array([min([label[k], *label[hit[k]]]) for k in range(n)])
        if (new == label).all():
            break
        label = new
    got = {r.vec_id: r for r in E.near_duplicates(df).collect()}
    assert len(got) == n + len(odd)
    found = sum(min(got[k].n_links, int(hit[k].sum())) for k in range(n))
    assert found >= 0.97 * hit.sum() and all(got[k].n_links <= hit[k].sum() for k in range(n))
    assert sum(got[k].component_id == label[k] for k in range(n)) >= 0.97 * n
    assert all(got[n + k].n_links == 0 and got[n + k].component_id == n + k and got[n + k].kept for k in range(len(odd)))
    assert E.near_duplicates(df.limit(0)).count() == 0


def test_links_between_saturated_groups(spark, monkeypatch):
    rng = np.random.default_rng(6)
    axes = np.linalg.qr(rng.standard_normal((48, 48)))[0]
    far = rng.standard_normal((600, 48))
    x = [axes[0] * np.cos(t) + axes[1] * np.sin(t) + rng.standard_normal(48) * 0.008 for t in (0.0, 0.36, 0.72) for _ in range(40)] + list(far)
    u = np.array(x) / np.linalg.norm(x, axis=1, keepdims=True)
    hit = u @ u.T >= 0.9
    np.fill_diagonal(hit, False)
    assert hit[:40, 40:80].all() and not hit[:40, 80:].any()
    df = spark.createDataFrame([(i, e.tolist()) for i, e in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in E.near_duplicates(df).collect()}
    assert all(got[k].n_links == hit[k].sum() for k in range(len(x))) and {got[k].component_id for k in range(120)} == {0}
    assert sum(r.kept for r in got.values()) == 601
    monkeypatch.setattr(E, "RECALL", 1.01)
    with pytest.raises(RuntimeError, match="recall"):
        E.near_duplicates(df.where("vec_id < 150"), max_passes=1)


def test_licences(spark):
    mit = LT.TEXTS[0][1]
    texts = [
        f"Copyright (c) 2020 Someone\n\n{mit.upper()}", f"The MIT License (MIT)\n\nCopyright 1999-2001 A. B.\n{mit.replace(' ', '  ')}", "a b\nReleased under the MIT Licence.\nc", "LICENSED under the Apache License - version 2.0",
        "Released under the MIT License. And more.", None, "", "!!", mit + " extra", "x y\n\nLicensed under CC BY 4.0\nReleased under CC0 1.0.",
    ]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(2, texts[2], "x")], "doc_id long, text string, licence string")
    rows = L.scan(df).collect()
    got = {r.doc_id: (r.licence, r.notices) for r in rows}
    assert len(rows) == len(texts) + 1
    assert got[0] == ("MIT", "") and got[1] == ("MIT", "") and got[2] == (None, "MIT") and got[3] == ("Apache-2.0", "Apache-2.0")
    assert got[4] == (None, "") and got[5] == got[6] == got[7] == (None, "") and got[8] == (None, "") and got[9] == (None, "CC-BY-4.0,CC0-1.0")
    assert L.scan(df.limit(0)).count() == 0


def test_whole_texts_of_long_licences(spark):
    named = dict(LT.FILES)
    bodies = {i: next(b for k, b in LT.TEXTS if k == i) for i in named}
    assert {"Apache-2.0", "GPL-2.0-only", "GPL-3.0-only", "LGPL-3.0-only", "MPL-2.0", "CC0-1.0", "CC-BY-SA-4.0"} <= set(named) and min(map(len, bodies.values())) > 5000
    cut = bodies["Apache-2.0"].partition(LT.END)[0]
    texts = [*((i, b) for i, b in bodies.items()), *((i, "\n\n".join(" ".join(x.split()) for x in b.upper().splitlines())) for i, b in bodies.items()), ("Apache-2.0", cut), (None, cut[: len(cut) // 2])]
    said = [("Apache-2.0", "This software is released under the Apache License v2.0."), ("GPL-3.0-only", "Distributed under the GNU GPLv3"), ("AGPL-3.0-only", "SPDX-License-Identifier: AGPL-3.0-only")]
    df = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(texts + [(i, f"x\n{t}\ny") for i, t in said])], "doc_id long, text string")
    got = {r.doc_id: (r.licence, r.notices) for r in L.scan(df).collect()}
    assert all(got[k][0] == i for k, (i, _) in enumerate(texts))
    assert [got[len(texts) + k] for k in range(len(said))] == [(None, i) for i, _ in said]
