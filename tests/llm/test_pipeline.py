"""The pipeline against a plain version: each stage written out over lists of rows."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from kestrel.llm import toxicity as X
from tests.llm.test_joins import shingles
from tests.llm.test_packing import library_ids

pytest.importorskip("public_tokenizers")


def words(text):
    import re

    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def plain(rows, items, model):
    """rows (doc_id, text) left before packing."""
    lexicon = X.Lexicon(model.weights)
    z = lambda t: model.bias + sum(a * b for a, b in zip(model.slopes, X.features(*X.hits(lexicon, t))))
    rows = [r for r in rows if z(r[1]) < 0]
    rows = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    kept, sets = [], [shingles(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    kept = [r for k, r in enumerate(rows) if not sets[k] or group[k] == k]
    windows = set()
    for w in map(words, items):
        windows |= {tuple(w[k : k + 13]) for k in range(max(1, len(w) - 12))} if w else set()
    out = []
    for i, t in kept:
        w, hit = words(t), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
        if not (hit and 20 * len(hit) >= len(w)):
            out.append((i, t))
    return out


def tables(spark, path, rows, labels, items):
    docs = spark.createDataFrame([(i, t, "en", k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, contaminated string, toxicity int")
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{path}/benchmark.parquet")
    return docs


def test_pipeline_against_the_plain_version(spark, tmp_path):
    rng = random.Random(12)
    vocabulary = ["".join(rng.choices("aeioulnrst", k=rng.randint(3, 8))) for _ in range(400)]
    text = lambda n: " ".join(rng.choices(vocabulary, k=n))
    rows, labels = [], []
    for i in range(400):
        body = text(rng.randint(15, 60)).split()
        bad = i % 5 == 0
        if bad:
            for w in ("grobvul", "schmutzig"):
                body.insert(rng.randrange(len(body)), w)
        rows.append((i, " ".join(body)))
        labels.append((i, int(bad)))
    item = text(30)
    rows += [(500, f"{text(20)} {item} {text(20)}"), (501, item.upper()), (502, f"{text(900)} {' '.join(item.split()[:13])} {text(900)}")]
    rows += [(600, rows[1][1]), (601, rows[2][1] + " end"), (1, rows[1][1]), (3, text(40)), (None, text(30)), (None, rows[4][1]), (None, None), (700, None), (701, ""), (702, ""), (703, text(60_000))]
    items = [("a", item), ("b", None), ("c", "")]
    docs = tables(spark, tmp_path, rows, labels, items)
    model = X.learn(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    left, stages = docs, []
    for _, stage in P.STAGES[:3]:
        left = P.materialise(stage(spark, left, str(tmp_path)))
        assert left.columns == docs.columns and {r.contaminated for r in left.collect()} <= {"en"}
        stages.append({r.doc_id for r in left.collect()})
    assert not {i for i, y in labels if y} & stages[0] and 500 in stages[1] and not {500, 501} & stages[2] and 502 in stages[2]
    wanted = plain(rows, [t for _, t in items], model)
    assert sorted(map(str, ((r.doc_id, r.text) for r in left.collect()))) == sorted(map(str, wanted))
    pieces = P.STAGES[3][1](spark, left, str(tmp_path)).collect()
    known = [r for r in pieces if r.doc_id is not None and r.doc_id not in (1, 3)]
    alone = [(i, t) for i, t in wanted if i is not None and i not in (1, 3)]
    place = {i: k for k, (i, _) in enumerate(alone)}
    renumbered = [r.asDict() | {"doc_id": place[r.doc_id]} for r in known]
    for r in renumbered:
        assert r["offset"] + r["length"] <= 1024
    total = sum(len(x) + 1 for x in library_ids([t or "" for _, t in wanted]))
    assert sum(r.length for r in pieces) == total and len({r.sequence_id for r in pieces}) <= -(-total // 1024) + 2
    assert {r.doc_id for r in pieces} == {i for i, _ in wanted}


def test_stages_on_empty_tables(spark, tmp_path):
    docs = tables(spark, tmp_path, [], [], [])
    for _, stage in P.STAGES[:3]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns and stage(spark, docs, str(tmp_path)).count() == 0
    assert P.run(spark, str(tmp_path)).count() == 0


def test_repeated_rows_and_ties(spark, tmp_path):
    same = " ".join(f"w{k}" for k in range(40))
    docs = tables(spark, tmp_path, [(1, same)] * 3 + [(2, same)] * 2 + [(3, None)] * 2, [(1, 0)], [("a", "x")])
    assert P.clean(spark, docs, str(tmp_path)).count() == 7
    assert sorted(r.doc_id for r in P.distinct(spark, docs, str(tmp_path)).collect()) == [1, 3]
    assert P.uncontaminated(spark, docs.withColumn("items", F.lit(5)), str(tmp_path)).columns[-1] == "items"
