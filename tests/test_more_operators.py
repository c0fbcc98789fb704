"""Literal cases and plain forms of rings' cycles, phones, notes, curves, noise, access edges and stream-held tables."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kestrel.operators import banks as B
from kestrel.operators import briefs as R
from kestrel.operators import evaluate as M
from kestrel.operators import messages as T
from kestrel.operators import rings as K
from kestrel.operators import trail as W
from kestrel.operators.components import components
from kestrel.sources import files as S
from kestrel.streaming import jobs as X


def test_cycles_of_any_length_and_turned_back_walks(spark):
    ring = lambda name, edges: [(name, a, b) for a, b in edges]
    long = [(f"n{k}", f"n{(k + 1) % 9}") for k in range(9)] + [("n0", "x")]
    tree = [(a, b) for a, b in (("a", "b"), ("b", "c"), ("c", "d"))] + [("b", "a"), ("c", "b"), ("d", "c")]
    mixed = [("p", "q"), ("q", "p"), ("q", "r"), ("r", "p"), ("s", "p")]
    rows = ring("long", long) + ring("tree", tree) + ring("mixed", mixed) + ring("chain", [("k1", "k2"), ("k2", "k3")])
    tx = spark.createDataFrame([(k, a, b, 1.0, 0) for k, (_, a, b) in enumerate(rows)], "tx_id long, source string, target string, amount double, t long")
    members = spark.createDataFrame(sorted({(n, x) for n, a, b in rows for x in (a, b)}), "ring_id string, account_id string")
    assert {r.ring_id for r in K.cyclic_rings(tx, members).collect()} == {"long", "mixed"}


def test_hubs_count_one_direction(spark):
    edges = [("a", "h"), ("b", "h"), ("h", "c"), ("h", "d"), ("a", "g"), ("b", "g"), ("g", "c"), ("g", "d")]
    tx = spark.createDataFrame([(k, a, b, 1.0, 0) for k, (a, b) in enumerate(edges)], "tx_id long, source string, target string, amount double, t long")
    members = spark.createDataFrame([("r", x) for x in "abcdgh"], "ring_id string, account_id string")
    assert K.topology(tx, members).first().label == "mixed laundering network"


def test_components_against_union_find(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)] + [(1000 + k, 1001 + k) for k in range(200)] + [(None, 1), (5, 5)]
    df = spark.createDataFrame(edges, "src long, dst long").repartition(7)
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    assert {r.node: r.component for r in components(df).collect()} == {x: find(x) for x in list(parent)}
    assert components(df.limit(0)).count() == 0


def test_phone_flags(spark):
    cases = {"9876543210": "", "+91 98765 43210": "", "09876543210": "", "5876543210": "bad_start", "98765": "too_short", "9999999999": "few_digits", "9898989898": "few_digits", "00919876543210123": "too_long", "": "too_short", "12": "too_short,bad_start,few_digits"}
    rows = spark.createDataFrame([(p,) for p in cases], "p string").select("p", T.phone_flags(F.col("p")).alias("f")).collect()
    assert {r.p: r.f for r in rows} == cases


def test_markers_of_literal_texts(spark):
    texts = {
        "Officer from the cyber crime cell speaking": ["authority_impersonation"],
        "your account will be blocked within 2 hours": ["urgency_pressure"],
        "Never share OTP with anyone": [],
        "please share\nthe OTP": [],
        "share your one-time password": ["personal_data_request"],
        "click here https://x.reward-a.in/a": ["suspicious_link"],
        "You are under digital arrest": ["video_call_isolation"],
        "pay in bitcoin or gift cards": ["crypto_or_giftcard_demand"],
        "this number is from police": ["spoofed_number"],
        None: [],
    }
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r.text: r.markers for r in T.detect(df).collect()}
    assert got == texts
    first = {(r.doc_id, r.marker): (r.place, r.evidence) for r in T.first_evidence(df, "doc_id").collect()}
    assert first[4, "personal_data_request"] == (1, "share your one-time password") and first[6, "video_call_isolation"] == (15, "digital arrest")


def test_curves_against_plain_forms(spark):
    rng = np.random.default_rng(2)
    score = np.round(rng.random(500), 2).tolist() + rng.random(300).tolist()
    label = [int(rng.random() < s) for s in score]
    df = spark.createDataFrame(list(zip(label, score)), "label int, score double")
    t = {r.score: (r.tp, r.called) for r in M.threshold_table(df).collect()}
    assert t == {s: (sum(y for y, x in zip(label, score) if x >= s), sum(x >= s for x in score)) for s in set(score)}
    pos, neg = [s for y, s in zip(label, score) if y], [s for y, s in zip(label, score) if not y]
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    assert M.auc(df).first().auc == pytest.approx(wins / len(pos) / len(neg))
    steps = sorted(set(score), reverse=True)
    ap = sum(sum(y for y, x in zip(label, score) if x == s) / len(pos) * t[s][0] / t[s][1] for s in steps)
    assert M.average_precision(df).first().average_precision == pytest.approx(ap)


def test_noise_is_repeatable_and_of_the_right_size(spark):
    df = spark.createDataFrame([(k, [1.0] + [0.0] * 63) for k in range(400)], "vec_id long, embedding array<double>")
    a, b = (np.array([r.embedding for r in B.noisy(df.repartition(n), "vec_id", 1.0).orderBy("vec_id").collect()]) for n in (2, 5))
    sigma = 2 * np.sqrt(2 * np.log(1.25e5))
    assert (a == b).all() and abs((a[:, 1:]).std() / sigma - 1) < 0.02 and abs(a[:, 1:].mean()) < 0.1 * sigma


def test_matching_by_group(spark):
    rows = [(e, o, i, s) for e in (0.5, 1.0) for o, i, s in ((1, 10, 0.9), (1, 11, 0.8), (2, 10, 0.85), (2, 11, 0.1), (3, 12, 0.05))]
    got = B.one_to_one(spark.createDataFrame(rows, "epsilon double, out_id long, in_id long, score double"), 0.1, ("epsilon",)).collect()
    assert sorted((r.epsilon, r.out_id, r.in_id) for r in got) == [(e, *p) for e in (0.5, 1.0) for p in ((1, 10), (2, 11))]


def test_records_meet_once_for_all_embeddings(spark):
    rows = [(k, k % 4, ("out", "in")[k // 4 % 2], 100 + k * 7 % 5, k * 3 % 20, [1.0, float(k % 5), 0.5]) for k in range(80)]
    df = spark.createDataFrame(rows, "vec_id long, bank_id long, direction string, amount_cents long, time_sec long, embedding array<double>")
    both = B.pair_scores(df.withColumn("e0", B.noise("vec_id", 0.5)), embeddings=("embedding", "e0"))
    assert both._jdf.queryExecution().optimizedPlan().toString().count("Join Inner") == 1
    got = {(r.out_id, r.in_id): tuple(r.score) for r in both.collect()}
    one, two = ({(r.out_id, r.in_id): r.score for r in B.pair_scores(d).collect()} for d in (df, B.noisy(df, "vec_id", 0.5)))
    assert got == {k: (one[k], two[k]) for k in one} and len(one) > 50


def test_access_edges(spark):
    nodes = spark.createDataFrame([("a", 10.0, 70.0), ("b", 10.2, 70.0), ("c", 30.0, 90.0)], "id string, lat double, lon double")
    places = spark.createDataFrame([("near", 10.1, 70.0), ("far", 20.0, 80.0), ("unknown", None, 1.0)], "place string, lat double, lon double")
    got = {(r.place, r.node) for r in W.attach(places, nodes).collect()}
    dist = lambda p, q: 2 * 6371 * np.arcsin(np.sqrt(np.sin(np.radians(q[0] - p[0]) / 2) ** 2 + np.cos(np.radians(p[0])) * np.cos(np.radians(q[0])) * np.sin(np.radians(q[1] - p[1]) / 2) ** 2))
    nearest = min("abc", key=lambda n: dist((20.0, 80.0), {"a": (10.0, 70.0), "b": (10.2, 70.0), "c": (30.0, 90.0)}[n]))
    assert got == {("near", "a"), ("near", "b"), ("far", nearest)}


def test_capping_and_checks(spark):
    rows = [("genuine", "valid", True), ("genuine", "duplicate", True), ("genuine", "valid", False), ("fake", "duplicate", False), ("uncertain", "valid", None), ("genuine", "valid", None)]
    df = spark.createDataFrame([(*r, 0.9) for r in rows], "verdict string, status string, review_ok boolean, confidence double")
    got = [(r.verdict, r.confidence, r.passed, r.recommendation) for r in R.note_check(R.capped(df)).collect()]
    assert got == [("genuine", 0.9, True, "accept"), ("uncertain", 0.75, False, "refer for inspection"), ("uncertain", 0.75, False, "refer for inspection"), ("fake", 0.9, False, "reject and retain"), ("uncertain", 0.9, False, "refer for inspection"), ("genuine", 0.9, True, "accept")]


def test_extra_rows_need_their_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text("text,label,origin,group\nx,1,o,g\n")
    assert S.extra_rows(spark, str(tmp_path)).count() == 1
    (tmp_path / "b.csv").write_text("text,label\nx,1\n")
    with pytest.raises(ValueError, match="origin"):
        S.extra_rows(spark, str(tmp_path))


def test_a_missing_version_is_an_error(spark, tmp_path):
    assert X.version(spark, str(tmp_path), -1, "a long").count() == 0
    with pytest.raises(Exception):
        X.version(spark, str(tmp_path), 3, "a long").count()
    path = tmp_path / "in.parquet"
    path.mkdir()
    for k, rows in enumerate(([(1, 5, "x"), (2, 4, "y")], [(1, 6, "z"), (3, 1, "w")])):
        pd.DataFrame(rows, columns=["k", "t", "v"]).to_parquet(path / f"part-{k}.parquet")
    stream = X.source(spark, str(path))
    X.upsert(stream, str(tmp_path / "out"), "k", "t", keep=2)()
    assert {(r.k, r.v) for r in X.newest_version(spark, str(tmp_path / "out"), stream.schema).collect()} == {(1, "z"), (2, "y")}
