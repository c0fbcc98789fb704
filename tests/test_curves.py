"""Curves of scores that lie close together."""

import random

import pytest
from pyspark.sql import functions as F

from kestrel.operators import evaluate as M


def test_sums_over_crowded_scores_stay_even_and_right(spark):
    dice = random.Random(9)
    scores = [dice.random() * 1e-4 for _ in range(9900)] + [dice.random() for _ in range(100)] + [0.5] * 50
    rows = [(int(dice.random() < 0.3), s) for s in scores] + [(1, None)]
    df = spark.createDataFrame(rows, "label int, score double")
    t = M.cumulated(M.by_score(df), ["pos", "n"], True)
    got = {r.score: (r.pos_c, r.n_c) for r in t.collect()}
    pos = n = 0
    want = {}
    for s in sorted({s for _, s in rows if s is not None}, reverse=True):
        own = [y for y, x in rows if x == s] if s == 0.5 else None
        if own is None:
            own = [rows[scores.index(s)][0]]
        pos, n = pos + sum(own), n + len(own)
        want[s] = (pos, n)
    assert got == want
    ranks = sorted(((s, y) for y, s in rows if s is not None), key=lambda r: r[0])
    ones = sum(y for _, y in ranks)
    below, wins, i = 0, 0.0, 0
    while i < len(ranks):
        j = i
        while j < len(ranks) and ranks[j][0] == ranks[i][0]:
            j += 1
        p = sum(y for _, y in ranks[i:j])
        wins += p * (below + (j - i - p) / 2)
        below += j - i - p
        i = j
    known = df.where("score IS NOT NULL")
    assert M.auc(known).first().auc == pytest.approx(wins / (ones * (len(ranks) - ones)))


def test_ranges_hold_about_as_many_scores_each(spark, monkeypatch):
    monkeypatch.setattr(M, "RANGES", 16)
    df = spark.range(4000).select((F.col("id") % 2).cast("int").alias("label"), F.when(F.col("id") < 3960, F.col("id") / 4e7).otherwise(F.col("id") / 4000).alias("score"))
    sizes = []
    real = M.Bucketizer.transform
    monkeypatch.setattr(M.Bucketizer, "transform", lambda self, d: sizes.append(real(self, d)) or sizes[-1])
    assert M.threshold_table(df).count() == 4000
    counts = [r["count"] for r in sizes[0].groupBy("_p").count().collect()]
    assert len(counts) == 16 and max(counts) < 2 * 4000 / 16


def test_empty_and_constant_scores(spark):
    empty = spark.createDataFrame([], "label int, score double")
    assert M.threshold_table(empty).count() == 0
    one = spark.createDataFrame([(1, 0.5), (0, 0.5)], "label int, score double")
    assert [(r.tp, r.called) for r in M.threshold_table(one).collect()] == [(1, 2)]
