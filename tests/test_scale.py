"""Work that must not grow faster than the input: how often texts are searched, and what is joined."""

from functools import reduce

from pyspark.sql import functions as F

from kestrel.functions import message_values as V
from kestrel.operators import messages as M

SAID = [
    "This is Inspector Rao calling from CBI", "an F.I.R; FIR: has been registered", "Pay now!", "send it to a safe\ncustody account, transfer today", "STAY ON the video call",
    "confirm your OTP", "go to https://bit.ly/x1", "this number is from police", "sub-inspector Das speaking", "you won 5 lakh, claim your prize", "do not tell your family", "", None, "plain talk",
]


def test_a_text_is_searched_only_with_a_word_of_the_marker_and_once(spark):
    df = spark.createDataFrame(list(enumerate(SAID)), "doc_id int, text string")
    each = {m: reduce(lambda a, b: a | b, [F.coalesce(F.col("text").rlike(f"(?i){p}"), F.lit(False)) for p in ps]) for m, ps in V.MARKERS.items()}
    wanted = {r.doc_id: [m for m in V.MARKERS if r[m]] for r in df.select("doc_id", *[c.alias(m) for m, c in each.items()]).collect()}
    assert {r.doc_id: r.markers for r in M.detect(df).collect()} == wanted and set().union(*wanted.values()) == set(V.MARKERS)
    assert M.cued(df).where("size(_cues) > 0").where("doc_id >= 11").count() == 0
    searched = M.marker_features(df)._jdf.queryExecution().optimizedPlan().toString().lower().count("regexp_instr(")
    assert searched <= len(V.MARKERS) + 3, searched


def test_trails_are_found_without_forming_pairs(spark):
    import random
    from decimal import Decimal

    from kestrel.operators import correlate as J

    deal = random.Random(5)
    cents = [0, 1, 7, 99, 100, 101, 4999, 5000, 5049, 5050, 5051, 123456]
    scams = [(k, Decimal(deal.choice(cents)) / 100, deal.choice([None, 0, 7200, 345600, 9 * 10**6]), k) for k in range(60)]
    edges = [(k, "a", f"r{k % 3}", Decimal(deal.choice(cents)) / 100, deal.choice([0, 1, 7200, 352800, 352801, 9 * 10**6])) for k in range(80)]
    paid = spark.createDataFrame([s[:3] for s in scams], "event_id long, paid decimal(18,2), t long")
    into = spark.createDataFrame(edges, "tx_id long, source string, target string, amount decimal(18,2), t long")
    wanted = {}
    for e, p, t, _ in scams:
        met = [(u, g, x) for x, _, g, a, u in edges if p > 0 and t is not None and abs(a - p) * 100 <= p and a > 0 and -7200 <= u - t <= 345600]
        if met:
            wanted[e] = min(met)
    found = J.money_trails(paid, into)
    assert {r.event_id: (r.lag_s, r.target, r.tx_id) for r in found.collect()} == {e: (u - scams[e][2], g, x) for e, (u, g, x) in wanted.items()}
    asked = paid.where("t IS NOT NULL").select(F.col("event_id").alias("id"), J.hundredths(F.col("paid")).alias("x"), (F.col("t") - 7200).alias("since"), (F.col("t") + 345600).alias("until"))
    held = into.select(J.hundredths(F.col("amount")).alias("x"), "t", "tx_id")
    numbers = {r.id: r.n for r in J.first_in_bands(asked, held, ["tx_id"], 0.01, 100_000, count=True).collect()}
    assert numbers == {e: n for e, p, t, _ in scams if (n := sum(t is not None and p > 0 < a and abs(a - p) * 100 <= p and -7200 <= u - t <= 345600 for _, _, _, a, u in edges))}


def test_reports_of_routes_are_counted_by_sets_of_cities(spark):
    from kestrel.operators import routes as R

    near = spark.createDataFrame([(a, e) for e in range(500) for a in (["x", "y"] if e % 2 else ["y"])] * 2, "at string, event_id long")
    cities = spark.createDataFrame([("r1", "x"), ("r1", "y"), ("r2", "x"), ("r3", "z")], "route string, at string")
    made = R.reported(cities, near, ["route"])
    assert {r.route: r.fir for r in made.collect()} == {"r1": 500, "r2": 250}
    assert R.reported(cities, near.withColumn("event_id", F.lit(None).cast("long")), ["route"]).count() == 0


def test_open_wedges_are_never_rows(spark):
    import itertools

    from kestrel.operators import features as G

    pairs = [(x, y) for x, y in itertools.combinations(range(9), 2) if (x * y) % 4 != 3] + [("h", k) for k in range(20)]
    tx = spark.createDataFrame([(str(a), str(b), 1.0, k) for k, (a, b) in enumerate([*pairs, (1, 1), (5, 2)])], "source string, target string, amount double, t long")
    known = {frozenset(map(str, p)) for p in pairs}
    names = sorted({n for p in known for n in p})
    closed = [c for c in itertools.combinations(names, 3) if all(frozenset(p) in known for p in itertools.combinations(c, 2))]
    made = G.triangles(tx)
    assert {r.account_id: r.triangles for r in made.collect()} == {n: sum(n in c for c in closed) for n in names}
    assert "array_intersect" in made._jdf.queryExecution().optimizedPlan().toString()


def test_documents_are_judged_once_and_values_taken_out_once(spark, tmp_path):
    from kestrel.operators import contracts as C
    from kestrel.streaming import jobs as X

    df = spark.createDataFrame([(k, '{"event_id": "n"}' if k % 2 else "[]") for k in range(20)], "k int, body string")
    plan = C.checked(df, C.NOTE)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("variant_get(") <= 150, plan.count("variant_get(")
    df.write.parquet(str(tmp_path / "in.parquet"))
    read, text = spark.sparkContext.accumulator(0), F.udf(lambda b: read.add(1) or b).asNondeterministic()
    stream = X.source(spark, str(tmp_path / "in.parquet"), 100).withColumn("body", text("body"))
    valid, quarantined = X.ingest_documents(stream, C.NOTE, str(tmp_path / "out"))
    assert valid.count() == 0 and quarantined.count() == 20 and read.value == 20


def test_ranks_of_two_sides_settle_in_few_rounds(spark):
    from kestrel.operators import features as G

    pairs = [(f"c{k}", f"s{(k * m) % 5}") for k in range(40) for m in (1, 2, 3)]
    both = [p for a, b in pairs for p in ((a, b), (b, a))]
    names = sorted({n for p in pairs for n in p} | {"d", "alone"})
    # What leaves for good, or to an account that pays nobody, ebbs as slowly as alpha lets it; what only goes to and fro does not.
    for rows, alpha in ((both, 0.85), (both + [("c0", "out"), ("away", "c1"), ("c2", "d")], 0.3)):
        tx, accounts = spark.createDataFrame(rows, "source string, target string"), spark.createDataFrame([(n,) for n in names], "account_id string")
        made = {r.account_id: r.pagerank for r in G.pagerank(tx, accounts, alpha, most=40).collect()}
        ends, n = {a: {y for x, y in rows if x == a} for a in names}, len(names)
        rank = dict.fromkeys(names, 1 / n)
        for _ in range(200):
            loose = sum(rank[a] for a in names if not ends[a])
            rank = {b: (1 - alpha) / n + alpha * (sum(rank[a] / len(ends[a]) for a in names if b in ends[a]) + loose / n) for b in names}
        assert made.keys() == rank.keys() and max(abs(made[a] - rank[a]) for a in names) < 1e-8


def test_cores_from_counted_values_and_bounded_arrays(spark, monkeypatch):
    from kestrel.operators import features as G

    monkeypatch.setattr(G, "ENDS", 3)
    rows = [(f"k{a}", f"k{b}", 1.0, 0) for a in range(6) for b in range(a)] + [("k0", f"p{k}", 1.0, 0) for k in range(30)] + [("p0", "p1", 1.0, 0), ("p1", "p0", 1.0, 0), ("k1", "k1", 1.0, 0)]
    tx = spark.createDataFrame(rows, "source string, target string, amount double, t long")
    wanted = {f"k{a}": 5 for a in range(6)} | {f"p{k}": 1 + (k < 2) for k in range(30)}
    assert {r.account_id: r.core_number for r in G.core_numbers(tx).collect()} == wanted
    assert G.ended(spark.range(10).selectExpr("0L AS i", "id AS j")).agg(F.max(F.size("ends"))).first()[0] == 3


def test_texts_are_counted_once_and_as_spark_does(spark):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import HashingTF, NGram, RegexTokenizer, VectorAssembler

    from kestrel.operators import learn as L

    texts = ["Pay NOW, pay now! 12 times", "", "ab", "Zahlen Sie Gebühr für Ärger_und über-all", "a  b\nc aaaaaa", "日本語 テキスト", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    grams = [("words", 1), ("words", 2), ("letters", 3), ("letters", 4), ("letters", 5)]
    stages = [
        RegexTokenizer(inputCol="text", outputCol="words", pattern="[^\\p{L}\\p{N}]+", toLowercase=True),
        RegexTokenizer(inputCol="text", outputCol="letters", pattern="", toLowercase=True, minTokenLength=0),
        *[NGram(n=n, inputCol=c, outputCol=f"g{k}") for k, (c, n) in enumerate(grams)],
        *[HashingTF(inputCol=f"g{k}", outputCol=f"tf{k}", numFeatures=1 << 16) for k in range(5)],
        VectorAssembler(inputCols=[f"tf{k}" for k in range(5)], outputCol="counts"),
    ]
    plain = df.na.fill("")
    wanted = {r.doc_id: r.counts for r in Pipeline(stages=stages).fit(plain).transform(plain).select("doc_id", "counts").collect()}
    made = L.with_features(df)
    terms = lambda v: {i: x for i, x in zip(v.indices.tolist(), v.values.tolist()) if i < 5 << 16}
    assert all(terms(r.counts) == terms(wanted[r.doc_id]) for r in made.collect()) and made.count() == len(texts)
    assert "Python" not in made._jdf.queryExecution().optimizedPlan().toString()
    model = L.message_model(made.withColumn("label", (F.col("doc_id") == 0).cast("int")))
    assert len(str(L.probabilities(model, made).schema["features"].metadata)) < 1000 and len(model.stages) == 2


def test_terms_are_counted_in_bounded_parts_and_stored_in_small_groups(spark, monkeypatch):
    import random
    from collections import Counter

    import numpy as np
    import pyarrow.parquet as pq

    from kestrel.operators import learn as L

    texts = ["pay now, pay now", "", "ä ß日本語x", "a", "_", "one_two  three\n" + "x" * 300, "🙂🙂 ok🙂"]
    flags = np.array([[k % 2, 0.4 * (k == 3)] for k in range(len(texts))], float)
    whole = L.counted(texts, flags).to_pylist()
    monkeypatch.setattr(L, "CHARACTERS", 7)
    assert L.counted(texts, flags).to_pylist() == whole
    for t, f, v in zip(texts, flags, whole):
        words = L.re.findall(r"[^\W_]+", t)
        n = len(words) + max(len(words) - 1, 0) + sum(max(len(t) - k + 1, 0) for k in (3, 4, 5))
        assert sum(x for i, x in zip(v["indices"], v["values"]) if i < 5 * L.PLACES) == n and v["size"] == 5 * L.PLACES + 2
        assert v["indices"] == sorted(set(v["indices"])) and [x for i, x in zip(v["indices"], v["values"]) if i >= 5 * L.PLACES] == [x for x in f if x]
    assert Counter(whole[0]["values"])[2.0] > 0
    deal = random.Random(1)
    rows = [(k, "".join(deal.choices("abcdefghijklmnopqrstuvwxyz ", k=20_000))) for k in range(120)]
    made = L.with_features(spark.createDataFrame(rows, "doc_id int, text string").coalesce(1))
    files = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in made.inputFiles()]
    assert max(m.row_group(g).num_rows for m in files for g in range(m.num_row_groups)) < 60 and made.count() == 120


def test_messages_are_scored_without_their_vectors(spark):
    from kestrel.operators import learn as L

    rows = [(k, t, int(k % len(SAID) < 6)) for k, t in enumerate(SAID * 3)]
    df = spark.createDataFrame(rows, "doc_id int, text string, label int")
    features = L.with_features(df)
    model = L.message_model(features)
    wanted = {r.doc_id: r.score for r in L.probabilities(model, features).select("doc_id", "score").collect()}
    made = L.scored(model, df.drop("label"))
    got = {r.doc_id: r for r in made.collect()}
    assert got.keys() == wanted.keys() and max(abs(got[k].score - s) for k, s in wanted.items()) < 1e-9 and len({round(s, 6) for s in wanted.values()}) > 5
    assert {k: r.markers for k, r in got.items()} == {r.doc_id: r.markers for r in M.detect(df).collect()}
    plan = M.analysed(made, "score")._jdf.queryExecution().optimizedPlan().toString()
    assert "counts#" not in plan and plan.lower().count("rlike") < 40 + len(V.MARKERS)


def test_a_driver_over_half_of_its_heap_hands_it_back(monkeypatch):
    from types import SimpleNamespace as N

    from kestrel import session as S

    calls, held = [], [10]
    heap = N(totalMemory=lambda: held[0], maxMemory=lambda: 100)
    lang = N(Runtime=N(getRuntime=lambda: heap), System=N(gc=lambda: calls.append(1)))
    spark = N(sparkContext=N(_jvm=N(java=N(lang=lang))))
    monkeypatch.setattr(S, "_collected", float("-inf"))
    S.hand_back(spark)
    assert not calls
    held[0] = 60
    S.hand_back(spark)
    S.hand_back(spark, 100)  # not again so soon
    assert len(calls) == 1
