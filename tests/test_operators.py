"""Small truth tables of the analytics operators."""

import math

import pytest
from pyspark.sql import functions as F

from kestrel.functions.geo import grid_join, haversine
from kestrel.operators import banks as B
from kestrel.operators import correlate as J
from kestrel.operators import evaluate as M
from kestrel.operators import features as G
from kestrel.operators import messages as T
from kestrel.operators import records as A
from kestrel.operators import resolve as E
from kestrel.operators import rings as K
from kestrel.operators import spectral as P
from kestrel.operators import trail as R
from kestrel.operators.components import components

TX = "tx_id long, source string, target string, amount decimal(18,2), t long"


def tx(spark, rows):
    from decimal import Decimal

    return spark.createDataFrame([(i, a, b, Decimal(str(x)), t) for i, (a, b, x, t) in enumerate(rows)], TX)


def test_components(spark):
    rng_edges = [(i, i + 1) for i in range(0, 60) if i % 10] + [(100, 3), (200, 200), (None, 5), (7, 7), (3, 100)]
    found = {r.node: r.component for r in components(spark.createDataFrame(rng_edges, "src long, dst long")).collect()}
    assert found[9] == found[100] == 1 and found[60] == 51 and 200 not in found and 10 in found
    assert components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_collector_account(spark):
    rows = [(f"a{i}", "a5", 50000, 60 * i) for i in range(5)] + [("a5", "a0", 240000, 4000)]
    got = {r.account_id: r for r in G.behaviour(tx(spark, rows)).collect()}
    hub = got["a5"]
    assert hub.fan_in_ratio == pytest.approx(5 / 6) and hub.fan_out_ratio == pytest.approx(1 / 6) and hub.throughput == pytest.approx(240 / 250)
    assert hub.round_amount_ratio == 1.0 and hub.burst_ratio == pytest.approx(4 / 6) and 0 <= hub.mule_score <= 1
    assert got["a1"].median_hold_minutes == 0.0 and got["a1"].round_amount_ratio == 0.5


def test_round_amounts(spark):
    rows = spark.createDataFrame([(x,) for x in (1000.0, 1000.5, 1999.5, 9999.0, 1500.0)], "x double").select(G.is_round(F.col("x")).alias("r")).collect()
    assert [r.r for r in rows] == [True, True, True, False, False]


def test_cores_and_clustering(spark):
    rows = [(a, b, 1, 0) for a in "abcd" for b in "abcd" if a < b] + [("d", "e", 1, 0), ("e", "e", 1, 0)]
    assert {r.account_id: r.core_number for r in G.core_numbers(tx(spark, rows)).collect()} == {"a": 3, "b": 3, "c": 3, "d": 3, "e": 1}
    c = {r.account_id: r.clustering for r in G.clustering(tx(spark, rows)).collect()}
    assert c["a"] == 1.0 and c["d"] == pytest.approx(0.5) and c["e"] == 0.0


def test_ring_shapes(spark):
    cycle = [("a", "b", 1, 0), ("b", "c", 1, 0), ("c", "a", 1, 0)]
    two = [(x, "H1", 1, 0) for x in "pqr"] + [(x, "H2", 1, 0) for x in "stu"] + [("H1", "H2", 1, 0), ("H2", "H1", 1, 0)]
    chain = [("k1", "k2", 1, 0), ("k2", "k3", 1, 0), ("k3", "k4", 1, 0)]
    rows = tx(spark, cycle + two + chain)
    names = {n for r in cycle + two + chain for n in r[:2]}
    scores = spark.createDataFrame([(n, 0.9, "D") for n in sorted(names)], "account_id string, score double, district string")
    members = K.ring_members(rows, scores)
    label = {r.ring_id: r.label for r in K.topology(rows, members).collect()}
    of = {r.account_id: label[r.ring_id] for r in members.collect()}
    assert (of["a"], of["H1"], of["k1"]) == ("round-tripping cycle", "multi-hub laundering network", "layering chain")
    assert K.summarise(rows, scores, members).where("size = 8").first().account_ids == "H1,H2,p,q,r,s,t,u"
    whole = components(rows, "source", "target").select(F.col("node").alias("account_id"), F.col("component").alias("label"))
    assert K.modularity(rows, K.communities(rows)) >= K.modularity(rows, whole) - 0.05


def test_money_trail_bounds(spark):
    from decimal import Decimal

    scam = spark.createDataFrame([(1, Decimal("49999.00"), 1000000)], "event_id long, paid decimal(18,2), t long")
    hit = lambda amount, dt: J.money_trails(scam, tx(spark, [("x", "r", amount, 1000000 + dt)])).count()
    assert hit(49999, 6 * 3600) == 1 and hit(25000, 6 * 3600) == 0 and hit(49999, -3 * 3600) == 0 and hit(49999, 97 * 3600) == 0
    assert hit(50498.99, 96 * 3600) == 1 and hit(49499.01, -2 * 3600) == 1 and hit(50499.5, 0) == 0
    first = J.money_trails(scam, tx(spark, [("x", "late", 49999, 1009000), ("x", "early", 49999, 1003600)])).first()
    assert first.target == "early"


def test_grid_join_is_complete(spark):
    import random

    rng = random.Random(0)
    pts = [(i, rng.uniform(-60, 75), rng.uniform(-170, 170)) for i in range(150)]
    pts += [(i + 1000, a + rng.uniform(-0.5, 0.5), b + rng.uniform(-0.5, 0.5)) for i, a, b in pts] + [(5000, None, 1.0)]
    df = spark.createDataFrame(pts, "id long, lat double, lon double")
    near = {(r.a, r.b) for r in grid_join(df, df, 40).select(F.col("l.id").alias("a"), F.col("r.id").alias("b")).collect()}

    def km(p, q):
        a, b, c, d = map(math.radians, (p[1], p[2], q[1], q[2]))
        return 2 * 6371 * math.asin(min(1, math.sqrt(math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2)))

    assert near == {(p[0], q[0]) for p in pts[:-1] for q in pts[:-1] if km(p, q) <= 40}


def test_hubs(spark):
    rows = [("scam", 24.0, 86.0, 1.0, "A"), ("ring", 24.05, 86.05, 0.5, "A"), ("counterfeit", 24.0, 86.1, None, "B"), ("scam", 10.0, 70.0, 1.0, "C")]
    hubs = E.hubs(spark.createDataFrame(rows, "type string, lat double, lon double, weight double, district string")).collect()
    assert len(hubs) == 1 and (hubs[0].tier, hubs[0].intensity, hubs[0].district, hubs[0].domains) == ("coordinated", 2.0, "A", "counterfeit,ring,scam")


def test_messages(spark):
    texts = ["This is Inspector Rao calling from CBI, an FIR has been registered, stay on the call", "do not share your OTP with anyone", "share the OTP", "hello"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in T.scripts(T.scam_type(T.detect(df))).collect()}
    assert rows[0].markers == ["authority_impersonation", "fake_fir_or_case", "video_call_isolation"] and rows[0].scam_type == "digital_arrest"
    assert rows[0].script.name == "digital_arrest" and rows[0].script.stages == 3 and rows[0].script.in_order
    assert rows[1].markers == [] and rows[2].markers == ["personal_data_request"] and rows[3].markers == [] and rows[3].script is None


def test_entities(spark):
    df = spark.createDataFrame([(1, "Pay a.b@okaxis or x@mail.com, see bit.ly/xyz, SBIN0001234, +91 9876543210, 9876543210 bit.ly/XYZ")], "doc_id long, text string")
    got = {(r.kind, r.entity) for r in T.entities(df, "doc_id").collect()}
    assert {("upi", "a.b@okaxis"), ("url", "http://bit.ly/xyz,"), ("ifsc", "SBIN0001234"), ("phone", "9876543210")} <= got
    hosts = spark.createDataFrame([(h,) for h in ("paytn.com", "hdfcbank.in", "bit.ly", "amazom.in", "phonepe.com")], "h string").select(T.lookalike_brand(F.col("h")).alias("b")).collect()
    assert [r.b for r in hosts] == ["paytm", None, None, "amazon", None]


def test_serials(spark):
    cases = {"5AB123654": "valid", "5ab 123-654": "valid", "5IB123654": "nonsense", "AB123456": "nonsense", "5AB111111": "suspicious", "5AB123456": "suspicious", "5AB987654": "suspicious", "5AB567890": "suspicious"}
    df = spark.createDataFrame([(s,) for s in cases], "s string").select("s", A.serial_status(F.col("s")).alias("x"))
    assert {r.s: r.x for r in df.collect()} == cases


def test_merge_keeps_touched_actions(spark):
    cur = spark.createDataFrame([("a", "approved", "low"), ("b", "proposed", "low"), ("c", "proposed", "low")], "action_id string, status string, priority string")
    der = spark.createDataFrame([("b", "high"), ("d", "high")], "action_id string, priority string")
    assert {r.action_id: (r.status, r.priority) for r in A.merge_actions(cur, der).collect()} == {"a": ("approved", "low"), "b": ("proposed", "high"), "d": ("proposed", "high")}


def test_curves(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.8), (0, 0.1)], "label int, score double")
    assert M.auc(df).first().auc == pytest.approx(0.875)
    assert M.precision_floor(df, 0.6).first().score == 0.8 and M.precision_floor(df, 1.1).first().ok is False


def test_spectrum_of_large_communities(spark):
    import numpy as np

    n = 450
    edges = [("x", f"a{i:03d}", f"a{j:03d}", 1.0 + (i * j) % 3) for i in range(n - 5) for j in {i * 7 % (n - 5), i + 1} if i < j < n - 5] + [("y", "p", "q", 2.0)]
    names = [("x", f"a{i:03d}") for i in range(n)] + [("y", "p"), ("y", "q"), ("z", "r")]
    df, lab = spark.createDataFrame(edges, "community string, a string, b string, w double"), spark.createDataFrame(names, "community string, account_id string")
    got = {r.community: r for r in P.spectrum(P.laplacian(df, lab)).collect()}
    w = np.zeros((n, n))
    for _, a, b, x in edges[:-1]:
        w[int(a[1:]), int(b[1:])] = w[int(b[1:]), int(a[1:])] = x
    d = np.where(w.sum(0) > 0, w.sum(0), 1.0)
    e = np.linalg.eigvalsh(np.eye(n) - w / np.sqrt(np.outer(d, d)))
    assert tuple(got["x"])[1:] == (n, pytest.approx(e[-1]), pytest.approx(e[1] - e[0], abs=1e-9), pytest.approx(e[n // 2 :].sum() / e.sum()))
    assert tuple(got["y"])[1:] == (2, pytest.approx(2), pytest.approx(2), pytest.approx(1)) and tuple(got["z"])[1:] == (1, 1.0, 0.0, 1.0)


def test_spectrum_solves_components_not_communities(spark, monkeypatch):
    import numpy as np

    edges = [("x", f"a{k:03d}", f"a{k + 1:03d}", 1.0 + k % 2) for k in range(0, 120, 3)] + [("x", f"a{k + 1:03d}", f"a{k + 2:03d}", 2.0) for k in range(0, 120, 3)]
    names = [("x", f"a{k:03d}") for k in range(123)]
    lap = P.laplacian(spark.createDataFrame(edges, "community string, a string, b string, w double"), spark.createDataFrame(names, "community string, account_id string"))
    m = np.zeros((123, 123))
    for r in lap.collect():
        m[int(r.i[1:]), int(r.j[1:])] = r.value
    e = np.linalg.eigvalsh(m)

    def bounded(m, solve=np.linalg.eigvalsh):
        if len(m) > 3:
            raise ValueError("a whole community in a task")
        return solve(m)

    made = P.spectrum.__globals__
    monkeypatch.setitem(made, "np", type("np", (), {"eye": np.eye, "linalg": type("linalg", (), {"eigvalsh": staticmethod(bounded)})}))
    got = P.spectrum(lap).first()
    assert tuple(got)[1:] == (123, pytest.approx(e[-1]), pytest.approx(e[1] - e[0], abs=1e-9), pytest.approx(e[61:].sum() / e.sum()))


def test_matching_runs_until_stable(spark):
    import random

    # Of a chain of preferences only its last pair is mutual at a time: it takes one round a link.
    rng, chain = random.Random(5), [(f"o{k}", f"i{k + d}", 0.3 + 0.02 * (2 * k + d)) for k in range(8) for d in (0, 1)]
    pairs = chain + [(f"p{k}", f"j{m}", rng.randint(1, 9) / 10) for k in range(12) for m in rng.sample(range(12), 5)]
    got = {(r.out_id, r.in_id) for r in B.one_to_one(spark.createDataFrame(pairs, "out_id string, in_id string, score double"), 0.3).collect()}
    wanted, left = set(), [p for p in pairs if p[2] >= 0.3]
    while left:
        best = lambda at, o: {k: min((-s, p[o]) for *p, s in left if p[at] == k) for k in {p[at] for p in left}}
        a, b = best(0, 1), best(1, 0)
        wanted |= (now := {(o, i) for o, i, _ in left if a[o][1] == i and b[i][1] == o})
        left = [p for p in left if p[0] not in {o for o, _ in now} and p[1] not in {i for _, i in now}]
    assert got == wanted and {(f"o{k}", f"i{k + 1}") for k in range(8)} <= got


def test_cheapest_paths_of_many_legs(spark):
    import random

    rng = random.Random(2)
    one = [(f"n{k}", f"n{k + 1}", 1.0, "rail") for k in range(9)] + [(f"n{rng.randrange(10)}", f"n{rng.randrange(10)}", rng.uniform(3, 9), "road") for _ in range(8)] + [("n0", "n6", 20.0, "road"), ("x", "y", 2.0, "road")]
    edges = [e for e in one + [(b, a, k, m) for a, b, k, m in one] if e[0] != e[1]]
    nodes = sorted({e[0] for e in edges})
    cost = {(a, b): 0.0 if a == b else math.inf for a in nodes for b in nodes}
    for a, b, k, m in edges:
        cost[a, b] = min(cost[a, b], k * (1.3 if m == "road" else 1))
    for via in nodes:
        cost |= {(a, b): min(c, cost[a, via] + cost[via, b]) for (a, b), c in cost.items()}
    got = {(r.start, r.node): r for r in R.cheapest(spark.createDataFrame(edges, "src string, dst string, km double, mode string"), spark.createDataFrame([(n,) for n in nodes], "id string")).collect()}
    wanted = {k: c for k, c in cost.items() if c < math.inf}
    assert got.keys() == wanted.keys() and all(got[k].cost == pytest.approx(c) for k, c in wanted.items()) and max(len(r.path) for r in got.values()) > 5
