"""Multi-mode routes and band filters against plain Python."""

import heapq
import random

import numpy as np
import pytest

from kestrel.operators import routes as R
from kestrel.operators import spectral as P


def test_stops_within_eight_kilometres_are_one_city(spark):
    rows = [
        ("a", "rail", 1, "Alpha", 20.0, 80.0, False), ("a", "rail", 2, "Beta", 20.5, 80.0, False), ("b", "ship", 1, "Beta port", 20.55, 80.02, True),
        ("b", "ship", 2, "Gamma", 21.5, 80.0, False), ("c", "air", 1, "Gamma field", 21.6, 80.3, False), ("d", "rail", 1, "Beta yard", 20.60, 80.02, False), ("d", "rail", 2, "Alpha yard", 20.01, 80.01, False),
    ]
    cities, edges = R.merged_network(spark.createDataFrame(rows, "corridor string, mode string, idx int, name string, lat double, lon double, hub boolean"))
    got = {r.city: (r.name, r.modes, r.hub, r.stops) for r in cities.collect()}
    assert got == {
        "a:1": ("Alpha", ["rail"], False, 2), "a:2": ("Beta", ["rail", "ship"], True, 3), "b:2": ("Gamma", ["ship"], False, 1), "c:1": ("Gamma field", ["air"], False, 1),
    }
    held = {(r.src, r.dst, r.mode, r.kind) for r in edges.collect()}
    one = {("a:1", "a:2", "rail", "haul"), ("a:2", "b:2", "ship", "haul"), ("b:2", "c:1", "road", "transfer")}
    # Alpha and Beta are 55.6 km apart, over the reach of a transfer; the two hauls between them are one.
    assert held == one | {(b, a, m, k) for a, b, m, k in one}


def dijkstra(edges, start):
    best, queue = {start: 0.0}, [(0.0, start)]
    while queue:
        d, x = heapq.heappop(queue)
        if d <= best[x]:
            for a, b, c in edges:
                if a == x and d + c < best.get(b, 1e18):
                    best[b] = d + c
                    heapq.heappush(queue, (d + c, b))
    return best


def test_cheapest_routes_of_every_preference(spark):
    dice, rows = random.Random(6), []
    line = [f"l{i:02d}" for i in range(18)]
    for a, b in zip(line, line[1:]):
        rows.append((a, b, 10.0, "rail", "haul"))
    for _ in range(25):
        a, b = dice.sample(line + ["x", "y", "z"], 2)
        rows.append((a, b, float(dice.randint(20, 400)), dice.choice(["rail", "ship", "air", "road"]), dice.choice(["haul", "haul", "transfer"])))
    rows.append(("alone", "alone2", 5.0, "cart", "haul"))
    rows += [(b, a, km, m, k) for a, b, km, m, k in rows]
    edges = spark.createDataFrame(rows, "src string, dst string, km double, mode string, kind string")
    names = sorted({r[0] for r in rows})
    best, legs = R.cheapest_by_mode(edges, spark.createDataFrame([(n,) for n in names], "id string"))
    cost = {(r.prefer, r.start, r.node): r.cost for r in best.collect()}
    routes = {}
    for r in legs.collect():
        routes.setdefault((r.prefer, r.start, r.node), []).append(r)

    def price(prefer, km, mode, kind):
        return km * R.MODE_RISK.get(mode, 1.5) * (4.0 if prefer != "any" and mode != prefer and kind == "haul" else 1.0)

    want = {}
    for prefer in R.PREFERENCES:
        priced = [(a, b, price(prefer, km, m, k)) for a, b, km, m, k in rows]
        for s in names:
            want |= {(prefer, s, n): c for n, c in dijkstra(priced, s).items()}
    assert cost.keys() == want.keys() and all(cost[k] == pytest.approx(want[k]) for k in want)
    assert routes.keys() == {k for k in want if k[1] != k[2]}
    for (prefer, start, node), own in routes.items():
        own.sort(key=lambda r: -r.back)
        assert [r.back for r in own] == list(range(len(own)))[::-1]
        assert own[0].src == start and own[-1].dst == node and all(a.dst == b.src for a, b in zip(own, own[1:]))
        assert sum(price(prefer, r.km, r.mode, r.kind) for r in own) == pytest.approx(cost[prefer, start, node])
    assert max(map(len, routes.values())) > 8


def test_alternatives_by_signature_and_entries(spark):
    legs = [
        ("any", 0, "s", "t", "rail", "haul", 600.0, 600.0),
        ("ship", 1, "s", "m", "ship", "haul", 300.0, 270.0), ("ship", 0, "m", "t", "ship", "haul", 300.0, 270.0),
        ("air", 0, "s", "t", "air", "haul", 500.0, 1300.0), ("road", 0, "s", "t", "rail", "haul", 700.0, 700.0),
    ]
    rows = spark.createDataFrame([(p, "s", "t", *r) for p, *r in legs], "prefer string, start string, node string, back int, src string, dst string, mode string, kind string, km double, own double")
    near = spark.createDataFrame([("m", 1), ("m", 2), ("t", 2)], "at string, event_id long")
    told = {r.prefer: r for r in R.told(rows, near).collect()}
    assert (told["ship"].signature, told["ship"].legs, told["ship"].fir) == ("ship", 2, 2)
    assert told["ship"].plausibility == pytest.approx(0.45 / 2 + 0.35 * 1.0 + 0.2 * 0.5) and told["air"].plausibility == pytest.approx(0.45 / (1 + 500 / 600) + 0.35 * 0.15 + 0.2 * 0.25, abs=1e-6)
    chosen = R.alternatives(R.told(rows, near))
    assert [(r.place, r.signature, r.prefer) for r in sorted(chosen.collect(), key=lambda r: r.place)] == [(1, "ship", "ship"), (2, "rail", "any"), (3, "air", "air")]
    cities = spark.createDataFrame([("s", 10.0, 10.0), ("t", 10.0, 10.03)], "city string, lat double, lon double")
    presses = spark.createDataFrame([("s",)], "start string")
    assert R.entry_routes(chosen, presses, cities).count() == 0  # the press is 3 km off
    assert R.entry_routes(chosen, presses, cities, apart_km=1, most=2).count() == 2


def test_band_filters_are_polynomials_of_the_laplacian(spark):
    dice = np.random.default_rng(3)
    a = np.triu(dice.random((12, 12)) < 0.3, 1).astype(float)
    a = a + a.T
    a[11] = a[:, 11] = 0
    d = a.sum(1)
    m = np.eye(12) - np.where(a > 0, a / np.sqrt(np.outer(np.maximum(d, 1), np.maximum(d, 1))), 0)
    x = dice.normal(size=(12, 2))
    lap = spark.createDataFrame([(i, j, float(m[i, j])) for i in range(12) for j in range(12) if m[i, j]], "i int, j int, value double")
    got = {r.i: r.bands for r in P.band_filters(lap, spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(12)], "i int, x array<double>")).collect()}
    values, vectors = np.linalg.eigh(m)
    for n, c in enumerate(P.beta_bands()):
        response = np.polynomial.chebyshev.chebval(values - 1, c)
        want = vectors @ np.diag(response) @ vectors.T @ x
        assert np.allclose([got[i][n] for i in range(12)], want, atol=1e-9)
    # The bands pass ever higher frequencies.
    peaks = [np.argmax(np.polynomial.chebyshev.chebval(np.linspace(-1, 1, 201), c)) for c in P.beta_bands()]
    assert peaks == sorted(peaks) and len(set(peaks)) == 4
