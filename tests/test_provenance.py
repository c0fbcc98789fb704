"""Scoped trails, forecast, evidence and fallback on a literal world."""

import pytest

from kestrel.operators import provenance as V

#: A line due north: a degree of latitude is 111.19 km.
NODES = [("k", i, f"N{i}", 10.0 + i, 80.0, i in (0, 4), "rail") for i in range(7)] + [("s", i, f"S{i}", 10.0 + i, 90.0, False, "ship") for i in range(3)]
DAY = 86400
SEIZED = [
    (1, 12.0, 80.0, 0 * DAY, "P"), (2, 13.0, 80.1, 2 * DAY, "P"), (3, 14.0, 80.0, 4 * DAY, "Q"), (4, 10.0, 90.0, 1 * DAY, "Q"), (5, 40.0, 80.0, DAY, "P"), (6, 12.0, 80.0, 0, None),
]


def world(spark):
    nodes = spark.createDataFrame(NODES, "corridor string, idx int, name string, lat double, lon double, hub boolean, mode string")
    seized = spark.createDataFrame(SEIZED, "event_id long, lat double, lon double, t long, district string")
    reports = spark.createDataFrame([(71, 10.0, 80.0), (72, 13.0, 80.0), (73, 12.0, 80.0), (74, 11.0, 80.0), (75, 50.0, 10.0)], "event_id long, lat double, lon double")
    s, own = V.tracks(seized, nodes)
    return nodes, s, own, reports


def test_every_scope_has_its_trails_and_forecast(spark):
    nodes, s, own, reports = world(spark)
    assert sorted((r.scope, r.base, r.event_id) for r in s.collect()) == [
        ("", "k", 1), ("", "k", 2), ("", "k", 3), ("", "k", 6), ("", "s", 4), ("P", "k", 1), ("P", "k", 2), ("Q", "k", 3), ("Q", "s", 4),
    ]
    trails = V.scoped_trails(s, own, nodes, reports)
    got = {r.corridor: r for r in trails.collect()}
    assert {k: (r.n, r.origin, r.fir) for k, r in got.items()} == {
        "|k": (4, "N0", 4), "P|k": (2, "N0", 4), "Q|k": (1, None, 4), "|s": (1, None, 0), "Q|s": (1, None, 0),
    }
    flows = {r.corridor: r for r in V.forecast(s, own, trails.where("origin IS NOT NULL")).collect()}
    assert set(flows) == {"|k", "P|k"}
    f, km = flows["P|k"], 111.1949
    # One node in two days; beyond N3 the hub N4 is a node away.
    assert (f.n, f.toward, f.next_hub, f.origin_behind) == (2, "N6", "N4", True)
    assert (f.km_per_day, f.r2, f.away_km, f.days_min, f.days_max) == (pytest.approx(km / 2, rel=1e-4), pytest.approx(1.0), pytest.approx(km, rel=1e-4), pytest.approx(1.4, rel=1e-4), pytest.approx(3.0, rel=1e-4))
    assert flows["|k"].next_hub == "N6"  # no hub beyond N4: the end


def test_evidence_in_order(spark):
    nodes, s, own, reports = world(spark)
    trails = V.scoped_trails(s, own, nodes, reports)
    near = spark.createDataFrame([("k", i) for i in (74, 72, 71, 73)], "base string, event_id long")
    got = {r.corridor: [tuple(i) for i in r["items"]] for r in V.evidence(trails, V.forecast(s, own, trails.where("origin IS NOT NULL")), near).collect()}
    cited = [("fir_mention", f"report {i}", 0.0625) for i in (71, 72, 73)]
    assert got["Q|k"] == [("corridor_snap", "1 seizures lie on the corridor", 0.35), *cited]
    assert [i[0] for i in got["P|k"]] == ["corridor_snap", "seizure_cluster", "corridor_terminus", "temporal_flow", *["fir_mention"] * 3]
    assert got["P|k"][3][1] == "moves towards N6 by 56 km a day" and got["|s"] == [("corridor_snap", "1 seizures lie on the corridor", 0.35)]


def test_fallback_to_the_finest_group_with_an_origin(spark):
    nodes, s, own, reports = world(spark)
    modes = nodes.selectExpr("corridor AS base", "mode").distinct()
    best = V.best_trails(V.scoped_trails(s, own, nodes, reports), modes)
    top = {(r.scope, r.asked): (r.base, r.place) for r in best.collect()}
    assert top[("", "rail")] == ("k", 1) and top[("", "ship")] == ("s", 2) and top[("", "any")] == ("k", 1)
    got = {(r.district, r["mode"]): (r.level, r.base) for r in V.with_fallback(best, spark.createDataFrame([("P",), ("Q",), ("R",)], "district string")).collect()}
    assert got == {
        ("P", "rail"): ("district", "k"), ("P", "ship"): ("district any mode", "k"), ("Q", "rail"): ("all", "k"), ("Q", "ship"): ("all any mode", "k"),
        ("R", "rail"): ("all", "k"), ("R", "ship"): ("all any mode", "k"),
    }


def test_routes_from_the_origin_to_the_middle_of_the_seizures(spark):
    from kestrel.operators import routes as R

    rows = [("s", "m", 300.0, "rail", "haul"), ("m", "t", 300.0, "rail", "haul"), ("s", "u", 500.0, "air", "haul")]
    edges = spark.createDataFrame(rows + [(b, a, *r) for a, b, *r in rows], "src string, dst string, km double, mode string, kind string")
    cities = spark.createDataFrame([("s", 10.0, 80.0), ("m", 12.0, 80.0), ("t", 14.0, 80.0), ("u", 14.0, 80.5)], "city string, lat double, lon double")
    best = spark.createDataFrame(
        [("", "Start", 10.01, 80.0, 14.0, 80.2), ("P", "Start", 10.0, 80.0, 30.0, 80.5), ("Q", None, None, None, 14.0, 80.2)],
        "scope string, origin string, o_lat double, o_lon double, c_lat double, c_lon double",
    )
    reports = spark.createDataFrame([(1, 12.1, 80.0), (2, 29.9, 80.4), (3, 0.0, 0.0)], "event_id long, lat double, lon double")
    got = {}
    for r in V.provenance(best, cities, R.cheapest_by_mode(edges, cities.selectExpr("city AS id")), reports).collect():
        got.setdefault(r.scope, {})[r.place] = r
    assert set(got) == {"", "P"}  # without an origin there is no route
    # Both cities are within reach of the middle; rail is likelier, air comes by its own preference.
    assert [(p, r.signature, r.legs, r.fir) for p, r in sorted(got[""].items())] == [(1, "rail", 3, 1), (2, "air", 2, 0)]
    assert got[""][1].km == pytest.approx(600 + 21.58, abs=0.1) and got[""][1].line.startswith("likeliest from Start by rail, 622 km, 1 reports on the way; else air")
    # None is within reach of the other middle: it hangs on its nearest city alone.
    assert {r.signature for r in got["P"].values()} == {"air"} and got["P"][1].fir == 1 and got["P"][1].line.endswith("1 reports on the way")
