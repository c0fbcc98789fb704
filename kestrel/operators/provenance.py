"""Trails of every scope with a forecast, their evidence and the routes behind them (W7-W10, W18). A scope is a district, or "" for all seizures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kestrel.functions.geo import grid_join
from kestrel.operators.routes import MODE_RISK, alternatives, told
from kestrel.operators.trail import attach, cumulative, scored, shaped, snap
from kestrel.session import materialise

ALL = ""


def tracks(seizures: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(snapped, nodes) with a corridor of its own, `scope|corridor`, for every scope that a seizure (event_id, lat, lon, t, district) of it
    falls in; the corridor's own name is in ``base``. Seizures are snapped once and dealt to their district and to all."""
    once = snap(seizures, nodes).join(seizures.select("event_id", "district"), "event_id")
    dealt = once.withColumn("scope", F.explode(F.array_distinct(F.array(F.lit(ALL), F.coalesce("district", F.lit(ALL))))))
    s = materialise(dealt.withColumnRenamed("corridor", "base").withColumn("corridor", F.concat_ws("|", "scope", "base")).drop("district"))
    own = s.select("scope", "base", "corridor").distinct()
    return s, materialise(own.join(nodes.withColumnRenamed("corridor", "base"), "base"))


def scoped_trails(snapped: DataFrame, own: DataFrame, nodes: DataFrame, reports: DataFrame) -> DataFrame:
    """W8 and W10 before the choice: scope, base, corridor and the trail of each. Reports near a corridor are counted once for all scopes."""
    hits = grid_join(reports, nodes, 80).select(F.col("r.corridor").alias("base"), "l.event_id").distinct().groupBy("base").agg(F.count("*").alias("fir"))
    t = shaped(snapped, own, reports)
    named = snapped.groupBy("corridor").agg(F.first("scope").alias("scope"), F.first("base").alias("base"))
    return scored(t.join(named, "corridor").join(hits, "base", "left"))


def best_trails(trails: DataFrame, modes: DataFrame) -> DataFrame:
    """Per scope and mode, and per scope for any mode, the trail of the highest confidence, the first corridor on ties, with its place
    among the modes of its scope. modes(base, mode); one pass over the trails serves all groups."""
    asked = trails.join(modes, "base").withColumn("asked", F.explode(F.array(F.lit("any"), "mode")))
    top = W.partitionBy("scope", "asked").orderBy(F.desc(F.round("confidence", 9)), "base")
    one = asked.withColumn("_r", F.row_number().over(top)).where("_r = 1").drop("_r")
    return one.withColumn("place", F.row_number().over(W.partitionBy("scope", F.col("asked") == "any").orderBy(F.desc(F.round("confidence", 9)), "asked")))


def with_fallback(best: DataFrame, districts: DataFrame) -> DataFrame:
    """For every district (name) and asked mode the trail of the finest group that infers an origin: district and mode, district, all and mode,
    all. ``level`` names it (district, district any mode, all, all any mode); a district where none does has no trail."""
    known = best.where("origin IS NOT NULL").select("scope", "asked", "base", "n", "origin", "confidence", "band")
    want = districts.select("district").distinct().crossJoin(F.broadcast(best.where("asked <> 'any'").select(F.col("asked").alias("mode")).distinct()))
    levels = [("district", F.col("district"), F.col("mode")), ("district any mode", F.col("district"), F.lit("any")), ("all", F.lit(ALL), F.col("mode")), ("all any mode", F.lit(ALL), F.lit("any"))]
    tried = want.select("district", "mode", F.posexplode(F.array(*[F.struct(F.lit(n).alias("level"), s.alias("scope"), a.alias("asked")) for n, s, a in levels])).alias("turn", "at"))
    met = tried.select("district", "mode", "turn", "at.*").join(known, ["scope", "asked"])
    first = met.withColumn("_r", F.row_number().over(W.partitionBy("district", "mode").orderBy("turn"))).where("_r = 1")
    return want.join(first.drop("_r", "turn", "scope", "asked"), ["district", "mode"], "left")


def forecast(snapped: DataFrame, nodes: DataFrame, origin: DataFrame, least: float = 5.0) -> DataFrame:
    """Corridors along which seizures move: km_per_day (with its sign), r2, toward, the next hub beyond the farthest seizure (the end
    without one) with its distance and the days in which it is reached, and whether the origin (corridor, origin) lies behind. Corridors with fewer
    than two positions or times, or a slower movement than ``least``, have no row."""
    line = materialise(cumulative(nodes).select("corridor", "idx", "name", "hub", "cum"))
    placed = snapped.join(line.select("corridor", "idx", "cum"), ["corridor", "idx"]).withColumn("day", F.col("t") / 86400)
    fit = placed.groupBy("corridor").agg(
        F.regr_slope("cum", "day").alias("slope"), F.regr_r2("cum", "day").alias("r2"), F.count("t").alias("timed"), F.min("idx").alias("lo"), F.max("idx").alias("hi"),
        F.min("cum").alias("c0"), F.max("cum").alias("c1"), F.min("day").alias("d0"), F.max("day").alias("d1"),
    )
    moving = fit.where((F.col("timed") >= 2) & (F.col("c0") < F.col("c1")) & (F.col("d0") < F.col("d1")) & (F.abs("slope") >= least))
    ends = line.groupBy("corridor").agg(F.min("idx").alias("first"), F.max("idx").alias("last"))
    m = moving.join(ends, "corridor").select("corridor", "slope", "r2", "timed", "first", "last", F.when(F.col("slope") > 0, 1).otherwise(-1).alias("sign"), F.when(F.col("slope") > 0, F.col("hi")).otherwise(F.col("lo")).alias("edge"))
    m = m.withColumn("end", F.when(F.col("sign") > 0, F.col("last")).otherwise(F.col("first")))
    at = lambda i, *c: line.select("corridor", F.col("idx").alias(i), *[F.col(a).alias(b) for a, b in c])
    m = m.join(at("edge", ("cum", "edge_cum")), ["corridor", "edge"]).join(at("end", ("name", "toward")), ["corridor", "end"])
    ahead = m.join(line, "corridor").where(((F.col("idx") - F.col("edge")) * F.col("sign") > 0) & (F.col("hub") | (F.col("idx") == F.col("end"))))
    # A hub before the end comes first by its distance in stops.
    near = ahead.groupBy("corridor").agg(F.min(F.struct(((F.col("idx") - F.col("edge")) * F.col("sign")).alias("o"), F.col("name"), F.abs(F.col("cum") - F.col("edge_cum")).alias("away"))).alias("h"))
    behind = origin.select("corridor", F.col("origin").alias("name")).join(line.select("corridor", "name", F.col("cum").alias("o_cum")), ["corridor", "name"]).groupBy("corridor").agg(F.min("o_cum").alias("o_cum"))
    out = m.join(near, "corridor", "left").join(behind, "corridor", "left")
    due = F.when(F.col("h.away") > 1, F.col("h.away") / F.abs("slope"))
    return out.select(
        "corridor", F.col("slope").alias("km_per_day"), "r2", F.col("timed").alias("n"), "toward", F.when(due.isNotNull(), F.col("h.name")).alias("next_hub"), F.when(due.isNotNull(), F.col("h.away")).alias("away_km"),
        (due * 0.7).alias("days_min"), (due * 1.5).alias("days_max"), ((F.col("o_cum") - F.col("edge_cum")) * F.col("sign") <= 0).alias("origin_behind"),
    )


def evidence(trails: DataFrame, flows: DataFrame, near: DataFrame, most: int = 3) -> DataFrame:
    """(corridor, items): what speaks for a trail, in order, each with type, detail and weight: seizures on the corridor, their cluster (two or more),
    the end it lacks (where an origin is inferred), movement (r2 from 0.5 on), and up to ``most`` reports near(base, event_id), the least first."""
    ranked = near.select("base", "event_id").distinct().withColumn("_r", F.row_number().over(W.partitionBy("base").orderBy("event_id")))
    cited = ranked.where(F.col("_r") <= most).groupBy("base").agg(F.array_sort(F.collect_list("event_id")).alias("cited"))
    t = trails.join(flows.select("corridor", "km_per_day", "r2", "toward"), "corridor", "left").join(cited, "base", "left")
    item = lambda kind, detail, weight: F.struct(F.lit(kind).alias("type"), detail.alias("detail"), F.round(weight, 4).alias("weight"))
    n = F.col("n").cast("string")
    fixed = F.array(
        item("corridor_snap", F.concat(n, F.lit(" seizures lie on the corridor")), F.lit(0.35)),
        F.when(F.col("n") >= 2, item("seizure_cluster", F.concat(n, F.lit(" seizures within "), F.round("radius_km", 0).cast("long").cast("string"), F.lit(" km")), F.lit(0.25))),
        F.when(F.col("origin").isNotNull(), item("corridor_terminus", F.concat(F.lit("none seized towards "), "origin"), F.lit(0.15))),
        F.when(F.col("r2") >= 0.5, item("temporal_flow", F.concat(F.lit("moves towards "), "toward", F.lit(" by "), F.round(F.abs("km_per_day"), 0).cast("long").cast("string"), F.lit(" km a day")), F.lit(0.15))),
    )
    told = F.transform(F.coalesce("cited", F.array().cast("array<bigint>")), lambda e: item("fir_mention", F.concat(F.lit("report "), e.cast("string")), 0.25 / F.greatest(F.col("fir"), F.lit(1))))
    return t.select("corridor", F.concat(F.filter(fixed, lambda x: x.isNotNull()), told).alias("items"))


def provenance(best: DataFrame, cities: DataFrame, found: tuple[DataFrame, DataFrame], reports: DataFrame, reach: float = 70, most: int = 4) -> DataFrame:
    """For each scope's best trail (scope, origin, o_lat, o_lon, c_lat, c_lon) the ``most`` likeliest routes from its origin to the middle of its seizures.

    ``found`` is (best, legs) of cheapest_by_mode. The origin is its nearest city; the middle is reached by road from the cities within ``reach``, or the
    nearest one. As nothing leads on from it, its cheapest route is the least over those cities, so no search is run again. Rows: scope, place,
    signature, km, legs, fir, plausibility, and in place 1 a line that sums the scope up.
    """
    costs_, legs = found
    known = materialise(best.where("origin IS NOT NULL").select("scope", "origin", "o_lat", "o_lon", "c_lat", "c_lon"))
    placed = cities.select(F.col("city").alias("id"), "lat", "lon")
    spot = lambda a, b: known.select(F.col("scope").alias("place"), F.col(a).alias("lat"), F.col(b).alias("lon"))
    near_origin = attach(spot("o_lat", "o_lon"), placed, 8).groupBy("place").agg(F.min(F.struct("km", "node")).alias("m"))
    start = materialise(near_origin.select(F.col("place").alias("scope"), F.col("m.node").alias("start")))
    access = materialise(attach(spot("c_lat", "c_lon"), placed, reach).select(F.col("place").alias("scope"), "node", F.col("km").alias("last")))
    offered = start.join(access, "scope").join(costs_, ["start", "node"]).withColumn("total", F.round(F.col("cost") + F.col("last") * MODE_RISK["road"], 9))
    via = materialise(offered.groupBy("scope", "start", "prefer").agg(F.min(F.struct("total", "node", "last")).alias("v")).select("scope", "start", "prefer", F.col("v.node").alias("node"), F.col("v.last").alias("last")))
    end = F.concat(F.lit("*"), "scope")
    before = via.join(legs, ["prefer", "start", "node"]).select("prefer", "start", end.alias("node"), (F.col("back") + 1).alias("back"), "src", "dst", "mode", "kind", "km", "own")
    last = via.select("prefer", "start", end.alias("node"), F.lit(0).alias("back"), F.col("node").alias("src"), end.alias("dst"), F.lit("road").alias("mode"), F.lit("access").alias("kind"), F.col("last").alias("km"), (F.col("last") * MODE_RISK["road"]).alias("own"))
    points = placed.unionByName(known.select(end.alias("id"), F.col("c_lat").alias("lat"), F.col("c_lon").alias("lon")))
    near = grid_join(reports, points, 80).select(F.col("r.id").alias("at"), "l.event_id").distinct()
    chosen = alternatives(told(before.unionByName(last), near), most).withColumn("scope", F.expr("substr(node, 2)")).join(known.select("scope", "origin"), "scope")
    others = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("place") > 1, F.struct("place", "signature"))).over(W.partitionBy("scope"))), lambda x: x["signature"]), "; ")
    line = F.concat(F.lit("likeliest from "), "origin", F.lit(" by "), "signature", F.lit(", "), F.round("km", 0).cast("long").cast("string"), F.lit(" km"), F.when(F.col("fir") > 0, F.concat(F.lit(", "), F.col("fir").cast("string"), F.lit(" reports on the way"))).otherwise(""))
    whole = chosen.withColumn("others", others).withColumn("line", F.when(F.col("place") == 1, F.when(F.col("others") != "", F.concat(line, F.lit("; else "), "others")).otherwise(line)))
    return whole.select("scope", "place", "origin", "signature", "km", "legs", "fir", "plausibility", "line")
