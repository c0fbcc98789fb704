"""Routes over a network of several modes (W11, W13-W16): stops(corridor, mode, idx, name, lat, lon, hub) in order of idx."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kestrel.functions.geo import grid_join, haversine
from kestrel.operators.components import components
from kestrel.session import materialise

#: How much a kilometre of each mode weighs, and that of any other; what a haul by another mode than the preferred one costs more.
MODE_RISK = {"rail": 1.0, "ship": 0.9, "road": 1.3, "air": 2.6}
OTHER_RISK, NOT_PREFERRED = 1.5, 4.0
#: What is asked for: any mode, or one above others.
PREFERENCES = ("any", "rail", "ship", "air", "road")
#: Costs closer than this are equal.
TIE = 1e-9


def risk(mode: str = "mode", other: float = OTHER_RISK) -> Column:
    return F.coalesce(*[F.when(F.col(mode) == m, F.lit(r)) for m, r in MODE_RISK.items()], F.lit(other))


def merged_network(stops: DataFrame, merge_km: float = 8, transfer_km: float = 55) -> tuple[DataFrame, DataFrame]:
    """(cities, edges). Stops within ``merge_km`` of each other, also by way of others, are one city, named and placed by its least stop (corridor:idx), with
    the modes of all and a hub if one is. Edges (src, dst, km, mode, kind), both ways: hauls between the cities of neighbouring stops of a
    corridor, and road transfers of up to ``transfer_km`` between cities whose sets of modes differ."""
    named = stops.select("*", F.concat_ws(":", "corridor", "idx").alias("id"))
    near = grid_join(named, named, merge_km).select(F.col("l.id").alias("src"), F.col("r.id").alias("dst")).where("src < dst")
    found = components(near, "src", "dst").select(F.col("node").alias("id"), "component")
    placed = materialise(named.join(found, "id", "left").withColumn("city", F.coalesce("component", "id")).drop("component"))
    first = placed.where("id = city").select("city", "name", "lat", "lon")
    held = placed.groupBy("city").agg(F.array_sort(F.collect_set("mode")).alias("modes"), F.max("hub").alias("hub"), F.count("*").alias("stops"))
    cities = materialise(first.join(held, "city"))
    order = W.partitionBy("corridor").orderBy("idx")
    steps = placed.select(F.col("city").alias("src"), F.lead("city").over(order).alias("dst"), "mode").where("dst IS NOT NULL AND src <> dst")
    at = lambda x: cities.select(F.col("city").alias(x), F.col("lat").alias(f"lat_{x}"), F.col("lon").alias(f"lon_{x}"))
    hauls = steps.join(at("src"), "src").join(at("dst"), "dst").select("src", "dst", haversine("lat_src", "lon_src", "lat_dst", "lon_dst").alias("km"), "mode", F.lit("haul").alias("kind"))
    apart = grid_join(cities, cities, transfer_km).where("l.city < r.city AND l.modes <> r.modes AND km > 0")
    roads = apart.select(F.col("l.city").alias("src"), F.col("r.city").alias("dst"), "km", F.lit("road").alias("mode"), F.lit("transfer").alias("kind"))
    one = hauls.unionByName(roads)
    both = one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "km", "mode", "kind"))
    return cities, both.distinct()


def costs(edges: DataFrame, preferences: Sequence[str] = PREFERENCES) -> DataFrame:
    """Edges once for each preference, with their cost: hauls by another mode than the preferred one cost more, transfers do not."""
    asked = F.explode(F.array(*map(F.lit, preferences))).alias("prefer")
    worse = (F.col("prefer") != "any") & (F.col("mode") != F.col("prefer")) & (F.col("kind") == "haul")
    own = F.col("km") * risk()
    return edges.select(asked, "*", own.alias("own")).withColumn("cost", F.col("own") * F.when(worse, NOT_PREFERRED).otherwise(1.0))


def cheapest_by_mode(edges: DataFrame, sources: DataFrame, preferences: Sequence[str] = PREFERENCES, max_rounds: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """(best, legs) of the cheapest route from every source (id) to every city it reaches, for every preference at once.

    best(prefer, start, node, cost); legs(prefer, start, node, back, src, dst, mode, kind, km, own), ``back`` counted from the route's end.
    Rounds extend the states that got better by an edge and keep a minimum for each; only keys and costs travel. Then every state's
    predecessor is the least one that attains its cost, and routes are read backwards by ancestors, each round twice as far. Rounds that do
    not settle are an error.
    """
    priced = materialise(costs(edges, preferences))
    keys = ["prefer", "start", "node"]
    best = materialise(sources.select(F.explode(F.array(*map(F.lit, preferences))).alias("prefer"), F.col("id").alias("start"), F.col("id").alias("node"), F.lit(0.0).alias("cost")))
    front = best
    forth = priced.select("prefer", F.col("src").alias("node"), "dst", F.col("cost").alias("c"))
    for _ in range(max_rounds):
        new = front.join(forth, ["prefer", "node"]).groupBy("prefer", "start", F.col("dst").alias("node")).agg(F.min(F.col("cost") + F.col("c")).alias("new"))
        both = materialise(best.join(new, keys, "full").select(*keys, "cost", "new", (F.col("cost").isNull() | (F.col("new") < F.col("cost") - TIE)).alias("better")))
        best = both.select(*keys, F.when(F.coalesce("better", F.lit(False)), F.col("new")).otherwise(F.col("cost")).alias("cost"))
        front = both.where("better").select(*keys, F.col("new").alias("cost"))
        if not front.limit(1).count():
            break
    else:
        raise RuntimeError(f"cheapest routes did not settle in {max_rounds} rounds")
    best = materialise(best)
    before = best.select("prefer", "start", F.col("node").alias("src"), F.col("cost").alias("was"))
    into = priced.select("prefer", "src", F.col("dst").alias("node"), "mode", "kind", "km", "own", F.col("cost").alias("c"))
    met = best.where("node <> start").join(into, ["prefer", "node"]).join(before, ["prefer", "start", "src"]).where(F.col("was") + F.col("c") <= F.col("cost") + TIE)
    last = materialise(met.groupBy(*keys).agg(F.min(F.struct("src", "mode", "kind", "km", "own")).alias("leg")))
    # The ancestors of a city at 0 to 2^k - 1 steps, and the one at 2^k.
    line = last.select(*keys, F.lit(0).alias("back"), F.col("node").alias("at"))
    jump, far = last.select(*keys, F.col("leg.src").alias("to")), 1
    while True:
        reached = jump.where("to <> start")
        if not reached.limit(1).count():
            break
        ahead = line.select("prefer", "start", F.col("node").alias("to"), (F.col("back") + far).alias("back"), "at")
        line = materialise(line.unionByName(reached.join(ahead, ["prefer", "start", "to"]).select(*keys, "back", "at")))
        jump = materialise(reached.join(jump.select("prefer", "start", F.col("node").alias("to"), F.col("to").alias("next")), ["prefer", "start", "to"]).select(*keys, F.col("next").alias("to")))
        far *= 2
    legs = line.join(last.select("prefer", "start", F.col("node").alias("at"), "leg"), ["prefer", "start", "at"])
    return best, legs.select(*keys, "back", "leg.src", F.col("at").alias("dst"), "leg.mode", "leg.kind", "leg.km", "leg.own")


def reported(cities: DataFrame, near: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, fir): distinct reports of near(at, event_id) at any of a route's cities(*keys, at). Reports near the same cities are counted
    once and for all, so a route meets sets of cities and not reports."""
    seen = near.where("event_id IS NOT NULL").groupBy("event_id").agg(F.array_sort(F.collect_set("at")).alias("ats"))
    sets = materialise(seen.groupBy("ats").agg(F.count("*").alias("n")))
    one = sets.select("ats", "n", F.explode("ats").alias("at"))
    return cities.join(one, "at").select(*keys, "ats", "n").distinct().groupBy(*keys).agg(F.sum("n").alias("fir"))


def told(legs: DataFrame, near: DataFrame) -> DataFrame:
    """W14, W15 before the choice: a row a route (prefer, start, node): km, own (cost without preference), legs, signature (haul modes in order,
    repeats collapsed, road without hauls), fir (reports of near(at, event_id) at any of its cities), plausibility."""
    keys = ["prefer", "start", "node"]
    hauls = F.collect_list(F.when(F.col("kind") == "haul", F.struct((-F.col("back")).alias("pos"), "mode")))
    modes = F.transform(F.array_sort(hauls), lambda x: x["mode"])
    own = legs.groupBy(*keys).agg(
        F.sum("km").alias("km"), F.sum("own").alias("own"), F.count("*").alias("legs"), modes.alias("modes"), F.avg(F.when(F.col("kind") == "haul", risk(other=1.3))).alias("risk")
    )
    cities = legs.select(*keys, F.col("src").alias("at")).unionByName(legs.select(*keys, F.col("dst").alias("at"))).distinct()
    met = reported(cities, near, keys)
    kept = F.filter(F.transform("modes", lambda m, i: F.when((i == 0) | (m != F.get("modes", i - 1)), m)), lambda m: m.isNotNull())
    out = own.join(met, keys, "left").withColumn("fir", F.coalesce("fir", F.lit(0)))
    score = F.when(F.col("risk").isNull(), 0.4).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (2.9 - F.col("risk")) / 2)))
    likely = 0.45 / (1 + F.col("km") / 600) + 0.35 * score + 0.20 * F.least(F.lit(1.0), F.col("fir") / 4)
    signature = F.when(F.size("modes") > 0, F.array_join(kept, ">")).otherwise("road")
    return out.select(*keys, "km", "own", "legs", signature.alias("signature"), "fir", F.round(F.least(F.lit(0.9), likely), 6).alias("plausibility"))


def alternatives(routes: DataFrame, most: int = 4) -> DataFrame:
    """Of the routes between two cities the cheapest of each signature, and of those the ``most`` likeliest, in places from 1."""
    by = W.partitionBy("start", "node", "signature").orderBy(F.round("own", 6), "prefer")
    one = routes.withColumn("_r", F.row_number().over(by)).where("_r = 1").drop("_r")
    place = F.row_number().over(W.partitionBy("start", "node").orderBy(F.desc("plausibility"), "signature"))
    return one.withColumn("place", place).where(F.col("place") <= most)


def entry_routes(chosen: DataFrame, presses: DataFrame, cities: DataFrame, apart_km: float = 5, most: int = 4) -> DataFrame:
    """For every city (node) the ``most`` likeliest routes of W15 from the cities of presses (start), none nearer than ``apart_km``."""
    at = lambda x: cities.select(F.col("city").alias(x), F.col("lat").alias(f"lat_{x}"), F.col("lon").alias(f"lon_{x}"))
    far = chosen.drop("place").join(presses.select("start").distinct(), "start", "left_semi").join(at("start"), "start").join(at("node"), "node")
    kept = far.where(haversine("lat_start", "lon_start", "lat_node", "lon_node") >= apart_km).drop("lat_start", "lon_start", "lat_node", "lon_node")
    place = F.row_number().over(W.partitionBy("node").orderBy(F.desc("plausibility"), "start", "signature"))
    return kept.withColumn("place", place).where(F.col("place") <= most)
