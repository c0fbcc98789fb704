"""Provenance of seizures along transport corridors: nodes (corridor, idx, name, lat, lon, hub) in order of idx."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kestrel.functions.geo import grid_join, haversine
from kestrel.operators.routes import reported
from kestrel.session import materialise


def snap(seizures: DataFrame, nodes: DataFrame, km: float = 60) -> DataFrame:
    """Per seizure and corridor the nearest node within ``km``, the first of the corridor on ties."""
    near = grid_join(seizures, nodes, km).select("l.event_id", "l.lat", "l.lon", "l.t", "r.corridor", F.struct("km", "r.idx").alias("at"))
    best = near.groupBy("event_id", "corridor").agg(F.min("at").alias("at"), F.first("lat").alias("lat"), F.first("lon").alias("lon"), F.first("t").alias("t"))
    return best.select("event_id", "corridor", "at.idx", "at.km", "lat", "lon", "t")


def cumulative(nodes: DataFrame) -> DataFrame:
    """Nodes with the distance walked from the corridor's first node."""
    w = W.partitionBy("corridor").orderBy("idx")
    step = F.coalesce(haversine(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon")), F.lit(0.0))
    return nodes.withColumn("step", step).withColumn("cum", F.sum("step").over(w.rowsBetween(W.unboundedPreceding, W.currentRow))).drop("step")


def origins(snapped: DataFrame, nodes: DataFrame, far: float = 150) -> DataFrame:
    """From the lowest and the highest seized node outwards to the first node that is ``far``, a hub or the end; the
    longer walk wins, the low end on ties. Needs two distinct nodes."""
    span = snapped.groupBy("corridor").agg(F.min("idx").alias("lo"), F.max("idx").alias("hi"), F.countDistinct("idx").alias("n_nodes")).where("n_nodes >= 2")
    c = cumulative(nodes)
    ends = c.groupBy("corridor").agg(F.min("idx").alias("first"), F.max("idx").alias("last"))
    at = c.select("corridor", F.col("idx").alias("own"), F.col("cum").alias("own_cum"))

    def walk(side: str, sign: int) -> DataFrame:
        end = "first" if sign < 0 else "last"
        base = span.withColumnRenamed(side, "own").join(at, ["corridor", "own"]).join(ends, "corridor")
        cand = base.join(c, "corridor").withColumn("walked", F.abs(F.col("cum") - F.col("own_cum")))
        beyond = cand.where(((F.col("idx") - F.col("own")) * sign > 0) & ((F.col("walked") >= far) | F.col("hub") | (F.col("idx") == F.col(end))) | ((F.col("own") == F.col(end)) & (F.col("idx") == F.col("own"))))
        first = beyond.groupBy("corridor").agg(F.min(F.struct((F.col("idx") * sign).alias("o"), "idx", "name", "lat", "lon", "walked")).alias("n"))
        return first.select("corridor", "n.idx", "n.name", "n.lat", "n.lon", "n.walked", F.lit(sign).alias("side"))

    both = walk("lo", -1).unionByName(walk("hi", 1))
    ranked = both.withColumn("_r", F.row_number().over(W.partitionBy("corridor").orderBy(F.desc("walked"), "side")))
    return ranked.where("_r = 1").select("corridor", F.col("name").alias("origin"), F.col("lat").alias("o_lat"), F.col("lon").alias("o_lon"), F.col("walked").alias("walked_km"))


def shaped(s: DataFrame, nodes: DataFrame, reports: DataFrame) -> DataFrame:
    """Per corridor of snapped seizures: their number, centre and radius, the origin and the reports within 80 km of it."""
    centre = s.groupBy("corridor").agg(F.count("*").alias("n"), F.avg("lat").alias("c_lat"), F.avg("lon").alias("c_lon"))
    radius = s.join(centre, "corridor").groupBy("corridor").agg(F.max(haversine("lat", "lon", "c_lat", "c_lon")).alias("r"))
    origin = origins(s, nodes)
    at = origin.select("corridor", F.col("o_lat").alias("lat"), F.col("o_lon").alias("lon"))
    near = grid_join(reports, at, 80).select("r.corridor", "l.event_id").distinct().groupBy("corridor").agg(F.count("*").alias("fir_origin"))
    return centre.join(radius, "corridor").join(origin, "corridor", "left").join(near, "corridor", "left")


def scored(t: DataFrame) -> DataFrame:
    """radius_km, confidence and band of corridors with n, r, origin, fir and fir_origin."""
    t = t.na.fill(0, ["fir", "fir_origin"])
    rad = F.when(F.col("n") > 1, F.col("r")).otherwise(0.0)
    tight = F.when(F.col("n") < 2, 0.0).when(rad > 0, F.greatest(F.lit(0.0), 1 - rad / 150)).otherwise(1.0)
    place = F.when(F.col("fir_origin") > 0, 1.0).when(F.col("origin").isNotNull(), 0.3).otherwise(0.0)
    raw = 0.35 * F.least(0.2 + (F.col("n") - 1) * 0.2, F.lit(0.85)) + 0.25 * tight + 0.25 * F.least(F.col("fir") * 0.5, F.lit(1.0)) + 0.15 * place
    out = t.withColumn("radius_km", rad).withColumn("confidence", F.least(raw, F.lit(0.85)))
    return out.withColumn("band", F.when(F.col("confidence") >= 0.6, "high").when(F.col("confidence") >= 0.35, "medium").otherwise("low"))


def trails(seizures: DataFrame, nodes: DataFrame, reports: DataFrame) -> DataFrame:
    """One row a corridor: seizures, radius, origin, reports near the corridor and near the origin, confidence and band."""
    s = materialise(snap(seizures, nodes))
    hits = grid_join(reports, nodes, 80).select("r.corridor", "l.event_id").distinct().groupBy("corridor").agg(F.count("*").alias("fir"))
    return scored(shaped(s, nodes, reports).join(hits, "corridor", "left"))


def flow(snapped: DataFrame, nodes: DataFrame, least: float = 5.0) -> DataFrame:
    """Least squares of the distance along a corridor against the day: slope, R2 and direction."""
    placed = snapped.join(cumulative(nodes).select("corridor", "idx", "cum"), ["corridor", "idx"]).withColumn("day", F.col("t") / 86400)
    fit = placed.groupBy("corridor").agg(F.regr_slope("cum", "day").alias("slope"), F.regr_r2("cum", "day").alias("r2"), F.count("*").alias("n"))
    return fit.withColumn("direction", F.when(F.abs("slope") < least, "stationary").when(F.col("slope") > 0, "forward").otherwise("backward"))


def network(nodes: DataFrame, transfer_km: float = 55) -> DataFrame:
    """Edges (src, dst, km, mode) both ways: neighbours on a corridor, and road transfers between corridors."""
    named = nodes.withColumn("id", F.concat_ws(":", "corridor", "idx"))
    w = W.partitionBy("corridor").orderBy("idx")
    along = named.withColumn("dst", F.lead("id").over(w)).withColumn("km", haversine(F.col("lat"), F.col("lon"), F.lead("lat").over(w), F.lead("lon").over(w)))
    rail = along.where("dst IS NOT NULL").select(F.col("id").alias("src"), "dst", "km", F.lit("rail").alias("mode"))
    road = grid_join(named, named, transfer_km).where("l.corridor < r.corridor").select(F.col("l.id").alias("src"), F.col("r.id").alias("dst"), "km", F.lit("road").alias("mode"))
    one = rail.unionByName(road)
    return one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "km", "mode"))


def cheapest(edges: DataFrame, sources: DataFrame, road_risk: float = 1.3) -> DataFrame:
    """The cheapest path from every source (id) to every node it reaches, the least path on ties: all pairs at
    once, a join with the edges and a minimum per pair each round until none improves; paths travel along as arrays."""
    cost = edges.withColumn("cost", F.col("km") * F.when(F.col("mode") == "road", road_risk).otherwise(1.0))
    best = materialise(sources.select(F.col("id").alias("start"), F.col("id").alias("node"), F.lit(0.0).alias("cost"), F.lit(0.0).alias("km"), F.array("id").alias("path")))
    front = best
    while front.limit(1).count():
        step = front.join(cost.select(F.col("src").alias("node"), "dst", F.col("cost").alias("c"), F.col("km").alias("k")), "node").where("NOT array_contains(path, dst)")
        new = step.select("start", F.col("dst").alias("node"), (F.col("cost") + F.col("c")).alias("cost"), (F.col("km") + F.col("k")).alias("km"), F.concat("path", F.array("dst")).alias("path"))
        merged = materialise(best.unionByName(new).groupBy("start", "node").agg(F.min(F.struct("cost", "path", "km")).alias("b")).select("start", "node", "b.cost", "b.km", "b.path"))
        front = materialise(merged.join(best.select("start", "node", F.col("cost").alias("old"), F.col("path").alias("was")), ["start", "node"], "left").where("old IS NULL OR cost < old OR cost = old AND path < was").drop("old", "was"))
        best = merged
    return best


def plausibility(routes: DataFrame) -> DataFrame:
    """Shorter routes on fewer road legs with more reports are likelier; held to 0.9."""
    p = 0.45 / (1 + F.col("km") / 600) + 0.35 * F.col("mode_score") + 0.20 * F.least(F.lit(1.0), F.col("fir") / 4)
    return routes.withColumn("plausibility", F.least(F.lit(0.9), p))


def attach(places: DataFrame, nodes: DataFrame, reach: float = 70) -> DataFrame:
    """Road edges (place, node, km) from places (place, lat, lon) to all nodes (id, lat, lon) within ``reach``; a place without one
    gets its nearest node, looked for in circles of twice the radius until all places have one."""
    found = materialise(grid_join(places, nodes, reach).select("l.place", F.col("r.id").alias("node"), "km"))
    left = materialise(places.where("lat IS NOT NULL AND lon IS NOT NULL").join(found.select("place"), "place", "left_anti"))
    some = nodes.limit(1).count()
    while some and reach < 20_100 and left.limit(1).count():
        reach *= 2
        near = grid_join(left, nodes, min(reach, 20_100)).select("l.place", F.struct("km", F.col("r.id").alias("node")).alias("at"))
        one = materialise(near.groupBy("place").agg(F.min("at").alias("at")).select("place", "at.node", "at.km"))
        found, left = found.unionByName(one), materialise(left.join(one.select("place"), "place", "left_anti"))
    return found


def routes(paths: DataFrame, edges: DataFrame, nodes: DataFrame, reports: DataFrame, km: float = 80) -> DataFrame:
    """Of every cheapest path (start, node, km, path) the legs, the haul modes in order with repeats collapsed, the share of
    haul legs' modes and the reports near any of its nodes; road legs between corridors are transfers and no haul."""
    legs = paths.where(F.size("path") > 1).select("start", "node", "path", F.posexplode(F.slice("path", 1, F.size("path") - 1)).alias("pos", "src"))
    legs = legs.withColumn("dst", F.get("path", F.col("pos") + 1)).join(edges.groupBy("src", "dst").agg(F.min(F.struct("km", "mode")).alias("e")), ["src", "dst"])
    hauls = F.transform(F.array_sort(F.collect_list(F.struct("pos", "e.mode"))), lambda x: x["mode"])
    own = legs.groupBy("start", "node").agg(hauls.alias("modes"))
    haul = F.filter("modes", lambda m: m != "road")
    kept = F.filter(F.transform(haul, lambda m, i: F.when((i == 0) | (m != F.get(haul, i - 1)), m)), lambda m: m.isNotNull())
    near = materialise(grid_join(reports, nodes, km).select(F.col("r.id").alias("at"), "l.event_id").distinct())
    met = reported(paths.where(F.size("path") > 1).select("start", "node", F.explode("path").alias("at")).distinct(), near, ["start", "node"])
    signature = F.when(F.size(kept) > 0, F.array_join(kept, ">")).otherwise("road")
    out = paths.where(F.size("path") > 1).select("start", "node", "cost", "km", "path").join(own, ["start", "node"]).join(met, ["start", "node"], "left")
    return out.select(
        "start", "node", "cost", "km", F.size("path").alias("stops"), signature.alias("signature"), F.size("modes").alias("legs"), F.coalesce("fir", F.lit(0)).alias("fir"),
        F.when(F.size(haul) > 0, F.lit(RAIL_SCORE)).otherwise(0.4).alias("mode_score"),
    )


#: Fixed value: the score of rail hauls.
RAIL_SCORE = 1.0


def entries(found: DataFrame, presses: DataFrame, most: int = 3) -> DataFrame:
    """The ``most`` likeliest routes into every node from the nodes of presses (start), not from itself."""
    likely = plausibility(found.join(presses, "start").where("start <> node"))
    ranked = likely.withColumn("place", F.row_number().over(W.partitionBy("node").orderBy(F.desc(F.round("plausibility", 6)), "start")))
    return ranked.where(F.col("place") <= most)


def route_facts(ranked: DataFrame, apart: float = 0.05) -> DataFrame:
    """For every ranked route how far the next one is behind, whether the two cannot be told apart, and a sentence."""
    gap = F.round(F.col("plausibility") - F.lead("plausibility").over(W.partitionBy("node").orderBy("place")), 6)
    out = ranked.withColumn("gap", gap).withColumn("inseparable", F.coalesce(gap < apart, F.lit(False)))
    said = F.concat(F.col("start"), F.lit(" to "), F.col("node"), F.lit(" by "), F.col("signature"), F.lit(" over "), F.col("stops").cast("string"), F.lit(" stops"), F.when(F.col("inseparable"), ", as likely as the next").otherwise(""))
    return out.withColumn("text", said)
