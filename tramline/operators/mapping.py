"""The mapper: schedule onto network, from candidates to link sequences, and what comes after."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T
from ..storage import stored
from . import candidates, network, paths
from .checks import mapping_summary


@dataclass(frozen=True)
class Options:
    """Defaults of the mapper."""

    by_time: bool = False
    max_cost_factor: float = 5.0
    n_links: int = candidates.N_LINKS
    max_distance: float = candidates.MAX_DISTANCE
    multiplier: float = candidates.MULTIPLIER
    candidate_costs: bool = True

    def __post_init__(self):
        if self.max_cost_factor < 1:
            raise ValueError("max_cost_factor is below 1")


def map_routes(stops: DataFrame, route_stops: DataFrame, links: DataFrame, options: Options = Options()) -> dict[str, DataFrame]:
    """Link sequences of all routes of one mode.

    ``stops``: stop_id, x, y; ``route_stops``: line_id, route_id, idx (0, 1, ...), stop_id; ``links``: link_id, from_node, to_node,
    fx, fy, tx, ty, length, freespeed. Distinct pairs of candidates are searched once for all routes, each only up to the largest
    cost that can count for its stops. Stops without a candidate get a loop link; where no path is cheap enough, an artificial link
    is made. With ``by_time`` all costs are seconds, and ``route_stops`` has the offsets arrival and departure in seconds, too.
    """
    near = candidates.soft_top(candidates.nearby(stops, links, options.max_distance), options.n_links, options.multiplier)
    loops = candidates.loop_links(stops.join(route_stops.select("stop_id"), "stop_id", "left_semi"), near)
    info = links.select(F.col("link_id").cast("string").alias("link_id"), F.col("from_node").cast("string").alias("from_node"), F.col("to_node").cast("string").alias("to_node"), "fx", "fy", "tx", "ty", "length", "freespeed")
    own = G.travel_cost("length", "freespeed", options.by_time) + (G.candidate_cost(F.lit(0.0), F.col("d"), F.col("freespeed"), options.by_time) if options.candidate_costs else F.lit(0.0))
    real = near.select("stop_id", F.col("link_id").cast("string").alias("link_id"), "d").join(info, "link_id").withColumn("own", own).withColumn("is_loop", F.lit(False))
    columns = ["stop_id", "link_id", "from_node", "to_node", "fx", "fy", "tx", "ty", "own", "is_loop"]
    bare = loops.withColumn("own", F.lit(0.0)).withColumn("is_loop", F.lit(True))
    options_of = real.select(columns).unionByName(bare.select(columns))
    options_of = stored(options_of, "candidates")

    w = W.partitionBy("line_id", "route_id").orderBy("idx")
    seconds = F.lead("arrival").over(w) - F.col("departure") if options.by_time else F.lit(None)
    steps = route_stops.withColumn("next_stop", F.lead("stop_id").over(w)).withColumn("seconds", seconds.cast("double")).where("next_stop IS NOT NULL")
    at = stops.select("stop_id", "x", "y")
    steps = steps.join(at, "stop_id").join(at.toDF("next_stop", "nx", "ny"), "next_stop")
    steps = steps.withColumn("least", G.least_travel_cost(G.distance("x", "y", "nx", "ny"), F.col("seconds"), options.by_time))
    beeline = steps.groupBy("stop_id", "next_stop").agg(F.max("least").alias("most"))
    rename = lambda p: options_of.select(*[F.col(c).alias(f"{p}_{c}") for c in columns])
    both = beeline.join(rename("a"), F.col("stop_id") == F.col("a_stop_id")).join(rename("b"), F.col("next_stop") == F.col("b_stop_id"))
    both = both.select(
        "stop_id", "next_stop", (F.col("most") * options.max_cost_factor).alias("most"), F.col("a_link_id").alias("a"), F.col("b_link_id").alias("b"), F.col("a_own").alias("cost_a"), F.col("b_own").alias("cost_b"), (F.col("a_is_loop") | F.col("b_is_loop")).alias("is_loop"),
        F.col("a_to_node").alias("a_to"), F.col("b_from_node").alias("b_from"), F.col("a_tx").alias("ax"), F.col("a_ty").alias("ay"), F.col("b_fx").alias("bx"), F.col("b_fy").alias("by"))
    both = stored(both, "candidate-pairs")
    cost = G.travel_cost("length", "freespeed", options.by_time)
    found = stored(paths.paths(both.where("NOT is_loop").select("a", "b", "most"), info.select("link_id", "from_node", "to_node", cost.alias("cost"))), "paths")
    layers = steps.select("line_id", "route_id", F.col("idx").alias("layer"), "stop_id", "next_stop", "least").join(both, ["stop_id", "next_stop"])
    edges = stored(paths.candidate_edges(layers, found, options.max_cost_factor), "pseudo-edges")
    chosen = stored(paths.layered(edges.select("line_id", "route_id", "layer", "a", "b", "weight")), "chosen")
    used = chosen.withColumn("b", F.lead("candidate").over(W.partitionBy("line_id", "route_id").orderBy("layer"))).select("line_id", "route_id", "layer", F.col("candidate").alias("a"), "b")
    bridges = used.join(edges.where("artificial"), ["line_id", "route_id", "layer", "a", "b"]).select("a", "b").distinct().join(both.dropDuplicates(["a", "b"]), ["a", "b"])
    return {"sequences": paths.link_sequences(chosen, edges), "chosen": chosen, "artificial": candidates.artificial_links(bridges), "loops": loops}


def child_stops(chosen: DataFrame, route_stops: DataFrame, stops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Route stops and facilities with a child of the stop for each link that serves it."""
    on = route_stops.join(chosen.select("line_id", "route_id", F.col("layer").alias("idx"), F.col("candidate").alias("link_id")), ["line_id", "route_id", "idx"])
    named = on.withColumn("parent", F.col("stop_id")).withColumn("stop_id", T.child_stop(F.col("stop_id").cast("string"), F.col("link_id")))
    facilities = named.select("stop_id", "parent", "link_id").distinct().join(stops.withColumnRenamed("stop_id", "parent"), "parent")
    return named, facilities


def child_transfers(transfers: DataFrame, facilities: DataFrame) -> DataFrame:
    """Transfers between parents as those between their children."""
    kids = facilities.select("stop_id", "parent")
    a, b = kids.toDF("a", "from_stop"), kids.toDF("b", "to_stop")
    return transfers.join(a, "from_stop").join(b, "to_stop").select(F.col("a").alias("from_stop"), F.col("b").alias("to_stop"), "min_time")


def sibling_transfers(facilities: DataFrame) -> DataFrame:
    """No time between the children of one stop; each ordered pair once."""
    a, b = facilities.select("parent", F.col("stop_id").alias("from_stop")), facilities.select("parent", F.col("stop_id").alias("to_stop"))
    return a.join(b, "parent").where("from_stop <> to_stop").select("from_stop", "to_stop", F.lit(0).alias("min_time"))


def pulled(route_links: DataFrame, route_stops: DataFrame, links: DataFrame) -> DataFrame:
    """One pass of moving a stop's link to the one before or after on its route, where that is strictly closer to the stop.

    ``route_links``: line_id, route_id, idx, link_id; ``route_stops``: line_id, route_id, idx, link_idx, x, y. Repeat until nothing moves.
    """
    near = route_links.join(links.select("link_id", "fx", "fy", "tx", "ty"), "link_id").select("line_id", "route_id", F.col("idx").alias("at"), "link_id", "fx", "fy", "tx", "ty")
    tries = route_stops.select("line_id", "route_id", "idx", "link_idx", "x", "y", F.explode(F.array(*[F.lit(i) for i in (-1, 0, 1)])).alias("step")).withColumn("at", F.col("link_idx") + F.col("step"))
    d = tries.join(near, ["line_id", "route_id", "at"]).withColumn("d", F.round(G.segment_distance("x", "y", "fx", "fy", "tx", "ty"), 9))
    best = F.min(F.struct("d", F.abs("step").alias("moves"), "step", "at", "link_id")).alias("best")
    return d.groupBy("line_id", "route_id", "idx").agg(best).select("line_id", "route_id", "idx", F.col("best.at").alias("link_idx"), F.col("best.link_id").alias("link_id"), (F.col("best.step") != 0).alias("moved"))


def pull_all(route_links: DataFrame, route_stops: DataFrame, links: DataFrame) -> DataFrame:
    """Pull stops until none moves any more, which ends as each move is strictly closer. Routes that visit a parent stop twice stay as they are."""
    parent = T.parent_stop("stop_id")
    twice = route_stops.groupBy("line_id", "route_id").agg((F.countDistinct(parent) < F.count("*")).alias("twice")).where("twice").select("line_id", "route_id")
    fixed = route_stops.join(twice, ["line_id", "route_id"], "left_semi")
    free = stored(route_stops.join(twice, ["line_id", "route_id"], "left_anti"), "pulled")
    while True:
        step = stored(pulled(route_links, free, links), "pulled")
        if step.where("moved").limit(1).count() == 0:
            break
        moved = step.select("line_id", "route_id", "idx", F.col("link_idx").alias("_at"), F.col("link_id").alias("_link"))
        free = free.join(moved, ["line_id", "route_id", "idx"], "left").withColumn("link_idx", F.coalesce("_at", "link_idx"))
        free = stored(free.withColumn("stop_id", F.when(F.col("_link").isNotNull(), T.child_stop(parent, F.col("_link").cast("string"))).otherwise(F.col("stop_id"))).drop("_at", "_link"), "pulled")
    return free.unionByName(fixed.select(free.columns))


def summary(sequences: DataFrame) -> DataFrame:
    """How many routes have artificial links, and how many such links there are."""
    return mapping_summary(sequences.select("line_id", "route_id", F.explode("link_ids").alias("link_id")))


def reduced(links: DataFrame, sequences: DataFrame, keep: list[str]) -> DataFrame:
    """The network that the mapped routes need."""
    return network.without_unused(links, sequences.select(F.explode("link_ids").alias("link_id")), keep)
