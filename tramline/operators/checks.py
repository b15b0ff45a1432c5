"""Checks of mapped schedules, and how well routes fit shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as G

#: Largest turn by mode, and how many seconds a route may be slower than its timetable.
TURN = {"bus": 0.6667 * G.PI, "rail": 0.3333 * G.PI}
TRAVEL_TIME_RANGE = 65.0
QUANTILES = (0.0, 0.25, 0.5, 0.75, 0.85, 0.95)


def direction_changes(route_links: DataFrame, turns: dict[str, float] = TURN) -> DataFrame:
    """Consecutive links that turn by more than the mode allows: line_id, route_id, first, second, angle.

    ``route_links``: line_id, route_id, mode, idx, link_id, from_node, to_node, fx, fy, tx, ty.
    """
    w = W.partitionBy("line_id", "route_id").orderBy("idx")
    nxt = route_links.withColumn("_next", F.lead(F.struct("link_id", "to_node", "tx", "ty")).over(w)).where("_next IS NOT NULL")
    angle = F.when(F.col("from_node") == F.col("_next.to_node"), F.lit(G.PI)).otherwise(F.abs(G.turn("fx", "fy", "tx", "ty", F.col("_next.tx"), F.col("_next.ty"))))
    limit = F.lit(None).cast("double")
    for mode, most in turns.items():
        limit = F.when(F.col("mode") == mode, most).otherwise(limit)
    return nxt.select("line_id", "route_id", F.col("link_id").alias("first"), F.col("_next.link_id").alias("second"), angle.alias("angle"), limit.alias("_m")).where(F.col("angle") > F.col("_m")).drop("_m")


def travel_times(route_stops: DataFrame, route_links: DataFrame, most: float = TRAVEL_TIME_RANGE) -> DataFrame:
    """Sections between stops that take longer on the links than in the timetable by more than ``most``.

    ``route_stops``: line_id, route_id, idx, link_id, departure_offset; ``route_links``: line_id, route_id, idx, link_id, seconds.
    Stops meet links in order: the i-th visit of a stop on a link is the i-th time the route is there.
    """
    nth = lambda df: df.withColumn("_k", F.row_number().over(W.partitionBy("line_id", "route_id", "link_id").orderBy("idx")))
    s = nth(route_stops).select("line_id", "route_id", "link_id", "_k", F.col("idx").alias("stop_idx"), "departure_offset")
    on = nth(route_links).join(s, ["line_id", "route_id", "link_id", "_k"], "left")
    w = W.partitionBy("line_id", "route_id").orderBy("idx")
    part = on.withColumn("section", F.count("stop_idx").over(w.rowsBetween(W.unboundedPreceding, -1)))
    total = part.where("section > 0").groupBy("line_id", "route_id", "section").agg(F.sum("seconds").alias("actual"), F.max("departure_offset").alias("until"))
    ends = s.withColumn("section", F.row_number().over(W.partitionBy("line_id", "route_id").orderBy("stop_idx"))).select("line_id", "route_id", "section", F.col("departure_offset").alias("since"))
    out = total.join(ends, ["line_id", "route_id", "section"]).withColumn("expected", F.col("until") - F.col("since"))
    return out.where((F.col("expected") > 0) & (F.col("actual") > F.col("expected") + most)).select("line_id", "route_id", "section", "expected", "actual")


def loops(route_links: DataFrame) -> DataFrame:
    """Parts of a route that come back to a node: (line_id, route_id, node_id, start, end), only those inside no other."""
    w = W.partitionBy("line_id", "route_id", "from_node").orderBy("idx")
    again = route_links.withColumn("start", F.lag("idx").over(w)).where("start IS NOT NULL").select("line_id", "route_id", F.col("from_node").alias("node_id"), "start", F.col("idx").alias("end"))
    # Sorted by start, a loop lies in another if an earlier or equal start has reached as far.
    o = W.partitionBy("line_id", "route_id").orderBy("start", F.desc("end"), "node_id").rowsBetween(W.unboundedPreceding, -1)
    return again.withColumn("_far", F.max("end").over(o)).where("_far IS NULL OR end > _far").drop("_far")


def artificial(route_links: DataFrame) -> DataFrame:
    return route_links.where(F.startswith(F.col("link_id").cast("string"), F.lit("pt_"))).select("line_id", "route_id", "link_id").distinct()


def by_links(warnings: DataFrame, links: Column) -> DataFrame:
    """Warnings of equal type and links count once: (type, link_ids, routes)."""
    return warnings.withColumn("link_ids", links).groupBy("type", "link_ids").agg(F.countDistinct("line_id", "route_id").alias("n_routes"))


def child_stops(stops: DataFrame) -> DataFrame:
    """Summary of children by parent: upper median, mean and largest number."""
    n = stops.groupBy("parent").agg(F.count("*").alias("n"))
    # Exact order statistic from the counts of counts, which are few.
    hist = n.groupBy("n").agg(F.count("*").alias("k"))
    total = hist.agg(F.sum("k").alias("parents"), (F.sum(F.col("n") * F.col("k")) / F.sum("k")).alias("mean"), F.max("n").alias("largest"))
    w = W.orderBy("n").rowsBetween(W.unboundedPreceding, 0)
    median = hist.withColumn("upto", F.sum("k").over(w)).crossJoin(F.broadcast(total)).where(F.col("upto") > F.floor(F.col("parents") / 2)).agg(F.min("n").alias("median"))
    return F.broadcast(total).crossJoin(median).select("parents", "median", "mean", "largest")


def exact_quantiles(distances: DataFrame, keys: list[str], column: str = "d", points: tuple = QUANTILES) -> DataFrame:
    """Order statistics at index floor(n * p) of each group, and the largest; no interpolation."""
    w = W.partitionBy(*keys)
    at = distances.withColumn("_i", F.row_number().over(w.orderBy(column)) - 1).withColumn("_n", F.count("*").over(w))
    picks = [F.max(F.when(F.col("_i") == F.floor(F.col("_n") * p), F.col(column))).alias(f"q{int(p * 100):02d}") for p in points]
    return at.groupBy(*keys).agg(*picks, F.max(column).alias("q100"))


def quantile_of_quantiles(quantiles: DataFrame, point: float = 0.85, column: str = "q85") -> DataFrame:
    """The order statistic over all routes of one of their quantiles, from counts of rounded values."""
    hist = quantiles.groupBy(F.round(column, 6).alias("v")).agg(F.count("*").alias("k"))
    n = hist.agg(F.sum("k").alias("n"))
    w = W.orderBy("v").rowsBetween(W.unboundedPreceding, 0)
    return hist.withColumn("upto", F.sum("k").over(w)).crossJoin(F.broadcast(n)).where(F.col("upto") > F.floor(F.col("n") * point)).agg(F.min("v").alias("qq"))


def length_ratio(lengths: DataFrame) -> DataFrame:
    """Mean squared relative difference of the routes' and shapes' lengths."""
    r = (F.col("route_length") - F.col("shape_length")) / F.col("shape_length")
    return lengths.agg(F.avg(r * r).alias("mean_squared"))


def resampled(route_points: DataFrame, step: float = 1.0) -> DataFrame:
    """Points every ``step`` along a route, the rest of a link carried over to the next: (line_id, route_id, at, x, y).

    ``route_points``: line_id, route_id, idx, fx, fy, tx, ty.
    """
    size = G.distance("fx", "fy", "tx", "ty")
    w = W.partitionBy("line_id", "route_id").orderBy("idx")
    # A link starts at the very number where the one before ends: a difference of rounded sums may skip a point or repeat it.
    run = route_points.withColumn("_size", size).withColumn("_end", F.sum("_size").over(w.rowsBetween(W.unboundedPreceding, 0)))
    run = run.withColumn("_start", F.coalesce(F.lag("_end").over(w), F.lit(0.0)))
    first, last = F.ceil(F.col("_start") / step), F.ceil(F.col("_end") / step) - 1
    each = run.where((F.col("_size") > 0) & (first <= last)).withColumn("_k", F.explode(F.sequence(first, last)))
    t = (F.col("_k") * step - F.col("_start")) / F.col("_size")
    return each.select("line_id", "route_id", (F.col("_k") * step).alias("at"), (F.col("fx") + t * (F.col("tx") - F.col("fx"))).alias("x"), (F.col("fy") + t * (F.col("ty") - F.col("fy"))).alias("y"))


def normalised(values: DataFrame, column: str, inverse: bool = False) -> DataFrame:
    """Values as shares of the largest (at least 0), or what is left to 1."""
    top = values.agg(F.greatest(F.max(column), F.lit(0.0)).alias("_top"))
    share = F.col(column) / F.col("_top")
    return values.crossJoin(F.broadcast(top)).withColumn(column, 1 - share if inverse else share).drop("_top")


def mapping_summary(route_links: DataFrame) -> DataFrame:
    """Artificial links, and routes with none of them."""
    is_artificial = F.startswith(F.col("link_id").cast("string"), F.lit("pt_"))
    per = route_links.groupBy("line_id", "route_id").agg(F.bool_or(is_artificial).alias("bad"))
    return F.broadcast(route_links.where(is_artificial).agg(F.countDistinct("link_id").alias("n_artificial"))).crossJoin(per.agg(F.count("*").alias("n_routes"), F.count_if(~F.col("bad")).alias("n_clean")))
