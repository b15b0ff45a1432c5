"""HAFAS trips to schedule: filters, valid sections, delays, departures, chained services, busiest block."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T
from .timetable import paired

#: Which stops of a trip must fulfil a filter.
WHICH = ("first", "first_or_last", "any", "all")


def over_stops(test, which: str = "first_or_last", stops="stops") -> Column:
    """A predicate over stops, applied to the first, to one of both ends, to any or to all."""
    first, last = test(F.element_at(stops, 1)), test(F.element_at(stops, -1))
    some = F.size(stops) > 0
    return some & {"first": first, "first_or_last": first | last, "any": F.exists(stops, test), "all": F.forall(stops, test)}[which]


def in_box(located: str, box: tuple[float, float, float, float], which: str = "first_or_last") -> Column:
    """Trips by the coordinates (x, y) of their stops, an array of structs in column ``located``."""
    return over_stops(lambda s: F.coalesce(G.in_box(s["x"], s["y"], *map(F.lit, map(float, box))), F.lit(False)), which, located)


def at_stops(ids: list[str], which: str = "first_or_last") -> Column:
    return over_stops(lambda s: s["stop_id"].isin(ids), which)


def of_category(categories: list[str], keep_replacement: bool = True) -> Column:
    c = F.col("category").isin(categories)
    return c | ((F.col("category") == "B") & F.col("replacement")) if keep_replacement else c


def on_bitfields(valid: list[int]) -> Column:
    """Trips with a section that holds; a trip without any validity holds always."""
    return (F.size("validity") == 0) | F.exists("validity", lambda v: v["bitfield"].isin(valid))


def filtered(trips: DataFrame, filters: list[Column]) -> tuple[DataFrame, DataFrame]:
    """Trips that all filters keep, and the (operator, category) pairs that some filter dropped. No filters keep all."""
    keep = reduce(lambda a, b: a & F.coalesce(b, F.lit(False)), filters, F.lit(True))
    return trips.where(keep), trips.where(~keep).select("operator_code", "category").distinct()


def valid_stops(trips: DataFrame, valid: list[int]) -> DataFrame:
    """Stops of the sections that hold on the chosen bitfields; no choice, or no validity, keeps all.

    A section opens at its first stop and closes at its last one; each is used once, and a stop that ends one section and
    starts the next is kept once.
    """
    chosen = F.col("validity") if not valid else F.filter("validity", lambda v: v["bitfield"].isin(valid))
    zero = F.struct(F.array().cast("array<struct<stop_id:string,arrival:int,departure:int>>").alias("out"), F.lit(False).alias("open"), chosen.alias("left"), F.lit("").alias("until"))

    def fold(acc, s):
        starts = F.filter(acc["left"], lambda v: v["from_stop"] == s["stop_id"])
        closes = acc["open"] & (acc["until"] == s["stop_id"])
        can = (F.size(starts) > 0) & (~acc["open"] | closes)
        used = F.element_at(starts, 1)
        rest = F.when(can, F.filter(acc["left"], lambda v: ~((v["from_stop"] == used["from_stop"]) & (v["to_stop"] == used["to_stop"]) & (v["bitfield"] == used["bitfield"])))).otherwise(acc["left"])
        keep = acc["open"] | can
        return F.struct(
            F.when(keep, F.concat(acc["out"], F.array(F.struct(s["stop_id"].alias("stop_id"), s["arrival"].alias("arrival"), s["departure"].alias("departure"))))).otherwise(acc["out"]).alias("out"),
            F.when(can, True).when(closes, False).otherwise(acc["open"]).alias("open"), rest.alias("left"), F.when(can, used["to_stop"]).otherwise(acc["until"]).alias("until"))

    whole = F.size("validity") == 0
    return trips.withColumn("stops", F.when(whole, F.col("stops")).otherwise(F.aggregate("stops", zero, fold, lambda a: a["out"]))).where("size(stops) > 1")


def route_stops(trips: DataFrame) -> DataFrame:
    """Stops in order with delays: 60 seconds of dwelling before the first departure."""
    first = F.element_at("stops", 1)["departure"]
    each = trips.select("number", "operator_code", first.alias("first"), F.posexplode("stops").alias("idx", "s"))
    return each.select(
        "number", "operator_code", "idx", F.col("s.stop_id").alias("stop_id"), F.when(F.col("idx") == 0, 0).otherwise(T.hafas_arrival_delay("s.arrival", "first")).alias("arrival_offset"),
        T.hafas_departure_delay("s.arrival", "s.departure", "first").alias("departure_offset"))


def departures(trips: DataFrame) -> DataFrame:
    """Departures of every trip; those of a cyclic one are numbered."""
    first = F.element_at("stops", 1)["departure"]
    each = trips.select("number", "operator_code", "cycles", F.posexplode(T.hafas_departures(first, F.col("cycles"), F.col("cycle_minutes"))).alias("i", "time"))
    return each.select("number", "operator_code", F.when(F.col("cycles") == 0, F.col("number")).otherwise(F.concat_ws("_", "number", "i")).alias("departure_id"), "time")


def chained(through: DataFrame, dep: DataFrame, trips: DataFrame, valid: list[int]) -> DataFrame:
    """Departures that go on as departures of another trip: paired by rank where the first trip ends at the connecting stop."""
    last = trips.select(F.col("number").cast("int").alias("first_trip"), F.col("operator_code").alias("first_operator"), F.element_at("stops", -1)["stop_id"].alias("_last"))
    start = trips.select(F.col("number").cast("int").alias("second_trip"), F.col("operator_code").alias("second_operator"), F.element_at("stops", 1)["stop_id"].alias("_start"))
    ok = through.where(F.col("bitfield").isin([0, *valid])).join(last, ["first_trip", "first_operator"]).join(start, ["second_trip", "second_operator"]).where("stop_id = _last AND stop_id = _start")
    key = F.concat_ws("|", "first_trip", "first_operator", "second_trip", "second_operator", "stop_id").alias("chain")
    ok = ok.select(key, "first_trip", "first_operator", "second_trip", "second_operator").distinct()
    side = lambda n: ok.join(dep.select(F.col("number").cast("int").alias(f"{n}_trip"), F.col("operator_code").alias(f"{n}_operator"), "departure_id", "time"), [f"{n}_trip", f"{n}_operator"]).select("chain", "departure_id", "time")
    return paired(side("first"), side("second"), ["chain"])


def busiest_block(fields: DataFrame, trips: DataFrame) -> DataFrame:
    """(block, weight): the hex digit — four days — that most departures cover whole; the first of equals. Unused bitfields weigh 1."""
    w = trips.select((F.col("cycles") + 1).alias("n"), F.explode("validity").alias("v")).groupBy(F.col("v.bitfield").alias("bitfield")).agg(F.sum("n").alias("n"))
    each = fields.join(w, "bitfield", "left").select(F.coalesce("n", F.lit(1)).alias("n"), F.posexplode(F.split("hex", "")).alias("block", "digit")).where("upper(digit) = 'F'")
    return each.groupBy("block").agg(F.sum("n").alias("weight")).orderBy(F.desc("weight"), "block").limit(1)
