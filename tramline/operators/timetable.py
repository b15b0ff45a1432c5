"""From stop times to routes: sequences, offsets, frequencies, merging, departures, vehicles, cleaning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T


def first_of_sequence(stop_times: DataFrame, position: str) -> DataFrame:
    """One row for each trip and sequence number: the first by file position."""
    w = W.partitionBy("trip_id", "stop_sequence").orderBy(position)
    return stop_times.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def filled(stop_times: DataFrame) -> DataFrame:
    """Untimed stops take the times of the stop before; a trip that starts untimed is an error."""
    w = W.partitionBy("trip_id").orderBy("stop_sequence").rowsBetween(W.unboundedPreceding, 0)
    timed = F.when(F.col("arrival").isNotNull(), F.struct("arrival", "departure"))
    out = stop_times.withColumn("_t", F.last(timed, ignorenulls=True).over(w))
    bad = F.raise_error(F.concat(F.lit("first stop without a time in trip "), F.col("trip_id").cast("string"))).cast("int")
    return out.withColumn("arrival", F.when(F.col("_t").isNull(), bad).otherwise(F.col("_t.arrival"))).withColumn("departure", F.coalesce("_t.departure", "_t.arrival")).drop("_t")


def offsets(stop_times: DataFrame) -> DataFrame:
    """Seconds since the trip's first arrival. The departure offset is that of the arrival; 0 at the first and last stop's open ends.

    Trips of one stop or none are dropped.
    """
    order = W.partitionBy("trip_id").orderBy("stop_sequence")
    whole = W.partitionBy("trip_id")
    out = stop_times.withColumn("_i", F.row_number().over(order)).withColumn("_n", F.count("*").over(whole)).withColumn("_s", F.first("arrival").over(order)).where("_n > 1")
    since = F.col("arrival") - F.col("_s")
    return out.withColumn("arrival_offset", F.when(F.col("_i") == 1, 0).otherwise(since)).withColumn("departure_offset", F.when(F.col("_i") == F.col("_n"), 0).otherwise(since)).drop("_i", "_n", "_s")


def departures_of(trips: DataFrame, frequencies: DataFrame) -> DataFrame:
    """(trip_id, departure): the trip's own, or every headway in [start, end) where it has frequencies. A headway below 1 is an error."""
    headway = F.when(F.col("headway") < 1, F.raise_error(F.lit("headway below 1"))).otherwise(F.col("headway")).cast("int")
    slots = F.when(F.col("start") < F.col("end"), F.sequence(F.col("start"), F.col("end") - 1, headway)).otherwise(F.array().cast("array<int>"))
    own = frequencies.dropDuplicates(["trip_id", "start", "end", "headway"]).select("trip_id", F.explode(slots).alias("departure"))
    rest = trips.join(frequencies.select("trip_id").distinct(), "trip_id", "left_anti").select("trip_id", F.col("start_time").alias("departure"))
    return own.unionByName(rest)


def profiles(offsets_of: DataFrame) -> DataFrame:
    """(line_id, trip_id, profile): stops and whole offsets in order."""
    part = F.concat_ws("-", F.col("stop_id"), F.col("arrival_offset").cast("long"), F.col("departure_offset").cast("long"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("stop_sequence", part.alias("p")))), lambda x: x["p"])
    return offsets_of.groupBy("line_id", "trip_id").agg(F.array_join(listed, "|").alias("profile"))


def merged_routes(profiled: DataFrame) -> DataFrame:
    """(line_id, route_id, trip_id): trips of a line with equal profiles are one route, named by the first."""
    keep = profiled.groupBy("line_id", "profile").agg(F.min("trip_id").alias("route_id"))
    return profiled.join(keep, ["line_id", "profile"]).select("line_id", "route_id", "trip_id")


def merged_by_stops(route_stops: DataFrame) -> DataFrame:
    """(line_id, route_id, merged_into) by the stops alone, whatever the times."""
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", F.col("stop_id").cast("string").alias("s")))), lambda x: x["s"]), "|")
    keyed = route_stops.groupBy("line_id", "route_id").agg(listed.alias("key"))
    return keyed.join(keyed.groupBy("line_id", "key").agg(F.min("route_id").alias("merged_into")), ["line_id", "key"]).drop("key")


def distinct_departures(departures: DataFrame) -> DataFrame:
    """One departure for each route and time: the first by id."""
    return departures.groupBy("line_id", "route_id", "time").agg(F.min("departure_id").alias("departure_id"))


def vehicles(departures: DataFrame, types: DataFrame) -> DataFrame:
    """One vehicle for each departure, numbered over all; its type by the mode, OTHER where the table has none.

    The number is the rank within a line after the departures of all lines before it, so no single task sorts everything.
    """
    order = W.partitionBy("line_id").orderBy("route_id", "departure_id")
    per_line = departures.groupBy("line_id").agg(F.count("*").alias("_m"))
    before = per_line.withColumn("_before", F.sum("_m").over(W.orderBy("line_id").rowsBetween(W.unboundedPreceding, -1))).select("line_id", F.coalesce("_before", F.lit(0)).alias("_before"))
    ranked = departures.withColumn("_r", F.row_number().over(order)).join(before, "line_id")
    n = F.col("_before") + F.col("_r")
    typed = ranked.withColumn("_type", T.vehicle_name("mode")).join(types.select(F.col("type").alias("_known")), F.col("_type") == F.col("_known"), "left")
    return typed.select("line_id", "route_id", "departure_id", F.concat(F.lit("veh_"), n, F.lit("_"), F.regexp_replace("mode", " ", "_")).alias("vehicle_id"), F.coalesce("_known", F.lit("OTHER")).alias("vehicle_type"))


def line_info(lines: DataFrame, routes: DataFrame, departures: DataFrame) -> DataFrame:
    """Lines with the number of their routes and departures; 0 for lines that have none."""
    r = routes.groupBy("line_id").agg(F.countDistinct("route_id").alias("numTransitRoutes"))
    d = departures.groupBy("line_id").agg(F.count("*").alias("totalDepartures"))
    return lines.join(r, "line_id", "left").join(d, "line_id", "left").fillna(0, ["numTransitRoutes", "totalDepartures"])


def cut(route_stops: DataFrame, inside: DataFrame) -> DataFrame:
    """Routes that touch any of the given stops, whole."""
    keep = route_stops.join(inside.select("stop_id").distinct(), "stop_id", "left_semi").select("line_id", "route_id").distinct()
    return route_stops.join(keep, ["line_id", "route_id"], "left_semi")


def unused_stops(stops: DataFrame, route_stops: DataFrame) -> DataFrame:
    return stops.join(route_stops.select("stop_id"), "stop_id", "left_anti")


def used_transfers(transfers: DataFrame, stops: DataFrame) -> DataFrame:
    """Transfers whose two stops are both there."""
    s = stops.select("stop_id")
    return transfers.join(s.withColumnRenamed("stop_id", "from_stop"), "from_stop", "left_semi").join(s.withColumnRenamed("stop_id", "to_stop"), "to_stop", "left_semi")


def transfer_times(transfers: DataFrame) -> DataFrame:
    """Minimum times: the given one for type 2, none for type 3, else 0; of repeated pairs the last row holds."""
    kept = transfers.where("transfer_type <> 3")
    time = F.when(F.col("transfer_type") == 2, F.col("min_time")).otherwise(0)
    return kept.groupBy("from_stop", "to_stop").agg(F.max_by(time, "position").alias("min_time"))


def combined_stops(route_stops: DataFrame) -> DataFrame:
    """Child stops taken back to their parents."""
    return route_stops.withColumn("stop_id", T.parent_stop("stop_id"))


def merged_schedules(base: DataFrame, other: DataFrame, shift_hours: int = 24, limit: int | None = None) -> DataFrame:
    """Departures (line_id, route_id, profile, departure_id, time) of two schedules.

    A route that both have with one profile takes the other's departures, shifted, if they are before the limit; with
    another profile it comes in as ``_merged`` without departures; a route the base lacks comes in as it is.
    """
    known = base.select("line_id", "route_id", F.col("profile").alias("_profile")).distinct()
    both = other.join(known, ["line_id", "route_id"], "left")
    late = F.col("time") + shift_hours * 3600
    same = both.where(F.col("profile") == F.col("_profile")).select("line_id", "route_id", "profile", F.concat("departure_id", F.lit(f"+{shift_hours}h")).alias("departure_id"), late.alias("time"))
    same = same if limit is None else same.where(F.col("time") < limit)
    unlike = both.where(F.col("profile") != F.col("_profile")).select("line_id", F.concat("route_id", F.lit("_merged")).alias("route_id"), "profile").distinct()
    unlike = unlike.withColumn("departure_id", F.lit(None).cast("string")).withColumn("time", F.lit(None).cast("long"))
    new = both.where(F.col("_profile").isNull()).drop("_profile")
    columns = ["line_id", "route_id", "profile", "departure_id", "time"]
    return base.select(columns).unionByName(new.select(columns)).unionByName(same.select(columns)).unionByName(unlike.select(columns))


def paired(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs the i-th row by time of each side within the keys; surplus rows have no partner and go."""
    rank = lambda df, n: df.withColumn("_i", F.row_number().over(W.partitionBy(*keys).orderBy("time", "departure_id"))).select(*keys, "_i", F.col("departure_id").alias(f"{n}_departure"), F.col("time").alias(f"{n}_time"))
    return rank(first, "first").join(rank(second, "second"), [*keys, "_i"]).drop("_i")


def one_route(route_stops: DataFrame, line: str, route: str = "*") -> DataFrame:
    """One route of a line, or all of them."""
    return route_stops.where((F.col("line_id") == line) & (F.lit(True) if route == "*" else F.col("route_id") == route))


def sampled_routes(route_stops: DataFrame, n: int, seed: int = 1) -> DataFrame:
    """About n routes, by a hash of line and route, whole."""
    total = route_stops.select("line_id", "route_id").distinct().count()
    lot = F.pmod(F.xxhash64("line_id", "route_id", F.lit(seed)), F.lit(1_000_000)) / 1_000_000
    return route_stops.where(lot <= n / max(total, 1))


def without_mode(route_stops: DataFrame, modes: list[str]) -> DataFrame:
    return route_stops.where(~F.col("mode").isin(modes))
