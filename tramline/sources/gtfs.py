"""GTFS feeds: a folder or a zip file as a set of checked, lazy tables."""

from __future__ import annotations

import datetime
import os
import tempfile
import zipfile
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import crs
from ..functions import text as T
from ..operators import calendar, timetable
from .csvs import read_csv

WEEKDAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]
# Modes of the basic and extended route types.
ROUTE_TYPES = {
    0: "tram",
    1: "subway",
    2: "rail",
    3: "bus",
    4: "ferry",
    5: "cable car",
    6: "gondola",
    7: "funicular",
    100: "rail",
    101: "rail",
    102: "rail",
    103: "rail",
    104: "rail",
    105: "rail",
    106: "rail",
    107: "rail",
    108: "rail",
    109: "rail",
    110: "rail",
    111: "rail",
    112: "rail",
    113: "rail",
    114: "rail",
    115: "rail",
    116: "rail",
    117: "rail",
    200: "rail",
    201: "bus",
    202: "bus",
    203: "bus",
    204: "bus",
    205: "bus",
    206: "bus",
    207: "bus",
    208: "bus",
    209: "bus",
    300: "rail",
    400: "rail",
    401: "subway",
    402: "subway",
    403: "rail",
    404: "rail",
    405: "rail",
    500: "subway",
    600: "subway",
    700: "bus",
    701: "bus",
    702: "bus",
    703: "bus",
    704: "bus",
    705: "bus",
    706: "bus",
    707: "bus",
    708: "bus",
    709: "bus",
    710: "bus",
    711: "bus",
    712: "bus",
    713: "bus",
    714: "bus",
    715: "bus",
    716: "bus",
    800: "bus",
    900: "tram",
    901: "tram",
    902: "tram",
    903: "tram",
    904: "tram",
    905: "tram",
    906: "tram",
    1000: "ferry",
    1001: "ferry",
    1002: "ferry",
    1003: "ferry",
    1004: "ferry",
    1005: "ferry",
    1006: "ferry",
    1007: "ferry",
    1008: "ferry",
    1009: "ferry",
    1010: "ferry",
    1011: "ferry",
    1012: "ferry",
    1013: "ferry",
    1014: "ferry",
    1015: "ferry",
    1016: "ferry",
    1017: "ferry",
    1018: "ferry",
    1019: "ferry",
    1020: "ferry",
    1021: "ferry",
    1100: "other",
    1101: "other",
    1102: "other",
    1103: "other",
    1104: "other",
    1105: "other",
    1106: "other",
    1107: "other",
    1108: "other",
    1109: "other",
    1110: "other",
    1111: "other",
    1112: "other",
    1113: "other",
    1114: "other",
    1200: "ferry",
    1300: "cable car",
    1301: "cable car",
    1302: "cable car",
    1303: "cable car",
    1304: "cable car",
    1305: "cable car",
    1306: "cable car",
    1307: "cable car",
    1400: "funicular",
    1401: "funicular",
    1402: "funicular",
    1500: "other",
    1501: "bus",
    1502: "ferry",
    1503: "rail",
    1504: "other",
    1505: "other",
    1506: "other",
    1507: "other",
    1600: "other",
    1601: "other",
    1602: "other",
    1603: "other",
    1604: "other",
    1700: "other",
    1701: "other",
    9999: "other",
}
LOCATION_TYPES = (0, 1, 2, 3, 4)


@dataclass(frozen=True)
class Feed:
    """Lazy tables of one feed."""

    agency: DataFrame
    stops: DataFrame
    services: DataFrame
    routes: DataFrame
    trips: DataFrame
    stop_times: DataFrame
    shapes: DataFrame
    frequencies: DataFrame
    transfers: DataFrame


def route_mode(code) -> F.Column:
    """Mode of a basic or extended route type; what is no route type is ``other``."""
    modes = F.create_map(*[F.lit(x) for pair in ROUTE_TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(modes, code.try_cast("int")), F.lit("other"))


def _guard(df: DataFrame, bad: F.Column, what: str, *columns: str) -> DataFrame:
    """``df`` with an error for every row that a rule forbids, raised when it is read."""
    said = F.concat(F.lit(what + ": "), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    return df.where(F.when(F.coalesce(bad, F.lit(False)), F.raise_error(said).cast("boolean")).otherwise(True))


def unzipped(path: str) -> str:
    """Folder of a zip file's tables; a folder is itself. Encrypted files are an error."""
    if not path.endswith(".zip"):
        return path
    to = tempfile.mkdtemp(prefix="feed-")
    with zipfile.ZipFile(path) as z:
        if any(i.flag_bits & 1 for i in z.infolist()):
            raise ValueError(f"{path} is encrypted")
        z.extractall(to)
    return to


def load(spark: SparkSession, folder: str) -> Feed:
    """Read a feed. Files that are required, and one of the two calendars, must be there."""
    folder = unzipped(folder)
    has = lambda n: os.path.exists(f"{folder}/{n}.txt")
    absent = [n for n in ("agency", "stops", "routes", "trips", "stop_times") if not has(n)]
    if absent or not (has("calendar") or has("calendar_dates")):
        raise FileNotFoundError(f"{folder} has no {absent or 'calendar'}")
    read = lambda n, req, opt=(), pos=False: read_csv(spark, f"{folder}/{n}.txt", req, list(opt), pos)

    agency = read("agency", ["agency_name", "agency_url", "agency_timezone"], ["agency_id"])
    agencies = agency.select("agency_id").take(2)
    if not agencies:
        raise ValueError("no agency")
    if len(agencies) > 1 and any(a["agency_id"] is None for a in agencies):
        raise ValueError("several agencies need ids")
    agency = agency.withColumn("agency_id", F.coalesce("agency_id", "agency_name"))

    return Feed(agency, _stops(spark, folder, read), _services(spark, has, read), _routes(read, agency, len(agencies) == 1), *_trips(spark, has, read))


def _stops(spark, folder, read) -> DataFrame:
    stops = read("stops", ["stop_id", "stop_name"], ["stop_lat", "stop_lon", "parent_station", "location_type"])
    kind = F.coalesce(F.col("location_type").try_cast("int"), F.lit(0))
    stops = stops.select("stop_id", F.col("stop_name").alias("name"), F.col("stop_lat").try_cast("double").alias("lat"), F.col("stop_lon").try_cast("double").alias("lon"), F.col("parent_station").alias("parent"), kind.alias("location_type"))
    parent = F.col("parent").isNotNull()
    stops = _guard(stops, ~F.col("location_type").isin(*LOCATION_TYPES), "unknown location type", "stop_id")
    stops = _guard(stops, (F.col("location_type") == 1) & parent, "a station has a parent", "stop_id")
    stops = _guard(stops, F.col("location_type").isin(2, 3, 4) & ~parent, "a parent is missing", "stop_id")
    stops = _guard(stops, F.col("location_type").isin(0, 1, 2) & (F.col("lat").isNull() | F.col("lon").isNull()), "coordinates are missing", "stop_id")
    # Nodes and boarding areas without coordinates have those of the nearest ancestor with some; stations are three levels up at most.
    for _ in range(3):
        up = stops.select(F.col("stop_id").alias("_p"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon"))
        stops = stops.join(up, F.col("parent") == F.col("_p"), "left").withColumn("lat", F.coalesce("lat", "_lat")).withColumn("lon", F.coalesce("lon", "_lon")).drop("_p", "_lat", "_lon")
    return stops


def _services(spark, has, read) -> DataFrame:
    if has("calendar"):
        c = read("calendar", ["service_id", *WEEKDAYS, "start_date", "end_date"])
        base = c.select("service_id", F.array(*[F.coalesce(F.col(d) == "1", F.lit(False)) for d in WEEKDAYS]).alias("days"), T.service_date("start_date").alias("start_date"), T.service_date("end_date").alias("end_date"))
    else:
        base = spark.createDataFrame([], "service_id string, days array<boolean>, start_date date, end_date date")
    if has("calendar_dates"):
        # Anything but 2 is an addition. Of a date that is both, both are kept; the addition holds when a service is asked.
        dates = read("calendar_dates", ["service_id", "date", "exception_type"])
        day = T.service_date("date")
        changes = dates.groupBy("service_id").agg(
            F.array_sort(F.collect_set(F.when(F.col("exception_type").eqNullSafe(F.lit("2")), None).otherwise(day))).alias("additions"),
            F.array_sort(F.collect_set(F.when(F.col("exception_type") == "2", day))).alias("exceptions"))
    else:
        changes = spark.createDataFrame([], "service_id string, additions array<date>, exceptions array<date>")
    none = F.array().cast("array<date>")
    out = base.join(changes, "service_id", "full_outer")
    off = F.array_repeat(F.lit(False), 7)
    return out.select("service_id", F.coalesce("days", off).alias("days"), "start_date", "end_date", F.coalesce("additions", none).alias("additions"), F.coalesce("exceptions", none).alias("exceptions"))


def _routes(read, agency, single: bool) -> DataFrame:
    routes = read("routes", ["route_id", "route_type"], ["route_short_name", "route_long_name", "agency_id"])
    routes = _guard(routes, F.col("route_short_name").isNull() & F.col("route_long_name").isNull(), "a route without a name", "route_id")
    only = agency.select(F.col("agency_id").alias("_a"))
    if single:
        routes = routes.crossJoin(F.broadcast(only.limit(1))).withColumn("agency_id", F.coalesce("agency_id", "_a")).drop("_a")
    routes = routes.join(only, F.col("agency_id") == F.col("_a"), "left")
    routes = _guard(routes, F.col("_a").isNull(), "a route of an unknown agency", "route_id", "agency_id").drop("_a")
    return routes.select(
        "route_id", F.coalesce("route_short_name", "route_long_name").alias("short_name"), F.coalesce("route_long_name", "route_short_name").alias("long_name"), "agency_id",
        F.col("route_type").try_cast("int").alias("route_type"), route_mode(F.col("route_type")).alias("mode"))


def _trips(spark, has, read) -> tuple:
    routes = read("routes", ["route_id"])
    all_trips = read("trips", ["route_id", "service_id", "trip_id"], ["shape_id"])
    trips = all_trips.join(routes, "route_id", "left_semi")
    calendars = [read(n, ["service_id"]) for n in ("calendar", "calendar_dates") if has(n)]
    known = calendars[0] if len(calendars) == 1 else calendars[0].union(calendars[1])
    trips = trips.join(known.distinct().withColumnRenamed("service_id", "_s"), F.col("service_id") == F.col("_s"), "left")
    trips = _guard(trips, F.col("_s").isNull(), "a trip of an unknown service", "trip_id", "service_id").drop("_s")
    if has("shapes"):
        p = read("shapes", ["shape_id", "shape_pt_lon", "shape_pt_lat", "shape_pt_sequence"])
        points = p.select("shape_id", F.col("shape_pt_sequence").cast("int").alias("seq"), F.col("shape_pt_lon").cast("double").alias("lon"), F.col("shape_pt_lat").cast("double").alias("lat")).distinct()
        n = F.count("*").over(W.partitionBy("shape_id", "seq"))
        points = _guard(points.withColumn("_n", n), F.col("_n") > 1, "two points at one place of a shape", "shape_id", "seq").drop("_n")
        shapes = points.groupBy("shape_id").agg(F.array_sort(F.collect_list(F.struct("seq", "lon", "lat"))).alias("points"))
        trips = trips.join(shapes.select(F.col("shape_id").alias("_k")), F.col("shape_id") == F.col("_k"), "left").withColumn("shape_id", F.col("_k")).drop("_k")
    else:
        shapes = spark.createDataFrame([], "shape_id string, points array<struct<seq:int,lon:double,lat:double>>")
    st = read("stop_times", ["trip_id", "stop_id", "stop_sequence", "arrival_time", "departure_time"], pos=True)
    st = st.join(all_trips.select(F.col("trip_id").alias("_t")), F.col("trip_id") == F.col("_t"), "left")
    st = _guard(st, F.col("_t").isNull(), "times of an unknown trip", "trip_id").drop("_t").join(trips.select("trip_id"), "trip_id", "left_semi")
    st = st.select("trip_id", "stop_id", F.col("stop_sequence").cast("int").alias("stop_sequence"), T.seconds("arrival_time").alias("arrival"), T.seconds("departure_time").alias("departure"), "position")
    st = timetable.filled(timetable.first_of_sequence(st, "position")).drop("position")
    if has("frequencies"):
        f = read("frequencies", ["trip_id", "start_time", "end_time", "headway_secs"])
        freq = f.select("trip_id", T.seconds("start_time").alias("start"), T.seconds("end_time").alias("end"), F.col("headway_secs").cast("int").alias("headway")).join(trips.select("trip_id"), "trip_id", "left_semi").distinct()
    else:
        freq = spark.createDataFrame([], "trip_id string, start int, end int, headway int")
    if has("transfers"):
        t = read("transfers", ["from_stop_id", "to_stop_id", "transfer_type"], ["min_transfer_time"], True)
        transfers = t.select(F.col("from_stop_id").alias("from_stop"), F.col("to_stop_id").alias("to_stop"), F.col("transfer_type").try_cast("int").alias("transfer_type"), F.col("min_transfer_time").try_cast("int").alias("min_time"), "position")
        transfers = _guard(transfers, (F.col("transfer_type") == 2) & F.col("min_time").isNull(), "a timed transfer without a time", "from_stop", "to_stop")
        transfers = transfers.groupBy("from_stop", "to_stop", "transfer_type", "min_time").agg(F.min("position").alias("position"))
    else:
        transfers = spark.createDataFrame([], "from_stop string, to_stop string, transfer_type int, min_time int, position long")
    return trips, st, shapes, freq, transfers


def projected(feed: Feed, name: str) -> Feed:
    """Stops and shapes with plane coordinates x and y."""
    project = crs.projection(name)
    stops = feed.stops.withColumn("_p", project(F.col("lon"), F.col("lat"))).withColumn("x", F.col("_p.x")).withColumn("y", F.col("_p.y")).drop("_p")
    move = lambda p: F.struct(p["seq"].alias("seq"), project(p["lon"], p["lat"])["x"].alias("x"), project(p["lon"], p["lat"])["y"].alias("y"))
    return replace(feed, stops=stops, shapes=feed.shapes.withColumn("points", F.transform("points", move)))


def sample_date(feed: Feed, selector: str):
    """Date of a selector: ``all`` (none), ``dayWithMostTrips``, ``dayWithMostServices`` or ``yyyymmdd``."""
    if selector == "all":
        return None
    if selector in ("dayWithMostTrips", "dayWithMostServices"):
        days = calendar.by_trips(feed.trips.select("service_id"), feed.services) if selector.endswith("Trips") else calendar.by_services(feed.services)
        row = days.first()
        if row is None:
            raise ValueError("no service runs on any day")
        return row["best_day"]
    if len(selector) == 8 and selector.isdigit():
        return datetime.datetime.strptime(selector, "%Y%m%d").date()
    raise ValueError(f"not a date or selector: {selector}")


def to_schedule(feed: Feed, selector: str = "dayWithMostTrips") -> dict[str, DataFrame]:
    """Unmapped schedule of a feed's day: stops, lines, route_stops, departures, transfers, vehicles, info.

    Trips of the day become routes; equal trips of a line are one route with several departures.
    """
    date = sample_date(feed, selector)
    day = F.lit(date).cast("date")
    running = feed.services.where(calendar.runs_on(day)).select("service_id")
    trips = feed.trips.join(running, "service_id", "left_semi").join(feed.routes.select("route_id", "mode"), "route_id").select("trip_id", F.col("route_id").alias("line_id"), "mode", "shape_id")
    off = timetable.offsets(feed.stop_times.join(trips.select("trip_id"), "trip_id", "left_semi"))
    off = off.join(trips, "trip_id")
    merged = timetable.merged_routes(timetable.profiles(off))
    start = feed.stop_times.groupBy("trip_id").agg(F.min_by("departure", "stop_sequence").alias("start_time"))
    own = trips.join(start, "trip_id")
    dep = timetable.departures_of(own, feed.frequencies.join(trips.select("trip_id"), "trip_id", "left_semi")).join(merged, "trip_id").join(trips.select("trip_id", "mode"), "trip_id")
    dep = dep.select("line_id", "route_id", F.concat_ws("_", "trip_id", T.clock("departure")).alias("departure_id"), F.col("departure").cast("long").alias("time"), "mode")
    kept = merged.where("route_id = trip_id").select("line_id", "route_id")
    route_stops = off.join(kept.withColumnRenamed("route_id", "trip_id"), ["line_id", "trip_id"], "left_semi").select(
        "line_id", F.col("trip_id").alias("route_id"), F.col("stop_sequence").alias("idx"), "stop_id", "arrival_offset", "departure_offset", "mode", F.concat(F.lit(T.SHAPE_PREFIX), "shape_id").alias("description"))
    stops = feed.stops.join(route_stops.select("stop_id"), "stop_id", "left_semi")
    lines = feed.routes.join(feed.agency.select("agency_id", "agency_name", "agency_url"), "agency_id").withColumnRenamed("route_id", "line_id")
    info = timetable.line_info(lines, route_stops, dep)
    info = info.select("line_id", "short_name", "long_name", F.col("mode").alias("type"), F.lit("").alias("description"), "agency_id", "agency_name", "agency_url", "numTransitRoutes", "totalDepartures")
    return {"stops": stops, "lines": lines, "route_stops": route_stops, "departures": dep, "transfers": timetable.used_transfers(timetable.transfer_times(feed.transfers), stops), "info": info}


def filtered_copy(feed: Feed, date, start: int, end: int) -> DataFrame:
    """Ids of trips that run on a date and whose last arrival lies between two times, these excluded."""
    running = feed.services.where(calendar.runs_on(F.lit(date).cast("date"))).select("service_id")
    last = feed.stop_times.groupBy("trip_id").agg(F.max_by("arrival", "stop_sequence").alias("last"))
    return feed.trips.join(running, "service_id", "left_semi").join(last, "trip_id").where((F.col("last") > start) & (F.col("last") < end)).select("trip_id")


def write_tables(feed: Feed, folder: str) -> None:
    """stop_times, stops, trips and transfers as quoted CSV folders."""
    write = lambda df, n: df.write.csv(f"{folder}/{n}", header=True, quoteAll=True)
    write(feed.stop_times.select("trip_id", T.clock("arrival").alias("arrival_time"), T.clock("departure").alias("departure_time"), "stop_id", "stop_sequence"), "stop_times")
    write(feed.stops.select("stop_id", F.col("lon").alias("stop_lon"), F.col("lat").alias("stop_lat"), F.col("name").alias("stop_name")), "stops")
    write(feed.trips.select("route_id", "service_id", "trip_id", "shape_id"), "trips")
    write(feed.transfers.select(F.col("from_stop").alias("from_stop_id"), F.col("to_stop").alias("to_stop_id"), "transfer_type", F.col("min_time").alias("min_transfer_time")), "transfers")
