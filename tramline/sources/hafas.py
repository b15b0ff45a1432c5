"""HAFAS raw data: positional text files as tables. Column numbers below are 1-based, as in the format's description."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a file without comments. Their order isn't kept; readers that need it group lines into records first."""
    return spark.read.text(path).where(~F.startswith("value", F.lit("*")) & (F.trim("value") != ""))


def _at(first: int, last: int, line="value") -> Column:
    return F.trim(F.substring(line, first, last - first + 1))


def stops(spark: SparkSession, path: str) -> DataFrame:
    """BFKOORD_WGS: id, longitude, latitude, name after the percent sign."""
    p = F.split(F.trim("value"), " +")
    return _lines(spark, path).select(p[0].alias("stop_id"), p[1].cast("double").alias("lon"), p[2].cast("double").alias("lat"), F.trim(F.regexp_extract("value", "%(.*)$", 1)).alias("name"))


def operators(spark: SparkSession, path: str) -> DataFrame:
    """BETRIEB_DE: (operator_code, abbreviation, name) of two-line records that share their number."""
    lines = _lines(spark, path).withColumn("n", _at(1, 5))
    quoted = lambda key: F.regexp_extract("value", rf'{key} "([^"]*)"', 1)
    names = lines.where(F.contains("value", F.lit('"'))).select("n", quoted("K").alias("abbreviation"), quoted("V").alias("name"))
    codes = lines.where(F.substring("value", 7, 1) == ":").select("n", F.explode(F.filter(F.split(F.trim(F.substring("value", 8, 10_000)), " +"), lambda x: x != "")).alias("operator_code"))
    return codes.join(names, "n").select("operator_code", "abbreviation", "name")


def bitfields(spark: SparkSession, path: str) -> DataFrame:
    """BITFELD: (bitfield, hex)."""
    return _lines(spark, path).select(_at(1, 6).cast("int").alias("bitfield"), _at(8, 103).alias("hex"))


def valid_on(fields: DataFrame, day: int) -> DataFrame:
    """Bitfields that hold on a day of the period; the first two bits are no days, and bitfield 0 holds always."""
    bits = T.bits_of_hex("hex")
    on = fields.where(F.substring(bits, day + 3, 1) == "1").select("bitfield")
    return on.union(fields.sparkSession.createDataFrame([(0,)], "bitfield int")).distinct()


def period(spark: SparkSession, path: str) -> DataFrame:
    """ECKDATEN: first and last day, the first two lines that are dates."""
    d = _lines(spark, path).select(F.to_date(F.regexp_extract("value", r"(\d{1,2}\.\d{1,2}\.\d{4})", 1), "d.M.yyyy").alias("d")).where("d IS NOT NULL")
    return d.agg(F.min("d").alias("first"), F.max("d").alias("last"))


def transfers(spark: SparkSession, within: str, between: str, all_stops: DataFrame | None = None, default_minutes: int | None = None) -> DataFrame:
    """(from_stop, to_stop, min_time) in seconds: UMSTEIGB within stops, METABHF between them."""
    own = _lines(spark, within).select(_at(1, 7).alias("from_stop"), _at(1, 7).alias("to_stop"), (_at(12, 13).try_cast("int") * 60).alias("min_time"))
    if all_stops is not None:
        own = own.join(all_stops.select(F.col("stop_id").alias("from_stop")), "from_stop", "left_semi" if default_minutes is None else "right")
        own = own.withColumn("to_stop", F.col("from_stop")).withColumn("min_time", F.coalesce("min_time", F.lit((default_minutes or 0) * 60)))
    pair = _lines(spark, between).where(F.substring("value", 8, 1) != ":").select(_at(1, 7).alias("from_stop"), _at(9, 15).alias("to_stop"), (_at(17, 19).try_cast("int") * 60).alias("min_time")).where("min_time IS NOT NULL")
    if all_stops is not None:
        ids = all_stops.select("stop_id")
        pair = pair.join(ids, F.col("from_stop") == F.col("stop_id"), "left_semi").join(ids, F.col("to_stop") == F.col("stop_id"), "left_semi")
    return own.unionByName(pair)


def through_services(spark: SparkSession, path: str) -> DataFrame:
    """DURCHBI: trips that go on as another trip at a stop; short lines and lines with bad numbers are skipped."""
    raw = _lines(spark, path).where(F.length("value") >= 42)
    blank = _at(37, 42) == ""
    return raw.select(
        _at(1, 6).try_cast("int").alias("first_trip"), _at(8, 13).alias("first_operator"), _at(15, 21).alias("stop_id"), _at(23, 28).try_cast("int").alias("second_trip"), _at(30, 35).alias("second_operator"),
        F.when(blank, 0).otherwise(_at(37, 42).try_cast("int")).alias("bitfield")).where("first_trip IS NOT NULL AND second_trip IS NOT NULL AND bitfield IS NOT NULL")


def points(spark: SparkSession, path: str) -> DataFrame:
    p = F.split(F.trim("value"), " +")
    return _lines(spark, path).select(p[0].alias("node_id"), p[1].cast("double").alias("x"), p[2].cast("double").alias("y"))


def edges(lines: DataFrame, nodes: DataFrame, freespeed: float = 15.0) -> DataFrame:
    """Links of polylines (edge_id, from_node, via, to_node, both): consecutive points, both ways where marked; unknown ends are skipped."""
    whole = F.concat(F.array("from_node"), "via", F.array("to_node"))
    steps = lines.select("both", F.explode(F.transform(F.sequence(F.lit(1), F.size(whole) - 1), lambda i: F.struct(F.element_at(whole, i).alias("f"), F.element_at(whole, i + 1).alias("t")))).alias("s"))
    fwd = steps.select(F.col("s.f").alias("from_node"), F.col("s.t").alias("to_node"))
    back = steps.where("both").select(F.col("s.t").alias("from_node"), F.col("s.f").alias("to_node"))
    n = nodes.select("node_id", "x", "y")
    every = fwd.union(back).where("from_node <> to_node").distinct()
    every = every.join(n.toDF("from_node", "fx", "fy"), "from_node").join(n.toDF("to_node", "tx", "ty"), "to_node")
    return every.select(F.concat_ws("_", "from_node", "to_node").alias("link_id"), "from_node", "to_node", "fx", "fy", "tx", "ty", F.lit(freespeed).alias("freespeed"))


def edge_lines(spark: SparkSession, path: str) -> DataFrame:
    """KANTEN: a head line (from, to, B for both ways) and its ``*G`` points, as one row each."""
    raw = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("n", "line")).where("trim(line) <> ''")
    head = ~F.startswith("line", F.lit("*"))
    grouped = raw.withColumn("g", F.sum(head.cast("int")).over(W.orderBy("n"))).where("g > 0")
    p = F.split(F.trim("line"), " +")
    return grouped.groupBy("g").agg(
        F.min_by(p[0], "n").alias("from_node"), F.transform(F.array_sort(F.collect_list(F.when(F.startswith("line", F.lit("*G")), F.struct("n", p[1].alias("id"))))), lambda x: x["id"]).alias("via"),
        F.min_by(p[1], "n").alias("to_node"), F.min_by(F.array_contains(p, "B"), "n").alias("both")).drop("g")


def trips(spark: SparkSession, path: str) -> DataFrame:
    """FPLAN: one row for each ``*Z`` record, with stops and validity.

    The file is split at its record heads, so records are parsed where they lie and nothing needs an order over the file.
    Stops that allow neither boarding nor alighting are dropped; ``*KW`` records and ``+`` lines are skipped.
    """
    raw = spark.read.option("lineSep", "\n*Z").text(path)
    raw = raw.where(~F.startswith("value", F.lit("*KW")))
    lines = F.split(F.regexp_replace("value", r"^\*Z", ""), "\r?\n")
    df = raw.select(F.concat(F.lit("*Z"), lines[0]).alias("head"), F.filter(F.slice(lines, 2, F.size(lines)), lambda x: (F.trim(x) != "") & ~F.startswith(x, F.lit("+"))).alias("lines"))
    df = df.where(_at(4, 9, "head") != "")
    marked = lambda mark: F.filter("lines", lambda x: F.startswith(x, F.lit(mark)))
    part = lambda x, a, b: F.trim(F.substring(x, a, b - a + 1))
    time = lambda x, a, b: F.when(part(x, a, b) != "", F.substring(part(x, a, b), 1, 2).try_cast("int") * 3600 + F.substring(part(x, a, b), 3, 2).try_cast("int") * 60)
    sign = lambda x, a: F.substring(x, a, 1) == "-"
    stop_lines = F.filter("lines", lambda x: ~F.startswith(x, F.lit("*")) & ~(sign(x, 30) & sign(x, 37)))
    stop_rows = F.transform(stop_lines, lambda x: F.struct(part(x, 1, 7).alias("stop_id"), F.coalesce(time(x, 32, 35), F.lit(0)).alias("arrival"), F.coalesce(time(x, 39, 42), F.lit(0)).alias("departure")))
    valid = F.transform(marked("*A VE"), lambda x: F.struct(F.coalesce(part(x, 23, 28).try_cast("int"), F.lit(0)).alias("bitfield"), part(x, 7, 13).alias("from_stop"), part(x, 15, 21).alias("to_stop")))
    return df.select(
        _at(4, 9, "head").alias("number"), _at(11, 16, "head").alias("operator_code"), F.coalesce(_at(24, 26, "head").try_cast("int"), F.lit(0)).alias("cycles"), F.coalesce(_at(28, 30, "head").try_cast("int"), F.lit(0)).alias("cycle_minutes"),
        part(F.get(marked("*G"), F.lit(0)), 4, 6).alias("category"), F.coalesce(part(F.get(marked("*L"), F.lit(0)), 4, 11), F.lit("")).alias("line"), (F.size(marked("*A BE")) > 0).alias("replacement"), valid.alias("validity"), stop_rows.alias("stops"))
