"""Transit relations over the star-schema tables, the same in Spark and in SQL.

Orders are trips, line items their stop times, suppliers the stops, nations the lines, regions the agencies.
Coordinates are integers, so that distances agree to the last digit after rounding.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    return s.select(k.alias("stop_id"), F.col("s_nationkey").cast("long").alias("parent"), ((k * 7919) % 1000).cast("double").alias("x"), ((k * 104729) % 1000).cast("double").alias("y"))


STOPS = """stops AS (
  SELECT s_suppkey AS stop_id, s_nationkey::BIGINT AS parent, ((s_suppkey * 7919) % 1000)::DOUBLE AS x, ((s_suppkey * 104729) % 1000)::DOUBLE AS y FROM supplier)"""


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("trip_id"), F.col("c_nationkey").cast("long").alias("line_id"), F.col("c_mktsegment").alias("mode"), F.to_date("o_orderdate").alias("service_date"))


TRIPS = """trips AS (
  SELECT o_orderkey AS trip_id, c_nationkey::BIGINT AS line_id, c_mktsegment AS mode, o_orderdate::DATE AS service_date
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


def stop_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each trip and sequence number: of repeated ones the first by stop and part.

    Rows are dealt by trip alone and sorted by number first, so that windows along trips need no other exchange or sort.
    """
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey").repartition("l_orderkey").withColumn("seq", F.col("l_linenumber").cast("long"))
    w = W.partitionBy("l_orderkey", "seq").orderBy("l_suppkey", "l_partkey")
    first = li.withColumn("n", F.row_number().over(w)).where("n = 1")
    return first.select(
        F.col("l_orderkey").alias("trip_id"), "seq", F.col("l_suppkey").alias("stop_id"),
        (F.col("l_linenumber") * 600 + F.col("l_partkey") % 300).cast("long").alias("arrival"))


STOP_TIMES = """stop_times AS (
  SELECT l_orderkey AS trip_id, l_linenumber::BIGINT AS seq, l_suppkey AS stop_id, (l_linenumber * 600 + l_partkey % 300)::BIGINT AS arrival
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_suppkey, l_partkey) AS n FROM lineitem) WHERE n = 1)"""


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directed links between consecutive stops of a trip, with the number of trips that use them."""
    w = W.partitionBy("trip_id").orderBy("seq")
    st = stop_times(spark, sf_dir).withColumn("to_stop", F.lead("stop_id").over(w)).where("to_stop IS NOT NULL AND to_stop <> stop_id")
    pairs = st.groupBy(F.col("stop_id").alias("from_node"), F.col("to_stop").alias("to_node")).agg(F.count("*").alias("uses"))
    s = stops(spark, sf_dir)
    a, b = (s.select(F.col("stop_id").alias(f"{n}_node"), F.col("x").alias(f"{n[0]}x"), F.col("y").alias(f"{n[0]}y")) for n in ("from", "to"))
    out = pairs.join(a, "from_node").join(b, "to_node")
    return out.select(
        F.concat_ws("_", "from_node", "to_node").alias("link_id"), "from_node", "to_node", "uses", "fx", "fy", "tx", "ty",
        F.greatest(F.lit(1.0), F.sqrt(F.pow(F.col("tx") - F.col("fx"), 2) + F.pow(F.col("ty") - F.col("fy"), 2))).alias("length"))


LINKS = """pairs AS (
  SELECT stop_id AS from_node, to_stop AS to_node, count(*) AS uses
  FROM (SELECT *, lead(stop_id) OVER (PARTITION BY trip_id ORDER BY seq) AS to_stop FROM stop_times) WHERE to_stop IS NOT NULL AND to_stop <> stop_id GROUP BY 1, 2),
links AS (
  SELECT concat_ws('_', from_node, to_node) AS link_id, from_node, to_node, uses, a.x AS fx, a.y AS fy, b.x AS tx, b.y AS ty,
    greatest(1.0, sqrt(pow(b.x - a.x, 2) + pow(b.y - a.y, 2))) AS length
  FROM pairs JOIN stops a ON a.stop_id = from_node JOIN stops b ON b.stop_id = to_node)"""


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as stops that no network was made for."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("stop_id"), ((k * 6007) % 1000).cast("double").alias("x"), ((k * 3571) % 1000).cast("double").alias("y"))


PLACES = """places AS (SELECT c_custkey AS stop_id, ((c_custkey * 6007) % 1000)::DOUBLE AS x, ((c_custkey * 3571) % 1000)::DOUBLE AS y FROM customer)"""


def sparse_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One link from each stop to the next one of its parent: as many links as stops, less the parents."""
    w = W.partitionBy("parent").orderBy("stop_id")
    s = stops(spark, sf_dir)
    s = s.withColumn("to_node", F.lead("stop_id").over(w)).withColumn("tx", F.lead("x").over(w)).withColumn("ty", F.lead("y").over(w)).where("to_node IS NOT NULL")
    return s.select(F.concat_ws("_", "stop_id", "to_node").alias("link_id"), F.col("stop_id").alias("from_node"), "to_node", F.col("x").alias("fx"), F.col("y").alias("fy"), "tx", "ty")


SPARSE_LINKS = """sparse AS (
  SELECT concat_ws('_', stop_id, to_node) AS link_id, stop_id AS from_node, to_node, x AS fx, y AS fy, tx, ty
  FROM (SELECT *, lead(stop_id) OVER w AS to_node, lead(x) OVER w AS tx, lead(y) OVER w AS ty FROM stops WINDOW w AS (PARTITION BY parent ORDER BY stop_id)) WHERE to_node IS NOT NULL)"""


def services(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A service for each part: weekday flags from its size, a span of days, one addition and one exception."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    start = F.date_add(F.lit("1996-01-01").cast("date"), (k % 60).cast("int"))
    return p.select(
        k.alias("service_id"), F.transform(F.sequence(F.lit(0), F.lit(6)), lambda i: (F.col("p_size") + i) % 3 != 0).alias("days"), start.alias("start_date"), F.date_add(start, F.col("p_size").cast("int")).alias("end_date"),
        F.array(F.date_add(start, (k % 90).cast("int"))).alias("additions"), F.array(F.date_add(start, (k % 7).cast("int"))).alias("exceptions"))


SERVICES = """services AS (
  SELECT p_partkey AS service_id, list_transform(range(0, 7), lambda i: (p_size + i) % 3 <> 0) AS days, DATE '1996-01-01' + (p_partkey % 60)::INT AS start_date,
    DATE '1996-01-01' + (p_partkey % 60)::INT + p_size::INT AS end_date, [DATE '1996-01-01' + (p_partkey % 60)::INT + (p_partkey % 90)::INT] AS additions,
    [DATE '1996-01-01' + (p_partkey % 60)::INT + (p_partkey % 7)::INT] AS exceptions FROM part)"""
