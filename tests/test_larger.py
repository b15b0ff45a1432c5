"""What showed on larger tables and odd inputs: one test for each finding."""

import datetime
import os
import random
import re

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tramline import storage
from tramline.operators import calendar, candidates, checks, paths
from tramline.plans import registry
from tramline.plans import views as V


def test_busiest_day_broadcasts_no_days(spark, tmp_path):
    """Trips are counted before their services unfold into days; repeated services and services without trips too."""
    r, first = random.Random(21), datetime.date(1996, 1, 1)
    day = lambda k: first + datetime.timedelta(k)
    rows = [(r.randint(0, 30), [r.random() < 0.6 for _ in range(7)], day(s), day(s + r.randint(-1, 20)), [day(r.randint(0, 40))], [day(s)]) for s in (r.randint(0, 20) for _ in range(40))]
    services = spark.createDataFrame(rows, "service_id int, days array<boolean>, start_date date, end_date date, additions array<date>, exceptions array<date>")
    services.write.parquet(str(tmp_path / "services"))
    services = spark.read.parquet(str(tmp_path / "services"))
    trips = [r.choice([None, *range(35)]) for _ in range(300)]
    out = calendar.by_trips(spark.createDataFrame([(t,) for t in trips], "service_id int"), services)
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    count = {}
    for service, date in (tuple(x) for x in calendar.service_days(services).collect()):
        count[date] = count.get(date, 0) + trips.count(service)
    assert [tuple(x) for x in out.collect()] == [min(count.items(), key=lambda x: (-x[1], x[0]))]


def test_search_by_joins_drops_old_tables(spark, monkeypatch):
    """A long path by joins leaves the last labels and the network, not the tables of every step."""
    folder = storage.shared_dir(spark).removeprefix("file://")
    links = spark.createDataFrame([(f"l{i}", f"n{i}", f"n{i + 1}", 1.0) for i in range(6)], "link_id string, from_node string, to_node string, cost double")
    pairs = spark.createDataFrame([("l0", "l5")], "a string, b string")
    monkeypatch.setattr(paths, "BROADCAST_LINKS", 1)
    before = set(os.listdir(folder))
    out = [tuple(r) for r in paths.paths(pairs, links, 10.0).collect()]
    assert out == [("l0", "l5", 4.0, ["l1", "l2", "l3", "l4"])]
    assert len({x for x in set(os.listdir(folder)) - before if x.startswith(("paths-", "frontier-"))}) <= 2


def test_resampled_loses_no_point_to_rounding(spark):
    """After a link of exactly 50 the next one starts at 50, whatever its own length; a route of no length has no point."""
    ends = [(30.0 + a, 40.0 + b) for a in range(1, 15) for b in range(1, 15)]
    rows = [x for i, (a, b) in enumerate(ends) for x in ((1, i, 1, 0.0, 0.0, 30.0, 40.0), (1, i, 2, 30.0, 40.0, a, b))] + [(2, 0, 1, 5.0, 5.0, 5.0, 5.0)]
    points = spark.createDataFrame(rows, "line_id int, route_id int, idx int, fx double, fy double, tx double, ty double")
    out = {(x["line_id"], x["route_id"]): x["at"] for x in checks.resampled(points, 50.0).groupBy("line_id", "route_id").agg(F.sort_array(F.collect_list("at")).alias("at")).collect()}
    assert out == {(1, i): [0.0, 50.0] for i in range(len(ends))}


def test_routes_of_no_length(spark, tmp_path):
    """Stops 1 and 1001 lie at one place: SQL gives such a route with 0 points."""
    tables = {"customer": "SELECT 1L AS c_custkey, 1 AS c_nationkey, 'BUILDING' AS c_mktsegment", "orders": "SELECT 1L AS o_orderkey, 1L AS o_custkey, timestamp'1996-01-01' AS o_orderdate",
              "supplier": "SELECT id AS s_suppkey, 1 AS s_nationkey FROM range(1, 1002, 1000)", "lineitem": "SELECT 1L AS l_orderkey, id * 1000 - 999 AS l_suppkey, 1L AS l_partkey, cast(id AS int) AS l_linenumber FROM range(1, 3)"}
    for name, sql in tables.items():
        spark.sql(sql).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert [tuple(r) for r in registry.QUERIES["resampled_routes"](spark, str(tmp_path)).collect()] == [(1, 1, 0)]


def test_places_and_courses_are_searched_once(spark, monkeypatch):
    """Copies of stops and links multiply the rows, not the distances that are computed."""
    r, seen = random.Random(22), []
    stops = spark.createDataFrame([(i, float(i % 7 * 3), float(i % 5 * 4)) for i in range(70)], "stop_id long, x double, y double")
    rows = [(f"l{i}", *(float(r.randint(0, 30)) for _ in range(4))) for i in range(9)]
    links = spark.createDataFrame([(f"{x}-{k}", *c) for x, *c in rows for k in range(6)], "link_id string, fx double, fy double, tx double, ty double")
    plain = candidates.nearby(stops, links, 1e3)
    first = {}
    for x in sorted((tuple(x) for x in plain.collect()), key=lambda x: (x[0], x[2], not x[3], x[1])):
        first.setdefault(x[0], x)
    near = candidates.nearby(candidates.spots(stops), candidates.courses(links), 1e3)
    whole = candidates.of_stops(candidates.of_links(near, links), stops)
    assert near.count() == 35 * 9 and sorted(map(tuple, whole.collect())) == sorted(map(tuple, plain.collect()))
    real = candidates.nearby
    monkeypatch.setattr(candidates, "nearby", lambda s, x, radius: (seen.append((s.count(), x.count())), real(s, x, radius))[1])
    assert sorted(tuple(x) for x in candidates.nearest(stops, links, 1e3).select("stop_id", "link_id", "d", "is_right").collect()) == sorted(first.values())
    assert seen == [(35, 9)]
    want = sorted(map(tuple, candidates.soft_top(plain.withColumn("d", F.round("d", 6))).collect()))
    counted = near.join(candidates.courses(links).select("link_id", "n"), "link_id").withColumn("d", F.round("d", 6)).select("stop_id", "link_id", "d", "is_right", "n")
    top = candidates.of_stops(candidates.of_links(candidates.soft_top(counted, n="n"), links), stops)
    assert sorted(map(tuple, top.drop("n").collect())) == want


def _plan(df):
    """Nodes of the plan, the result's first."""
    return [x.strip(" +-:*()0123456789").split("(")[0].split(" [")[0].strip() for x in df._jdf.queryExecution().executedPlan().toString().splitlines()]


def test_stops_and_links_unfold_last(spark, tmp_path):
    """Copies of stops and links pass through no exchange, sort or join as pairs: both lists meet first, then they unfold."""
    spark.sql("SELECT id AS s_suppkey, 1 AS s_nationkey FROM (SELECT id + k * 1000 AS id FROM range(20) CROSS JOIN (SELECT id AS k FROM range(70)))").write.parquet(str(tmp_path / "supplier.parquet"))
    seen = random.Random(24)
    trips = [(t, seen.randrange(20) + seen.randrange(70) * 1000, seen.randrange(300), n) for t in range(150) for n in (1, 2, 2, 3, 5)]
    spark.createDataFrame(trips, "l_orderkey long, l_suppkey long, l_partkey long, l_linenumber int").write.parquet(str(tmp_path / "lineitem.parquet"))
    out = registry.QUERIES["nearby_links"](spark, str(tmp_path))
    nodes = _plan(out)
    moved = next(i for i, x in enumerate(nodes) if "Exchange" in x or "Sort" in x or "Join" in x)
    assert sum(x.startswith("Generate") for x in nodes[:moved]) == 2
    plain = candidates.nearby(V.stops(spark, str(tmp_path)), V.links(spark, str(tmp_path)), 9.0).withColumn("d", F.round("d", 6))
    rows = sorted(map(tuple, out.collect()))
    assert len(rows) > 10000 and rows == sorted(map(tuple, plain.select(out.columns).collect()))


def test_lists_hold_every_value(spark, monkeypatch):
    """Keys with more values than a list may hold have several lists; null and repeated values stay."""
    monkeypatch.setattr(candidates, "LISTED", 3)
    rows = [("a", i) for i in range(10)] + [("a", None), ("a", 4), ("b", None), ("c", 7)]
    lists = candidates.listed(spark.createDataFrame(rows, "k string, v int"), F.col("k"), "v").collect()
    assert max(len(x["list"]) for x in lists) == 3 and sum(x["key"] == "a" for x in lists) == 4
    assert sorted(((x["key"], v) for x in lists for v in x["list"]), key=str) == sorted(rows, key=str)


def test_windows_along_trips_share_one_exchange(spark, tmp_path):
    """Stop times are dealt and sorted once, and the next stop is found without another exchange."""
    spark.sql("SELECT id % 9 AS l_orderkey, id % 4 AS l_suppkey, id AS l_partkey, cast(id % 5 AS int) AS l_linenumber FROM range(60)").write.parquet(str(tmp_path / "lineitem.parquet"))
    nodes = _plan(V.stop_times(spark, str(tmp_path)).withColumn("next", F.lead("stop_id").over(W.partitionBy("trip_id").orderBy("seq"))))
    assert sum(x.startswith("Exchange") for x in nodes) == 1 and sum(x.startswith("Sort") for x in nodes) == 1


def test_grid_join_is_compiled_and_dealt(spark):
    """The JVM compiles no method of over 8000 bytes, and AQE merges partitions by size: few links unfold into many cells."""
    stops = spark.createDataFrame([(1, 0.0, 0.0)], "stop_id int, x double, y double")
    links = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 1.0)], "link_id int, fx double, fy double, tx double, ty double")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        near = candidates.nearby(candidates.spots(stops), links, 9.0).withColumn("d", F.round("d", 6))
        plan = near._jdf.queryExecution().executedPlan()
        code = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$").codegenString(plan)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", code))) <= 8000
    assert "REPARTITION_BY_NUM" in plan.toString()
