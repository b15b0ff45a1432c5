"""Shapes, loops, isolated stops, pulling, sampling, and the command line."""

import json

from pyspark.sql import functions as F

from tests.test_gtfs import write
from tramline import cli
from tramline.functions import crs
from tramline.operators import mapping, network, timetable

LINKS = "link_id string, from_node string, to_node string, fx double, fy double, tx double, ty double, length double, freespeed double, modes array<string>"


def _links(spark):
    rows = [("ab", "a", "b", 0, 0, 100, 0), ("bc", "b", "c", 100, 0, 200, 0), ("cd", "c", "d", 200, 0, 200, 500)]
    return spark.createDataFrame([(*r[:3], *map(float, r[3:]), 100.0, 10.0, ["car"]) for r in rows], LINKS)


def test_around_a_shape(spark):
    nodes = spark.createDataFrame([("a", 0.0, 0.0), ("b", 100.0, 0.0), ("c", 200.0, 0.0), ("d", 200.0, 500.0)], "node_id string, x double, y double")
    shapes = spark.createDataFrame([("s", [(0.0, 10.0), (150.0, 10.0)])], "shape_id string, points array<struct<x:double,y:double>>")
    assert {r["node_id"] for r in network.near_line(nodes, shapes, 20.0).collect()} == {"a", "b"}
    assert {r["link_id"] for r in network.shape_networks(_links(spark), nodes, shapes, 20.0).collect()} == {"ab"}


def test_links_for_stops_and_modes(spark):
    links = _links(spark)
    rl = spark.createDataFrame([("l", "r", 0, "bc"), ("l", "r", 1, "cd")], "line_id string, route_id string, idx int, link_id string")
    loop = network.start_loops(rl, links).first()
    assert (loop["link_id"], loop["length"]) == ("loop_b", 0.0)
    alone = spark.createDataFrame([("x", 90.0, 30.0)], "stop_id string, x double, y double")
    assert {(r["from_node"], r["to_node"]) for r in network.connected(alone, links).collect()} == {("x", "a"), ("a", "x")}
    assert network.replaced_modes(links, "car", ["car", "pt"]).first()["modes"] == ["car", "pt"]
    assert network.with_freespeed(links, "car", 3.0).first()["freespeed"] == 3.0
    assert network.artificial_lengths(links.withColumn("modes", F.array(F.lit("artificial")))).where("link_id = 'cd'").first()["length"] == 500.0


def test_pulling(spark):
    rl = spark.createDataFrame([("l", "r", i, x) for i, x in enumerate(("ab", "bc", "cd"))], "line_id string, route_id string, idx int, link_id string")
    stops = spark.createDataFrame([("l", "r", 0, "s.link:ab", 0, 199.0, 300.0), ("l", "r", 1, "t.link:cd", 2, 200.0, 400.0)], "line_id string, route_id string, idx int, stop_id string, link_idx int, x double, y double")
    out = {r["idx"]: (r["stop_id"], r["link_idx"]) for r in mapping.pull_all(rl, stops, _links(spark)).collect()}
    assert out == {0: ("s.link:cd", 2), 1: ("t.link:cd", 2)}


def test_some_routes(spark):
    rs = spark.createDataFrame([("l", f"r{i}", "bus" if i % 2 else "rail") for i in range(200)], "line_id string, route_id string, mode string")
    assert 20 < timetable.sampled_routes(rs, 50).count() < 90 and timetable.one_route(rs, "l", "r3").count() == 1 and timetable.without_mode(rs, ["bus"]).count() == 100


def test_projections(spark):
    row = spark.range(1).select(crs.projection("EPSG:32632")(F.lit(9.0), F.lit(47.0)).alias("p"), crs.projection("EPSG:2056")(F.lit(7.438632495), F.lit(46.951082877)).alias("q")).first()
    assert abs(row["p"]["x"] - 500000) < 0.01 and abs(row["p"]["y"] - 5205164.1) < 0.5 and abs(row["q"]["x"] - 2600000) < 1 and abs(row["q"]["y"] - 1200000) < 1


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "feed").mkdir()
    cli.main(["gtfs", write(tmp_path / "feed"), "20181005", "EPSG:2056", str(tmp_path / "schedule")], spark)
    assert spark.read.parquet(str(tmp_path / "schedule/departures")).count() == 10
    cli.main(["defaults"], spark)
    assert json.loads(capsys.readouterr().out)["mapping"]["n_links"] == 6
