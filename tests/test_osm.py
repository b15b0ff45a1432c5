"""A small extract: closure, lanes, speeds, links, restrictions, subnetworks."""

import pytest
from pyspark.sql import functions as F

from tramline.functions import text as T
from tramline.operators import osm_network as O
from tramline.sources import osm

XML = """<?xml version="1.0" encoding="UTF-8"?>
<osm version="0.6">
 <node id="1" lat="0" lon="0"/><node id="2" lat="0" lon="100"/><node id="3" lat="0" lon="200"/><node id="4" lat="100" lon="100"/>
 <node id="5" lat="0" lon="300"><tag k="highway" v="bus_stop"/><tag k="name" v="End"/></node><node id="6" lat="0" lon="150"/><node id="7" lat="900" lon="900"/>
 <way id="10"><nd ref="1"/><nd ref="2"/><tag k="highway" v="primary"/><tag k="maxspeed" v="50"/><tag k="lanes" v="4"/><tag k="name" v="A&amp;B"/></way>
 <way id="11"><nd ref="2"/><nd ref="6"/><nd ref="3"/><tag k="highway" v="residential"/><tag k="lanes:bus" v="2"/></way>
 <way id="12"><nd ref="2"/><nd ref="4"/><tag k="highway" v="residential"/><tag k="oneway" v="-1"/></way>
 <way id="13"><nd ref="3"/><nd ref="5"/><tag k="highway" v="path"/></way>
 <way id="14"><nd ref="3"/><nd ref="99"/><tag k="highway" v="primary"/></way>
 <relation id="20"><member type="way" ref="13" role=""/><member type="node" ref="3" role="stop"/><member type="node" ref="5" role="stop"/><member type="node" ref="5" role="stop"/><member type="way" ref="14" role=""/><member type="way" ref="12" role=""/><tag k="type" v="route"/><tag k="route" v="trolleybus"/><tag k="ref" v="7"/></relation>
 <relation id="21"><member type="way" ref="10" role="from"/><member type="node" ref="2" role="via"/><member type="way" ref="11" role="to"/><tag k="type" v="restriction"/><tag k="restriction" v="no_right_turn"/></relation>
</osm>"""


@pytest.fixture
def extract(spark, tmp_path):
    (tmp_path / "a.osm").write_text(XML)
    return osm.load(spark, str(tmp_path / "a.osm"))


def test_closure(extract):
    assert {r["way_id"] for r in extract.ways.collect()} == {10, 11, 12, 13}
    members = extract.relations.where("relation_id = 20").first()["members"]
    assert [(m["ref"], m["role"]) for m in members] == [(13, ""), (3, "stop"), (5, "stop"), (5, "stop"), (12, "")]
    smaller = osm.without(extract, nodes=extract.nodes.where("node_id = 6"))
    assert smaller.ways.where("way_id = 11").first()["nodes"] == [2, 3]


def test_links(extract):
    links, nodes = O.links_of(extract)
    by = {r["link_id"]: r for r in links.collect()}
    assert set(by) == {"10_0_f", "10_0_r", "11_0_f", "11_0_r", "11_0_f_spec", "11_0_r_spec", "12_0_r", "13_0_f", "13_0_r"}
    assert by["10_0_f"]["lanes"] == 2 and by["10_0_f"]["freespeed"] == pytest.approx(50 / 3.6) and by["10_0_f"]["length"] == 100
    assert by["11_0_f"]["length"] == 100 and by["11_0_f_spec"]["lanes"] == 1 and by["11_0_f_spec"]["modes"] == ["bus"]
    assert (by["12_0_r"]["from_node"], by["12_0_r"]["to_node"]) == ("4", "2") and by["13_0_f"]["modes"] == ["bus", "pt"] and by["13_0_f"]["capacity"] == 9999
    assert by["10_0_f"]["attrs"]["osm:way:name"] == "AANDB"
    assert {r["node_id"] for r in nodes.collect()} == {"1", "2", "3", "4", "5"}
    wkt = {r["LinkId"]: r["Geometry"] for r in O.geometry_table(links, links).collect()}
    assert wkt["11_0_f"] == "LINESTRING(100.00000 0.00000, 150.00000 0.00000, 200.00000 0.00000)"


def test_thinning(extract):
    links, _ = O.links_of(extract, O.Options(max_link_length=60))
    assert {r["length"] for r in links.where("way_id = 11").collect()} == {50.0}


def test_restrictions_and_subnetworks(extract):
    links, _ = O.links_of(extract)
    assert {(r["link_id"], r["mode"], tuple(map(tuple, r["next_links"]))) for r in O.restrictions(extract, links).collect()} == {("10_0_f", "car", (("11_0_f",), ("11_0_f_spec",)))}
    kept = {r["link_id"]: set(r["modes"]) for r in O.routable(links, {"car": ("car",), "bus": ("car", "bus")}).collect()}
    assert kept["12_0_r"] == {"pt"} and kept["10_0_f"] == {"bus", "car"} and kept["13_0_f"] == {"bus", "pt"}


def test_lines_and_stops(extract):
    line = O.transit_lines(extract).first()
    assert (line["line_id"], line["mode"], line["stop_ids"]) == ("7", "bus", [3, 5, 5])
    assert O.stop_facilities(extract).first()["name"] == "End"


def test_tag_functions(spark):
    speed = lambda v: spark.range(1).select(T.max_speed(F.lit(v), F.lit(9.0)).alias("s")).first()["s"]
    assert speed("50 mph") == pytest.approx(50 / 2.237) and speed("36;50") == 10 and speed("none") == pytest.approx(200 / 3.6) and speed("fast") == 9
    row = spark.range(1).select(F.create_map(F.lit("bus:lanes"), F.lit("designated|yes|designated"), F.lit("junction"), F.lit("roundabout")).alias("t"))
    assert row.select(T.reserved_lanes("t", True, F.lit(True)).alias("n"), T.direction("t", F.lit(False)).alias("d")).first() == (2.0, 1)
    match = lambda pos, exc=None: row.select(T.tag_matches("t", pos, exc).alias("m")).first()["m"]
    assert match({}) and match({"junction": None}) and match({"junction": ["roundabout"]}) and not match({"highway": None}) and not match({"junction": None}, {"bus:lanes": None}) and not match({}, {"x": None})


@pytest.mark.parametrize(
    ("key", "value", "lanes", "speed", "capacity", "oneway", "mode"),
    [
        ("highway", "motorway", 2, 120, 2000, True, "car"),
        ("highway", "motorway_link", 1, 80, 1500, True, "car"),
        ("highway", "trunk", 2, 80, 2000, False, "car"),
        ("highway", "trunk_link", 1, 50, 1500, False, "car"),
        ("highway", "primary", 1, 80, 1500, False, "car"),
        ("highway", "primary_link", 1, 60, 1500, False, "car"),
        ("highway", "secondary", 1, 30, 1000, False, "car"),
        ("highway", "secondary_link", 1, 30, 1000, False, "car"),
        ("highway", "tertiary", 1, 25, 600, False, "car"),
        ("highway", "tertiary_link", 1, 25, 600, False, "car"),
        ("highway", "unclassified", 1, 25, 600, False, "car"),
        ("highway", "residential", 1, 15, 600, False, "car"),
        ("highway", "living_street", 1, 10, 300, False, "car"),
        ("railway", "rail", 1, 160, 9999, False, "rail"),
        ("railway", "tram", 1, 40, 9999, True, "rail"),
        ("railway", "light_rail", 1, 80, 9999, False, "rail"),
    ],
)
def test_way_defaults(key, value, lanes, speed, capacity, oneway, mode):
    (d,) = [d for d in O.DEFAULTS if (d.key, d.value) == (key, value)]
    assert (d.lanes, d.freespeed * 3.6, d.factor, d.capacity, d.oneway, d.modes) == (lanes, pytest.approx(speed), 1.0, capacity, oneway, (mode,))
    assert len(O.DEFAULTS) == 16


def test_osm_modes(spark):
    names = ["bus", "trolleybus", "bicycle", "motorcycle", "motorcar", "hgv", "psv", "train"]
    found = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(T.network_mode("n")).collect()]
    assert found == ["bus", "bus", "bike", "motorcycle", "car", "hgv", "psv", "train"]
