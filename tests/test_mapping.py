"""The mapper and its parts on a small network, and plain versions of graph operators."""

import heapq
import random

import pytest
from pyspark.sql import functions as F

from tramline.operators import candidates, checks, exports, mapping, network, paths

NODES = {"A": (40, 40), "B": (60, 40), "C": (60, 60), "D": (40, 60), "E": (20, 60), "F": (20, 40), "G": (20, 20), "H": (40, 30), "I": (60, 20), "W": (30, 70), "X": (50, 45), "Z": (50, 10)}
TWO_WAY, ONE_WAY = "AB BC CD DE EF FG GI IB AD AX XC XB".split(), "EW WD AH HZ ZI".split()


@pytest.fixture(scope="module")
def links(spark):
    pairs = [*TWO_WAY, *[p[::-1] for p in TWO_WAY], *ONE_WAY]
    rows = [(p, p[0], p[1], *map(float, (*NODES[p[0]], *NODES[p[1]])), 1.0, ["car", "bus"]) for p in pairs]
    df = spark.createDataFrame(rows, "link_id string, from_node string, to_node string, fx double, fy double, tx double, ty double, freespeed double, modes array<string>")
    return df.withColumn("length", F.sqrt((F.col("tx") - F.col("fx")) ** 2 + (F.col("ty") - F.col("fy")) ** 2)).cache()


def test_opposites_and_components(links):
    assert {r["link_id"]: r["opposite"] for r in network.opposites(links).collect()} == {p: p[::-1] for p in [*TWO_WAY, *[p[::-1] for p in TWO_WAY]]}
    comp = {r["component"] for r in network.strong_components(links).collect()}
    assert len(comp) == 1
    cut = links.where("NOT link_id IN ('ZI', 'WD')")
    assert {r["node_id"] for r in network.strong_components(cut).groupBy("component").agg(F.min("node_id").alias("node_id"), F.count("*").alias("n")).where("n = 1").collect()} == {"H", "W", "Z"}
    assert network.largest_component(cut).where("link_id IN ('AH', 'HZ', 'EW')").count() == 0


def test_components_against_a_plain_version(spark):
    r = random.Random(4)
    edges = [(r.randint(0, 40), r.randint(0, 40)) for _ in range(60)]
    reach = {a: {a} for e in edges for a in e}
    for _ in range(50):
        for a, b in edges:
            reach[a] |= reach[b]
    want = {a: min(b for b in reach[a] if a in reach[b]) for a in reach}
    df = spark.createDataFrame([(f"{i}", a, b) for i, (a, b) in enumerate(edges)], "link_id string, from_node long, to_node long")
    found = {}
    for row in network.strong_components(df).collect():
        found.setdefault(row["component"], set()).add(row["node_id"])
    groups = {}
    for a, c in want.items():
        groups.setdefault(c, set()).add(a)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, groups.values()))


def test_paths_both_ways(spark, links, monkeypatch):
    cost = links.select("link_id", "from_node", "to_node", F.col("length").alias("cost"))
    rows = cost.collect()
    pairs = spark.createDataFrame([(a["link_id"], b["link_id"]) for a in rows for b in rows], "a string, b string")

    def plain(start):
        best, heap = {start: 0.0}, [(0.0, start)]
        while heap:
            d, n = heapq.heappop(heap)
            for x in rows:
                if x["from_node"] == n and d + x["cost"] < best.get(x["to_node"], 1e9) - 1e-12:
                    best[x["to_node"]] = d + x["cost"]
                    heapq.heappush(heap, (d + x["cost"], x["to_node"]))
        return best

    near = {n: plain(n) for n in NODES}
    ends = {r["link_id"]: (r["from_node"], r["to_node"], r["cost"]) for r in rows}
    for limit in (paths.BROADCAST_LINKS, 1):
        monkeypatch.setattr(paths, "BROADCAST_LINKS", limit)
        for most in (1e9, 40.0):
            out = {(r["a"], r["b"]): (r["cost"], r["path"]) for r in paths.paths(pairs, cost, most).collect()}
            want = {(a, b): near[ends[a][1]][ends[b][0]] for a in ends for b in ends if near[ends[a][1]].get(ends[b][0], 1e9) <= most}
            assert {k: round(c, 6) for k, (c, _) in out.items()} == {k: round(c, 6) for k, c in want.items()}
            for (a, b), (c, p) in out.items():
                chain = [a, *p, b]
                assert all(ends[x][1] == ends[y][0] for x, y in zip(chain, chain[1:], strict=False)) and sum(ends[x][2] for x in p) == pytest.approx(c)


def test_mapper(spark, links):
    stops = spark.createDataFrame([(k, float(x), float(y)) for k, x, y in [("s1", 30, 61), ("s2", 41, 50), ("s3", 49, 44), ("s4", 61, 30), ("far", 500, 500)]], "stop_id string, x double, y double")
    routes = spark.createDataFrame([("A", "r1", i, s) for i, s in enumerate(("s1", "s2", "s3", "s4"))] + [("B", "r2", i, s) for i, s in enumerate(("s1", "far"))], "line_id string, route_id string, idx int, stop_id string")
    out = mapping.map_routes(stops, routes, links, mapping.Options(max_distance=15.0))
    seq = {r["route_id"]: r["link_ids"] for r in out["sequences"].collect()}
    ends = {r["link_id"]: (r["from_node"], r["to_node"]) for r in links.collect()}
    chain = seq["r1"]
    assert not any(x.startswith("pt_") for x in chain) and all(ends[x][1] == ends[y][0] for x, y in zip(chain, chain[1:], strict=False))
    assert [r["link_id"] for r in out["loops"].collect()] == ["pt_far"] and any(x.startswith("pt_") for x in seq["r2"])
    assert out["artificial"].count() == 1
    total = mapping.summary(out["sequences"]).first()
    assert (total["n_routes"], total["n_clean"]) == (2, 1)
    named, facilities = mapping.child_stops(out["chosen"], routes, stops)
    assert named.count() == 6 and facilities.where("stop_id LIKE 's2.link:%'").count() == 1
    assert mapping.sibling_transfers(facilities.union(facilities.where("parent = 's1'").withColumn("stop_id", F.lit("s1.link:zz")))).count() >= 2
    with pytest.raises(ValueError, match="below 1"):
        mapping.Options(max_cost_factor=0.5)


def test_layered_search(spark):
    r = random.Random(2)
    edges = [("l", "r", k, f"{k}{a}", f"{k + 1}{b}", float(r.randint(-3, 9))) for k in range(4) for a in "xyz" for b in "xyz"]
    df = spark.createDataFrame(edges, "line_id string, route_id string, layer int, a string, b string, weight double")
    weight = {(a, b): w for *_, a, b, w in edges}
    import itertools

    best = min(sum(weight[f"{k}{p[k]}", f"{k + 1}{p[k + 1]}"] for k in range(4)) for p in itertools.product("xyz", repeat=5))
    out = paths.layered(df).orderBy("layer").collect()
    assert out[0]["total"] == best and len(out) == 5
    assert sum(weight[a["candidate"], b["candidate"]] for a, b in zip(out, out[1:], strict=False)) == best


def test_candidates(spark, links):
    stops = spark.createDataFrame([("s", 50.0, 42.0)], "stop_id string, x double, y double")
    near = candidates.nearby(stops, links, 30.0)
    top = {r["link_id"] for r in candidates.soft_top(near, 2, 1.0).collect()}
    assert top == {"AB", "BA"}
    assert candidates.nearest(stops, links, 0.5).first()["link_id"] == "BA"
    shared = spark.createDataFrame([("l", "r", 0, "a", "x", 1.0), ("l", "r", 1, "b", "x", 2.0), ("l", "r", 2, "c", "x", 2.0), ("l", "r", 0, "a", "y", 3.0), ("l", "r", 1, "b", "y", 3.0)], "line_id string, route_id string, idx int, stop_id string, link_id string, d double")
    kept = {(r["idx"], r["link_id"]) for r in candidates.separated(shared).collect()}
    assert kept == {(0, "x"), (2, "x"), (1, "y")}


def test_chains(spark, links):
    cand = spark.createDataFrame([("s", x, d) for x, d in (("EW", 3.0), ("WD", 1.0), ("AH", 5.0), ("HZ", 2.0), ("ZI", 4.0), ("AB", 9.0))], "stop_id string, link_id string, d double")
    assert {r["link_id"] for r in network.chains(links, cand).collect()} == {"WD", "HZ", "AB"}


def test_network_edits(spark, links):
    used = spark.createDataFrame([("AB", "bus"), ("BC", "bus")], "link_id string, mode string")
    out = {r["link_id"]: r["modes"] for r in network.without_unused(links, used, ["car"]).collect()}
    assert out["AB"] == ["car", "bus"] and out["FG"] == ["car"]
    none = {r["link_id"] for r in network.without_unused(links, used, []).collect()}
    assert none == {"AB", "BA", "BC", "CB"}
    a = links.where("link_id = 'AB'")
    with pytest.raises(Exception, match="links differ"):
        network.merged(a, a.withColumn("length", F.lit(3.0))).collect()
    speeds = network.required_speeds(spark.createDataFrame([("AB", "bus", 100.0, 10.0)], "link_id string, mode string, length double, seconds double"), links, ["bus"])
    assert speeds.where("link_id = 'AB'").first()["freespeed"] == 11.0


def test_checks_and_exports(spark, links):
    route = spark.createDataFrame([("l", "r", "bus", i, x) for i, x in enumerate(("AB", "BA", "AX", "XB"))], "line_id string, route_id string, mode string, idx int, link_id string").join(links, "link_id")
    assert {(r["first"], r["second"]) for r in checks.direction_changes(route).collect()} == {("AB", "BA"), ("BA", "AX")}
    stops = spark.createDataFrame([("l", "r", 0, "AB", 0.0), ("l", "r", 1, "XB", 5.0)], "line_id string, route_id string, idx int, link_id string, departure_offset double")
    slow = checks.travel_times(stops, route.withColumn("seconds", F.lit(50.0)), 65.0).first()
    assert (slow["expected"], slow["actual"]) == (5.0, 150.0)
    features = [r["feature"] for r in exports.schedule_features(route, spark.createDataFrame([("l", "r", "08:00:00")], "line_id string, route_id string, clock string"), spark.createDataFrame([("s", 1.0, 2.0, "n")], "stop_id string, x double, y double, name string")).collect()]
    assert any('"coordinates":[[40.0,40.0],[60.0,40.0],[40.0,40.0],[50.0,45.0],[60.0,40.0]]' in f for f in features) and any('"Point"' in f for f in features)
    xml = exports.network_xml(links.withColumn("capacity", F.lit(1.0)).withColumn("lanes", F.lit(1.0)), spark.createDataFrame([("A<", 1.0, 2.0)], "node_id string, x double, y double"))
    assert '<node id="A&lt;" x="1.0" y="2.0"/>' in {r["xml"] for r in xml.collect()}


def test_network_round_trip(spark, links, tmp_path):
    from tramline.sources import networks

    nodes = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in NODES.items()], "node_id string, x double, y double")
    exports.write_xml(exports.network_xml(links.withColumn("capacity", F.lit(1.0)).withColumn("lanes", F.lit(1.0)), nodes).coalesce(1), str(tmp_path / "n"))
    assert networks.links(spark, str(tmp_path / "n/links")).count() == links.count() and networks.nodes(spark, str(tmp_path / "n/nodes")).count() == len(NODES)
    assert networks.links(spark, str(tmp_path / "n/links")).where("link_id = 'AB'").first()["modes"] == ["car", "bus"]


def test_equal_paths_above_and_below_the_bound(spark, monkeypatch):
    r = random.Random(7)
    rows = [(f"{r.randint(0, 999)}-{i}", f"n{r.randint(0, 25)}", f"n{r.randint(0, 25)}", float(r.randint(0, 3))) for i in range(120)]
    links = spark.createDataFrame(rows, "link_id string, from_node string, to_node string, cost double")
    pairs = spark.createDataFrame([(a[0], b[0], float(r.randint(0, 6))) for a in rows[:25] for b in rows], "a string, b string, most double")
    found = []
    for limit in (paths.BROADCAST_LINKS, 1):
        monkeypatch.setattr(paths, "BROADCAST_LINKS", limit)
        found.append(sorted((x["a"], x["b"], x["cost"], x["path"]) for x in paths.paths(pairs, links).collect()))
    assert found[0] == found[1] and len(found[0]) > 500
    bound = {(x["a"], x["b"]): x["most"] for x in pairs.collect()}
    assert all(c <= bound[a, b] for a, b, c, _ in found[0])


def test_chains_longer_than_a_few_rounds_and_rings(spark):
    r = random.Random(8)
    line = r.sample(range(1000, 2000), 150)
    rows = [(f"{x}", f"a{i}", f"a{i + 1}") for i, x in enumerate(line)] + [(f"{x}", f"r{i}", f"r{(i + 1) % 21}") for i, x in enumerate(r.sample(range(2000, 3000), 21))]
    links = spark.createDataFrame(rows, "link_id string, from_node string, to_node string")
    d = {x[0]: float(r.randint(1, 10**6)) for x in rows}
    cand = spark.createDataFrame([("s", k, v) for k, v in d.items()], "stop_id string, link_id string, d double")
    want = {min((x[0] for x in part), key=d.get) for part in (rows[:150], rows[150:])}
    assert {x["link_id"] for x in network.chains(links, cand).collect()} == want


def test_nearest_at_any_distance(spark, links):
    stops = spark.createDataFrame([("near", 50.0, 42.0), ("far", 4e9, 42.0), ("none", None, 1.0)], "stop_id string, x double, y double")
    assert {x["stop_id"] for x in candidates.nearest(stops, links).collect()} == {"near", "far"}
    assert candidates.nearest(stops, links.limit(0)).count() == 0


def test_nearby_against_all_pairs(spark):
    r = random.Random(9)
    rows = [(f"l{i}", *(float(r.randint(-200, 200)) for _ in range(4))) for i in range(60)] + [("up", 7.0, -90.0, 7.0, 90.0), ("flat", -90.0, 14.0, 90.0, 14.0), ("dot", 7.0, 7.0, 7.0, 7.0)]
    stops = [(i, float(r.randint(-200, 200)), float(r.randint(-200, 200))) for i in range(300)]

    def distance(s, x):
        dx, dy = x[3] - x[1], x[4] - x[2]
        n = dx * dx + dy * dy
        t = min(1.0, max(0.0, ((s[1] - x[1]) * dx + (s[2] - x[2]) * dy) / n)) if n else 0.0
        return ((s[1] - x[1] - t * dx) ** 2 + (s[2] - x[2] - t * dy) ** 2) ** 0.5

    for radius in (1.0, 7.0, 90.0):
        near = candidates.nearby(spark.createDataFrame(stops, "stop_id long, x double, y double"), spark.createDataFrame(rows, "link_id string, fx double, fy double, tx double, ty double"), radius)
        found = sorted((x["stop_id"], x["link_id"]) for x in near.collect())
        assert found == sorted((s[0], x[0]) for s in stops for x in rows if distance(s, x) <= radius)


def test_mapper_by_time(spark, links):
    stops = spark.createDataFrame([("s1", 30.0, 61.0), ("s2", 61.0, 30.0)], "stop_id string, x double, y double")
    fast = links.withColumn("freespeed", F.lit(10.0))
    for seconds, real in ((8, True), (1, False)):
        routes = spark.createDataFrame([("A", "r", 0, "s1", 0, 0), ("A", "r", 1, "s2", seconds, seconds)], "line_id string, route_id string, idx int, stop_id string, arrival int, departure int")
        out = mapping.map_routes(stops, routes, fast, mapping.Options(by_time=True, max_distance=15.0)).get("sequences").first()["link_ids"]
        assert any(x.startswith("pt_") for x in out) != real
