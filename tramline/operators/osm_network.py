"""From OSM elements to a routable multimodal network and to transit lines."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import crs
from ..functions import geometry as G
from ..functions import text as T
from ..sources.osm import Extract
from . import network


@dataclass(frozen=True)
class WayDefault:
    """Lanes, free speed (m/s), speed factor, capacity of a lane, one-way and modes of ways with a tag."""

    key: str
    value: str
    lanes: float
    freespeed: float
    factor: float
    capacity: float
    oneway: bool
    modes: tuple[str, ...]


# Fixed values, which results depend on: defaults by kind of way, speeds in km/h divided by 3.6.
DEFAULTS = (
    WayDefault("highway", "motorway", 2, 120 / 3.6, 1.0, 2000, True, ("car",)),
    WayDefault("highway", "motorway_link", 1, 80 / 3.6, 1.0, 1500, True, ("car",)),
    WayDefault("highway", "trunk", 2, 80 / 3.6, 1.0, 2000, False, ("car",)),
    WayDefault("highway", "trunk_link", 1, 50 / 3.6, 1.0, 1500, False, ("car",)),
    WayDefault("highway", "primary", 1, 80 / 3.6, 1.0, 1500, False, ("car",)),
    WayDefault("highway", "primary_link", 1, 60 / 3.6, 1.0, 1500, False, ("car",)),
    WayDefault("highway", "secondary", 1, 30 / 3.6, 1.0, 1000, False, ("car",)),
    WayDefault("highway", "secondary_link", 1, 30 / 3.6, 1.0, 1000, False, ("car",)),
    WayDefault("highway", "tertiary", 1, 25 / 3.6, 1.0, 600, False, ("car",)),
    WayDefault("highway", "tertiary_link", 1, 25 / 3.6, 1.0, 600, False, ("car",)),
    WayDefault("highway", "unclassified", 1, 25 / 3.6, 1.0, 600, False, ("car",)),
    WayDefault("highway", "residential", 1, 15 / 3.6, 1.0, 600, False, ("car",)),
    WayDefault("highway", "living_street", 1, 10 / 3.6, 1.0, 300, False, ("car",)),
    WayDefault("railway", "rail", 1, 160 / 3.6, 1.0, 9999, False, ("rail",)),
    WayDefault("railway", "tram", 1, 40 / 3.6, 1.0, 9999, True, ("rail",)),
    WayDefault("railway", "light_rail", 1, 80 / 3.6, 1.0, 9999, False, ("rail",)),
)
# Relations that are transit, by their tags.
TRANSIT_ROUTES = ("bus", "trolleybus", "rail", "train", "tram", "light_rail", "funicular", "monorail", "subway")
TRANSIT_MASTERS = ("bus", "trolleybus", "tram", "monorail", "subway", "ferry")
# Lanes, free speed, speed factor and capacity of a lane of other ways that transit uses; their mode.
TRANSIT_WAY = (1.0, 50 / 3.6, 1.0, 9999.0)
TRANSIT_MODE = "pt"


@dataclass(frozen=True)
class Options:
    max_link_length: float = 500.0
    keep_paths: bool = False
    scale_max_speed: bool = False
    keep_tags: bool = True
    keep_transit_ways: bool = True
    defaults: tuple[WayDefault, ...] = DEFAULTS
    subnetworks: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"car": ("car",), "bus": ("car", "bus")})
    projection: str = "WGS84"


def way_parameters(x: Extract, options: Options) -> DataFrame:
    """Ways with their defaults: highway first, then railway; of others those that transit uses, if these are kept."""
    spark = x.ways.sparkSession
    d = spark.createDataFrame([(w.key, w.value, float(w.lanes), float(w.freespeed), float(w.factor), float(w.capacity), w.oneway, list(w.modes)) for w in options.defaults],
                              "key string, value string, d_lanes double, d_speed double, factor double, d_capacity double, d_oneway boolean, modes array<string>")
    d = F.broadcast(d)
    at = lambda key, p: d.where(F.col("key") == key).select(F.col("value").alias(f"_{p}"), F.struct("d_lanes", "d_speed", "factor", "d_capacity", "d_oneway", "modes").alias(p))
    ways = x.ways.withColumn("_v1", F.col("tags")["highway"]).withColumn("_v2", F.col("tags")["railway"])
    ways = ways.join(at("highway", "h"), F.col("_v1") == F.col("_h"), "left").join(at("railway", "r"), F.col("_v1").isNull() & (F.col("_v2") == F.col("_r")), "left")
    master = F.coalesce(F.col("tags")["route_master"].isin(*TRANSIT_MASTERS), F.lit(False))
    route = F.coalesce(F.col("tags")["route"].isin(*TRANSIT_ROUTES), F.lit(False))
    transit = x.relations.where(master | route).select(F.explode("members").alias("m"), F.col("tags")["route"].alias("mode"))
    used = transit.where("m.type = 'way'").groupBy(F.col("m.ref").alias("way_id")).agg(F.array_sort(F.collect_set(T.network_mode("mode"))).alias("transit_modes"))
    ways = ways.join(used, "way_id", "left").withColumn("is_transit", F.col("transit_modes").isNotNull() | _designated())
    # Where a relation with a mode uses the way, it has this mode and that of all transit.
    modes = F.when(F.size("transit_modes") > 0, F.array_union("transit_modes", F.array(F.lit(TRANSIT_MODE)))).otherwise(F.array().cast("array<string>"))
    ways = ways.withColumn("transit_modes", modes)
    is_transit = F.col("is_transit")
    lanes, speed, factor, capacity = TRANSIT_WAY
    fallback = F.struct(F.lit(lanes).alias("d_lanes"), F.lit(speed).alias("d_speed"), F.lit(factor).alias("factor"), F.lit(capacity).alias("d_capacity"), F.lit(False).alias("d_oneway"), F.array(F.lit(TRANSIT_MODE)).alias("modes"))
    known = F.coalesce("h", "r", F.when(is_transit & F.lit(options.keep_transit_ways), fallback))
    out = ways.withColumn("p", known).where("p IS NOT NULL").select("way_id", "nodes", "tags", "transit_modes", "p.*")
    return out.withColumn("modes", F.array_sort(F.array_union("modes", "transit_modes")))


def _designated() -> F.Column:
    """Whether a way is set aside for public service vehicles, or open to them by its tags."""
    return F.coalesce(F.col("tags")["psv"].isin("yes", "designated"), F.lit(False)) | F.coalesce(F.col("tags")["bus"] == "designated", F.lit(False))


def thinned(ways: DataFrame, nodes: DataFrame, options: Options) -> DataFrame:
    """(way_id, kept): node places where a way is cut — ends, nodes that several ways or one way twice share, and one before the
    length since the last would pass the limit. Rings without a shared node keep about the root of their nodes, evenly.
    """
    each = ways.select("way_id", F.posexplode("nodes").alias("i", "node_id"))
    shared = each.groupBy("node_id").agg((F.count("*") > 1).alias("shared"))
    placed = each.join(shared, "node_id").join(nodes.select("node_id", "x", "y"), "node_id")
    rows = placed.groupBy("way_id").agg(F.array_sort(F.collect_list(F.struct("i", "node_id", "shared", "x", "y"))).alias("s"))
    n = F.size("s")
    zero = F.struct(F.array(F.lit(0)).alias("kept"), F.lit(0.0).alias("run"), F.col("s")[0].alias("last"))

    def fold(acc, p):
        step = G.distance(acc["last"]["x"], acc["last"]["y"], p["x"], p["y"])
        far = acc["run"] + step > options.max_link_length
        here = p["shared"] | (p["i"] == n - 1) | F.lit(options.keep_paths)
        before = F.when(far & (F.element_at(acc["kept"], -1) != acc["last"]["i"]), F.array(acc["last"]["i"])).otherwise(F.array().cast("array<int>"))
        kept = F.concat(acc["kept"], before, F.when(here, F.array(p["i"])).otherwise(F.array().cast("array<int>")))
        return F.struct(kept.alias("kept"), F.when(here, F.lit(0.0)).when(far, step).otherwise(acc["run"] + step).alias("run"), p.alias("last"))

    kept = F.array_distinct(F.aggregate(F.slice("s", 2, n), zero, fold, lambda a: a["kept"]))
    ring = (F.col("s")[0]["node_id"] == F.element_at("s", -1)["node_id"]) & (F.size(kept) == 2) & (n > 3)
    stride = F.greatest(F.lit(1), F.floor(F.sqrt(n.cast("double"))).cast("int"))
    even = F.array_distinct(F.concat(F.sequence(F.lit(0), n - 1, stride), F.array(n - 1)))
    return rows.select("way_id", "s", F.when(ring, even).otherwise(kept).alias("kept"))


def links_of(x: Extract, options: Options = Options()) -> tuple[DataFrame, DataFrame]:
    """Links and nodes of an extract: ways cut at kept nodes, one link for each direction, and one for reserved lanes."""
    project = crs.projection(options.projection)
    nodes = x.nodes.withColumn("_p", project(F.col("lon"), F.col("lat"))).select("node_id", F.col("_p.x").alias("x"), F.col("_p.y").alias("y"))
    ways = way_parameters(x, options)
    cut = thinned(ways, nodes, options)
    part = cut.select("way_id", "s", F.posexplode(F.slice("kept", 1, F.size("kept") - 1)).alias("k", "a"), "kept").withColumn("b", F.col("kept")[F.col("k") + 1])
    line = F.slice("s", F.col("a") + 1, F.col("b") - F.col("a") + 1)
    part = part.withColumn("line", line).select("way_id", "k", F.col("line")[0].alias("f"), F.element_at("line", -1).alias("t"), F.greatest(F.lit(1.0), G.line_length(F.col("line"))).alias("length"), F.transform("line", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("geometry"))
    w = ways.withColumn("dir", T.direction("tags", "d_oneway"))
    both = part.join(w, "way_id")
    oneway = F.col("dir") != 0

    def one_way(forward: bool) -> DataFrame:
        keep = both.where(F.col("dir") >= 0 if forward else F.col("dir") <= 0)
        a, b = ("f", "t") if forward else ("t", "f")
        speed = T.directed_speed("tags", forward, "d_speed")
        if options.scale_max_speed:
            speed = speed * F.col("factor")
        reserved = T.reserved_lanes("tags", forward, oneway)
        n = T.lanes("tags", forward, oneway, "d_lanes")
        geometry = F.col("geometry") if forward else F.reverse("geometry")
        base = keep.select(
            "way_id", "k", F.lit(forward).alias("forward"), F.col(f"{a}.node_id").cast("string").alias("from_node"), F.col(f"{b}.node_id").cast("string").alias("to_node"), "length", speed.alias("freespeed"),
            n.alias("lanes"), (F.col("d_capacity") * n).alias("capacity"), "modes", "tags", geometry.alias("geometry"), reserved.alias("reserved"))
        return base

    every = one_way(True).unionByName(one_way(False))
    name = F.concat_ws("_", F.col("way_id").cast("string"), F.col("k").cast("string"), F.when(F.col("forward"), "f").otherwise("r"))
    every = every.withColumn("link_id", name)
    special = every.where("reserved > 0").withColumn("link_id", F.concat("link_id", F.lit("_spec"))).withColumn("capacity", F.col("capacity") / F.col("lanes") * F.col("reserved")).withColumn("lanes", F.col("reserved")).withColumn("modes", F.array(F.lit("bus")))
    out = every.unionByName(special)
    attrs = T.tag_attributes("tags") if options.keep_tags else F.create_map().cast("map<string,string>")
    out = out.select("link_id", "from_node", "to_node", "length", "freespeed", "capacity", "lanes", "modes", attrs.alias("attrs"), "geometry", "way_id", "forward")
    used = out.select(F.col("from_node").alias("node_id")).union(out.select("to_node")).distinct()
    return out, nodes.withColumn("node_id", F.col("node_id").cast("string")).join(used, "node_id", "left_semi")


def restrictions(x: Extract, links: DataFrame) -> DataFrame:
    """(link_id, mode, next_links): sequences a vehicle may not follow after a link, from restriction relations with a via node.

    A prohibition bars the link onto the ``to`` way; an obligation bars every other link out of the via node.
    """
    kind = F.coalesce(F.col("tags")["restriction"], F.col("tags")["restriction:bus"], F.col("tags")["restriction:hgv"])
    mode = F.when(F.col("tags")["restriction"].isNotNull(), F.lit("car")).when(F.col("tags")["restriction:bus"].isNotNull(), F.lit("bus")).otherwise(F.lit("car"))
    role = lambda r, t: F.filter("members", lambda m: (m["role"] == r) & (m["type"] == t))
    r = x.relations.where(kind.isNotNull()).select("relation_id", kind.alias("kind"), mode.alias("mode"), role("from", "way").alias("f"), role("to", "way").alias("t"), role("via", "node").alias("v"), F.split(F.coalesce(F.col("tags")["except"], F.lit("")), ";").alias("free"))
    r = r.where("size(f) = 1 AND size(t) = 1 AND size(v) = 1").select("relation_id", "kind", "mode", F.col("f")[0]["ref"].alias("fw"), F.col("t")[0]["ref"].alias("tw"), F.col("v")[0]["ref"].cast("string").alias("via"), "free")
    r = r.where(~F.array_contains("free", F.col("mode")))
    into = links.select(F.col("link_id"), F.col("way_id").alias("fw"), F.col("to_node").alias("via"), F.col("from_node").alias("_back"))
    out = links.select(F.col("link_id").alias("next"), F.col("way_id").alias("nw"), F.col("from_node").alias("via"), F.col("to_node").alias("_to"))
    turn = r.join(into, ["fw", "via"]).join(out, "via")
    no = turn.where(F.startswith(F.col("kind"), F.lit("no_")) & (F.col("nw") == F.col("tw")) & (F.contains(F.col("kind"), F.lit("u_turn")) | (F.col("_to") != F.col("_back")) | (F.col("fw") != F.col("tw"))))
    only = turn.where(F.startswith(F.col("kind"), F.lit("only_")) & (F.col("nw") != F.col("tw")))
    return no.union(only).groupBy("link_id", "mode").agg(F.array_sort(F.collect_set(F.array("next"))).alias("next_links"))


def routable(links: DataFrame, subnetworks: dict[str, tuple[str, ...]]) -> DataFrame:
    """Each subnetwork mode stays on the links of its largest strongly connected component; other modes stay as they are."""
    keep = []
    for mode, over in subnetworks.items():
        part = network.largest_component(network.with_modes(links, list(over)))
        keep.append(part.select("link_id", F.lit(mode).alias("mode")))
    cleaned = F.array(*[F.lit(m) for m in subnetworks])
    rest = links.select("link_id", F.explode(F.array_except("modes", cleaned)).alias("mode"))
    for k in keep:
        rest = rest.unionByName(k)
    modes = rest.groupBy("link_id").agg(F.array_sort(F.collect_set("mode")).alias("modes"))
    return links.drop("modes").join(modes, "link_id")


def transit_lines(x: Extract) -> DataFrame:
    """(line_id, route_id, mode, stop_ids): stops of route relations in order; the last member is left out."""
    r = x.relations.where(F.col("tags")["route"].isin(*TRANSIT_ROUTES))
    stops = F.transform(F.filter(F.slice("members", 1, F.greatest(F.size("members") - 1, F.lit(0))), lambda m: m["role"].isin("stop", "stop_forward")), lambda m: m["ref"])
    return r.select(T.osm_line_id("tags", "relation_id").alias("line_id"), F.col("relation_id").cast("string").alias("route_id"), T.network_mode(F.col("tags")["route"]).alias("mode"), stops.alias("stop_ids")).where("size(stop_ids) > 1")


def stop_facilities(x: Extract) -> DataFrame:
    """Stops: those of stop areas first, with the area's name, then other stop positions and bus stops."""
    stop = F.coalesce((F.col("tags")["public_transport"] == "stop_position") | (F.col("tags")["highway"] == "bus_stop"), F.lit(False))
    nodes = x.nodes.where(stop)
    areas = x.relations.where(F.col("tags")["public_transport"] == "stop_area").select(F.explode("members").alias("m"), F.col("tags")["name"].alias("area"))
    area = areas.where("m.type = 'node'").groupBy(F.col("m.ref").alias("node_id")).agg(F.min("area").alias("area"))
    out = nodes.join(area, "node_id", "left")
    return out.select(F.col("node_id").alias("stop_id"), F.coalesce("area", F.col("tags")["name"]).alias("name"), "lon", "lat", F.col("area").isNotNull().alias("in_area"))


def geometry_table(links: DataFrame, kept: DataFrame) -> DataFrame:
    """(LinkId, Geometry) as WKT with five decimals, of the links that are left."""
    wkt = F.concat(F.lit("LINESTRING("), F.array_join(F.transform("geometry", lambda p: F.format_string("%.5f %.5f", p["x"], p["y"])), ", "), F.lit(")"))
    return links.join(kept.select("link_id"), "link_id", "left_semi").select(F.col("link_id").alias("LinkId"), wkt.alias("Geometry"))


def build(spark: SparkSession, x: Extract, options: Options = Options()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links, nodes and turn restrictions of a routable network."""
    links, _nodes = links_of(x, options)
    links = routable(links, options.subnetworks)
    return links, network.nodes_of(links, _nodes), restrictions(x, links)
