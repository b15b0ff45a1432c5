"""Links and nodes: opposites, filters, merging, modes, components, chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T
from ..storage import stored
from . import candidates


def opposites(links: DataFrame) -> DataFrame:
    """(link_id, opposite): the link back; the least id where there are several."""
    back = links.select(F.col("link_id").alias("opposite"), F.col("from_node").alias("_f"), F.col("to_node").alias("_t"))
    return links.join(back, (F.col("from_node") == F.col("_t")) & (F.col("to_node") == F.col("_f"))).groupBy("link_id").agg(F.min("opposite").alias("opposite"))


def with_modes(links: DataFrame, modes: list[str]) -> DataFrame:
    """Links that allow any of the modes, whatever the case."""
    return links.where(T.any_shared("modes", F.array(*[F.lit(m) for m in modes])))


def with_exactly(links: DataFrame, modes: list[str]) -> DataFrame:
    return links.where(T.same_set("modes", F.array(*[F.lit(m) for m in modes])))


def nodes_of(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes that some link touches."""
    ids = links.select(F.col("from_node").alias("node_id")).union(links.select("to_node"))
    return nodes.join(ids, "node_id", "left_semi")


def cut(links: DataFrame, nodes: DataFrame, keep: Column) -> tuple[DataFrame, DataFrame]:
    """Network of the nodes that a predicate keeps, and of the links between them."""
    n = nodes.where(keep)
    ids = n.select("node_id")
    return links.join(ids, F.col("from_node") == F.col("node_id"), "left_semi").join(ids, F.col("to_node") == F.col("node_id"), "left_semi"), n


def merged(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union of two networks' links; a link in both must agree but for its modes, which are united."""
    cols = [c for c in a.columns if c not in ("link_id", "modes")]
    other = b.select("link_id", F.col("modes").alias("_modes"), *[F.col(c).alias(f"_{c}") for c in cols])
    both = a.withColumn("_in_a", F.lit(True)).join(other.withColumn("_in_b", F.lit(True)), "link_id", "full_outer")
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in cols]
    agree = F.lit(True)
    for s in same:
        agree = agree & s
    bad = F.raise_error(F.concat(F.lit("links differ: "), F.col("link_id").cast("string"))).cast("array<string>")
    none = F.array().cast("array<string>")
    modes = F.when(F.col("_in_a") & F.col("_in_b") & ~agree, bad).otherwise(F.array_union(F.coalesce("modes", none), F.coalesce("_modes", none)))
    return both.select("link_id", *[F.when(F.col("_in_a"), F.col(c)).otherwise(F.col(f"_{c}")).alias(c) for c in cols], modes.alias("modes"))


def schedule_modes(route_links: DataFrame, links: DataFrame, keep: list[str] = ()) -> DataFrame:
    """Modes by link: those of the routes that use it (mode column), and of its own the ones to keep."""
    used = route_links.groupBy("link_id").agg(F.array_sort(F.collect_set("mode")).alias("_used"))
    kept = F.array_intersect("modes", F.array(*[F.lit(k) for k in keep]).cast("array<string>"))
    return links.join(used, "link_id", "left").withColumn("modes", F.array_union(F.coalesce("_used", F.array().cast("array<string>")), kept)).drop("_used")


def inferred_modes(route_links: DataFrame, links: DataFrame) -> DataFrame:
    """(schedule mode, network modes): all modes of the links that the mode's routes use."""
    each = route_links.join(links.select("link_id", F.explode("modes").alias("network_mode")), "link_id")
    return each.groupBy("mode").agg(F.array_sort(F.collect_set("network_mode")).alias("network_modes"))


def without_unused(links: DataFrame, route_links: DataFrame, keep: list[str]) -> DataFrame:
    """Links that routes use, their opposites, and links of modes to keep; unused ones are reduced to these modes."""
    used = route_links.select("link_id").distinct()
    back = opposites(links).join(used, "link_id").select(F.col("opposite").alias("link_id"))
    needed = used.union(back).distinct().withColumn("_used", F.lit(True))
    kept = F.array(*[F.lit(k) for k in keep]).cast("array<string>")
    out = links.join(needed, "link_id", "left")
    out = out.where(F.col("_used") | T.any_shared("modes", kept))
    return out.withColumn("modes", F.when(F.col("_used"), F.col("modes")).otherwise(T.shared("modes", kept))).drop("_used")


def required_speeds(segments: DataFrame, links: DataFrame, modes: list[str], margin: float = 1.02) -> DataFrame:
    """Free speeds raised to what the timetable needs: the largest of length / seconds * margin of the segments on a link, rounded up.

    ``segments``: (link_id, mode, length, seconds), a row for each link of a segment between stops.
    """
    need = segments.where(F.col("mode").isin(modes) & (F.col("seconds") > 0)).groupBy("link_id").agg(F.ceil(F.max(F.col("length") / F.col("seconds") * margin)).cast("double").alias("_need"))
    return links.join(need, "link_id", "left").withColumn("freespeed", F.greatest("freespeed", F.coalesce("_need", "freespeed"))).drop("_need")


def out_degree(links: DataFrame) -> DataFrame:
    return links.groupBy(F.col("from_node").alias("node_id")).agg(F.count("*").alias("n"))


def chains(links: DataFrame, candidates: DataFrame) -> DataFrame:
    """Of each unbranched chain of candidate links (stop_id, link_id, d) only the closest link.

    A link joins its predecessor's chain if that is the only candidate into its start and it the only one out of it. Chains
    are found by pointer jumping; a ring is cut at its least link.
    """
    c = candidates.join(links.select("link_id", "from_node", "to_node"), "link_id")
    into = c.groupBy("stop_id", F.col("to_node").alias("node")).agg(F.count("*").alias("n_in"), F.min("link_id").alias("before"))
    out = c.groupBy("stop_id", F.col("from_node").alias("node")).agg(F.count("*").alias("n_out"))
    joint = into.join(out, ["stop_id", "node"]).where("n_in = 1 and n_out = 1").drop("n_in", "n_out")
    step = c.join(joint.withColumnRenamed("node", "from_node"), ["stop_id", "from_node"], "left")
    ends = F.col("before").isNull().alias("ends")
    state = step.select("stop_id", "link_id", F.coalesce("before", "link_id").alias("p"), F.least("link_id", F.coalesce("before", "link_id")).alias("least"), ends)
    state = stored(state, "chains")
    # Each round doubles how far back a pointer reaches, so that as many as the longest chain's logarithm are enough.
    most = c.groupBy("stop_id").count().agg(F.max("count")).first()[0] or 1
    for _ in range(int(most).bit_length()):
        other = state.select("stop_id", F.col("link_id").alias("p"), F.col("p").alias("pp"), F.col("least").alias("l2"), F.col("ends").alias("e2"))
        jumped = state.join(other, ["stop_id", "p"])
        state = stored(jumped.select("stop_id", "link_id", F.col("pp").alias("p"), F.least("least", "l2").alias("least"), F.col("e2").alias("ends")), "chains")
    # A chain is known by its first link; a ring, in which pointers never end, by its least one.
    chain = F.when(F.col("ends"), F.col("p")).otherwise(F.col("least"))
    w = W.partitionBy("stop_id", "chain").orderBy("d", "link_id")
    return candidates.join(state.select("stop_id", "link_id", chain.alias("chain")), ["stop_id", "link_id"]).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "chain")


def strong_components(links: DataFrame) -> DataFrame:
    """(node_id, component): strongly connected components by forward and backward colouring.

    Each round every node takes the least node that reaches it as its colour; the nodes that reach their colour's root within
    the colour are that root's component and leave. Rounds and steps are written tables; nothing comes to the driver but counts.
    """
    edges = stored(links.select(F.col("from_node").alias("a"), F.col("to_node").alias("b")).where("a <> b").distinct(), "scc-edges")
    left = stored(links.select(F.col("from_node").alias("v")).union(links.select("to_node")).distinct(), "scc-nodes")
    done = None
    while left.limit(1).count():
        color = _spread(left.select("v", F.col("v").alias("c")), edges)
        same = edges.join(color.select(F.col("v").alias("a"), F.col("c").alias("ca")), "a").join(color.select(F.col("v").alias("b"), F.col("c").alias("cb")), "b").where("ca = cb")
        back = stored(same.select(F.col("b").alias("a"), F.col("a").alias("b")), "scc-back")
        reach = color.where("v = c")
        while True:
            more = reach.join(back, reach.v == back.a).select(F.col("b").alias("v"), "c").distinct().join(reach.select("v"), "v", "left_anti")
            more = stored(more, "scc-reach")
            if more.limit(1).count() == 0:
                break
            reach = stored(reach.union(more), "scc-reach")
        done = reach if done is None else done.union(reach)
        left = stored(left.join(reach, "v", "left_anti"), "scc-nodes")
        edges = stored(edges.join(left.withColumnRenamed("v", "a"), "a", "left_semi").join(left.withColumnRenamed("v", "b"), "b", "left_semi"), "scc-edges")
    out = done if done is not None else left.withColumn("c", F.col("v"))
    return out.select(F.col("v").alias("node_id"), F.col("c").alias("component"))


def _spread(color: DataFrame, edges: DataFrame) -> DataFrame:
    """Least colour that reaches each node."""
    color = stored(color, "scc-color")
    while True:
        along = edges.join(color, F.col("a") == F.col("v")).groupBy("b").agg(F.min("c").alias("n"))
        now = stored(color.join(along, F.col("v") == F.col("b"), "left").select("v", F.least("c", F.coalesce("n", "c")).alias("c")), "scc-color")
        same = now.join(color.select(F.col("v"), F.col("c").alias("o")), "v").where("c <> o").limit(1).count() == 0
        color = now
        if same:
            return color


def largest_component(links: DataFrame) -> DataFrame:
    """Links within the largest strongly connected component; of equal ones the least."""
    comp = stored(strong_components(links), "components")
    best = comp.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(1)
    nodes = comp.join(best, "component", "left_semi").select("node_id")
    return links.join(nodes, F.col("from_node") == F.col("node_id"), "left_semi").join(nodes, F.col("to_node") == F.col("node_id"), "left_semi")


def near_line(nodes: DataFrame, shapes: DataFrame, buffer: float) -> DataFrame:
    """(shape_id, node_id): nodes within a buffer of a shape (shape_id, points), by sample points every half buffer.

    Points and nodes meet in grid cells as large as the buffer, so a node is only compared with points of the cells around it.
    """
    steps = shapes.select("shape_id", F.posexplode(F.slice("points", 1, F.greatest(F.size("points") - 1, F.lit(0)))).alias("i", "a"), "points").withColumn("b", F.col("points")[F.col("i") + 1])
    n = F.greatest(F.lit(1), F.ceil(G.distance("a.x", "a.y", "b.x", "b.y") / (buffer / 2)).cast("int"))
    each = steps.withColumn("n", n).select("shape_id", "a", "b", "n", F.explode(F.sequence(F.lit(0), F.col("n"))).alias("k"))
    t = F.col("k") / F.col("n")
    at = each.select("shape_id", (F.col("a.x") + t * (F.col("b.x") - F.col("a.x"))).alias("px"), (F.col("a.y") + t * (F.col("b.y") - F.col("a.y"))).alias("py")).distinct()
    cell = lambda c: F.floor(F.col(c) / buffer)
    around = at.withColumn("cx", F.explode(F.transform(F.array(*[F.lit(i) for i in (-1, 0, 1)]), lambda i: cell("px") + i))).withColumn("cy", F.explode(F.transform(F.array(*[F.lit(i) for i in (-1, 0, 1)]), lambda i: cell("py") + i)))
    return nodes.withColumn("cx", cell("x")).withColumn("cy", cell("y")).join(around, ["cx", "cy"]).where(G.distance("x", "y", "px", "py") <= buffer).select("shape_id", "node_id").distinct()


def shape_networks(links: DataFrame, nodes: DataFrame, shapes: DataFrame, buffer: float) -> DataFrame:
    """(shape_id, link_id, ...): the part of the network around each shape."""
    near = near_line(nodes, shapes, buffer)
    a, b = near.toDF("shape_id", "from_node"), near.toDF("shape_id", "to_node")
    return links.join(a, "from_node").join(b, ["shape_id", "to_node"])


def start_loops(route_links: DataFrame, links: DataFrame) -> DataFrame:
    """Links of no length at the first node of every route, once for each node."""
    first = route_links.groupBy("line_id", "route_id").agg(F.min_by("link_id", "idx").alias("link_id")).join(links.select("link_id", "from_node"), "link_id")
    node = F.col("from_node").cast("string")
    return first.select(F.concat(F.lit("loop_"), node).alias("link_id"), F.col("from_node"), F.col("from_node").alias("to_node"), F.lit(0.0).alias("length"), F.array(F.lit("loop")).alias("modes")).distinct()


def connected(isolated: DataFrame, links: DataFrame, freespeed: float = 10.0) -> DataFrame:
    """Links both ways between nodes (stop_id, x, y) that no link touches and the start of the link nearest to each."""
    near = candidates.nearest(isolated, links).join(links.select("link_id", F.col("from_node").alias("node"), F.col("fx").alias("nx"), F.col("fy").alias("ny")), "link_id")
    both = near.join(isolated, "stop_id").withColumn("length", F.greatest(F.lit(1.0), G.distance("x", "y", "nx", "ny")))
    stop, node = F.col("stop_id").cast("string"), F.col("node").cast("string")
    one = lambda a, b: both.select(F.concat_ws("_", F.lit("pseudo"), a, b).alias("link_id"), a.alias("from_node"), b.alias("to_node"), "length", F.lit(freespeed).alias("freespeed"))
    return one(stop, node).unionByName(one(node, stop))


def replaced_modes(links: DataFrame, old: str, new: list[str]) -> DataFrame:
    """A mode exchanged for others, for instance car for car and pt."""
    others = F.array_except("modes", F.array(F.lit(old)))
    return links.withColumn("modes", F.when(F.array_contains("modes", old), F.array_union(others, F.array(*[F.lit(m) for m in new]))).otherwise(F.col("modes")))


def with_freespeed(links: DataFrame, mode: str, freespeed: float) -> DataFrame:
    return links.withColumn("freespeed", F.when(F.array_contains("modes", mode), F.lit(freespeed)).otherwise(F.col("freespeed")))


def artificial_lengths(links: DataFrame) -> DataFrame:
    """Artificial links take the distance of their ends as length, 1 at least."""
    return links.withColumn("length", F.when(F.array_contains("modes", "artificial"), F.greatest(F.lit(1.0), G.distance("fx", "fy", "tx", "ty"))).otherwise(F.col("length")))
