"""Edits of a mapped schedule, one by one or as a list of commands."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from . import paths


@dataclass(frozen=True)
class Schedule:
    """routes: line_id, route_id, link_ids; route_stops: line_id, route_id, idx, stop_id; stops: stop_id, parent, link_id; links: link_id, from_node, to_node, cost."""

    routes: DataFrame
    route_stops: DataFrame
    stops: DataFrame
    links: DataFrame


def routed(refs: DataFrame, links: DataFrame) -> DataFrame:
    """(line_id, route_id, link_ids) of the least-cost paths between the links that the stops of a route lie on.

    ``refs``: line_id, route_id, idx, link_id. A route with a stop without a link, or without a path, gets none.
    """
    w = W.partitionBy("line_id", "route_id").orderBy("idx")
    refs = refs.withColumn("b", F.lead("link_id").over(w)).withColumn("_n", F.count("*").over(W.partitionBy("line_id", "route_id"))).withColumnRenamed("link_id", "a")
    pairs = refs.where("b IS NOT NULL AND a IS NOT NULL AND a <> b").select("a", "b").distinct()
    found = paths.paths(pairs, links).select("a", "b", "path")
    steps = refs.join(found, ["a", "b"], "left")
    last = F.col("b").isNull() & (F.row_number().over(w) == F.col("_n"))
    ok = F.col("a").isNotNull() & (last | (F.col("a") == F.col("b")) | F.col("path").isNotNull())
    part = F.when(F.col("a").eqNullSafe(F.col("b")), F.array().cast("array<string>")).otherwise(F.concat(F.array("a"), F.coalesce("path", F.array().cast("array<string>"))))
    rows = steps.select("line_id", "route_id", "idx", part.alias("p"), ok.alias("ok"))
    out = rows.groupBy("line_id", "route_id").agg(F.bool_and("ok").alias("ok"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("idx", "p"))), lambda x: x["p"])).alias("link_ids"))
    return out.select("line_id", "route_id", F.when(F.col("ok"), F.col("link_ids")).alias("link_ids"))


def _is(line: str, route: str) -> Column:
    return (F.col("line_id") == line) & (F.col("route_id") == route)


def refreshed(s: Schedule, which: Column | None = None) -> Schedule:
    """Route the chosen routes (or all) again between their stops' links."""
    chosen = s.routes if which is None else s.routes.where(which)
    refs = s.route_stops.join(chosen.select("line_id", "route_id"), ["line_id", "route_id"], "left_semi").join(s.stops.select("stop_id", "link_id"), "stop_id", "left")
    new = routed(refs.select("line_id", "route_id", "idx", "link_id"), s.links)
    rest = s.routes.join(new, ["line_id", "route_id"], "left_anti")
    return replace(s, routes=rest.select("line_id", "route_id", "link_ids").unionByName(new))


def _with_child(s: Schedule, parent: str, link: str) -> tuple[Schedule, str]:
    """The child of a stop on a link, made if it isn't there."""
    child = f"{parent}{T.CHILD_MARK}{link}"
    spark = s.stops.sparkSession
    new = spark.createDataFrame([(child, parent, link)], "stop_id string, parent string, link_id string").join(s.stops.select("stop_id"), "stop_id", "left_anti")
    return replace(s, stops=s.stops.select("stop_id", "parent", "link_id").unionByName(new)), child


def change_ref_link(s: Schedule, stop: str, link: str, line: str | None = None, route: str | None = None) -> Schedule:
    """Put a stop onto another link, everywhere or in one route, and route anew what stops there."""
    parent = stop.split(T.CHILD_MARK)[0]
    s, child = _with_child(s, parent, link)
    here = (F.col("stop_id") == stop) & (F.lit(True) if line is None else _is(line, route))
    touched = s.route_stops.where(here).select("line_id", "route_id").distinct()
    s = replace(s, route_stops=s.route_stops.withColumn("stop_id", F.when(here, F.lit(child)).otherwise(F.col("stop_id"))))
    return _refresh_rows(s, touched)


def _refresh_rows(s: Schedule, touched: DataFrame) -> Schedule:
    part = replace(s, routes=s.routes.join(touched, ["line_id", "route_id"], "left_semi"))
    rest = s.routes.join(touched, ["line_id", "route_id"], "left_anti").select("line_id", "route_id", "link_ids")
    return replace(s, routes=rest.unionByName(refreshed(part).routes))


def change_ref_link_on(s: Schedule, old: str, stop: str, link: str) -> Schedule:
    """Put a stop onto another link in all routes that use a link."""
    parent = stop.split(T.CHILD_MARK)[0]
    s, child = _with_child(s, parent, link)
    on = s.routes.where(F.array_contains("link_ids", old)).select("line_id", "route_id", F.lit(True).alias("_on"))
    moved = s.route_stops.join(on, ["line_id", "route_id"], "left")
    here = F.col("_on") & (T.parent_stop("stop_id") == parent)
    stops = moved.withColumn("stop_id", F.when(F.coalesce(here, F.lit(False)), F.lit(child)).otherwise(F.col("stop_id"))).drop("_on")
    return _refresh_rows(replace(s, route_stops=stops.select("line_id", "route_id", "idx", "stop_id")), on.drop("_on"))


def replace_stop(s: Schedule, old: str, new: str, line: str | None = None, route: str | None = None) -> Schedule:
    here = (F.col("stop_id") == old) & (F.lit(True) if line is None else _is(line, route))
    touched = s.route_stops.where(here).select("line_id", "route_id").distinct()
    return _refresh_rows(replace(s, route_stops=s.route_stops.withColumn("stop_id", F.when(here, F.lit(new)).otherwise(F.col("stop_id")))), touched)


def reroute_via(s: Schedule, line: str, route: str, old: str, new: str) -> Schedule:
    """Lead one route over another link instead of one of its own: from the stop before it, over the new link, to the stop after it."""
    row = s.routes.where(_is(line, route)).first()
    refs = [r["link_id"] for r in s.route_stops.where(_is(line, route)).join(s.stops, "stop_id").orderBy("idx").select("link_id").collect()]
    if row is None or row["link_ids"] is None or old not in row["link_ids"]:
        raise ValueError(f"{line} {route} doesn't use {old}")
    ids = row["link_ids"]
    at, cuts, k = ids.index(old), [], -1
    for ref in refs:
        k = ids.index(ref, k if k >= 0 and ids[k] == ref else k + 1)
        cuts.append(k)
    before, after = max(c for c in cuts if c <= at), min(c for c in cuts if c >= at)
    if before == after:
        raise ValueError(f"a stop lies on {old}")
    spark = s.routes.sparkSession
    found = {(r["a"], r["b"]): r["path"] for r in paths.paths(spark.createDataFrame([(ids[before], new), (new, ids[after])], "a string, b string"), s.links).collect()}
    if len(found) < 2:
        raise ValueError(f"no path over {new}")
    whole = [*ids[: before + 1], *found[ids[before], new], new, *found[new, ids[after]], *ids[after:]]
    return replace(s, routes=s.routes.withColumn("link_ids", F.when(_is(line, route), F.array(*[F.lit(x) for x in whole])).otherwise(F.col("link_ids"))))


def reroute_from_stop(s: Schedule, line: str, route: str, stop: str, via: str) -> Schedule:
    """Lead one route over a link between a stop and the next one."""
    rows = s.route_stops.where(_is(line, route)).join(s.stops, "stop_id").orderBy("idx").select("stop_id", "parent", "link_id").collect()
    at = next((i for i, r in enumerate(rows) if stop in (r["stop_id"], r["parent"])), None)
    if at is None or at + 1 >= len(rows):
        raise ValueError(f"{line} {route} doesn't go on from {stop}")
    ids = s.routes.where(_is(line, route)).first()["link_ids"]
    lo = ids.index(rows[at]["link_id"])
    hi = ids.index(rows[at + 1]["link_id"], lo)
    if hi - lo < 2:
        raise ValueError("no link between these stops")
    return reroute_via(s, line, route, ids[lo + 1], via)


def add_link(s: Schedule, link: str, start: str, end: str, like: str) -> Schedule:
    """A new link with the attributes of another one; then all routes are routed again."""
    new = s.links.where(F.col("link_id") == like).withColumn("link_id", F.lit(link)).withColumn("from_node", F.lit(start)).withColumn("to_node", F.lit(end))
    return refreshed(replace(s, links=s.links.unionByName(new)))


def without_mapping(s: Schedule) -> Schedule:
    """Stops without links, routes without sequences."""
    return replace(s, routes=s.routes.withColumn("link_ids", F.lit(None).cast("array<string>")), stops=s.stops.withColumn("link_id", F.lit(None).cast("string")))


_COMMANDS = {
    "rerouteViaLink": ((4,), lambda s, a: reroute_via(s, *a)),
    "rerouteFromStop": ((4,), lambda s, a: reroute_from_stop(s, *a)),
    "changeRefLink": ((2, 4), lambda s, a: change_ref_link(s, *a) if len(a) == 2 else change_ref_link(s, a[2], a[3], a[0], a[1])),
    "changeRefLinkOnLink": ((3,), lambda s, a: change_ref_link_on(s, *a)),
    "addLink": ((4,), lambda s, a: add_link(s, *a)),
    "replaceStopFacilityInAllRoutes": ((2,), lambda s, a: replace_stop(s, *a)),
    "replaceStopFacilityInRoute": ((4,), lambda s, a: replace_stop(s, a[2], a[3], a[0], a[1])),
    "refreshTransitRoute": ((2,), lambda s, a: refreshed(s, _is(*a))),
    "refreshSchedule": ((0,), lambda s, a: refreshed(s)),
}


def run(s: Schedule, commands: list[list[str]]) -> Schedule:
    """Apply commands in order. Comments start with ``//``; unknown names and wrong numbers of arguments are errors."""
    for command in commands:
        words = [w.strip() for w in command]
        while words and not words[-1]:
            words.pop()
        if not words or words[0].startswith("//"):
            continue
        if words[0] not in _COMMANDS:
            raise ValueError(f"unknown command {words[0]}")
        counts, f = _COMMANDS[words[0]]
        if len(words) - 1 not in counts:
            raise ValueError(f"{words[0]} takes {counts} arguments")
        s = f(s, words[1:])
    return s


def read_commands(spark: SparkSession, path: str) -> list[list[str]]:
    """Commands of a semicolon-separated file: a list for a person to write, so it comes to the driver."""
    return [r["value"].split(";") for r in spark.read.text(path).collect()]
