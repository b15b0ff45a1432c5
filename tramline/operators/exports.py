"""Sinks: GeoJSON, WKT and CSV of networks, schedules, shapes, warnings and quantiles; XML of networks and schedules."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _feature(kind: str, coordinates: Column, properties: Column) -> Column:
    geometry = F.struct(F.lit(kind).alias("type"), coordinates.alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), properties.alias("properties")))


def point_feature(x: Column, y: Column, properties: Column) -> Column:
    return _feature("Point", F.array(x, y), properties)


def line_feature(points: Column, properties: Column) -> Column:
    """``points``: array of structs with x and y."""
    return _feature("LineString", F.transform(points, lambda p: F.array(p["x"], p["y"])), properties)


def coordinates(links: Column) -> Column:
    """Start of every link, then the end of the last: an array of structs fx, fy, tx, ty as points."""
    last = F.element_at(links, -1)
    return F.concat(F.transform(links, lambda q: F.struct(q["fx"].alias("x"), q["fy"].alias("y"))), F.array(F.struct(last["tx"].alias("x"), last["ty"].alias("y"))))


def network_features(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(feature): a line for every link, a point for every node."""
    props = F.struct("link_id", "from_node", "to_node", "length", "freespeed", "capacity", "lanes", F.array_join("modes", ",").alias("modes"))
    line = F.array(F.struct(F.col("fx").alias("x"), F.col("fy").alias("y")), F.struct(F.col("tx").alias("x"), F.col("ty").alias("y")))
    return links.select(line_feature(line, props).alias("feature")).union(nodes.select(point_feature(F.col("x"), F.col("y"), F.struct("node_id"))))


def shape_features(shapes: DataFrame) -> DataFrame:
    return shapes.select(line_feature(F.transform("points", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))), F.struct("shape_id")).alias("feature"))


def schedule_features(route_links: DataFrame, departures: DataFrame, stops: DataFrame) -> DataFrame:
    """A line for every route with its departures in order, a point for every stop.

    ``route_links``: line_id, route_id, mode, idx, fx, fy, tx, ty; ``departures``: line_id, route_id, clock.
    """
    seq = F.array_sort(F.collect_list(F.struct("idx", "fx", "fy", "tx", "ty")))
    lines = route_links.groupBy("line_id", "route_id", "mode").agg(seq.alias("seq"))
    times = departures.groupBy("line_id", "route_id").agg(F.array_join(F.array_sort(F.collect_set("clock")), ", ").alias("departures"))
    routes = lines.join(times, ["line_id", "route_id"], "left").select(line_feature(coordinates(F.col("seq")), F.struct("line_id", "route_id", "mode", "departures")).alias("feature"))
    return routes.union(stops.select(point_feature(F.col("x"), F.col("y"), F.struct("stop_id", "name"))))


def warning_features(warnings: DataFrame, links: DataFrame) -> DataFrame:
    """Warnings (type, link_ids, n_routes) as lines over their links."""
    each = warnings.select("type", "link_ids", "n_routes", F.posexplode("link_ids").alias("idx", "link_id")).join(links.select("link_id", "fx", "fy", "tx", "ty"), "link_id")
    seq = F.array_sort(F.collect_list(F.struct("idx", "fx", "fy", "tx", "ty")))
    return each.groupBy("type", "link_ids", "n_routes").agg(seq.alias("seq")).select(line_feature(coordinates(F.col("seq")), F.struct("type", "n_routes")).alias("feature"))


def write_features(features: DataFrame, path: str) -> None:
    """One feature a line, as GeoJSON text sequences are read."""
    features.select("feature").write.text(path)


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    df.write.csv(path, header=True, sep=sep, quoteAll=True)


def links_wide(ranked: DataFrame, k: int) -> DataFrame:
    """Distances of the k nearest links of each stop side by side."""
    return ranked.where(F.col("rank") <= k).groupBy("stop_id").agg(*[F.max(F.when(F.col("rank") == i, F.col("d"))).alias(f"link{i}") for i in range(1, k + 1)])


def _attribute(name: str, value: Column) -> Column:
    text = F.coalesce(value.cast("string"), F.lit(""))
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return F.concat(F.lit(f' {name}="'), text, F.lit('"'))


def _element(tag: str, **attributes: Column) -> Column:
    return F.concat(F.lit(f"<{tag}"), *[_attribute(k.rstrip("_"), v) for k, v in attributes.items()], F.lit("/>"))


def network_xml(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(section, xml): an element for every node and link; a reader takes each section's parts in any order."""
    n = nodes.select(F.lit("nodes").alias("section"), _element("node", id=F.col("node_id"), x=F.col("x"), y=F.col("y")).alias("xml"))
    c = F.col
    return n.union(links.select(F.lit("links"), _element("link", id=c("link_id"), from_=c("from_node"), to=c("to_node"), length=c("length"), freespeed=c("freespeed"), capacity=c("capacity"), permlanes=c("lanes"), modes=F.array_join("modes", ","))))


def schedule_xml(stops: DataFrame, route_stops: DataFrame, departures: DataFrame) -> DataFrame:
    """(section, xml): an element for every stop, and one for every route with its stops and departures in order."""
    c = F.col
    facilities = stops.select(F.lit("transitStops").alias("section"), _element("stopFacility", id=c("stop_id"), x=c("x"), y=c("y"), name=c("name")).alias("xml"))
    stop = _element("stop", refId=c("stop_id"), arrivalOffset=c("arrival_offset"), departureOffset=c("departure_offset"))
    profile = route_stops.groupBy("line_id", "route_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", stop.alias("s")))), lambda x: x["s"]), "").alias("profile"))
    dep = departures.groupBy("line_id", "route_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("time", "departure_id", _element("departure", id=c("departure_id"), departureTime=c("time")).alias("d")))), lambda x: x["d"]), "").alias("deps"))
    whole = F.concat(F.lit("<transitRoute"), _attribute("line", c("line_id")), _attribute("id", c("route_id")), F.lit("><routeProfile>"), c("profile"), F.lit("</routeProfile><departures>"), F.coalesce("deps", F.lit("")), F.lit("</departures></transitRoute>"))
    return facilities.union(profile.join(dep, ["line_id", "route_id"], "left").select(F.lit("transitRoutes"), whole))


def write_xml(parts: DataFrame, path: str, sections: tuple[str, ...] = ("nodes", "links")) -> None:
    """A folder for each section; every part file is a document of its own, with the section as its root."""
    for section in sections:

        def wrapped(frames: Iterator[pd.DataFrame], root: str = section) -> Iterator[pd.DataFrame]:
            yield pd.DataFrame({"xml": [f"<{root}>"]})
            for frame in frames:
                yield frame[["xml"]]
            yield pd.DataFrame({"xml": [f"</{root}>"]})

        parts.where(F.col("section") == section).select("xml").mapInPandas(wrapped, "xml string").write.text(f"{path}/{section}")
