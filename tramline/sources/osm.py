"""OpenStreetMap extracts as three tables: nodes, ways and relations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

_TAG = "tag array<struct<_k:string,_v:string>>"
_SCHEMAS = {
    "node": f"_id long, _lat double, _lon double, {_TAG}",
    "way": f"_id long, nd array<struct<_ref:long>>, {_TAG}",
    "relation": f"_id long, member array<struct<_type:string,_ref:long,_role:string>>, {_TAG}",
}


@dataclass(frozen=True)
class Extract:
    nodes: DataFrame  # node_id, lat, lon, tags
    ways: DataFrame  # way_id, nodes, tags
    relations: DataFrame  # relation_id, members, tags


def _tags() -> F.Column:
    entries = F.transform(F.coalesce("tag", F.array().cast("array<struct<_k:string,_v:string>>")), lambda t: F.struct(t["_k"], t["_v"]))
    return F.map_from_entries(entries).alias("tags")


def load(spark: SparkSession, path: str, node_filter: tuple | None = None, way_filter: tuple | None = None, relation_filter: tuple | None = None) -> Extract:
    """Read an extract. Filters are (positive, exceptions) of tag_matches, applied at the scan.

    Ways with a node outside of the extract are dropped; members outside of it are taken out of their relations, in place.
    """
    read = lambda tag: spark.read.format("xml").option("rowTag", tag).schema(_SCHEMAS[tag]).load(path)
    keep = lambda df, rule: df if rule is None else df.where(T.tag_matches("tags", *rule))
    nodes = keep(read("node").select(F.col("_id").alias("node_id"), F.col("_lat").alias("lat"), F.col("_lon").alias("lon"), _tags()), node_filter)
    ways = keep(read("way").select(F.col("_id").alias("way_id"), F.transform(F.coalesce("nd", F.array().cast("array<struct<_ref:long>>")), lambda n: n["_ref"]).alias("nodes"), _tags()), way_filter)
    members = F.transform(F.coalesce("member", F.array().cast("array<struct<_type:string,_ref:long,_role:string>>")), lambda m: F.struct(m["_type"].alias("type"), m["_ref"].alias("ref"), m["_role"].alias("role")))
    relations = keep(read("relation").select(F.col("_id").alias("relation_id"), members.alias("members"), _tags()), relation_filter)
    return closed(Extract(nodes, ways, relations))


def closed(x: Extract) -> Extract:
    """Referential closure of an extract."""
    refs = x.ways.select("way_id", F.explode("nodes").alias("node_id"))
    broken = refs.join(x.nodes.select("node_id"), "node_id", "left_anti").select("way_id")
    ways = x.ways.join(broken, "way_id", "left_anti")
    there = x.nodes.select(F.lit("node").alias("type"), F.col("node_id").alias("ref")).union(ways.select(F.lit("way"), "way_id")).union(x.relations.select(F.lit("relation"), "relation_id"))
    each = x.relations.select("relation_id", F.posexplode("members").alias("i", "m")).select("relation_id", "i", "m.*").join(there, ["type", "ref"], "left_semi")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("i", "type", "ref", "role"))), lambda m: F.struct(m["type"].alias("type"), m["ref"].alias("ref"), m["role"].alias("role")))
    kept = each.groupBy("relation_id").agg(listed.alias("members"))
    relations = x.relations.drop("members").join(kept, "relation_id", "left")
    relations = relations.withColumn("members", F.coalesce("members", F.array().cast("array<struct<type:string,ref:bigint,role:string>>"))).select("relation_id", "members", "tags")
    return Extract(x.nodes, ways, relations)


def without(x: Extract, nodes: DataFrame | None = None, ways: DataFrame | None = None, relations: DataFrame | None = None) -> Extract:
    """An extract without some elements; what refers to them is mended: a deleted node leaves its ways."""
    n, w, r = x.nodes, x.ways, x.relations
    if nodes is not None:
        n = n.join(nodes.select("node_id"), "node_id", "left_anti")
        each = w.select("way_id", F.posexplode("nodes").alias("i", "node_id")).join(nodes.select("node_id"), "node_id", "left_anti")
        listed = F.transform(F.array_sort(F.collect_list(F.struct("i", "node_id"))), lambda p: p["node_id"])
        w = w.drop("nodes").join(each.groupBy("way_id").agg(listed.alias("nodes")), "way_id").select("way_id", "nodes", "tags")
    if ways is not None:
        w = w.join(ways.select("way_id"), "way_id", "left_anti")
    if relations is not None:
        r = r.join(relations.select("relation_id"), "relation_id", "left_anti")
    return closed(Extract(n, w, r))
