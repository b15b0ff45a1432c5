"""Command line: ``python -m tramline.cli COMMAND ...``. Results are Parquet folders, one for each table."""

from __future__ import annotations

import argparse
import json
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession

from .operators import checks, editor, exports, mapping, osm_network
from .sources import gtfs, osm


def _write(tables: dict[str, DataFrame], folder: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def _gtfs(spark: SparkSession, a) -> None:
    out = gtfs.to_schedule(gtfs.projected(gtfs.load(spark, a.feed), a.crs), a.day)
    _write(out, a.out)
    exports.write_csv(out["info"], f"{a.out}/info_csv")


def _osm(spark: SparkSession, a) -> None:
    links, nodes, restrictions = osm_network.build(spark, osm.load(spark, a.file), osm_network.Options(projection=a.crs))
    _write({"links": links, "nodes": nodes, "restrictions": restrictions}, a.out)


def _osm_lines(spark: SparkSession, a) -> None:
    x = osm.load(spark, a.file)
    _write({"lines": osm_network.transit_lines(x), "stops": osm_network.stop_facilities(x)}, a.out)


def _map(spark: SparkSession, a) -> None:
    read = spark.read.parquet
    links, nodes = read(f"{a.network}/links"), read(f"{a.network}/nodes")
    a_, b_ = nodes.toDF("from_node", "fx", "fy"), nodes.toDF("to_node", "tx", "ty")
    out = mapping.map_routes(read(f"{a.schedule}/stops"), read(f"{a.schedule}/route_stops").selectExpr("line_id", "route_id", "row_number() OVER (PARTITION BY line_id, route_id ORDER BY idx) - 1 AS idx", "stop_id"), links.join(a_, "from_node").join(b_, "to_node"))
    _write(out, a.out)
    print(json.dumps(mapping.summary(out["sequences"]).first().asDict()))


def _check(spark: SparkSession, a) -> None:
    links = spark.read.parquet(f"{a.network}/links")
    rl = spark.read.parquet(f"{a.schedule}/route_links").join(links, "link_id")
    _write({"turns": checks.direction_changes(rl), "loops": checks.loops(rl), "artificial": checks.artificial(rl)}, a.out)


def _edit(spark: SparkSession, a) -> None:
    read = spark.read.parquet
    s = editor.Schedule(*[read(f"{a.schedule}/{n}") for n in ("routes", "route_stops", "stops")], read(f"{a.network}/links"))
    s = editor.run(s, editor.read_commands(spark, a.commands))
    _write({"routes": s.routes, "route_stops": s.route_stops, "stops": s.stops, "links": s.links}, a.out)


def _defaults(spark: SparkSession, a) -> None:
    print(json.dumps({"mapping": asdict(mapping.Options()), "network": asdict(osm_network.Options())}, indent=1))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tramline")
    sub = p.add_subparsers(required=True)
    for name, f, args in (
        ("gtfs", _gtfs, ("feed", "day", "crs", "out")), ("osm", _osm, ("file", "crs", "out")), ("osm-lines", _osm_lines, ("file", "out")), ("map", _map, ("schedule", "network", "out")),
        ("check", _check, ("schedule", "network", "out")), ("edit", _edit, ("schedule", "network", "commands", "out")), ("defaults", _defaults, ()),
    ):
        s = sub.add_parser(name)
        for x in args:
            s.add_argument(x)
        s.set_defaults(run=f)
    return p


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(args)
    a.run(spark or SparkSession.builder.appName("tramline").getOrCreate(), a)


if __name__ == "__main__":
    main()
