"""CSV reading with header checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BOM = "﻿"


def read_csv(spark: SparkSession, path: str, required: list[str], optional: list[str] = (), position: bool = False) -> DataFrame:
    """All columns as trimmed text, blanks as null; a missing required column is an error, unknown ones are ignored.

    ``position`` adds the row's place in the file, for rules that follow file order.
    """
    df = spark.read.csv(path, header=True, encoding="UTF-8", multiLine=True, escape='"', inferSchema=False)
    df = df.toDF(*[c.removeprefix(BOM).strip().strip('"') for c in df.columns])
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"{path}: missing columns {missing}")
    text = lambda c: F.nullif(F.trim(F.col(c)), F.lit("")).alias(c)
    out = df.select(*[text(c) for c in required], *[text(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in optional])
    return out.withColumn("position", F.monotonically_increasing_id()) if position else out


def nested_map(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Three columns as (key, map of second to third column)."""
    df = spark.read.csv(path, sep=sep, header=False).toDF("a", "b", "c")
    return df.groupBy(F.col("a").alias("key")).agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct("b", "c")))).alias("entries"))
