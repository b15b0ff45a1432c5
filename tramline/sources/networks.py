"""Network and schedule XML as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def nodes(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.format("xml").option("rowTag", "node").schema("_id string, _x double, _y double").load(path)
    return df.select(F.col("_id").alias("node_id"), F.col("_x").alias("x"), F.col("_y").alias("y"))


def links(spark: SparkSession, path: str) -> DataFrame:
    schema = "_id string, _from string, _to string, _length double, _freespeed double, _capacity double, _permlanes double, _modes string"
    df = spark.read.format("xml").option("rowTag", "link").schema(schema).load(path)
    return df.select(
        F.col("_id").alias("link_id"), F.col("_from").alias("from_node"), F.col("_to").alias("to_node"), F.col("_length").alias("length"), F.col("_freespeed").alias("freespeed"), F.col("_capacity").alias("capacity"),
        F.col("_permlanes").alias("lanes"), F.transform(F.split("_modes", ","), F.trim).alias("modes"))


def stop_facilities(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.format("xml").option("rowTag", "stopFacility").schema("_id string, _x double, _y double, _name string, _linkRefId string").load(path)
    return df.select(F.col("_id").alias("stop_id"), F.col("_x").alias("x"), F.col("_y").alias("y"), F.col("_name").alias("name"), F.col("_linkRefId").alias("link_id"))


def vehicles(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.format("xml").option("rowTag", "vehicle").schema("_id string, _type string").load(path)
    return df.select(F.col("_id").alias("vehicle_id"), F.col("_type").alias("vehicle_type"))
