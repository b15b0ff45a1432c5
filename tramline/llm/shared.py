"""Storage that the driver and all executors see, and small column helpers."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.storage import shared_dir

#: The characters that separate words: space, and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"

def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    This cuts the lineage: executors that are lost later cost no recomputation. The files go when the session ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def forget(*frames: DataFrame) -> None:
    """Delete tables that stored() wrote and nothing reads any more."""
    for df in frames:
        jvm = df.sparkSession.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(df.stored_at)
        at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of frames that nothing refers to any more.

    Spark itself holds on to the last query it has run, so a small one is run first.
    """
    spark.range(1).count()
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: At most so many keys of a table hold more than this part of its rows each.
HOT_KEYS = 20_000


def looked_up(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Left join of ``rows`` with ``table``, which has one row for each ``key`` and in ``n`` how many rows have it.

    Keys with more than one ``HOT_KEYS``-th of all rows are ``HOT_KEYS`` at most, so they are broadcast; no other key can
    burden the task it is shuffled to.
    """
    total = table.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") * HOT_KEYS > F.lit(total)
    few, rest = table.where(hot).drop("n"), table.where(~hot).drop("n")
    others = rows.join(F.broadcast(few.select(key)), key, "left_anti").join(rest, key, "left")
    return rows.join(F.broadcast(few), key).unionByName(others)


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often a lambda in ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_RUN), lambda w: w != "")


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % n


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
