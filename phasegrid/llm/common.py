"""Helpers shared by the corpus operators: input tables, shared-folder tables, skew-safe joins, gapless ranks."""

from __future__ import annotations

import contextlib
import gc
import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phasegrid.sources.store import drop_stored, shared_dir, stored

__all__ = ["bloom_joins", "drop_stored", "gapless_rank", "int_map", "new_path", "release", "shared_dir", "small_batches", "stored", "table", "words"]

#: ASCII white space; words are maximal runs of anything else.
SPACE = r"[\x20\x09-\x0D]+"

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of frames that are no longer referenced."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextlib.contextmanager
def bloom_joins(spark: SparkSession):
    """Within it, joins of a large table with a filtered small one get Spark's runtime Bloom filter even if the large one isn't huge: rows without a partner go before they are shuffled."""
    key = "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold"
    before = spark.conf.get(key, "10GB")
    spark.conf.set(key, "1MB")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def small_batches(spark: SparkSession) -> None:
    """Texts can be long: Arrow batches of few rows and bytes keep executors' Python small. A setting of the session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def words(text: Column) -> Column:
    """The words of a text, as array<string>; null text: empty."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE, -1), lambda w: w != "")


def int_map(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small driver-made table; the caller proves its bound."""
    return spark.createDataFrame(rows, schema)


def gapless_rank(df: DataFrame, key: str, order: list[str], out: str) -> DataFrame:
    """df with a gapless rank from 0 within each value of the integer column key, ordered within slices.

    df has to be a stored table. Keys have few values (at most some 10^5: histogram cells or lengths). A key with
    many rows is cut into slices by a hash of the order columns, so no task holds a hot key; the slices number at
    most keys + 8192 for any input, which bounds what the driver adds up and what is broadcast.
    """
    spark = df.sparkSession
    counts = {r[0]: r[1] for r in df.groupBy(key).count().collect()}
    target = max(256, math.ceil(sum(counts.values()) / 8192))
    pieces = {k: math.ceil(n / target) for k, n in counts.items() if n > target}
    sliced = df.withColumn("_slice", F.lit(0))
    if pieces:
        cut = F.broadcast(spark.createDataFrame(list(pieces.items()), T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("_n", T.IntegerType())])))
        sliced = df.join(cut, key, "left").withColumn("_slice", F.pmod(F.xxhash64(*order), F.coalesce("_n", F.lit(1))).cast("int")).drop("_n")
    at, seen = [], {}
    for k, s, n in sorted(map(tuple, sliced.groupBy(key, "_slice").count().collect()), key=lambda r: (r[0], r[1])):
        at.append((k, s, seen.get(k, 0)))
        seen[k] = seen.get(k, 0) + n
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("_slice", T.IntegerType()), T.StructField("_at", T.LongType())])
    offsets = F.broadcast(spark.createDataFrame(at, schema))
    w = Window.partitionBy(key, "_slice").orderBy(*order)
    return sliced.withColumn("_r", F.row_number().over(w)).join(offsets, [key, "_slice"]).withColumn(out, F.col("_at") + F.col("_r") - 1).drop("_slice", "_at", "_r")
