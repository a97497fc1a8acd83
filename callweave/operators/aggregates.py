"""Counts and running totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callweave.plans.stored import stored


def histogram(files: DataFrame, by: str = "language") -> DataFrame:
    return files.groupBy(by).agg(F.count(F.lit(1)).alias("n"))


def parse_stats(files: DataFrame) -> DataFrame:
    """Per language: files, functions and failed files of ``files(language, functions, failed)``."""
    return files.groupBy("language").agg(F.count(F.lit(1)).alias("files"), F.sum("functions").alias("functions"), F.count_if("failed").alias("errors"))


def running_totals(rows: DataFrame, key: str, order: str, bucket: Column, value: str) -> DataFrame:
    """``rows`` with running count and sum of ``value`` per key in the order given.

    ``bucket`` must grow with the order. Sums run inside a bucket and over the buckets' totals, so that a
    key with most rows is still dealt out.
    """
    rows = rows.withColumn("bucket_", bucket)
    inside = Window.partitionBy(key, "bucket_").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("k_").orderBy("b_").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(F.col(key).alias("k_"), F.col("bucket_").alias("b_")).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("v"))
    base = totals.select("k_", "b_", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n0"), F.coalesce(F.sum("v").over(earlier), F.lit(0)).alias("v0"))
    own = rows.withColumn("n1", F.count(F.lit(1)).over(inside)).withColumn("v1", F.sum(value).over(inside))
    joined = own.join(base, F.col(key).eqNullSafe(F.col("k_")) & (F.col("bucket_") == F.col("b_")))
    columns = [c for c in rows.columns if c != "bucket_"]
    return joined.select(*columns, (F.col("n1") + F.col("n0")).alias("running_count"), (F.col("v1") + F.col("v0")).alias("running_sum"))


def range_buckets(df: DataFrame, key: str) -> DataFrame:
    """``df`` with ``bucket``, ranges of ``key`` numbered in its order (nulls first); equal keys share one.

    These are the session's shuffle partitions, dealt by range and written once, so that their number follows the cluster.
    """
    return stored(df.repartitionByRange(F.col(key)).withColumn("bucket", F.spark_partition_id()))
