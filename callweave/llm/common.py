"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid
import weakref
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one table of the given folder, which may be in any store Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_WRITTEN: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``.

    Where that is unset, a local session (tests) gets a temporary folder; a cluster session raises, as
    its executors couldn't read one another's folders.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    This cuts the lineage without computing the last stage twice, as ``checkpoint()`` would,
    and the copy outlives lost executors.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _WRITTEN[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``cut`` wrote and that nothing reads any more."""
    for t in tables:
        path = _WRITTEN.pop(t, None)
        if path:
            spark = t.sparkSession
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def hold(df: DataFrame) -> DataFrame:
    """Keep ``df`` on the executors' disks until ``unpersist``; what is lost with an executor is computed again.

    For tables that few steps read and that are quickly made of written ones: no files are named and moved.
    """
    return df.persist(StorageLevel.DISK_ONLY)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 500):
    """Let what is executed inside hand at most ``rows`` rows at a time to Python; the setting returns afterwards."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def release() -> None:
    """Give freed memory of a Python worker back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def frugal(run):
    """Wrap a generator that runs in Python workers: when it ends, freed memory goes back to the system.

    Workers stay alive between tasks and would keep what the largest batch took.
    """

    @functools.wraps(run)
    def wrapped(batches):
        yield from run(batches)
        release()

    return wrapped


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def free_name(df: DataFrame, name: str) -> str:
    """A column name that clashes with no column of ``df`` (names are compared without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def connected_components(edges: DataFrame) -> DataFrame:
    """Smallest reachable id for every id of ``edges(a, b)``: columns ``id, component``.

    Alternates two star operations (every node's larger, then smaller neighbours are hung on its
    smallest neighbour) until every component is a star around its smallest id; only one row at most
    reaches the driver, and every round is two aggregations over the edges that are left. No group is
    collected: the smallest neighbour is a ``min`` and joins back on the node, where AQE may split a hot node.
    """
    pairs = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    while True:
        both = pairs.select(F.col("hi").alias("n"), F.col("lo").alias("m")).union(pairs.select(F.col("lo").alias("n"), F.col("hi").alias("m")))
        # Minima are written before they join back, so that a hot node's edges can be split in the join.
        least = cut(both.groupBy("n").agg(F.least(F.min("m"), F.col("n")).alias("least"), F.count_if(F.col("m") < F.col("n")).alias("below"), F.bool_or(F.col("m") > F.col("n")).alias("above")))
        if least.where("below > 1 or (below = 1 and above)").isEmpty():
            discard(least)
            return pairs.select(F.col("hi").alias("id"), F.col("lo").alias("component")).unionByName(
                pairs.select(F.col("lo").alias("id"), F.col("lo").alias("component")).distinct()
            )
        large = both.where("m > n").join(least, "n").select(F.col("m").alias("hi"), F.col("least").alias("lo")).where("hi <> lo").distinct()
        large = hold(large)
        smallest = cut(large.groupBy("hi").agg(F.min("lo").alias("least")))
        small = (
            large.join(smallest, "hi")
            .select(F.explode(F.array(F.struct(F.col("lo").alias("hi"), F.col("least").alias("lo")), F.struct("hi", F.col("least").alias("lo")))).alias("e"))
            .select("e.hi", "e.lo")
            .where("hi <> lo")
            .distinct()
        )
        small = cut(small)
        large.unpersist()
        discard(pairs, least, smallest)
        pairs = small


def query_blocks(rows: DataFrame, key: str, size, most_rows: int, most_bytes: int) -> list[DataFrame]:
    """Split a query set into parts by a hash of ``key``, each of which may be broadcast.

    A part has at most ``most_rows`` rows and ``most_bytes`` bytes of ``size``, unless rows of one key alone
    are more than that. The parts' sizes are measured, and their number doubles until all of them fit.
    """
    n, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    parts = max(1, -(-n // most_rows), -(-total // most_bytes))
    place = lambda: F.pmod(F.xxhash64(key), F.lit(parts))
    if parts == 1:
        return [rows]
    while True:
        held = rows.groupBy(place().alias("part")).agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("b"), F.min(key).alias("x"), F.max(key).alias("y"))
        if held.where((F.col("n") > most_rows) | (F.col("b") > most_bytes)).where("x <> y").isEmpty():
            return [rows.where(place() == i) for i in range(parts)]
        parts *= 2
