"""Incremental binding: a batch of changed files re-binds the sites that it can touch, and no others.

State is a folder of append-only tables, each batch a folder of its own that a repeated batch overwrites: ``files`` (which
files a batch brought), ``definitions``, ``sites``, ``bindings`` and ``changes`` (names whose definitions changed). The
current rows of a file are those of its last batch. A site is bound anew if its file changed or if a definition of the
called name appeared, moved or went; the last binding of a site counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from callweave.functions.extract import analyze, sites_of
from callweave.operators.resolve import FAN_OUT, resolve_name
from callweave.plans.stored import stored

_SITE = ["rel_path", "def_id", "callee", "line_no", "start_col"]
_DEFINITION = ["rel_path", "def_id", "name", "start_line", "start_col"]
_SCHEMAS = {
    "files": "rel_path string",
    "definitions": "rel_path string, def_id string, name string, start_line int, start_col int",
    "sites": "rel_path string, def_id string, callee string, line_no int, start_col int",
    "bindings": "rel_path string, def_id string, callee string, line_no int, start_col int, version long, rank int, target_id string",
    "changes": "name string",
}


def _read(spark: SparkSession, target: str, table: str, before: int | None = None) -> DataFrame:
    """A table of all batches, or of those before one; empty where nothing was written."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/{table}")
    schema = f"{_SCHEMAS[table]}, batch long"
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(f"{target}/{table}")
    return rows if before is None else rows.where(F.col("batch") < before)


def _latest(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Rows of every file's last batch."""
    last = files.groupBy("rel_path").agg(F.max("batch").alias("batch"))
    return rows.join(last, ["rel_path", "batch"], "left_semi")


def bind_batch(files: DataFrame, batch_id: int, target: str, compat: bool = True, fan_out: int = FAN_OUT) -> None:
    """Take in ``files(rel_path, language, lines)``, one row a file; lines of null mean that the file is gone."""
    spark = files.sparkSession
    own = stored(files.dropDuplicates(["rel_path"]))
    keep = lambda df, table: df.write.mode("overwrite").parquet(f"{target}/{table}/batch={batch_id}")
    read = lambda table: spark.read.schema(_SCHEMAS[table]).parquet(f"{target}/{table}/batch={batch_id}")
    found = stored(analyze(own.where("lines is not null"), compat)).where("kind <> 'error'")
    keep(own.select("rel_path"), "files")
    keep(found.select(*_DEFINITION), "definitions")
    keep(sites_of(found).select(*_SITE), "sites")
    changed, new = read("files"), read("definitions")
    known = _read(spark, target, "files", batch_id)
    old = stored(_latest(_read(spark, target, "definitions", batch_id), known).drop("batch"))
    gone = old.join(changed, "rel_path", "left_semi")
    both = gone.select(*_DEFINITION, F.lit(1).alias("o"), F.lit(0).alias("n")).unionByName(new.select(*_DEFINITION, F.lit(0).alias("o"), F.lit(1).alias("n")))
    moved = both.groupBy(*_DEFINITION).agg(F.max("o").alias("o"), F.max("n").alias("n")).where("o <> n")
    keep(moved.select("name").distinct(), "changes")
    elsewhere = _latest(_read(spark, target, "sites", batch_id), known).withColumnRenamed("batch", "version").join(changed, "rel_path", "left_anti")
    touched = elsewhere.join(read("changes").withColumnRenamed("name", "callee"), "callee", "left_semi")
    touched = stored(touched.select(*_SITE, "version").unionByName(read("sites").withColumn("version", F.lit(batch_id).cast("long"))))
    called = touched.select(F.col("callee").alias("name")).distinct()
    candidates = old.join(changed, "rel_path", "left_anti").unionByName(new).join(called, "name", "left_semi")
    bound = resolve_name(touched, candidates, fan_out)
    open_ = touched.join(bound.select(*_SITE).distinct(), _SITE, "left_anti").withColumns({"rank": F.lit(None).cast("int"), "target_id": F.lit(None).cast("string")})
    keep(bound.select(*_SITE, "version", "rank", "target_id").unionByName(open_.select(*_SITE, "version", "rank", "target_id")), "bindings")


def bind_stream(files: DataFrame, target: str, checkpoint: str, compat: bool = True) -> StreamingQuery:
    """``bind_batch`` for everything that a stream of (rel_path, language, lines) brings."""
    take = lambda batch, batch_id: bind_batch(batch, batch_id, target, compat)
    return files.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, target: str, table: str) -> DataFrame:
    """The definitions, sites or bindings that hold now; of bindings each site's last, open sites with a null target."""
    files = _read(spark, target, "files")
    if table != "bindings":
        return _latest(_read(spark, target, table), files).drop("batch")
    rows = _read(spark, target, "bindings")
    live = files.groupBy("rel_path").agg(F.max("batch").alias("version"))
    rows = rows.join(live, ["rel_path", "version"], "left_semi")
    last = rows.groupBy(*_SITE).agg(F.max("batch").alias("batch"))
    return rows.join(last, [*_SITE, "batch"], "left_semi").select(*_SITE, "rank", "target_id")


def bound_sites(spark: SparkSession, target: str) -> DataFrame:
    """Bound sites as (src, dst, site_file, site_line, site_col), as ``graph.edge_groups`` takes them."""
    rows = current(spark, target, "bindings").where("target_id is not null")
    return rows.select(F.col("def_id").alias("src"), F.col("target_id").alias("dst"), F.col("rel_path").alias("site_file"), F.col("line_no").alias("site_line"), F.col("start_col").alias("site_col"))
