"""Tables of documents, pages and orders read as source files, definitions, call sites and call edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from callweave.sources.files import lines_of


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def document_files(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as files: rel_path is source/lang/doc_id."""
    path = F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))
    return read(spark, folder, "documents").select(path.alias("rel_path"), F.col("lang").alias("language"), "text")


def document_lines(spark: SparkSession, folder: str) -> DataFrame:
    return lines_of(document_files(spark, folder).select("rel_path", "language", "text"))


def definitions(lines: DataFrame) -> DataFrame:
    """A line that begins with three letters or more defines their lower-cased run, up to the next definition."""
    name = F.regexp_extract("line", "^([A-Za-z]{3,})", 1)
    starts = lines.select("rel_path", "language", "line_no", "line", F.max("line_no").over(Window.partitionBy("rel_path")).alias("n_lines"), F.lower(name).alias("name"))
    starts = starts.where("name <> ''")
    following = F.lead("line_no").over(Window.partitionBy("rel_path").orderBy("line_no"))
    end = F.coalesce(following - 1, F.col("n_lines"))
    return starts.select("rel_path", "language", "name", F.col("line_no").alias("start_line"), end.alias("end_line"), F.col("line").alias("signature"))


def call_sites(lines: DataFrame) -> DataFrame:
    """Every run of six letters or more before a comma calls its lower-cased name; ``turn`` counts within the line."""
    names = F.regexp_extract_all("line", F.lit("([A-Za-z]{6,}),"), F.lit(1))
    rows = lines.select("rel_path", "language", "line_no", "line", F.posexplode(names).alias("p", "n"))
    return rows.select("rel_path", "language", "line_no", (F.col("p") + 1).alias("turn"), F.lower("n").alias("callee"), "line")


def placed_call_sites(lines: DataFrame) -> DataFrame:
    """``call_sites`` with ``start_col``, the column of each site's name from 1: gaps and matches before it add up."""
    pattern = "[A-Za-z]{6,},"
    both = F.arrays_zip(F.regexp_extract_all("line", F.lit(pattern), F.lit(0)).alias("m"), F.split("line", pattern, -1).alias("g"))
    rows = lines.select("rel_path", "language", "line_no", "line", F.posexplode(both).alias("p", "s")).where("s.m is not null")
    before = Window.partitionBy("rel_path", "line_no").orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    start = F.sum(F.length("s.g") + F.length("s.m")).over(before) - F.length("s.m") + 1
    return rows.select("rel_path", "language", "line_no", (F.col("p") + 1).alias("turn"), start.cast("int").alias("start_col"), F.lower(F.expr("substring(s.m, 1, char_length(s.m) - 1)")).alias("callee"), "line")


def part_calls(spark: SparkSession, folder: str) -> DataFrame:
    """Calls between parts: every line of an order "calls" the part of the order's next line.

    Columns src, dst, status, site_file (order) and site_line. The last line of an order calls something
    that isn't found, or, where its number is even, is ambiguous. Repeated (order, line) pairs give one call for each pair of parts.
    """
    items = read(spark, folder, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("src"))
    return consecutive_calls(items)


def consecutive_calls(items: DataFrame) -> DataFrame:
    """``part_calls`` of items(l_orderkey, line, src), which are dealt and sorted by order once.

    Equal rows go next to each other and count once; a row then sees the next line of its order as a frame of the same
    window. Neither a join nor a table of all distinct calls is needed. A null order or line has no next line.
    """
    order = Window.partitionBy("l_orderkey").orderBy("line", "src")
    here = F.struct("line", "src")
    once = items.withColumn("again", F.lag(here).over(order).eqNullSafe(here)).where(~F.col("again")).drop("again")
    following = F.collect_list(F.struct(F.col("src").alias("dst"))).over(Window.partitionBy("l_orderkey").orderBy("line").rangeBetween(1, 1))
    following = F.when(F.col("l_orderkey").isNotNull() & F.col("line").isNotNull(), following)
    calls = once.withColumn("next", following).select("l_orderkey", "line", "src", F.explode_outer("next").alias("next"))
    # A line without a next one, and every next line without a part, is one call without a target.
    status = F.when(F.col("dst").isNotNull(), "resolved").when(F.col("line") % 2 == 0, "unresolved-ambiguous").otherwise("unresolved-notfound")
    return calls.select("src", F.col("next.dst").alias("dst"), "l_orderkey", "line").select("src", "dst", status.alias("status"), F.col("l_orderkey").alias("site_file"), F.col("line").alias("site_line"))


def part_sites(spark: SparkSession, folder: str) -> DataFrame:
    """The calls of ``part_calls`` that reach a part: src, dst, site_file, site_line."""
    return part_calls(spark, folder).where("dst is not null").drop("status")


def part_definitions(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as definitions: id, file (brand), line (size), name."""
    return read(spark, folder, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("file"), F.col("p_size").alias("line"), F.col("p_name").alias("name"))
