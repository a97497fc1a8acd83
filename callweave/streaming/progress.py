"""Analysis of files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from callweave.functions.extract import analyze


def progress_totals(events: DataFrame) -> DataFrame:
    """Running totals per kind as a streaming (or batch) aggregate: parsed files and found functions."""
    return events.groupBy("language").agg(F.count(F.lit(1)).alias("parsed"), F.sum("functions").alias("functions"), F.count_if("failed").alias("failed"))


def analyze_stream(files: DataFrame, target: str, checkpoint: str, compat: bool = True) -> StreamingQuery:
    """Analyse a stream of (rel_path, language, lines) with what is there, in batches.

    Every batch appends its definitions under ``batch=<id>``; rewriting a batch after a failure replaces
    its own folder, so that results come once.
    """

    def keep(batch: DataFrame, batch_id: int) -> None:
        latest = batch.dropDuplicates(["rel_path"])
        analyze(latest, compat).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return files.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_definitions(written: DataFrame) -> DataFrame:
    """Of definitions written by batches those of each file's last batch."""
    last = written.groupBy("rel_path").agg(F.max("batch").alias("batch"))
    return written.join(last, ["rel_path", "batch"], "left_semi")
