"""Five stages from raw documents to packed training sequences.

Every stage takes all rows its predecessor kept. All but the last return the columns of documents;
``n_chars`` follows the text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.llm import langid, neardup, packing, secrets, substrings
from callweave.llm.common import cut, discard, small_batches, table

#: A document is rejected if its language is undetermined or less likely than this.
LEAST_SCORE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a language that was recognised; null texts and texts without letters go."""
    found = langid.predict(docs, langid.train(docs))
    keep = (F.col("language.lang_pred") != langid.UNDETERMINED) & (F.col("language.score") >= LEAST_SCORE)
    return found.where(keep).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest doc_id of every group of near duplicates, and all rows without a doc_id.

    Of rows that repeat a doc_id with one text a single row stays; rows of one doc_id with different texts all stay.
    """
    kept = neardup.near_duplicates(docs).where("kept and doc_id is not null").select("doc_id").distinct()
    named = docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return named.select(*docs.columns).unionByName(docs.where("doc_id is null"))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take strings of ``substrings.PASSAGE`` bytes that repeat out of the texts; a character cut in two goes. Emptied documents go."""
    found = substrings.remove_repeats(docs, length=substrings.PASSAGE)
    changed = F.col("cleaned.n_removed") > 0
    out = found.withColumn("text", F.when(changed, substrings.decoded("cleaned.kept")).otherwise(F.col("text")))
    return out.where(~changed | (F.trim("text") != "")).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every secret with a mask."""
    out = secrets.redact(secrets.find_secrets(docs))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents' pieces into sequences of at most 1024 tokens."""
    pieces = packing.tokenize_pieces(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    return packing.pack(pieces.select("doc_id", "piece_.piece", "piece_.start", "piece_.length", F.crc32("piece_.ids").alias("ids_crc32")))


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("secret_scan", secret_scan),
    ("pack", pack),
]

#: Language prediction, set similarity and packing are beyond SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    with small_batches(spark):
        for _, stage in STAGES[:-1]:
            before, docs = docs, cut(stage(spark, docs, sf_dir))
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
