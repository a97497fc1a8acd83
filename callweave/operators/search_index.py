"""A stored index of trigrams for repeated searches.

Files are numbered in path order within ranges of paths. For every trigram of lower-cased text and every range the index
holds the sorted numbers of the files that have it. A search reads the lists of its own trigrams alone, intersects them
range by range, and reads only the ranges and files that are left; their texts decide. With a limit ranges are read in
path order until there are enough hits.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.operators.search import MAX_HITS, search_files
from callweave.plans.stored import shared_folder, stored

GRAM = 3
#: Folders of trigrams, by hash.
FOLDERS = 32


def grams(text: Column) -> Column:
    """The distinct trigrams of a lower-cased text; a shorter text has none."""
    # The list of characters is an element of an array, so that it is made once and not for every trigram.
    characters = F.array(F.slice(F.split(F.lower(text), ""), F.lit(1), F.length(F.lower(text))))
    every = F.transform(characters, lambda c: F.transform(F.sequence(F.lit(0), F.size(c) - GRAM), lambda i: F.concat(*[F.get(c, i + k) for k in range(GRAM)])))
    return F.when(F.length(F.lower(text)) >= GRAM, F.array_distinct(F.element_at(every, 1))).otherwise(F.array().cast("array<string>"))


#: Characters of texts whose trigrams are sorted at once.
SORTED_CHARACTERS = 1 << 20


def _lists(span: int, numbers: list[int], texts: list[str]) -> Iterator[pa.RecordBatch]:
    """Lists of file numbers by trigram of a few texts of one range: places of trigrams are sorted as numbers of three characters and a text."""
    characters = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    known = np.flatnonzero(np.bincount(characters))
    if len(known) ** 3 * len(texts) >= 1 << 63:
        half = len(texts) // 2
        yield from _lists(span, numbers[:half], texts[:half])
        yield from _lists(span, numbers[half:], texts[half:])
        return
    rank = np.zeros(known[-1] + 1, np.int64)
    rank[known] = np.arange(len(known))
    c, owner = rank[characters], np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    places = (((c[:-2] * len(known) + c[1:-1]) * len(known) + c[2:]) * len(texts) + owner[2:])[owner[:-2] == owner[2:]]
    places.sort()
    places = places[np.append(True, places[1:] != places[:-1])]
    code, owner = np.divmod(places, len(texts))
    starts = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
    code = code[starts]
    parts = known[np.stack([code // len(known) ** 2, code // len(known) % len(known), code % len(known)], axis=1)].astype("<u4")
    text = parts.tobytes().decode("utf-32-le", "surrogatepass")
    own = pa.array([text[i : i + GRAM] for i in range(0, len(text), GRAM)], pa.string())
    lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(owner)), pa.int32()), pa.array(np.array(numbers, np.int32)[owner]))
    yield pa.RecordBatch.from_arrays([own, pa.array(np.full(len(starts), span, np.int32)), lists], ["gram", "range", "numbers"])


def lists_of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``_lists`` of rows (range, number, lower-cased text), a bounded number of characters at a time; long texts overlap by two."""
    held, numbers, size, before = [], [], 0, None
    for batch in batches:
        for span, number, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            for at in range(0, max(len(text) - GRAM + 1, 0), SORTED_CHARACTERS):
                part = text[at : at + SORTED_CHARACTERS + GRAM - 1]
                if held and (span != before or size + len(part) > SORTED_CHARACTERS):
                    yield from _lists(before, numbers, held)
                    held, numbers, size = [], [], 0
                held.append(part)
                numbers.append(number)
                size, before = size + len(part), span
    if held:
        yield from _lists(before, numbers, held)


class SearchIndex:
    """Texts by range of paths, and lists of file numbers by trigram and range, in two tables of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.files = spark.read.parquet(f"{folder}/files")
        self.lists = spark.read.parquet(f"{folder}/lists")

    @classmethod
    def build(cls, files: DataFrame, folder: str | None = None, ranges: int | None = None) -> SearchIndex:
        """Index ``files(rel_path, language, text)``; without a folder in the shared one. Null texts are empty."""
        spark = files.sparkSession
        folder = folder or f"{shared_folder(spark)}/{uuid.uuid4().hex}"
        ordered = files.select("rel_path", "language", F.coalesce("text", F.lit("")).alias("text"))
        ordered = ordered.repartitionByRange(ranges, "rel_path") if ranges else ordered.repartitionByRange("rel_path")
        ordered = ordered.sortWithinPartitions("rel_path", "text").withColumn("at", F.monotonically_increasing_id())
        numbered = ordered.select((F.col("at") / (1 << 33)).cast("int").alias("range"), F.pmod("at", F.lit(1 << 33)).cast("int").alias("number"), "rel_path", "language", "text")
        numbered.write.partitionBy("range").parquet(f"{folder}/files")
        stable = spark.read.parquet(f"{folder}/files").select("range", "number", F.lower("text").alias("text"))
        # Tasks hand on one list for many files' trigrams instead of a row for each; lists of one range are joined.
        pieces = stable.mapInArrow(lists_of_batches, "gram string, range int, numbers array<int>")
        lists = pieces.groupBy("gram", "range").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("numbers")))).alias("numbers"))
        lists = lists.withColumn("folder", F.pmod(F.xxhash64("gram"), F.lit(FOLDERS)).cast("int"))
        lists.repartition("folder").sortWithinPartitions("folder", "gram").write.partitionBy("folder").parquet(f"{folder}/lists")
        return cls(spark, folder)

    def candidates(self, query: str) -> DataFrame:
        """(range, number) of the files that have every trigram of a query; of all files where it has none."""
        spark = self.files.sparkSession
        wanted = spark.range(1).select(grams(F.lit(query.strip())).alias("g")).select(F.explode("g").alias("gram"), F.pmod(F.xxhash64(F.col("gram")), F.lit(FOLDERS)).cast("int").alias("folder")).collect()
        if not wanted:
            return self.files.select("range", "number")
        lists = self.lists.where(F.col("folder").isin(sorted({r.folder for r in wanted})) & F.col("gram").isin([r.gram for r in wanted]))
        held = lists.groupBy("range").agg(F.collect_list("numbers").alias("own")).where(F.size("own") == len(wanted))
        both = F.aggregate(F.slice("own", 2, len(wanted)), F.element_at("own", 1), lambda a, b: F.array_intersect(a, b))
        return held.select("range", F.explode(both).alias("number"))

    def search(self, query: str, define, call, max_hits: int | None = MAX_HITS) -> tuple[DataFrame, DataFrame]:
        """``search_files`` over the candidates' files, range after range while there are too few hits."""
        found = stored(self.candidates(query))
        sizes = found.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
        ahead = [r.range for r in sizes.orderBy("range").collect()]  # one row a range, however many files
        taken, step = 0, len(ahead) if max_hits is None else 1
        while True:
            taken = min(len(ahead), taken + step)
            chosen = self.files.where(F.col("range").isin(ahead[:taken])).join(found, ["range", "number"], "left_semi").drop("range", "number")
            hits, defs = search_files(chosen, query, define, call, max_hits)
            if max_hits is None or taken == len(ahead):
                return hits, defs
            hits = stored(hits)
            if hits.count() >= max_hits:
                return hits.orderBy("rel_path", "turn"), defs
            step *= 2
