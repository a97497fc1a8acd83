"""SimHash fingerprints and Hamming search in DataFrame functions alone.

Each word of a text votes with its 64 hash bits; a word that occurs often votes as often. Two bits
are counted in one long (bits ``i`` and ``i + 32`` in its halves), so that 32 sums hold all votes.
The search cuts fingerprints into blocks; every choice of blocks that must be equal within the radius
is a permuted table keyed by these blocks, joined by equality and verified by counting bits.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from callweave.llm.common import cut, table, text_or_empty

BITS = 64
RADIUS = 3
#: Blocks of a fingerprint; ``RADIUS`` differing bits leave at least ``BLOCKS - RADIUS`` of them equal.
BLOCKS = 5
#: Documents meant for one bucket of neighbouring ids, segments of buckets, and buckets whose table is broadcast.
BUCKET_ROWS, SEGMENTS, BROADCAST_BUCKETS = 512, 64, 200_000
_LANES = 0x0000000100000001


def votes(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """One row per key (rows of equal keys vote together): the keys and ``fp``, the fingerprint as a long.

    Words are what lies between white space. A text without words has the fingerprint 0. A bit is set
    where more than half of the votes are ones. Counts are exact up to 2^31 words.
    """
    words = texts.select(*keys, F.explode_outer(F.split(F.col(text), r"\s+")).alias("w"))
    words = words.select(*keys, F.when(F.col("w") != "", F.xxhash64("w")).alias("h"))
    sums = [F.sum(F.shiftrightunsigned("h", i).bitwiseAND(F.lit(_LANES))).alias(f"v{i}") for i in range(BITS // 2)]
    counted = words.groupBy(*keys).agg(F.count("h").alias("total"), *sums)
    fp = F.lit(0).cast("long")
    for i in range(BITS // 2):
        low, high = F.col(f"v{i}").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(f"v{i}", 32)
        for bit, ones in ((i, low), (i + 32, high)):
            fp = fp.bitwiseOR(F.shiftleft(F.when(2 * ones > F.col("total"), F.lit(1)).otherwise(F.lit(0)).cast("long"), bit))
    return counted.select(*keys, fp.alias("fp"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(float(BITS))


def hexed(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def within_radius(queries: DataFrame, known: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """For each distinct ``fp`` of ``queries`` the number of rows of ``known`` within the radius: (fp, near).

    Equal fingerprints are counted first, so that groups of copies are one row in every table.
    """
    bounds = [BITS * k // blocks for k in range(blocks + 1)]
    masks = []
    for chosen in combinations(range(blocks), blocks - radius):
        m = sum(((1 << bounds[k + 1] - bounds[k]) - 1) << bounds[k] for k in chosen)
        masks.append(m - (1 << 64) if m >> 63 else m)
    tables = F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.lit(m).alias("m")) for n, m in enumerate(masks)]))
    keyed = lambda df: df.withColumn("t", tables).withColumn("key", F.col("fp").bitwiseAND(F.col("t.m"))).withColumn("n", F.col("t.n")).drop("t")
    q = keyed(queries.select("fp").distinct()).withColumnRenamed("fp", "q")
    k = keyed(known.groupBy("fp").agg(F.count(F.lit(1)).alias("rows")))
    pairs = q.join(k, ["n", "key"]).where(F.bit_count(F.col("q").bitwiseXOR(F.col("fp"))) <= radius)
    return pairs.select("q", "fp", "rows").distinct().groupBy("q").agg(F.sum("rows").alias("near")).withColumnRenamed("q", "fp")


def _deal(edges: Column, value: Column, share: Column) -> tuple[Column, Column]:
    """Which of the ranges between sorted ``edges`` a value lies in, and where in it.

    A value that is an edge itself, and often, fills several ranges; ``share`` (0 to 1) deals its rows
    over these. What is left of the share places a row inside its range.
    """
    same = F.size(F.filter(edges, lambda e: e == value))
    spread = share * (same + 1)
    part = F.least(F.floor(spread), same)
    return (F.size(F.filter(edges, lambda e: e <= value)) - same + part).cast("int"), spread - part


def with_next(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` with ``next``, the text of the next row by descending doc_id, after the last the first.

    Rows are dealt into buckets of about ``BUCKET_ROWS`` neighbouring rows by quantiles in two levels
    (``SEGMENTS``, then as many in each as the rows need), and the first row of each bucket is also put
    last in the bucket before it (``halo``), so that one shuffle brings every row and its successor
    together. The table of buckets is broadcast while it is small and joined otherwise. Equal ids are
    ordered by a hash of their text, and many of them fill several buckets; null ids come last. Columns:
    bucket, turn (the order inside it), halo, doc_id, text, next.
    """
    docs = docs.withColumn("tie", F.xxhash64("text"))
    rows, nulls, cuts = docs.agg(F.count("doc_id"), F.count_if(F.col("doc_id").isNull()), F.percentile_approx("doc_id", [k / SEGMENTS for k in range(1, SEGMENTS)], 10000)).first()
    parts = max(1, -(-rows // (BUCKET_ROWS * SEGMENTS)))
    few = rows + nulls <= BUCKET_ROWS * BROADCAST_BUCKETS
    share = F.col("tie").cast("double") / 2.0**64 + 0.5
    segment, rest = _deal(F.array(*[F.lit(c) for c in cuts or []]).cast("array<long>"), F.col("doc_id"), share)
    last = -1 - F.floor((1 - share) * max(1, -(-nulls // BUCKET_ROWS)))  # null ids, behind all others
    dealt = docs.withColumn("segment", F.when(F.col("doc_id").isNull(), last.cast("int")).otherwise(segment)).withColumn("rest", F.when(F.col("doc_id").isNotNull(), rest))
    if parts > 1:
        inner = dealt.where("doc_id is not null").groupBy(F.col("segment").alias("e_segment")).agg(F.percentile_approx("doc_id", [k / parts for k in range(1, parts)], 10000).alias("edges"))
        dealt = dealt.join(F.broadcast(inner) if few else inner, F.col("segment") == F.col("e_segment"), "left")
        part = F.coalesce(_deal(F.col("edges"), F.col("doc_id"), F.col("rest"))[0], F.lit(0))
    else:
        part = F.lit(0)
    dealt = dealt.select("segment", (F.col("segment").cast("long") * parts + part).alias("bucket"), "doc_id", "tie", "text")
    heads = cut(dealt.groupBy("segment", "bucket").agg(F.max(F.struct("doc_id", "tie")).alias("head")))
    # The bucket before each: in its segment, or the lowest one of the segment before; of segments there are few.
    lowest = heads.groupBy("segment").agg(F.min("bucket").alias("low"), F.max("bucket").alias("top")).orderBy(F.desc("segment")).collect()
    above = docs.sparkSession.createDataFrame([(s.top, lowest[k - 1].low) for k, s in enumerate(lowest)], "top_ long, above long")
    inside = F.lag("bucket").over(Window.partitionBy("segment").orderBy(F.desc("bucket")))
    plan = heads.withColumn("inside", inside).join(F.broadcast(above), F.col("bucket") == F.col("top_"), "left")
    plan = plan.select(F.col("bucket").alias("b_"), F.coalesce("inside", "above").alias("target"), F.col("head.doc_id").alias("head_id"), F.col("head.tie").alias("head_tie"))
    joined = dealt.join(F.broadcast(plan) if few else plan, F.col("bucket") == F.col("b_"), "left")
    is_head = F.col("doc_id").eqNullSafe(F.col("head_id")) & (F.col("tie") == F.col("head_tie"))
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("halo"))
    spread = F.when(is_head, F.array(own, F.struct(F.col("target").alias("bucket"), F.lit(True).alias("halo")))).otherwise(F.array(own))
    spread = joined.select("doc_id", "tie", "text", F.explode(spread).alias("s")).select("s.bucket", "s.halo", "doc_id", "tie", "text")
    order = Window.partitionBy("bucket").orderBy("halo", F.desc_nulls_last("doc_id"), F.desc("tie"))
    return spread.select("bucket", F.row_number().over(order).alias("turn"), "halo", "doc_id", "text", F.lead("text").over(order).alias("next"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: n_chars, edited_sha256, fp, edited_fp and next_fp.

    Null texts are empty ones; an empty text has the fingerprint 0. Rows of one doc_id and text are the
    same place in the order; each of them has a row.
    """
    rows = with_next(docs.select("doc_id", text_or_empty().alias("text")))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.left("text", n - half), F.left(F.coalesce("next", F.lit("")), half))
    rows = rows.select("bucket", "turn", "halo", "doc_id", "text", n.cast("long").alias("n_chars"), edited.alias("edited"))
    both = F.array(
        F.struct(F.lit(0).alias("kind"), F.col("text").alias("text"), F.unhex(F.sha2("edited", 256)).alias("sha")),
        F.struct(F.lit(1).alias("kind"), F.col("edited").alias("text"), F.unhex(F.lit("")).alias("sha")),
    )
    both = F.when(F.col("halo"), F.slice(both, 1, 1)).otherwise(both)
    texts = rows.select("bucket", "turn", "halo", "doc_id", "n_chars", F.explode(both).alias("t")).select("bucket", "turn", "halo", "doc_id", "n_chars", "t.kind", "t.sha", "t.text")
    keys = ["bucket", "turn", "halo", "doc_id", "n_chars", "kind", "sha"]
    found = votes(texts, keys)
    found = found.groupBy("bucket", "turn", "halo", "doc_id", "n_chars").agg(
        F.max(F.when(F.col("kind") == 0, F.struct("fp", "sha"))).alias("own"), F.max(F.when(F.col("kind") == 1, F.col("fp"))).alias("edited_fp")
    )
    found = found.withColumn("next_fp", F.lead("own.fp").over(Window.partitionBy("bucket").orderBy("turn")))
    return found.where("not halo").select("doc_id", "n_chars", F.lower(F.hex("own.sha")).alias("edited_sha256"), "own.fp", "edited_fp", "next_fp")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``n_near`` counts the documents within ``RADIUS`` bits of each query (doc_id divisible by 100), itself included."""
    found = cut(fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text")))
    queries = found.where("doc_id % 100 = 0")
    near = within_radius(queries, found).withColumnRenamed("fp", "near_fp")
    asked = queries.select(F.col("doc_id").alias("q_id"), F.col("fp").alias("q_fp")).distinct().join(near, F.col("q_fp") == F.col("near_fp"))
    joined = found.join(asked.select("q_id", "q_fp", "near"), (F.col("doc_id") == F.col("q_id")) & (F.col("fp") == F.col("q_fp")), "left")
    return joined.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        hexed(F.col("fp")).alias("fingerprint"),
        hexed(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
        F.col("near").alias("n_near"),
    )
