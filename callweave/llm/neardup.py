"""Near-duplicate documents by SetSketch registers.

Each distinct shingle set gets registers: every element has a stream of exponential arrival times,
each at a random register, a register keeps its first arrival, truncated to an exponentially spaced
integer scale. Only arrivals before a bound that fills all registers are made, so the cost is that of
one hash an element. Registers merge by maximum, and equal registers of two sets are as likely as
their Jaccard similarity. Bands of registers give buckets, buckets give candidate clusters. In a
cluster the joint likelihood of the registers (given both set sizes) excludes pairs that cannot
reach the threshold; the others are verified on their full sets. Clusters too large for a task fall apart
into their buckets, so that chance meetings of weakly similar sets don't chain into one large comparison.

Exact copies of a set are one class, represented by the smallest id. Clusters of bounded size are
verified in one task each. Larger ones are never brought together: a leader is chosen, all members
are compared with it alone, and from then on only their symmetric differences to the leader matter,
because |a^b| = |(a^l)^(b^l)|. Two members that the leader doesn't connect need a minimum of shared
difference elements, so that the rarest differences (a prefix that must hit any partner) form
smaller groups, which are verified or divided again in the same way. No link is lost there, and no
group's pairs are emitted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.llm.common import connected_components, cut, discard, frugal, hold, release, small_batches, table, text_or_empty
from callweave.llm.shingles import mix, shingle_sets

BANDS, ROWS = 36, 5
REGISTERS = BANDS * ROWS
BASE = 1.001
#: Similarity at which documents are linked, in hundredths, unless a caller names another.
THRESHOLD = 80
#: The registered query's own threshold.
OP3_THRESHOLD = 85
#: Largest cluster verified in one task: members, and elements of all their sets, where eight bytes of text count as one at least.
GROUP_ROWS, GROUP_ELEMENTS = 1024, 2_000_000
#: A pair is excluded where the threshold's likelihood is below the best one's by this many nats.
NATS = 20.0
#: Bytes of text whose arrays are made at once; their arrivals take some hundred times that.
CHUNK_BYTES = 1 << 17

_TURN = np.uint64(0x9E3779B97F4A7C15)
_BURST = 16


def _arrivals(h: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Waiting time of the k-th arrival of elements, and its register."""
    x = mix(h[:, None] + (k[None, :] + np.uint64(1)) * _TURN)
    u = ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
    return -np.log(u) / REGISTERS, ((x & np.uint64(2047)) * np.uint64(REGISTERS) >> np.uint64(11)).astype(np.int64)


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, REGISTERS) unsigned 16-bit registers; zeros for an empty set."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    first = np.full((len(sets), REGISTERS), np.inf)
    flat = first.reshape(-1)
    todo = np.flatnonzero(sizes)
    bound = np.zeros(len(sets))
    bound[todo] = (np.log(REGISTERS) + 3) / sizes[todo]
    while len(todo):
        h = np.concatenate([sets[i] for i in todo])
        owner = np.repeat(todo, sizes[todo])
        time, spot = _arrivals(h, np.zeros(1, np.uint64))
        time, spot = time[:, 0], spot[:, 0]
        live = time < bound[owner]
        h, owner, time, spot = h[live], owner[live], time[live], spot[live]
        np.minimum.at(flat, owner * REGISTERS + spot, time)
        k = 1
        while len(h):
            wait, spot = _arrivals(h, np.arange(k, k + _BURST, dtype=np.uint64))
            times = time[:, None] + np.cumsum(wait, axis=1)
            inside = times < bound[owner][:, None]
            np.minimum.at(flat, ((owner * REGISTERS)[:, None] + spot)[inside], times[inside])
            live = inside[:, -1]
            h, owner, time = h[live], owner[live], times[live, -1]
            k += _BURST
        todo = todo[np.isinf(first[todo]).any(axis=1)]
        bound[todo] *= 2
    scale = np.clip(np.floor(3000 - np.log(np.where(np.isinf(first), 1, first)) / np.log(BASE)), 1, 65535)
    return np.where(np.isinf(first), 0, scale).astype(np.uint16)


def band_keys(regs: np.ndarray) -> np.ndarray:
    """One 64-bit key per band; the band's number is part of it."""
    bands = regs.reshape(len(regs), BANDS, ROWS).astype(np.uint64)
    keys = np.zeros((len(regs), BANDS), np.uint64) + np.arange(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        keys = mix(keys * _TURN + bands[:, :, r])
    return keys.view(np.int64)


def possible(regs: np.ndarray, sizes: np.ndarray, one: int, others: np.ndarray, threshold: int = THRESHOLD) -> np.ndarray:
    """Which of ``others`` may reach the threshold with ``one``, by the joint likelihood of the registers.

    In the similarity j, the likelihood's logarithm is same * log(j) + more * log(a - b * j) + less * log(b - a * j)
    and a constant. It is concave, so that its maximum is a root of a quadratic, and the best value from
    the threshold on is at the larger of the two.
    """
    a, b = float(sizes[one]), sizes[others].astype(float)
    fits = 100 * np.minimum(a, b) >= threshold * np.maximum(a, b)
    others, b = others[fits], b[fits]
    if not len(others):
        return others
    theirs = regs[others]
    same = np.count_nonzero(theirs == regs[one], axis=1)
    more = np.count_nonzero(theirs < regs[one], axis=1)
    less = REGISTERS - same - more
    ratio = a / b
    slope = same * (ratio + 1 / ratio) + more / ratio + less * ratio
    best = 2 * same / (slope + np.sqrt(np.maximum(slope * slope - 4.0 * REGISTERS * same, 0)))
    log = lambda x: np.log(np.maximum(x, 1e-9))
    score = lambda j: same * log(j) + more * log((a - b * j) / (a + b)) + less * log((b - a * j) / (a + b))
    return others[score(np.maximum(best, threshold / 100 - 0.005)) >= score(best) - NATS]


def linked(sizes_a, sizes_b, difference, threshold: int = THRESHOLD):
    """100 * intersection >= threshold * union, from set sizes and the size of the symmetric difference."""
    return (100 - threshold) * (sizes_a + sizes_b) >= (100 + threshold) * difference


def _postings(sets: list[np.ndarray], lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of all elements in the sets' order, the sets that hold each element, one element after the other, and how many do."""
    flat = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    turn = np.argsort(flat, kind="stable").astype(np.int32)
    flat = flat[turn]
    first = np.ones(len(flat), bool)
    first[1:] = flat[1:] != flat[:-1]
    del flat
    inverse = np.empty(len(turn), np.int32)
    inverse[turn] = np.cumsum(first, dtype=np.int32) - 1
    counts = np.diff(np.append(np.flatnonzero(first), len(turn)))
    return inverse, np.repeat(np.arange(len(sets), dtype=np.int32), lengths)[turn], counts


def links_in_group(ids: list, sizes: np.ndarray, sets: list[np.ndarray], regs: np.ndarray | None, threshold: int = THRESHOLD) -> list[tuple]:
    """Links that span the connected members of one bounded group; ``sets`` may be differences to a leader.

    Members that are connected already aren't compared again.
    """
    k = len(ids)
    lengths = np.fromiter(map(len, sets), np.int64, k)
    inverse, by_element, counts = _postings(sets, lengths)
    begin = np.cumsum(counts) - counts
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    part = np.arange(k)
    out = []
    for i in range(k - 1):
        others = i + 1 + np.flatnonzero(part[i + 1 :] != part[i])
        if regs is not None and len(others):
            others = possible(regs, sizes, i, others, threshold)
        if not len(others):
            continue
        own = inverse[bounds[i] : bounds[i + 1]]
        n = counts[own]
        at = np.repeat(begin[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        shared = np.bincount(by_element[at], minlength=k)[others]
        for j in others[linked(sizes[i], sizes[others], lengths[i] + lengths[others] - 2 * shared, threshold)].tolist():
            if part[i] != part[j]:
                part[part == part[j]] = part[i]
                out.append((ids[i], ids[j]))
    return out


def _encoded(texts: list) -> Iterator[list[bytes]]:
    """The texts as UTF-8 in lists of ``CHUNK_BYTES`` at most, unless one text alone is longer; what is no text is empty."""
    part, size = [], 0
    for t in texts:
        raw = t.encode() if isinstance(t, str) else b""
        if part and size + len(raw) > CHUNK_BYTES:
            yield part
            part, size = [], 0
        part.append(raw)
        size += len(raw)
    if part:
        yield part


def sketch(docs: DataFrame) -> DataFrame:
    """``doc_id`` of ``docs(doc_id, text)`` with its bytes, n_shingles, a 128-bit signature of the set and the band keys."""

    @F.pandas_udf("n long, s1 long, s2 long, bands array<long>")
    @frugal
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for raw in _encoded(texts.tolist()):
                sets = shingle_sets(raw)
                keys = band_keys(registers(sets))
                for own, bands in zip(sets, keys, strict=True):
                    x, y = mix(own), mix(own ^ _TURN)
                    s = np.array([x.sum(dtype=np.uint64), y.sum(dtype=np.uint64)], np.uint64).view(np.int64)
                    rows.append((len(own), int(s[0]), int(s[1]), bands if len(own) else []))
            yield pd.DataFrame(rows, columns=["n", "s1", "s2", "bands"])

    sized = docs.select("doc_id", F.octet_length(text_or_empty("text")).cast("long").alias("bytes"), run(text_or_empty("text")).alias("k"))
    return sized.select("doc_id", "bytes", "k.*")


def _small_links(groups: DataFrame, from_text: bool, threshold: int) -> DataFrame:
    """Links inside groups of bounded size, each verified in one task."""

    def verify(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc")
        if from_text:
            docs, texts = pdf["doc"].tolist(), pdf.pop("text").tolist()
            sets, regs = [], []
            for raw in _encoded(texts):  # arrays of arrivals are many times a set's size
                own = shingle_sets(raw)
                sets += own
                regs.append(registers(own))
            del texts
            sizes = np.fromiter(map(len, sets), np.int64, len(sets))
            found = links_in_group(docs, sizes, sets, np.concatenate(regs), threshold)
            if len(docs) > GROUP_ROWS // 8 or sizes.sum() > GROUP_ELEMENTS // 8:
                del sets, regs
                release()
        else:
            sets = [np.sort(np.asarray(d, np.int64).view(np.uint64)) for d in pdf["delta"]]
            found = links_in_group(pdf["doc"].tolist(), pdf["n"].to_numpy(), sets, None, threshold)
        return pd.DataFrame(found, columns=["a", "b"])

    # Few bytes may be much work: the groups are dealt over all partitions whatever their size.
    parts = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return groups.repartition(parts, "grp").groupBy("grp").applyInPandas(verify, "a long, b long")


def _divide(groups: DataFrame, threshold: int) -> tuple[DataFrame, DataFrame]:
    """One round over large groups(grp, doc, n, delta, score): links with the leaders, and the next groups."""
    leaders = groups.groupBy("grp").agg(F.max_by("doc", F.struct("score", -F.col("doc"))).alias("leader")).withColumnRenamed("grp", "x_grp")
    lead = groups.join(leaders, (F.col("grp") == F.col("x_grp")) & (F.col("doc") == F.col("leader"))).select(
        F.col("grp").alias("l_grp"), "leader", F.col("n").alias("l_n"), F.col("delta").alias("l_delta")
    )
    lead = lead.dropDuplicates(["l_grp"])
    rows = groups.join(lead, F.col("grp") == F.col("l_grp")).where("doc <> leader")
    rows = rows.withColumn("delta", F.concat(F.array_except("delta", "l_delta"), F.array_except("l_delta", "delta")))
    rows = rows.withColumn("d", F.size("delta").cast("long"))
    low, high = 100 - threshold, 100 + threshold
    rows = cut(rows.select("grp", "doc", "n", "delta", "d", "leader", "l_n", (low * (F.col("n") + F.col("l_n")) >= high * F.col("d")).alias("inside")))
    links = rows.where("inside").select(F.col("leader").alias("a"), F.col("doc").alias("b"))
    elements = rows.select("grp", "doc", F.explode("delta").alias("e"))
    shared = elements.groupBy("grp", "e").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    ordered = (
        elements.join(shared, ["grp", "e"])
        .groupBy("grp", "doc")
        .agg(F.sort_array(F.collect_list(F.struct("df", "e"))).alias("own"))
        .select(F.col("grp").alias("o_grp"), F.col("doc").alias("o_doc"), "own")
    )
    # The least overlap of differences that a partner not connected by the leader needs.
    most = low * (F.col("n") + F.col("n") * 100 / threshold) / high
    need = F.when(F.col("inside"), (F.col("d") + low * (F.col("l_n") - F.col("n")) / high) / 2).otherwise(F.col("d") - most)
    need = F.greatest(F.lit(1), F.ceil(need - 1e-6)).cast("int")
    rows = rows.join(ordered, (F.col("grp") == F.col("o_grp")) & (F.col("doc") == F.col("o_doc"))).withColumn("need", need)
    rows = rows.where("need <= size(own)").withColumn("e", F.explode(F.expr("slice(own, 1, size(own) - need + 1)")))
    following = rows.select(F.xxhash64("grp", "e.e").alias("grp"), "doc", "n", "delta", (-F.col("d")).alias("score"), "inside")
    live = following.groupBy("grp").agg(F.count(F.lit(1)).alias("m"), F.max(~F.col("inside")).alias("open")).where("m > 1 and open").select("grp")
    return links, following.join(live, "grp", "left_semi").drop("inside")


def _sized(groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups that one task may verify, and the larger ones."""
    elements = F.size("delta") if "delta" in groups.columns else F.col("n")
    sizes = groups.groupBy("grp").agg(F.count(F.lit(1)).alias("m"), F.sum(elements).alias("e"))
    large = sizes.where((F.col("m") > GROUP_ROWS) | (F.col("e") > GROUP_ELEMENTS)).select("grp")
    return groups.join(large, "grp", "left_anti"), groups.join(large, "grp", "left_semi")


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def _split_by_buckets(large: DataFrame, banded: DataFrame, buckets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members(grp, doc, n, score) of large clusters as groups of bounded size, and what must be divided further.

    Weakly similar sets meet in a bucket now and then, and such chance meetings may chain very many sets
    into one cluster. Any two sets that are compared share a bucket, so that the buckets themselves can
    be the groups. Only buckets too large for a task are still joined into clusters; a bucket whose
    members all lie in one such cluster is covered by it, and of buckets with equal members one is kept.
    """
    members = hold(banded.join(large.select(F.col("doc").alias("doc_id"), "score"), "doc_id").join(buckets, "key").select(F.col("key").alias("grp"), F.col("doc_id").alias("doc"), "n", "score", "least"))
    small, giant = _sized(members)
    giant = cut(giant)
    whole = connected_components(giant.select(F.col("doc").alias("a"), F.col("least").alias("b"))).select(F.col("id").alias("w_doc"), F.col("component").alias("whole"))
    small = cut(small.join(whole, F.col("doc") == F.col("w_doc"), "left").select("grp", "doc", "n", "score", "whole"))
    members.unpersist()
    h = F.xxhash64("doc")
    kept = small.groupBy("grp").agg(
        F.count(F.lit(1)).alias("m"), F.count("whole").alias("inside"), F.min("whole").alias("a"), F.max("whole").alias("b"), F.bit_xor(h).alias("x"), F.sum(h.cast("decimal(38,0)")).alias("y")
    )
    kept = kept.where("not (m = inside and a = b)").groupBy("m", "x", "y").agg(F.min("grp").alias("grp"))
    parts = small.join(kept.select("grp"), "grp", "left_semi").select("grp", "doc", "n", "score")
    clusters = large.drop("grp").join(whole, F.col("doc") == F.col("w_doc")).select(F.col("whole").alias("grp"), "doc", "n", "score")
    return parts, clusters


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, n_shingles, component_id, kept.

    Documents are linked from ``threshold`` hundredths of similarity on; below 80 the bands would miss pairs.
    Null and empty texts and texts without words have no shingles, link with nothing and are kept.
    Rows of equal doc_id are one node; rows of null doc_id link with nothing, have a null component
    and are kept.
    """
    with small_batches(docs.sparkSession):
        return _near_duplicates(docs.select("doc_id", "text"), threshold)


def _near_duplicates(docs: DataFrame, threshold: int) -> DataFrame:
    rows = cut(sketch(docs))
    known = rows.where("doc_id is not null and n > 0")
    classes = cut(known.groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("rep")))  # written, so that a hot class may be split in the join
    same_id = known.join(classes, ["n", "s1", "s2"]).where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    reps = classes.select(F.col("rep").alias("doc_id"), "n", "s1", "s2")
    # From here on n is the work of a member: a text of few shingles may still be long, and whole texts meet in a group.
    work = F.greatest("n", F.floor(F.col("bytes") / 8)).alias("n")
    banded = known.join(reps, ["doc_id", "n", "s1", "s2"], "left_semi").select("doc_id", work, F.explode("bands").alias("key"))
    banded = cut(banded)
    buckets = cut(banded.groupBy("key").agg(F.count_distinct("doc_id").alias("m"), F.min("doc_id").alias("least")).where("m > 1"))
    hits = hold(banded.join(buckets, "key").groupBy("doc_id", "least").agg(F.max("n").alias("n"), F.sum("m").alias("score")))
    clusters = connected_components(hits.select(F.col("doc_id").alias("a"), F.col("least").alias("b")))
    scored = hits.groupBy("doc_id").agg(F.max("n").alias("n"), F.sum("score").alias("score"))
    placed = hold(scored.join(clusters, F.col("doc_id") == F.col("id")).select(F.col("component").alias("grp"), F.col("doc_id").alias("doc"), "n", "score"))
    small, large = _sized(placed)
    large = cut(large)
    found = [small]
    if not large.isEmpty():
        parts, large = _split_by_buckets(large, banded, buckets)
        found.append(parts)
    hits.unpersist()
    texts = cut(_union(found).join(docs, F.col("doc") == F.col("doc_id")).select("grp", "doc", "text"))
    placed.unpersist()
    links = [_small_links(texts, True, threshold), same_id]

    @F.pandas_udf("array<long>")
    @frugal
    def full_set(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in batches:
            yield pd.Series([s.view(np.int64) for s in shingle_sets([t.encode() for t in part])])

    groups = large.join(docs, F.col("doc") == F.col("doc_id")).select("grp", "doc", full_set(text_or_empty("text")).alias("delta"), "score")
    groups = groups.select("grp", "doc", F.size("delta").cast("long").alias("n"), "delta", "score")
    rounds = []
    while True:
        groups = cut(groups)
        rounds.append(groups)
        if groups.isEmpty():
            break
        small, large = _sized(groups)
        links.append(cut(_small_links(small.select("grp", "doc", "n", "delta"), False, threshold)))
        star, groups = _divide(large, threshold)
        links.append(cut(star))
    edges = links[0]
    for more in links[1:]:
        edges = edges.unionByName(more)
    components = connected_components(edges).withColumnRenamed("id", "doc_id")
    discard(classes, banded, buckets, texts, *links[2:], *rounds)
    out = rows.select("doc_id", F.col("n").alias("n_shingles")).join(components, "doc_id", "left")
    own = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"))


def op3_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents at 85 hundredths; null and empty texts link with nothing."""
    return near_duplicates(table(spark, sf_dir, "documents"), OP3_THRESHOLD)
