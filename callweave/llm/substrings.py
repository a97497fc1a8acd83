"""Removal of byte strings of a given length that occur twice or more in the corpus, exactly.

Routing. Every window of ``length`` bytes holds cores of two fifths of its size; the one with the least hash is
its anchor, chosen by content alone, so that equal windows have equal anchors at equal places. Anchors
whose surroundings (all windows that are theirs, by 128-bit digest) occur again are settled by
counting. Others of the same core meet in blocks of bounded size, one row for each kind of surroundings.

Deciding. A block is one text: the bytes before and behind every anchor, the common core as one symbol
between them, each row closed by a separator of its own. Its suffixes are sorted, which gives the
Burrows-Wheeler transform and its rank mapping. Breadth-first backward extension starts at the interval
of all suffixes; the step for prefixes of ``k`` symbols gives the intervals of ``k + 1``, and a boundary
that shows up for the first time has the common prefix ``k``. Common prefixes are derived by increasing
value in this way, and expansion stops at the threshold: boundaries that are left join suffixes with at
least the wanted length in common. These comparisons are of bytes.

A core with more kinds of surroundings than a block takes is divided by ranges of the window's start,
with longer cores, until the kinds fit or the core is the window itself, where counting decides.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.llm.common import cut, discard, free_name, frugal, small_batches, table, text_or_empty
from callweave.llm.shingles import mix

#: Length of the strings that the registered query removes.
LENGTH = 400
#: A length that a passage of fifty words reaches; the pipeline removes strings of it.
PASSAGE = 250
#: Symbols meant for one block, and kinds of surroundings of one core before it is divided.
BLOCK_SYMBOLS, CORE_KINDS = 700_000, 1_000
#: Bytes hashed at a time; a longer text is taken in parts.
PART = 1 << 16
#: Bytes by which surroundings are compared before they enter a transform.
STEP = 16

_MASK = (1 << 64) - 1


def side_of(length: int) -> int:
    """Bytes around a core that windows may reach, on either side; the core has the rest of the length."""
    return length * 3 // 5


class _Rolling:
    """Hashes of any range of an array of bytes, by prefix sums modulo 2^64. They choose anchors and decide nothing."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.byte = rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
        self.base = int(rng.integers(1, 1 << 62)) * 8 + 5
        self.up = self.down = np.ones(1, np.uint64)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        if len(self.up) <= len(data):
            for name, base in (("up", self.base & _MASK), ("down", pow(self.base, -1, 1 << 64))):
                steps = np.full(len(data) + 1, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.byte[data] * self.up[: len(data)], out=out[1:], dtype=np.uint64)
        return out

    def ranges(self, prefix: np.ndarray, starts, stops) -> np.ndarray:
        return mix((prefix[stops] - prefix[starts]) * self.down[starts])


_CORES = _Rolling(11)


def _slide(x: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over x[i : i + width], for every full window."""
    size = 1
    while size * 2 <= width:
        x = pick(x[:-size], x[size:])
        size *= 2
    return x if size == width else pick(x[: len(x) - (width - size)], x[width - size :])


def anchors_of(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Anchors of texts joined in ``data``, each ending at ``ends``, with the windows that are theirs.

    A window's anchor is the first of its least cores, so that every window has one anchor, and the
    windows of an anchor are neighbours. Gives positions, bytes from the first window to the anchor
    and from the anchor to the last window's end, core hashes, and digests of all these bytes and of
    the anchor's place in them (two columns).
    """
    n, side = len(data), side_of(length)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, np.zeros(0, np.uint64), np.zeros((0, 2), np.int64)
    begins = np.concatenate([[0], ends[:-1]])
    prefix = _CORES.prefix(data)
    at = np.arange(n - (length - side) + 1)
    core = _CORES.ranges(prefix, at, at + (length - side))
    # The place is the low part of what is compared, so that the minimum tells the first of the least cores.
    bits = np.uint64(n.bit_length())
    place = (np.uint64(1) << bits) - np.uint64(1)
    least = _slide((core & ~place) | at.astype(np.uint64), side + 1, np.minimum)
    chosen = (least & place).astype(np.int64)
    size = ends - begins
    window = np.flatnonzero(np.arange(len(least)) + length <= np.repeat(ends, size)[: len(least)])
    pick = chosen[window]
    new = np.flatnonzero(np.concatenate([[True], (pick[1:] != pick[:-1]) | (window[1:] != window[:-1] + 1)])[: len(window)])
    pos, low = pick[new], window[new]
    high = window[np.concatenate([new[1:] - 1, [len(window) - 1]])[: len(new)]] + length
    raw, digest = data.tobytes(), hashlib.blake2b
    around = b"".join([digest(raw[a:b], digest_size=16).digest() for a, b in zip(low.tolist(), high.tolist(), strict=True)])
    around = np.frombuffer(around, "<i8").reshape(-1, 2).copy()
    around[:, 0] += pos - low
    return pos, pos - low, high - pos, core[pos], around


def _parts(size: int, length: int) -> Iterator[tuple[int, int, int, int]]:
    """Parts of a long text: bytes to read from and to, anchors to keep from and to."""
    for a in range(0, size, PART):
        yield max(0, a - length), min(size, a + PART + 2 * length), a, min(size, a + PART)


def _text_anchors(raws: Iterator[bytes], length: int) -> Iterator[tuple]:
    """Anchors of whole texts, in runs: index of the text, then as ``anchors_of``, positions within the text."""
    batch: list[tuple[int, bytes]] = []
    held = 0

    def run() -> tuple:
        ends = np.cumsum([len(raw) for _, raw in batch])
        pos, back, room, h, g = anchors_of(np.frombuffer(b"".join(raw for _, raw in batch), np.uint8), ends, length)
        which = np.searchsorted(ends, pos, side="right")
        return np.array([i for i, _ in batch])[which], pos - (ends - np.diff(ends, prepend=0))[which], back, room, h, g

    for i, raw in enumerate(raws):
        if len(raw) < length:
            continue
        if len(raw) > 2 * PART:
            for low, high, a, b in _parts(len(raw), length):
                pos, back, room, h, g = anchors_of(np.frombuffer(raw[low:high], np.uint8), np.array([high - low]), length)
                keep = np.flatnonzero((pos + low >= a) & (pos + low < b))
                yield np.full(len(keep), i), pos[keep] + low, back[keep], room[keep], h[keep], g[keep]
            continue
        batch.append((i, raw))
        held += len(raw)
        if held >= PART:
            yield run()
            batch, held = [], 0
    if batch:
        yield run()


def anchor_table(pieces: DataFrame, length: int) -> DataFrame:
    """``pieces(doc_id, v, at, raw)`` to anchors(doc_id, v, at, pos, back, room, h, g1, g2); ``pos`` counts from the piece's begin."""
    kind = pieces.schema["doc_id"].dataType

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = (t.as_buffer().to_pybytes() if t.is_valid else b"" for t in batch.column("raw"))
            for which, pos, back, room, h, g in _text_anchors(raws, length):
                rows = pa.array(which)
                columns = [batch.column(c).take(rows) for c in ("doc_id", "v", "at")]
                yield pa.RecordBatch.from_arrays(
                    [*columns, *(pa.array(x.astype(np.int32)) for x in (pos, back, room)), pa.array(h.view(np.int64)), pa.array(g[:, 0]), pa.array(g[:, 1])],
                    names=["doc_id", "v", "at", "pos", "back", "room", "h", "g1", "g2"],
                )

    return pieces.mapInArrow(run, f"doc_id {kind.simpleString()}, v long, at int, pos int, back int, room int, h long, g1 long, g2 long")


def _ordered(key: np.ndarray, bits: int) -> np.ndarray:
    """Stable order of keys of so many bits; a key and its place are sorted as one number where they fit."""
    place = len(key).bit_length()
    if bits + place > 63:
        return np.argsort(key, kind="stable")
    key = (key << place) | np.arange(len(key))
    key.sort()
    return key & ((1 << place) - 1)


def sorted_suffixes(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of ``text`` in the order of their first ``depth`` symbols or more, by doubling prefixes."""
    n, k = len(text), 1
    rank, most = text.astype(np.int64), int(text.max())
    while True:
        width = (most + 1).bit_length()
        following = np.zeros(n, np.int64)
        following[: n - k] = rank[k:] + 1
        key = (rank << width) | following
        order = _ordered(key, 2 * width)
        key = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))[:n]
        most = int(rank[order[-1]])
        k *= 2
        if k >= min(depth, n) or most == n - 1:
            return order


def common_prefixes(text: np.ndarray, order: np.ndarray, bound: int) -> np.ndarray:
    """Common prefix of the suffixes ``order[i - 1]`` and ``order[i]`` for every i, ``bound`` where it isn't shorter.

    The last symbol of ``text`` must be unique. Derived by increasing value: intervals of suffixes that
    share ``size`` symbols are extended backwards by every symbol before them, by the ranks of the
    transform; the end of an extended interval that no shorter prefix has set differs after ``size`` symbols.
    """
    n = len(text)
    before = text[order - 1]
    by_symbol = _ordered(before, int(before.max()).bit_length()).astype(np.int32)
    rank = np.empty(n, np.int32)
    rank[by_symbol] = np.arange(n, dtype=np.int32)
    same = before[by_symbol[1:]] == before[by_symbol[:-1]]
    previous, following = np.full(n, -1, np.int32), np.full(n, n, np.int32)
    previous[by_symbol[1:][same]] = by_symbol[:-1][same]
    following[by_symbol[:-1][same]] = by_symbol[1:][same]
    out = np.full(n + 1, bound, np.int32)
    out[[0, n]] = -1
    starts, stops = np.array([0], np.int32), np.array([n], np.int32)
    count = np.arange(n, dtype=np.int32)
    for size in range(bound):
        many = stops - starts
        reached = np.cumsum(many, dtype=np.int32)
        at = np.repeat(starts - (reached - many), many) + count[: reached[-1]]
        first = previous[at] < np.repeat(starts, many)
        last = following[at] >= np.repeat(stops, many)
        # Extended intervals don't overlap, so that their begins and their ends have one order.
        starts, stops = np.sort(rank[at[first]]), np.sort(rank[at[last]]) + 1
        fresh = out[stops] == bound
        starts, stops = starts[fresh], stops[fresh]
        if not len(starts):
            break
        out[stops] = size
    return out


def _matrix(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of bytes filled up with zeros to a common width, and their sizes."""
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    width = -(-max(int(sizes.max(initial=0)), 1) // STEP) * STEP
    return np.frombuffer(b"".join(r.ljust(width, b"\0") for r in rows), np.uint8).reshape(len(rows), width), sizes


def _reach(group: np.ndarray, rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How many leading bytes a row may share with another of its group, at most; compared by hashes of ``STEP`` bytes."""
    words = np.ascontiguousarray(rows).view("<u8")
    live, state, reach = np.arange(len(rows)), mix(group.astype(np.uint64) + np.uint64(1)), np.minimum(sizes, STEP - 1)
    for k in range(rows.shape[1] // STEP):
        live = live[sizes[live] >= (k + 1) * STEP]
        if not len(live):
            break
        now = mix(mix(state[live] + words[live, 2 * k]) + words[live, 2 * k + 1])
        state[live] = now
        _, code, counts = np.unique(now, return_inverse=True, return_counts=True)
        live = live[counts[code] > 1]
        reach[live] = np.minimum(sizes[live], (k + 2) * STEP - 1)
    return reach


def shared_windows(group: np.ndarray, before: list[bytes], after: list[bytes], need: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, step) of every window that another row of its group has too.

    A window begins ``step`` bytes before the group's core and takes ``need`` symbols, the core being
    one. ``before`` holds the bytes before the core, nearest first; ``after`` those behind it.
    """
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(group):
        return none
    _, group = np.unique(group, return_inverse=True)
    left, size_b = _matrix(before)
    right, size_a = _matrix(after)
    reach_b, reach_a = _reach(group, left, size_b), _reach(group, right, size_a)
    rows = np.flatnonzero((reach_b + reach_a + 1 >= need) & (np.bincount(group)[group] > 1))
    if len(rows) < 2:
        return none
    size_b, size_a, n = reach_b[rows], reach_a[rows], len(rows)
    total = size_b + size_a + 2
    ends = np.cumsum(total)
    row = np.repeat(np.arange(n), total)
    place = np.arange(ends[-1]) - (ends - total)[row] - size_b[row]  # 0 at the core
    first_byte = n + int(group.max()) + 1
    text = np.where(place > size_a[row], row, n + group[rows][row])
    b, a = place < 0, (place > 0) & (place <= size_a[row])
    text[b] = left[rows[row[b]], -place[b] - 1] + np.int64(first_byte)
    text[a] = right[rows[row[a]], place[a] - 1] + np.int64(first_byte)
    bound = int(need[rows].max())
    order = sorted_suffixes(text, bound)
    prefix = common_prefixes(text, order, bound)
    row, step = row[order], -place[order]
    found = np.flatnonzero((step >= 0) & (np.maximum(prefix[:-1], prefix[1:]) >= need[rows[row]]))
    row, step = rows[row[found]], step[found]
    turn = np.lexsort((step, row))
    return row[turn], step[turn]


def _resolve(rows: DataFrame, schema: str, length: int) -> DataFrame:
    """Spans of single rows of ``rows(block, key, doc_id, v, pos, single, low, high, before, after)``.

    The core of a row takes in ``low`` bytes before it and ``side - high`` behind it.
    """
    side = side_of(length)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        low, high = pdf["low"].to_numpy(), pdf["high"].to_numpy()
        before = [b[p:q] for b, p, q in zip(pdf["before"], low.tolist(), high.tolist(), strict=True)]
        after = [a[p:q] for a, p, q in zip(pdf["after"], (side - high).tolist(), (side - low).tolist(), strict=True)]
        row, step = shared_windows(pd.factorize(pdf["key"])[0], before, after, high - low + 1)
        keep = pdf["single"].to_numpy()[row] if len(row) else np.zeros(0, bool)
        row, step = row[keep], step[keep]
        new = np.concatenate([[True], (row[1:] != row[:-1]) | (step[1:] != step[:-1] + 1)])[: len(row)]
        first = np.flatnonzero(new)
        last = np.concatenate([first[1:], [len(row)]])[: len(first)] - 1
        out = pdf.iloc[row[first]][["doc_id", "v"]].reset_index(drop=True)
        origin = pdf["pos"].to_numpy()[row[first]] - low[row[first]]
        out["start"], out["stop"] = origin - step[last], origin - step[first] + length
        return out

    return rows.groupBy("block").applyInPandas(run, schema)


def repeated_spans(pieces: DataFrame, length: int) -> DataFrame:
    """Spans (doc_id, v, start, stop) of ``pieces(doc_id, v, at, raw)`` whose union is what occurs again.

    ``at`` is where a piece begins in its text; spans count from the begin of the text.
    """
    side = side_of(length)
    id_type = pieces.schema["doc_id"].dataType.simpleString()
    span = f"doc_id {id_type}, v long, start int, stop int"
    own_id = ["doc_id", "v", "at", "pos", "back", "room"]
    with small_batches(pieces.sparkSession):
        anchors = cut(anchor_table(pieces, length))
    # What is counted is written before it joins back, so that rows of a hot anchor can be split in the join.
    again = cut(anchors.groupBy("h").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("h"))
    rows = cut(anchors.join(again.hint("shuffle_hash"), "h", "left_semi"))
    discard(anchors, again)
    # Any row may stand for its kind; all columns come of the same one.
    kinds = cut(rows.groupBy("g1", "g2").agg(F.count(F.lit(1)).alias("m"), *[F.first(c).alias(c) for c in ("h", *own_id)]))
    whole = rows.join(kinds.where("m > 1").select("g1", "g2"), ["g1", "g2"], "left_semi")
    settled = cut(whole.select("doc_id", "v", (F.col("at") + F.col("pos") - F.col("back")).alias("start"), (F.col("at") + F.col("pos") + F.col("room")).alias("stop")))
    open_ = cut(kinds.groupBy("h").agg(F.count(F.lit(1)).alias("k"), F.min("m").alias("least")).where("k > 1 and least = 1").select("h"))
    edges = kinds.join(open_, "h", "left_semi").select((F.col("m") == 1).alias("single"), *own_id)
    per_doc = edges.groupBy("doc_id", "v", "at").agg(F.collect_list(F.struct("pos", "back", "room", "single")).alias("own"))

    @F.pandas_udf("array<struct<key:binary,before:binary,after:binary>>")
    def sides(raws: pd.Series, own: pd.Series) -> pd.Series:
        out = []
        for raw, places in zip(raws, own, strict=True):
            rows = []
            for e in places:
                a, b = e["pos"], e["pos"] + length - side
                rows.append({"key": hashlib.blake2b(raw[a:b], digest_size=16).digest(), "before": raw[a - e["back"] : a][::-1], "after": raw[b : a + e["room"]]})
            out.append(rows)
        return pd.Series(out)

    other = per_doc.select(F.col("doc_id").alias("e_id"), F.col("v").alias("e_v"), F.col("at").alias("e_at"), "own")
    same = F.col("e_id").eqNullSafe(F.col("doc_id")) & (F.col("e_v") == F.col("v")) & (F.col("e_at") == F.col("at"))
    found = pieces.where(F.octet_length("raw") >= length).join(other.hint("shuffle_hash"), same)
    found = found.select("doc_id", "v", "at", F.inline(F.arrays_zip("own", sides("raw", "own").alias("sides"))))
    found = found.select("doc_id", "v", (F.col("at") + F.col("own.pos")).alias("pos"), "own.single", "sides.*")
    with small_batches(pieces.sparkSession):
        pending = cut(found.withColumns({"low": F.lit(0), "high": F.lit(side)}))
    discard(rows, kinds, open_)
    spans = [settled]
    while True:
        counts = cut(pending.groupBy("key").agg(F.count(F.lit(1)).alias("k")).where("k > 1"))
        total = counts.agg(F.coalesce(F.sum(F.when(F.col("k") <= CORE_KINDS, F.col("k"))), F.lit(0)), F.coalesce(F.max("k"), F.lit(0))).first()
        live = pending.join(counts, "key")
        block = F.pmod(F.xxhash64("key"), F.lit(max(1, -(-total[0] * (2 * side + 2) // BLOCK_SYMBOLS))))
        spans.append(cut(_resolve(live.where(F.col("k") <= CORE_KINDS).drop("k").withColumn("block", block), span, length)))
        if total[1] <= CORE_KINDS:
            discard(pending, counts)
            break
        more, following = _divide(live.where(F.col("k") > CORE_KINDS).drop("k"), length)
        spans.append(more)
        discard(pending, counts)
        pending = following
    out = spans[0]
    for s in spans[1:]:
        out = out.unionByName(s)
    return out


def _divide(large: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """Halve the steps of cores with many kinds: spans settled by counting, and the rows of the next round."""
    side = side_of(length)
    middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
    halves = large.withColumn("half", F.explode(F.array(F.struct(F.col("low").alias("a"), middle.alias("b")), F.struct((middle + 1).alias("a"), F.col("high").alias("b")))))
    halves = halves.where("half.a <= half.b and length(before) >= half.a and length(after) >= %d - half.b" % side)
    core = F.sha2(F.concat("key", F.encode(F.concat_ws(":", "half.a", "half.b"), "utf-8"), F.expr("substring(before, 1, half.a)"), F.expr(f"substring(after, 1, {side} - half.b)")), 256)
    rows = halves.select(
        F.substring(F.unhex(core), 1, 16).alias("key"),
        "doc_id",
        "v",
        "pos",
        "single",
        F.col("half.a").alias("low"),
        F.col("half.b").alias("high"),
        F.expr("substring(before, 1, half.b)").alias("before"),
        F.expr(f"substring(after, 1, {side} - half.a)").alias("after"),
    )
    rows = cut(rows)
    kinds = rows.groupBy("key", "low", "high", "before", "after").agg(F.count(F.lit(1)).alias("m"), F.max(F.struct("single", "doc_id", "v", "pos")).alias("one"))
    kinds = cut(kinds)
    settled = rows.where("single").join(kinds.where("m > 1").select("key", "before", "after"), ["key", "before", "after"], "left_semi")
    # All windows that lie in the bytes at hand: from the farthest to the nearest step possible.
    first = F.least(F.col("high"), F.length("before"))
    last = F.greatest(F.col("low"), side - F.length("after"))
    spans = cut(settled.where(first >= last).select("doc_id", "v", (F.col("pos") - first).alias("start"), (F.col("pos") - last + length).alias("stop")))
    following = cut(
        kinds.select("key", "one.doc_id", "one.v", "one.pos", (F.col("one.single") & (F.col("m") == 1)).alias("single"), "low", "high", "before", "after")
    )
    discard(rows, kinds)
    return spans, following


def _merged(own, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the maximal runs that spans cover."""
    ranges = np.array([(s["start"], s["stop"]) for s in own], np.int64).clip(0, size)
    ranges = ranges[np.argsort(ranges[:, 0], kind="stable")]
    reach = np.maximum.accumulate(ranges[:, 1])
    first = np.flatnonzero(np.concatenate([[True], ranges[1:, 0] > reach[:-1]]))
    return ranges[first, 0], reach[np.concatenate([first[1:] - 1, [len(reach) - 1]])]


def _per_text(spans: DataFrame, near: DataFrame | None = None) -> DataFrame:
    """(s_id, s_v, own, near): spans of every text, as two arrays."""
    rows = spans.withColumn("own", F.lit(True))
    if near is not None:
        rows = rows.unionByName(near.withColumn("own", F.lit(False)))
    place = F.struct("start", "stop")
    lists = [F.collect_list(F.when(F.col("own") == own, place)).alias(name) for own, name in ((True, "own"), (False, "near"))]
    return rows.groupBy(F.col("doc_id").alias("s_id"), F.col("v").alias("s_v")).agg(*lists)


def _whole(docs: DataFrame, text: str) -> DataFrame:
    """Texts as pieces(doc_id, v, at, raw), nulls empty."""
    raw = text_or_empty(text)
    return docs.select("doc_id", F.xxhash64(raw).alias("v"), F.lit(0).alias("at"), F.encode(raw, "utf-8").alias("raw"))


def _runs(pieces: DataFrame, spans: DataFrame, length: int) -> DataFrame:
    """The maximal runs of at least ``length`` bytes that ``spans`` cover, as pieces."""

    @F.pandas_udf("array<struct<at:int,raw:binary>>")
    @frugal
    def take(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for raws, own in batches:
            out = []
            for raw, s in zip(raws, own, strict=True):
                out.append([{"at": a, "raw": raw[a:b]} for a, b in zip(*(x.tolist() for x in _merged(s, len(raw))), strict=True) if b - a >= length])
            yield pd.Series(out)

    texts = pieces.where(F.octet_length("raw") >= length).drop("at")
    joined = texts.join(_per_text(spans).hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("s_id")) & (F.col("v") == F.col("s_v")))
    return joined.select("doc_id", "v", F.inline(take("raw", "own"))).select("doc_id", "v", "at", "raw")


def remove_repeats(docs: DataFrame, text: str = "text", length: int = LENGTH, passage: int | None = None) -> DataFrame:
    """``docs`` with a struct column ``cleaned``: n_bytes, n_removed, n_spans, n_shared and the bytes ``kept``.

    Strings of ``length`` bytes that occur twice or more are removed. With a shorter ``passage``,
    ``n_shared`` counts the bytes covered by strings of that length which occur again (they stay); every
    longer repeat lies in their runs, which alone are searched for it. Otherwise it equals n_removed.
    A text shorter than ``length``, null or empty loses nothing. Repeated rows count as copies, so that
    both lose what they share. ``docs`` must have doc_id; a null doc_id is a document like others. A
    string that repeats inside one text counts. There are no ties: all copies go.
    """
    pieces = _whole(docs, text)
    if passage is None or passage >= length:
        both = _per_text(repeated_spans(pieces, length))
    else:
        near = repeated_spans(pieces, passage)
        with small_batches(docs.sparkSession):
            runs = cut(_runs(pieces, near, length))
        spans = repeated_spans(runs, length)
        discard(runs)
        both = _per_text(spans, near)

    names = ["n_bytes", "n_removed", "n_spans", "n_shared", "kept"]

    @F.pandas_udf("n_bytes long, n_removed long, n_spans long, n_shared long, kept binary")
    @frugal
    def strip(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, own, near in batches:
            rows, held = [], 0
            for t, a, b in zip(texts, own, near, strict=True):
                rows.append(_strip_one(t.encode(), a, b))
                held += len(t)
                if held > 32 * PART:
                    yield pd.DataFrame(rows, columns=names)
                    rows, held = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=names)

    v, s_id, s_v, own, near = (free_name(docs, x) for x in ("v_", "s_id_", "s_v_", "own_", "near_"))
    keyed = docs.withColumn(text, text_or_empty(text)).withColumn(v, F.xxhash64(text_or_empty(text)))
    both = both.select(F.col("s_id").alias(s_id), F.col("s_v").alias(s_v), F.col("own").alias(own), F.col("near").alias(near))
    joined = keyed.join(both.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col(s_id)) & (F.col(v) == F.col(s_v)), "left")
    return joined.withColumn(free_name(docs, "cleaned"), strip(text, own, near)).drop(own, near, s_id, s_v, v)


def _strip_one(raw: bytes, own, near) -> tuple[int, int, int, int, bytes]:
    starts = stops = np.zeros(0, np.int64)
    if own is not None and len(own):
        starts, stops = _merged(own, len(raw))
    removed = shared = int((stops - starts).sum())
    if near is not None and len(near):
        a, b = _merged(near, len(raw))
        shared = int((b - a).sum())
    kept = b"".join(raw[a:b] for a, b in zip([0, *stops.tolist()], [*starts.tolist(), len(raw)], strict=True))
    return len(raw), removed, len(starts), shared, kept


def decoded(column: str) -> Column:
    """Text of kept bytes; bytes of a character that was cut are left out (and replacement characters with them)."""
    return F.regexp_replace(F.make_valid_utf8(F.col(column).cast("string")), "\ufffd", "")


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removal of 400-byte repeats; ``n_shared`` counts bytes in repeats of ``PASSAGE`` bytes, which stay."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = remove_repeats(docs, passage=PASSAGE)
    return found.select("doc_id", "cleaned.n_bytes", "cleaned.n_removed", "cleaned.n_spans", F.sha2("cleaned.kept", 256).alias("kept_sha256"), "cleaned.n_shared")
