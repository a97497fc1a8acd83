"""Best-fit packing by bin completion over the histogram of piece lengths.

Lengths are integers up to the capacity, so that the problem is fully described by at most
``capacity`` counts, whatever the number of pieces. Only these counts reach the driver. There,
best-fit decreasing gives the first incumbent. If it is above the lower bound, bin completion
searches: around the largest length left it enumerates the undominated fillings, takes them by
growing waste and repeats each as often as the counts allow; a branch ends when its waste exceeds
what an improvement on the incumbent may waste. The result is a short list of patterns with
multiplicities. Pieces then find their place by their rank among pieces of equal length: ranks come
from salted windows and prefix sums over (length, salt), so that a length that holds most rows is
dealt out too, and the pattern list is joined by broadcast (its size is bounded by the capacity).
"""

from __future__ import annotations

import functools
import math
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from callweave.llm import bpe
from callweave.llm.common import cut, free_name, frugal, small_batches, table, text_or_empty

CAPACITY = 1024
END_ID = 2
#: Ids after which a task hands its rows on.
FLUSH_IDS = 1 << 20
#: Ways to order fillings, tried in turn.
EASE = (0, 4, 8, 2, 16)
#: Steps after which the sums of what is left are computed anew, and pieces of fillings tested for dominance.
RENEW, TESTED = 64, 6
#: Steps of an enumeration of fillings that a search has for each length.
STEPS = 1000

Pattern = tuple[tuple[int, int], ...]  # (length, how often), longest first


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Martello and Toth's second bound, over all thresholds."""
    sizes = sorted(counts)
    best = math.ceil(sum(s * n for s, n in counts.items()) / capacity)
    for t in [s for s in sizes if 2 * s <= capacity]:
        big = sum(n for s, n in counts.items() if s > capacity - t)
        half = [(s, n) for s, n in counts.items() if capacity - t >= s and 2 * s > capacity]
        rest = sum(s * n for s, n in counts.items() if 2 * s <= capacity and s >= t)
        room = sum((capacity - s) * n for s, n in half)
        best = max(best, big + sum(n for _, n in half) + max(0, math.ceil((rest - room) / capacity)))
    return max(best, sum(n for s, n in counts.items() if 2 * s > capacity))


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing over runs of equal bins: (pattern, number of bins)."""
    bins: dict[tuple[int, Pattern], int] = {}

    def add(room: int, pattern: Pattern, many: int) -> None:
        if many:
            bins[room, pattern] = bins.get((room, pattern), 0) + many

    for size in sorted(counts, reverse=True):
        left = counts[size]
        for room, pattern in sorted(k for k in bins if k[0] >= size):
            if not left:
                break
            have, per = bins.pop((room, pattern)), room // size
            full = min(have, left // per)
            add(room - per * size, (*pattern, (size, per)), full)
            left, have = left - full * per, have - full
            if have and left:
                add(room - left * size, (*pattern, (size, left)), 1)
                left, have = 0, have - 1
            add(room, pattern, have)
        per = capacity // size
        add(capacity - per * size, ((size, per),), left // per)
        if left % per:
            add(capacity - left % per * size, ((size, left % per),), 1)
    return [(p, n) for (_, p), n in bins.items()]


def _dominates(big: tuple[int, ...], small: tuple[int, ...]) -> bool:
    """Whether the items of ``small`` fit, in groups, into the items of ``big`` as if these were bins."""
    if not small:
        return True
    first, rest = small[0], small[1:]
    tried = set()
    for k, room in enumerate(big):
        if room >= first and room not in tried:
            tried.add(room)
            if _dominates((*big[:k], room - first, *big[k + 1 :]), rest):
                return True
    return False


class _Stock:
    """Pieces that are left, and the sums that they can make; sums may be stale, but only on the large side."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.left, self.capacity, self.age = dict(counts), capacity, RENEW
        self.steps = STEPS * len(counts)
        self.sizes: list[int] = []
        self.sums: list[int] = []

    def take(self, pattern: Pattern, many: int) -> None:
        for s, k in pattern:
            self.left[s] -= k * many
        self.age = RENEW if many < 0 else self.age + 1  # what comes back makes the sums too small

    def renew(self) -> None:
        if self.age < RENEW:
            return
        self.age = 0
        self.sizes = sorted((s for s, n in self.left.items() if n), reverse=True)
        made, full, sums = 1, (1 << self.capacity + 1) - 1, [1]
        for s in reversed(self.sizes):
            n, step = min(self.left[s], self.capacity // s), 1
            while n > 0:
                step = min(step, n)
                made |= made << step * s
                n -= step
                step *= 2
            made &= full
            sums.append(made)
        self.sums = sums[::-1]  # sums[k]: what pieces of sizes[k:] can make

    def fill(self, room: int) -> Iterator[Pattern]:
        """Selections that fill ``room`` exactly, those with the largest pieces first."""
        sizes, sums = self.sizes, self.sums  # of now: when the iteration goes on, what is left is what was left

        def rest(k: int, room: int) -> Iterator[Pattern]:
            if room == 0:
                yield ()
                return
            k = max(k, bisect_left(sizes, -room, key=lambda s: -s))
            while k < len(sizes) and sums[k] >> room & 1 and self.steps > 0:
                self.steps -= 1
                s = sizes[k]
                for n in range(min(self.left[s], room // s), 0, -1):
                    if sums[k + 1] >> room - n * s & 1:
                        for more in rest(k + 1, room - n * s):
                            yield ((s, n), *more)
                k += 1

        return rest(0, room)

    def fill_by_few(self, room: int, easy: int) -> Iterator[tuple[int, Pattern]]:
        """(waste, selection) of at most two pieces that leave no more than ``easy``: one piece first, then pieces of like size."""
        if room <= easy:
            yield room, ()
        for waste in range(min(easy, room - 1) + 1):
            if self.left.get(room - waste):
                yield waste, ((room - waste, 1),)
        sizes = self.sizes
        for waste in range(min(easy, room - 1) + 1):
            for k in range(bisect_right(sizes, -(room - waste) / 2, key=lambda s: -s) - 1, -1, -1):
                a, b = sizes[k], room - waste - sizes[k]
                if b <= 0:
                    break
                if self.left[a] and self.left.get(b, 0) > (a == b):
                    yield waste, (((a, 1), (b, 1)) if a != b else ((a, 2),))


def fillings(stock: _Stock, room: int, most_waste: int, easy: int = 0) -> Iterator[tuple[int, Pattern]]:
    """Undominated maximal fillings of ``room`` with pieces at hand: (waste, pattern).

    First come those of at most two pieces that waste no more than ``easy``: they keep small pieces for
    rooms that nothing else fills. Then all others follow, lazily, by growing waste. Dominance is tested
    against earlier fillings of few pieces; a filling that isn't tested stays, which loses nothing.
    """
    few: list[tuple[int, ...]] = []
    least = stock.sizes[-1] if stock.sizes else room + 1

    def new(waste: int, pattern: Pattern) -> bool:
        if waste >= least:
            used = dict(pattern)
            if any(s <= waste and n > used.get(s, 0) for s, n in stock.left.items()):
                return False
        items = tuple(s for s, n in pattern for _ in range(n))
        if len(items) <= TESTED:
            if any(_dominates(b, items) for b in few):
                return False
            few.append(items)
        return True

    most_waste = min(most_waste, room)
    every = ((waste, pattern) for waste in range(most_waste + 1) for pattern in stock.fill(room - waste))
    for waste, pattern in chain(stock.fill_by_few(room, min(easy, most_waste)) if easy else (), every):
        if new(waste, pattern):
            yield waste, pattern


def bin_completion(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[Pattern, int]]:
    """Patterns and how often each is used; every piece is in exactly one.

    The incumbent is best-fit decreasing's, until a search finds better. The search ends with the lower
    bound met (which proves the optimum) or with all branches looked at; otherwise, when the search has
    ended in all orders of ``EASE``, the best incumbent stands.
    """
    counts = {s: n for s, n in counts.items() if n}
    best = best_fit_decreasing(counts, capacity)
    total = sum(s * n for s, n in counts.items())
    bins, bound = sum(n for _, n in best), lower_bound(counts, capacity)
    for ease in EASE:
        for target in (bound, bins - 1):
            if bound <= target < bins and (better := _improve(counts, capacity, target, ease)):
                best, bins = better, sum(n for _, n in better)
    return best


def _improve(counts: dict[int, int], capacity: int, bins: int, ease: int) -> list[tuple[Pattern, int]] | None:
    """A packing into ``bins`` at most, by depth-first search; None where none is found.

    A filling may waste ``ease`` times its share of what can be wasted before fillings that waste less are
    tried. The search ends when it has turned back once for each length, or has made its steps: sums that are stale let
    an enumeration run into dead ends, so that turning back alone doesn't bound it.
    """
    stock = _Stock(counts, capacity)
    slack = bins * capacity - sum(s * n for s, n in counts.items())
    taken: list[tuple[int, Pattern, int]] = []
    frames: list[Iterator] = []
    waste, used, open_ = 0, 0, set(counts)

    def options() -> Iterator:
        while stock.left[size := max(open_)] == 0:
            open_.discard(size)
        stock.renew()
        stock.left[size] -= 1
        own = fillings(stock, capacity - size, slack - waste, ease * (slack - waste) // max(1, bins - used))
        while True:
            found = next(own, None)
            stock.left[size] += 1
            if found is None:
                return
            w, pattern = found
            merged = dict(pattern)
            merged[size] = merged.get(size, 0) + 1
            times = min(stock.left[s] // k for s, k in merged.items())
            for many in dict.fromkeys((min(times, (slack - waste) // w) if w else times, 1)):
                if many > 0:
                    yield w * many, tuple(sorted(merged.items(), reverse=True)), many
            stock.left[size] -= 1

    pieces = sum(counts.values())
    turns = len(counts)
    while turns and (stock.steps > 0 or not pieces):
        if not pieces:
            return [(p, n) for _, p, n in taken]
        if len(frames) == len(taken):
            frames.append(options())
        step = next(frames[-1], None)
        if step is None:
            frames.pop()
            turns -= 1
            if not taken:
                return None
            w, pattern, many = taken.pop()
            waste, used = waste - w, used - many
            stock.take(pattern, -many)
            open_.update(s for s, _ in pattern)
            pieces += many * sum(k for _, k in pattern)
            continue
        w, pattern, many = step
        waste, used = waste + w, used + many
        stock.take(pattern, many)
        pieces -= many * sum(k for _, k in pattern)
        taken.append(step)
    return [(p, n) for _, p, n in taken] if not pieces else None


@functools.cache
def _coder(path: str) -> bpe.ByteBPE:
    """Vectorised slices, with the merges of new slices by the tokenizer library."""
    coder = bpe.from_vocabulary(path)
    library = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})
    one = library._core_bpe.encode_single_piece
    coder.merge = lambda piece: tuple(one(piece))
    coder.merge_many = lambda pieces: [tuple(one(p)) for p in pieces]
    return coder


#: Special tokens of the vocabulary that the tokenizer recognises inside texts (fixed values).
SPECIAL = {"<|endoftext|>": 50256}


def _ids(coder: bpe.ByteBPE, texts: list[str]) -> Iterator[np.ndarray]:
    for a, b in bpe.chunks(texts):
        marked = [i for i in range(a, b) if any(s in texts[i] for s in SPECIAL)]
        ids, bounds, _, _ = coder.encode(["" if i in marked else texts[i] for i in range(a, b)] if marked else texts[a:b])
        for i in range(a, b):
            if i not in marked:
                yield ids[bounds[i - a] : bounds[i - a + 1]]
                continue
            own: list[np.ndarray] = []
            for name, special in SPECIAL.items():
                for k, part in enumerate(texts[i].split(name)):
                    own += [np.array([special], np.uint32)] * (k > 0) + [coder.encode([part])[0]]
            yield np.concatenate(own)


def tokenize_pieces(docs: DataFrame, path: str, text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: the columns of ``docs`` but the text, and a struct ``piece``.

    The struct has piece, start, length and ``ids`` (little-endian unsigned 32-bit). A document's ids
    end with ``END_ID``; a document longer than ``capacity`` is cut so that only its first piece is
    shorter. Null and empty texts are one piece of one id.
    """

    @F.pandas_udf("array<struct<piece:int,start:long,length:long,ids:binary>>")
    @frugal
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        coder = _coder(path)
        end = np.array([END_ID], np.uint32)
        for texts in batches:
            rows, held = [], 0
            for ids in _ids(coder, [t if isinstance(t, str) else "" for t in texts]):
                if held > FLUSH_IDS:
                    yield pd.Series(rows)
                    rows, held = [], 0
                held += len(ids)
                ids = np.concatenate([ids, end]).astype("<u4")
                cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
                rows.append([{"piece": k, "start": a, "length": b - a, "ids": ids[a:b].tobytes()} for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))])
            if rows:
                yield pd.Series(rows)

    keep = [F.col(f"`{c}`") for c in docs.columns if c != text]
    return docs.select(*keep, F.explode(run(text_or_empty(text))).alias(free_name(docs, "piece_")))


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Place every piece of ``pieces(doc_id, piece, length, ...)``: adds sequence_id and offset.

    Lengths must be 1 to ``capacity``. Repeated rows are pieces of their own. An empty table stays empty.
    Other columns pass through under any name but those of the two new ones.
    """
    spark = pieces.sparkSession
    others = [c for c in pieces.columns if c not in ("doc_id", "piece", "length")]
    order = pieces.columns
    with small_batches(spark):
        pieces = cut(pieces.select("doc_id", "piece", "length", F.struct(F.lit(0).alias("none_"), *[F.col(f"`{c}`") for c in others]).alias("extra_")))
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots, used, sequence = [], dict.fromkeys(counts, 0), 0
    for pattern, times in bin_completion(counts, capacity):
        offset = 0
        for size, k in pattern:
            slots.append((size, used[size], used[size] + k * times, sequence, k, offset))
            used[size] += k * times
            offset += size * k
        sequence += times
    plan = spark.createDataFrame(slots, "p_length long, low long, high long, first long, per long, base long")
    salts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    salted = pieces.withColumn("salt_", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    before = Window.partitionBy("b_length").orderBy("b_salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        salted.groupBy(F.col("length").alias("b_length"), F.col("salt_").alias("b_salt"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select("b_length", "b_salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before_"))
    )
    within = Window.partitionBy("length", "salt_").orderBy("doc_id", "piece", F.xxhash64("extra_"))
    ranked = salted.withColumn("rank_", F.row_number().over(within) - 1)
    ranked = ranked.join(bases, (F.col("length") == F.col("b_length")) & (F.col("salt_") == F.col("b_salt")))
    ranked = ranked.withColumn("rank_", F.col("rank_") + F.col("before_"))
    placed = ranked.join(F.broadcast(plan), (F.col("length") == F.col("p_length")) & (F.col("rank_") >= F.col("low")) & (F.col("rank_") < F.col("high")))
    turn = F.col("rank_") - F.col("low")
    return placed.select(
        *[F.col(f"extra_.`{c}`").alias(c) if c in others else F.col(c) for c in order],
        (F.col("first") + F.floor(turn / F.col("per"))).cast("long").alias("sequence_id"),
        (F.col("base") + turn % F.col("per") * F.col("length")).alias("offset"),
    )


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces, packed into as few sequences of 1024 tokens as the search finds; null texts are empty."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cutted = tokenize_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"))
    pieces = cutted.select("doc_id", "piece_.piece", "piece_.start", "piece_.length", F.crc32("piece_.ids").alias("ids_crc32"))
    return pack(pieces)
