"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

The text of a batch becomes one array of code points. A table gives each its class; with one or two
code points of look-ahead, classes become symbols of a small automaton whose states say what kind of
slice is open. Automaton transitions are functions on states and form a finite monoid, so that the
state before every code point follows from an associative scan over monoid elements: scanned in
blocks, then over the blocks, then joined. A flag per (state, symbol) says where a slice begins; no
regular expression runs. Slices up to 16 bytes are grouped by exact integer keys, so that each
distinct slice of a batch is merged, or found in a bounded cache, once. Byte offsets of slices are
kept for decoding and for spans.
"""

from __future__ import annotations

import base64
import functools
import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.llm.common import free_name, frugal, table, text_or_empty

#: Slices kept in a worker's cache; it is emptied when full.
CACHE_SLICES = 150_000
#: Bytes of text encoded at a time; a longer text is taken alone.
CHUNK_BYTES = 1 << 20

L, N, O, WS_RUN, WS_SPACE, WS_LAST, AP1, AP2 = range(8)
CLOSED, LETTERS, NUMBERS, OTHER, SPACE, RUN, TAIL1, TAIL2 = range(8)
_BLOCK = 64
_NONE = 1 << 60
_WIDE = 16


@functools.cache
def class_table() -> np.ndarray:
    """Class of every code point: 0 letter, 1 number, 2 other, 3 white space."""
    out = np.full(0x110000, 2, np.uint8)
    for cp in range(0x110000):
        kind = unicodedata.category(chr(cp))[0]
        if kind == "L":
            out[cp] = 0
        elif kind == "N":
            out[cp] = 1
    spaces = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
    out[spaces] = 3
    return out


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """Next state and whether this symbol begins a slice."""
    if symbol == L:
        joins = {LETTERS: LETTERS, SPACE: LETTERS, TAIL1: CLOSED, TAIL2: TAIL1}
        return (joins[state], False) if state in joins else (LETTERS, True)
    if symbol == N:
        return NUMBERS, state not in (NUMBERS, SPACE)
    if symbol in (O, AP1, AP2):
        if state in (OTHER, SPACE):
            return OTHER, False
        return {O: OTHER, AP1: TAIL1, AP2: TAIL2}[symbol], True
    if symbol == WS_RUN:
        return RUN, state != RUN
    return (SPACE if symbol == WS_SPACE else CLOSED), True


@functools.cache
def _monoid():
    """Symbols 0-7, and 8-15 for the same symbols at a text's start, closed under composition."""
    step = np.zeros((16, 8), np.uint8)
    begins = np.zeros((16, 8), bool)
    for symbol in range(8):
        for state in range(8):
            step[symbol, state], begins[symbol, state] = _step(state, symbol)
        step[symbol + 8], begins[symbol + 8] = _step(CLOSED, symbol)[0], True
    elements = [tuple(range(8))]
    place = {elements[0]: 0}
    for f in map(tuple, step.tolist()):
        if f not in place:
            place[f] = len(elements)
            elements.append(f)
    of_symbol = np.array([place[tuple(f)] for f in step.tolist()], np.uint8)
    k = 0
    while k < len(elements):
        for f in map(tuple, step.tolist()):
            g = tuple(f[x] for x in elements[k])  # first elements[k], then f
            if g not in place:
                place[g] = len(elements)
                elements.append(g)
        k += 1
    m = len(elements)
    assert m <= 256
    compose = np.array([[place[tuple(b[x] for x in a)] for b in elements] for a in elements], np.uint8)
    return step, begins, of_symbol, compose, np.array(elements, np.uint8)


def _scan(elements: np.ndarray, compose: np.ndarray) -> np.ndarray:
    """Inclusive associative scan of monoid elements."""
    n = len(elements)
    if n <= _BLOCK:
        out = elements.copy()
        shift = 1
        while shift < n:
            out[shift:] = compose[out[:-shift], out[shift:]]
            shift *= 2
        return out
    rows = -(-n // _BLOCK)
    grid = np.zeros((_BLOCK, rows), np.uint8)
    padded = np.zeros(rows * _BLOCK, np.uint8)
    padded[:n] = elements
    grid[:] = padded.reshape(rows, _BLOCK).T
    flat, width = compose.ravel(), compose.shape[1]
    for j in range(1, _BLOCK):
        grid[j] = flat[grid[j - 1].astype(np.intp) * width + grid[j]]
    before = np.zeros(rows, np.uint8)
    before[1:] = _scan(grid[-1], compose)[:-1]
    return flat[before.astype(np.intp) * width + grid].T.reshape(-1)[:n]


def slice_starts(codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Code point positions at which slices begin; ``first`` holds where texts begin (no empty texts)."""
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64)
    kind = class_table()[codes]
    begin = np.zeros(n + 2, bool)
    begin[first] = True
    begin[n:] = True
    symbol = np.where(kind < 3, kind, np.uint8(WS_LAST)).astype(np.uint8)
    white = kind == 3
    follows = np.zeros(n, bool)  # the next code point is of the same text and not white space
    follows[:-1] = ~white[1:] & ~begin[1:n]
    symbol[white & ~follows] = WS_RUN
    symbol[white & follows & (codes == 0x20)] = WS_SPACE
    quotes = np.flatnonzero(codes == 0x27)
    if len(quotes):
        ahead = np.concatenate([codes, np.zeros(2, codes.dtype)])
        a, b = ahead[quotes + 1], ahead[quotes + 2]
        a = np.where(begin[quotes + 1], 0, a)
        b = np.where(begin[quotes + 2], 0, b)
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = (np.isin(a, [ord("r"), ord("v")]) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        symbol[quotes[one]] = AP1
        symbol[quotes[two]] = AP2
    symbol[first] += 8
    _, begins, of_symbol, compose, apply = _monoid()
    state = apply[_scan(of_symbol[symbol], compose), CLOSED]
    before = np.empty(n, np.uint8)
    before[0] = CLOSED
    before[1:] = state[:-1]
    return np.flatnonzero(begins.ravel()[symbol.astype(np.intp) * 8 + before])


class ByteBPE:
    """Encoder and decoder for a table of ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.cache: dict[bytes, tuple[int, ...]] = {}
        self.of_byte = np.array([ranks.get(bytes([b]), 0) for b in range(256)], np.int64)
        pairs = [(ranks[t[:k]] << 32 | ranks[t[k:]], i) for t, i in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        self.pair_keys = pd.Index(np.array([p for p, _ in pairs], np.int64))
        self.pair_ranks = np.array([r for _, r in pairs] + [_NONE], np.int64)

    @functools.cached_property
    def tokens(self) -> dict[int, bytes]:
        return {i: t for t, i in self.ranks.items()}

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Merge the lowest-ranked pair, the leftmost of equals, until none is left."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        if len(piece) > 64:
            return self._merge_long(piece)
        ranks = self.ranks
        parts = [piece[i : i + 1] for i in range(len(piece))]
        pairs = [ranks.get(parts[i] + parts[i + 1], 1 << 60) for i in range(len(parts) - 1)]
        while pairs:
            least = min(pairs)
            if least == 1 << 60:
                break
            i = pairs.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1], 1 << 60)
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], 1 << 60)
        return tuple([ranks[p] for p in parts])

    def _pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids; ``_NONE`` where they don't merge or one is missing (negative)."""
        rank = self.pair_ranks[self.pair_keys.get_indexer(a << 32 | b)]
        return np.where((a < 0) | (b < 0), _NONE, rank)

    def merge_many(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """``merge`` of many slices of at most ``_WIDE`` bytes, one merge in each per round."""
        n = len(pieces)
        sizes = np.fromiter(map(len, pieces), np.int64, n)
        data = np.frombuffer(b"".join(p.ljust(_WIDE, b"\0") for p in pieces), np.uint8).reshape(n, _WIDE)
        ids = np.full((n, _WIDE + 1), -1, np.int64)
        inside = np.arange(_WIDE) < sizes[:, None]
        ids[:, :_WIDE][inside] = self.of_byte[data[inside]]
        ranks = np.full((n, _WIDE), _NONE, np.int64)
        rows, cols = np.nonzero(inside & (np.arange(_WIDE) < sizes[:, None] - 1))
        ranks[rows, cols] = self._pair_rank(ids[rows, cols], ids[rows, cols + 1])
        live = np.arange(n)
        while len(live):
            own = ranks[live]
            at = own.argmin(axis=1)
            least = own[np.arange(len(live)), at]
            go = least < _NONE
            live, at, least = live[go], at[go], least[go]
            if not len(live):
                break
            moved = np.arange(_WIDE + 1) > at[:, None]
            take = np.minimum(np.arange(_WIDE + 1) + moved, _WIDE)
            ids[live] = np.take_along_axis(ids[live], take, axis=1)
            ids[live, at] = least
            ranks[live] = np.take_along_axis(ranks[live], np.minimum(take[:, :_WIDE], _WIDE - 1), axis=1)
            ranks[live, _WIDE - 1] = _NONE
            ranks[live, at] = self._pair_rank(ids[live, at], ids[live, at + 1])
            left = np.flatnonzero(at > 0)
            ranks[live[left], at[left] - 1] = self._pair_rank(ids[live[left], at[left] - 1], ids[live[left], at[left]])
        counts = (ids >= 0).sum(axis=1).tolist()
        return [tuple(row[:k]) for row, k in zip(ids.tolist(), counts, strict=True)]

    def _merge_long(self, piece: bytes) -> tuple[int, ...]:
        """The same with a heap, for long slices."""
        ranks, n = self.ranks, len(piece)
        parts: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []

        def push(i: int) -> None:
            j = after[i]
            if i >= 0 and j < n:
                rank = ranks.get(parts[i] + parts[j])
                if rank is not None:
                    heapq.heappush(heap, (rank, i, parts[i], parts[j]))

        for i in range(n - 1):
            push(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] is not a or j >= n or parts[j] is not b:
                continue
            parts[i], parts[j] = a + b, None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            push(i)
            if before[i] >= 0:
                push(before[i])
        return tuple(ranks[p] for p in parts if p is not None)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts; bounds of each text's ids; each slice's first id and first byte."""
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        joined = "".join(texts)
        if not joined:
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        codes = np.frombuffer(joined.encode("utf-32-le"), "<u4")
        raw = joined.encode()
        ends = np.cumsum(lengths)
        first = (ends - lengths)[lengths > 0]
        starts = slice_starts(codes, first)
        if len(raw) == len(codes):
            at = starts
        else:
            data = np.frombuffer(raw, np.uint8)
            at = np.flatnonzero((data & 0xC0) != 0x80)[starts]
        stops = np.append(at[1:], len(raw))
        which, ids_of, counts = self._distinct(raw, at, stops)
        n_ids = counts[which]
        slice_bounds = np.concatenate([[0], np.cumsum(n_ids)])
        begin_of = np.concatenate([[0], np.cumsum(counts)])[:-1]
        ids = ids_of[np.repeat(begin_of[which] - slice_bounds[:-1], n_ids) + np.arange(slice_bounds[-1])]
        bounds = slice_bounds[np.searchsorted(starts, np.concatenate([[0], ends]))]
        return ids, bounds, slice_bounds, at

    def _distinct(self, raw: bytes, at: np.ndarray, stops: np.ndarray):
        """Number each slice by its content; ids of the distinct slices, flat, and their counts."""
        size = stops - at
        data = np.frombuffer(raw + bytes(16), np.uint8)
        words = np.ndarray((len(raw) + 9,), "<u8", data, 0, (1,))
        zero = data[: len(raw)] == 0
        short = size <= 16
        if zero.any():
            holes = np.concatenate([[0], np.cumsum(zero)])
            short &= holes[stops] == holes[at]
        which = np.empty(len(at), np.int64)
        firsts: list[np.ndarray] = []
        total = 0
        for low, high in ((0, 8), (8, 16)):
            rows = np.flatnonzero(short & (size > low) & (size <= high))
            if not len(rows):
                continue
            last = (size[rows] - low).astype(np.uint64) * np.uint64(8)
            mask = np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - last)
            if low == 0:
                code, kinds = pd.factorize(words[at[rows]] & mask)
            else:
                c1, k1 = pd.factorize(words[at[rows]])
                c2, k2 = pd.factorize(words[at[rows] + 8] & mask)
                code, kinds = pd.factorize(c1 * len(k2) + c2)
            which[rows] = code + total
            example = np.empty(len(kinds), np.int64)
            example[code[::-1]] = rows[::-1]
            firsts.append(example)
            total += len(kinds)
        pieces = [raw[a:b] for f in firsts for a, b in zip(at[f].tolist(), stops[f].tolist(), strict=True)]
        rows = np.flatnonzero(~short)
        if len(rows):
            seen: dict[bytes, int] = {}
            which[rows] = [seen.setdefault(raw[a:b], total + len(seen)) for a, b in zip(at[rows].tolist(), stops[rows].tolist(), strict=True)]
            pieces += list(seen)
        cache = self.cache
        if len(cache) > CACHE_SLICES:
            cache.clear()
        found = [cache.get(piece) for piece in pieces]
        new = [k for k, ids in enumerate(found) if ids is None]
        many = [k for k in new if len(pieces[k]) <= _WIDE]
        merged = self.merge_many([pieces[k] for k in many]) if many else []
        merged += [self.merge(pieces[k]) for k in new if len(pieces[k]) > _WIDE]
        many += [k for k in new if len(pieces[k]) > _WIDE]
        for k, ids in zip(many, merged, strict=True):
            found[k] = ids
            if len(pieces[k]) <= 64:
                cache[pieces[k]] = ids
        counts = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((i for ids in found for i in ids), np.uint32, int(counts.sum()))
        return which, flat, counts

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of ids; an id that is not in the table raises KeyError."""
        return b"".join(map(self.tokens.__getitem__, ids))


@functools.cache
def from_ranks(path: str) -> ByteBPE:
    """Encoder for a file of base64 tokens and ranks."""
    with open(path, "rb") as f:
        return ByteBPE({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})


@functools.cache
def from_vocabulary(path: str) -> ByteBPE:
    """Encoder for a JSON vocabulary whose ids follow the order of its merges; added tokens are left out."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    to_byte = {chr(b): b for b in plain}
    to_byte.update({chr(0x100 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))})
    added = {t["content"] for t in spec.get("added_tokens", [])}
    return ByteBPE({bytes(to_byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in added})


def chunks(texts: list[str], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` characters."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def encode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` with a struct column ``bpe``: ids, slice_ids, slice_bytes and decoded.

    ``ids`` are little-endian unsigned 32-bit integers in one binary; ``n_tokens`` counts them.
    ``slices`` is a binary of (first id, first byte) pairs, one for each slice: the offsets that
    decoding needs to find any part of the text. ``decoded`` is the text from the ids alone. Null and
    empty texts have no ids. A column named ``bpe`` keeps its name; the new one gets an underscore.
    """

    @F.pandas_udf("n_tokens long, ids binary, slices binary, decoded binary")
    @frugal
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        coder = from_ranks(path)
        for texts in batches:
            texts = [t if isinstance(t, str) else "" for t in texts]
            for a, b in chunks(texts):
                rows = []
                ids, bounds, slice_ids, slice_bytes = coder.encode(texts[a:b])
                ids = ids.astype("<u4")
                sizes = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts[a:b]])])
                marks = np.searchsorted(slice_ids[:-1], bounds)
                for k in range(b - a):
                    own = ids[bounds[k] : bounds[k + 1]]
                    m = slice(marks[k], marks[k + 1])
                    pairs = np.stack([slice_ids[m] - bounds[k], slice_bytes[m] - sizes[k]], axis=1).astype("<u4")
                    rows.append((len(own), own.tobytes(), pairs.tobytes(), coder.decode(own.tolist())))
                yield pd.DataFrame(rows, columns=["n_tokens", "ids", "slices", "decoded"])  # a chunk at a time bounds memory

    return docs.withColumn(free_name(docs, "bpe"), run(text_or_empty(text)))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and their bytes decoded again; null texts are empty."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return coded.select("doc_id", "bpe.n_tokens", F.sha2("bpe.ids", 256).alias("ids_sha256"), F.sha2("bpe.decoded", 256).alias("decoded_sha256"))
