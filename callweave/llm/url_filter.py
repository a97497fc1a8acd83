"""URL filter: a memory-mapped, sorted array of 64-bit digests probed by binary search.

A rule is a host and a path prefix. The rules' full strings are hashed with 64-bit xxhash; the
sorted hashes, the place of each string and the strings themselves form one file. Every executor
fetches that file once (``SparkContext.addFile``) and maps it, so its Python workers share the
pages. A url's candidates (each domain suffix with each path prefix of a length that some rule has)
are hashed, found by one vectorised ``searchsorted`` per batch, and compared with the stored string,
so that colliding hashes never decide. The longest rule that fits wins, of equally long ones that with
the longer host, then the later string.

The rules of a table are hashed, sorted and packed by executors; the driver only strings the packed parts
together. The file is only made for lists up to ``MAX_INDEX_BYTES``; a larger list goes by an equi-join on
hash and string, which moves neither list nor urls through the driver.
"""

from __future__ import annotations

import atexit
import os
import shutil
import struct
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.llm.common import free_name, table

#: Largest list (bytes of rules) that is put in a file for every executor.
MAX_INDEX_BYTES = 256 << 20

#: The rules of the registered query: (verdict, host and path).
RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _host_length(rule: str) -> int:
    return rule.find("/") if "/" in rule else len(rule)


def _pack(hashes: np.ndarray, rules: list[bytes], block: list[bool]) -> tuple[bytes, bytes, bytes, bytes]:
    """Sorted hashes, string sizes, verdicts and strings of some rules."""
    return hashes.astype("<u8").tobytes(), np.array([len(r) for r in rules], "<i8").tobytes(), np.array(block, "u1").tobytes(), b"".join(rules)


def _assemble(parts, lengths: list[int], path: str) -> None:
    """Write the digest file from packed parts in the order of their hashes; a part is in memory at a time."""
    n = total = 0
    names = [f"{path}.{x}" for x in ("keys", "ends", "block", "strings")]
    with open(names[0], "wb") as keys, open(names[1], "wb") as ends, open(names[2], "wb") as block, open(names[3], "wb") as strings:
        ends.write(struct.pack("<q", 0))
        for k, sizes, b, s in parts:
            stops = total + np.cumsum(np.frombuffer(sizes, "<i8"))
            for out, raw in zip((keys, ends, block, strings), (k, stops.astype("<i8").tobytes(), b, s), strict=True):
                out.write(raw)
            n, total = n + len(stops), total + len(s)
    with open(path, "wb") as out:
        out.write(struct.pack("<qq", n, len(lengths)))
        for name in [names[0], names[1], None, names[2], names[3]]:
            if name is None:
                out.write(np.array(lengths, "<i8").tobytes())
                continue
            with open(name, "rb") as part:
                shutil.copyfileobj(part, out)
            os.remove(name)


def write_index(rules: list[tuple[str, str]], path: str) -> None:
    """Write the digest file: counts, sorted hashes, string bounds, path lengths, verdicts, strings.

    Of equal rule strings with different verdicts, ``block`` wins.
    """
    verdict = {}
    for v, rule in rules:
        verdict[rule] = max(v, verdict.get(rule, v))
    rows = sorted((xxhash.xxh64_intdigest(r.encode()), r.encode(), v == "block") for r, v in verdict.items())
    part = _pack(np.array([h for h, _, _ in rows], np.uint64), [r for _, r, _ in rows], [b for *_, b in rows])
    _assemble([part], sorted({len(r) - _host_length(r) for r in verdict}), path)


def write_index_of(rules: DataFrame, path: str) -> None:
    """``write_index`` for a table ``(verdict, rule)``; rows with a null are no rules."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [r.encode() for r in batch.column(0).to_pylist()]
            h = np.fromiter((xxhash.xxh64_intdigest(r) for r in raw), np.uint64, len(raw))
            yield pa.RecordBatch.from_arrays([pa.array((h ^ np.uint64(1 << 63)).view(np.int64)), pa.array(raw, pa.binary()), batch.column(1)], ["h", "raw", "block"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column(0).to_numpy().view(np.uint64) ^ np.uint64(1 << 63)
            part = _pack(h, batch.column(1).to_pylist(), batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in part], ["k", "n", "b", "s"])

    once = rules.where("rule is not null and verdict is not null").groupBy("rule").agg((F.max("verdict") == "block").alias("block"))
    ordered = once.mapInArrow(hashed, "h long, raw binary, block boolean").repartitionByRange("h").sortWithinPartitions("h", "raw")
    _assemble(map(tuple, ordered.mapInArrow(packed, "k binary, n binary, b binary, s binary").toLocalIterator()), _path_lengths(rules), path)


def _path_lengths(rules: DataFrame) -> list[int]:
    """The distinct lengths of the rules' paths."""
    length = F.expr("if(instr(rule, '/') = 0, 0, char_length(rule) - instr(rule, '/') + 1)")
    return sorted(r[0] for r in rules.where("rule is not null and verdict is not null").select(length.alias("n")).distinct().collect())


class DigestIndex:
    """The mapped digest file."""

    def __init__(self, path: str):
        raw = np.memmap(path, dtype="u1", mode="r")
        n, m = struct.unpack("<qq", raw[:16].tobytes())
        at = 16
        self.keys, at = raw[at : at + 8 * n].view("<u8"), at + 8 * n
        self.ends, at = raw[at : at + 8 * (n + 1)].view("<i8"), at + 8 * (n + 1)
        self.path_lengths, at = raw[at : at + 8 * m].view("<i8").tolist(), at + 8 * m
        self.block, at = raw[at : at + n], at + n
        self.strings = raw[at:]

    def find(self, candidates: list[str]) -> np.ndarray:
        """Index of the rule equal to each candidate, or -1."""
        found = np.full(len(candidates), -1, np.int64)
        if not len(self.keys) or not candidates:
            return found
        raw = [c.encode() for c in candidates]
        hashes = np.fromiter((xxhash.xxh64_intdigest(c) for c in raw), np.uint64, len(raw))
        at = np.searchsorted(self.keys, hashes)
        live = np.flatnonzero(at < len(self.keys))
        live = live[self.keys[at[live]] == hashes[live]]
        for i in live:
            j = int(at[i])
            while j < len(self.keys) and self.keys[j] == hashes[i]:  # several strings may have one hash
                if self.strings[self.ends[j] : self.ends[j + 1]].tobytes() == raw[i]:
                    found[i] = j
                    break
                j += 1
        return found


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    if url is None:
        return "", ""
    rest = url.partition("://")[2]
    cuts = [i for i in (rest.find(c) for c in "/?#") if i >= 0]
    end = min(cuts, default=len(rest))
    host, rest = rest[:end].translate(_LOWER), rest[end:]
    cuts = [i for i in (rest.find(c) for c in "?#") if i >= 0]
    return host, rest[: min(cuts, default=len(rest))]


def candidates_of(host: str, path: str, lengths: list[int]) -> list[str]:
    """Every (domain suffix, path prefix) string, the one that wins first."""
    if not host:
        return []
    labels = host.split(".")
    suffixes = [".".join(labels[i:]) for i in range(len(labels))]
    out = [s + path[:n] for s in suffixes for n in lengths if n <= len(path)]
    return sorted(out, key=lambda r: (len(r), _host_length(r), r), reverse=True)


def _judge(urls: pd.Series, index: DigestIndex, default: str) -> pd.DataFrame:
    parts = [split_url(u if isinstance(u, str) else None) for u in urls]
    owner, flat = [], []
    for i, (host, path) in enumerate(parts):
        c = candidates_of(host, path, index.path_lengths)
        flat += c
        owner += [i] * len(c)
    hit = index.find(flat)
    rule, verdict = [None] * len(parts), [default] * len(parts)
    for k in np.flatnonzero(hit >= 0)[::-1]:  # the winner comes first, so it is written last
        rule[owner[k]] = flat[k]
        verdict[owner[k]] = "block" if index.block[hit[k]] else "allow"
    return pd.DataFrame({"host": [p[0] for p in parts], "path": [p[1] for p in parts], "rule": rule, "verdict": verdict}, dtype=object)


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]] | DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with a struct column ``judged`` (host, path, rule, verdict).

    ``rules`` is a list or a DataFrame ``(verdict, rule)``. Null urls and urls without ``://`` have an
    empty host and path and get ``default``; so does an empty list of rules. Of equally long rules that fit, that
    with the longer host wins, then the later string, whatever the list's size; of equal rules ``block`` does.
    Rules with a null are none. Other columns pass through
    whatever their names are (a column named ``judged`` gives way to ``judged_``).
    """
    name = free_name(pages, "judged")
    if isinstance(rules, DataFrame):
        size = rules.agg(F.coalesce(F.sum(F.octet_length("rule") + 32), F.lit(0))).first()[0]
        if size > MAX_INDEX_BYTES:
            return _filter_by_join(pages, rules, url, default, name)
    spark = pages.sparkSession
    folder = tempfile.mkdtemp(prefix="spark-url-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)  # executors may fetch the file as long as the session lives
    path = os.path.join(folder, f"urls-{uuid.uuid4().hex}.idx")  # Spark takes each file name once
    (write_index_of if isinstance(rules, DataFrame) else write_index)(rules, path)
    spark.sparkContext.addFile(path)
    file = os.path.basename(path)

    @F.pandas_udf("host string, path string, rule string, verdict string")
    def judge(urls: pd.Series) -> pd.DataFrame:
        return _judge(urls, _opened(file), default)

    return pages.withColumn(name, judge(F.col(url)))


_OPEN: dict[str, DigestIndex] = {}


def _opened(file: str) -> DigestIndex:
    if file not in _OPEN:
        _OPEN[file] = DigestIndex(SparkFiles.get(file))
    return _OPEN[file]


def _filter_by_join(pages: DataFrame, rules: DataFrame, url: str, default: str, name: str) -> DataFrame:
    """The same result for lists too large for a file: distinct (host, path) pairs join the rules on hash and string."""
    rest = F.when(F.instr(F.col(url), "://") > 0, F.expr(f"substr(`{url}`, instr(`{url}`, '://') + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)([^?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^([^/?#]*)([^?#]*)", 2)
    keyed = pages.withColumn(name, F.struct(host.alias("host"), path.alias("path")))
    places = keyed.select(f"{name}.*").distinct().where("host <> ''")
    lengths = _path_lengths(rules)
    flat = places.select(
        "host", "path", F.explode(F.expr("transform(sequence(1, size(split(host, '[.]'))), i -> concat_ws('.', slice(split(host, '[.]'), i, 1000000)))")).alias("suffix")
    ).select("host", "path", F.explode(F.array(*[F.when(F.length("path") >= n, F.concat("suffix", F.substring("path", 1, n))) for n in lengths])).alias("rule"))
    flat = flat.where("rule is not null").withColumn("h", F.xxhash64("rule"))
    known = rules.where("rule is not null and verdict is not null").groupBy("rule").agg(F.max("verdict").alias("verdict")).withColumn("h", F.xxhash64("rule"))
    best = flat.join(known, ["h", "rule"]).groupBy("host", "path").agg(F.max_by(F.struct("rule", "verdict"), F.struct(F.length("rule"), F.instr(F.concat("rule", F.lit("/")), "/"), "rule")).alias("best"))
    best = best.select(F.col("host").alias("b_host"), F.col("path").alias("b_path"), "best")
    joined = keyed.join(best, (keyed[f"{name}.host"] == best.b_host) & (keyed[f"{name}.path"] == best.b_path), "left")
    judged = F.struct(F.col(f"{name}.host").alias("host"), F.col(f"{name}.path").alias("path"), F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
    return joined.select(*[F.col(f"`{c}`") for c in pages.columns], judged.alias(name))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's url; urls that no rule fits are allowed."""
    judged = filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), RULES)
    return judged.select("page_id", "judged.host", "judged.path", "judged.rule", "judged.verdict")


ORACLE = r"""
WITH u AS (
  SELECT page_id,
    CASE WHEN url IS NULL OR instr(url, '://') = 0 THEN '' ELSE substr(url, instr(url, '://') + 3) END AS rest
  FROM pages),
p AS (
  SELECT page_id,
    translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM u),
r AS (
  SELECT page_id, host, path,
    CASE
      WHEN (host = 'www.example.com' OR suffix(host, '.www.example.com')) AND prefix(path, '/en/') THEN 'www.example.com/en/'
      WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND prefix(path, '/en/') THEN 'example.com/en/'
      WHEN (host = 'net' OR suffix(host, '.net')) AND prefix(path, '/es/') THEN 'net/es/'
      WHEN (host = 'net' OR suffix(host, '.net')) AND prefix(path, '/fr/') THEN 'net/fr/'
      WHEN (host = 'com' OR suffix(host, '.com')) AND prefix(path, '/') THEN 'com/'
    END AS rule
  FROM p)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""
