"""Source trees as DataFrames: scan, decode, lines, directory tree."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from callweave.functions.languages import COLLECTED, collected_language, detect_language, extension
from callweave.operators.aggregates import range_buckets
from callweave.sources.tree import read_tree

# Directories that scans leave out.
EXCLUDED_NAME_MODE = [
    ".git", ".svn", ".hg", ".build", "build", "out", "dist",
    ".gradle", "node_modules", "Pods", "DerivedData", ".next",
    "vendor", "Vendor", ".venv", "venv", "__pycache__", ".idea", ".vscode",
    "xcuserdata", ".kotlin", ".hermes", ".swiftpm", "target",
    ".cache", "coverage", ".terraform", ".dart_tool",
    "oh_modules", ".ohpm", ".hvigor", "release", "Debug", "Release",
    ".cxx", "cxx", ".plugin", ".l10n", "xcarchive",
]
EXCLUDED_QUALIFIED_MODE = [
    "node_modules", "build", "dist", ".git", ".svn", "target",
    "DerivedData", "__pycache__", ".venv", "venv", ".next",
    ".build", ".spdx", "Pods", ".gradle", ".idea", ".vscode",
]

#: Every Unicode line break is a break of its own, so that CR LF leaves an empty line between.
NEWLINES = "[\n\r\u000b\u000c\u0085  ]"


@dataclass
class ScanOptions:
    """Limits of a scan; None lifts one. ``max_seconds`` bounds the listing of each partition of a tree."""

    max_files: int | None = 4000
    max_bytes: int | None = 2_500_000
    max_lines: int | None = 20_000
    max_seconds: float | None = 15.0
    extra_excludes: list[str] = field(default_factory=list)


def relative_path(path: Column | str, root: str) -> Column:
    """Path below the root; a path elsewhere stays as it is."""
    plain = F.regexp_replace(path, r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?(?=/)", "")
    root = root.rstrip("/") + "/"
    return F.when(F.startswith(plain, F.lit(root)), F.substr(plain, F.lit(len(root) + 1))).otherwise(plain)


def allowed(rel_path: Column | str, mode: str, extra: list[str] | None = None) -> Column:
    """No directory on the way is hidden or excluded; in "qualified" mode hidden files go too."""
    parts = F.split(rel_path, "/")
    dirs = F.slice(parts, 1, F.size(parts) - 1)
    clean = ~F.exists(dirs, lambda d: F.startswith(d, F.lit(".")) | d.isin(_excluded(mode, extra)))
    return clean if mode == "name" else clean & ~F.startswith(F.element_at(parts, -1), F.lit("."))


def _is_local(root: str) -> bool:
    return root.startswith("file:") or "://" not in root


def _read(path: str) -> bytes | None:
    try:
        with open(path, "rb") as f:
            return f.read()
    except OSError:
        return None


def _content(path: str) -> Column:
    """Bytes of a file that executors see."""

    @F.pandas_udf("binary")
    def run(paths: pd.Series) -> pd.Series:
        return pd.Series([_read(p) for p in paths], dtype=object)

    return run(path)


def list_files(spark: SparkSession, root: str, mode: str = "name", options: ScanOptions | None = None) -> DataFrame:
    """Files below a root with language, size and content; filters and caps act before content is read.

    "name" mode keeps files of a known language within the limits (the first ``max_files`` paths);
    "qualified" mode keeps the collected extensions without limits and leaves out hidden files and links. Trees of a
    file system that all executors share are listed by ``read_tree``. Of other stores Spark's file source lists
    them, which leaves out names that begin with ``.`` or ``_``. A file that can't be read has null content.
    """
    options = options or ScanOptions()
    if _is_local(root):
        files = read_tree(spark, root, _excluded(mode, options.extra_excludes), options.max_seconds if mode == "name" else None).where("type = 'file'")
        if mode != "name":
            files = files.where(~F.col("link") & ~F.startswith("name", F.lit(".")))
        files, content = files.drop("parent", "type", "link"), _content("path")
    else:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
        files = files.withColumn("rel_path", relative_path("path", root)).where(allowed("rel_path", mode, options.extra_excludes))
        content = F.col("content")
    if mode == "name":
        files = files.withColumn("language", detect_language("rel_path")).where("language is not null")
        if options.max_bytes is not None:
            files = files.where(F.col("length") <= options.max_bytes)
        if options.max_files is not None:
            files = files.orderBy("rel_path").limit(options.max_files) if _is_local(root) else files.join(files.select("rel_path").orderBy("rel_path").limit(options.max_files), "rel_path", "left_semi")
    else:
        files = files.where(extension("rel_path").isin(COLLECTED)).withColumn("language", collected_language("rel_path"))
    return files.select("rel_path", "language", "length", content.alias("content"))


def _excluded(mode: str, extra: list[str] | None = None) -> list[str]:
    return (EXCLUDED_NAME_MODE if mode == "name" else EXCLUDED_QUALIFIED_MODE) + list(extra or [])


def list_tree(spark: SparkSession, root: str) -> DataFrame:
    """The tree below a root as rows (parent, name, path, type, depth, turn): no hidden names, no links, directories first.

    Empty directories are rows too. ``turn`` counts among siblings in binary name order.
    """
    found = read_tree(spark, root, EXCLUDED_QUALIFIED_MODE).where(~F.col("link") & ~F.startswith("name", F.lit(".")))
    return _ranked(found.select("parent", "name", F.col("rel_path").alias("path"), "type", F.size(F.split("rel_path", "/")).alias("depth")))


def decode_name_mode(content: Column | str) -> Column:
    """UTF-8, else UTF-16, else null."""
    text = F.col(content) if isinstance(content, str) else content
    bom = F.hex(F.substring(text, 1, 2)).isin("FEFF", "FFFE")
    even = F.octet_length(text) % 2 == 0
    as_string = text.cast("string")
    return F.when(F.is_valid_utf8(as_string), as_string).when(bom & even, F.decode(text, "UTF-16"))


def decode_qualified_mode(files: DataFrame, content: str = "content") -> DataFrame:
    """``files`` with text, encoding and error: NUL test, BOM, UTF-8, GBK, Shift-JIS.

    A NUL within the first 8192 bytes makes a file binary. With a byte-order mark, bad UTF-8 is
    accepted with replacements. Null content is a read error.
    """

    @F.pandas_udf("text string, encoding string, error string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for raws in batches:
            yield pd.DataFrame([_decoded(raw) for raw in raws], columns=["text", "encoding", "error"])

    # Valid UTF-8 without a NUL at its beginning and without a replacement character never goes to Python.
    raw = F.col(content)
    as_string = F.when(F.hex(F.substring(raw, 1, 3)) == "EFBBBF", F.substring(raw, 4, 2**31 - 1)).otherwise(raw).cast("string")
    plain = F.is_valid_utf8(raw.cast("string")) & ~F.contains(F.substring(raw, 1, 8192), F.unhex(F.lit("00"))) & ~F.contains(as_string, F.lit("�"))
    native = F.struct(as_string.alias("text"), F.lit("utf-8").alias("encoding"), F.lit(None).cast("string").alias("error"))
    judged = files.withColumn("plain_", F.coalesce(plain, F.lit(False)))
    rest = judged.withColumn("rest_", run(F.when(~F.col("plain_"), raw)))
    return rest.withColumn("decoded_", F.when(F.col("plain_"), native).otherwise(F.col("rest_"))).select(*files.columns, "decoded_.*")


def _decoded(raw: bytes | None) -> tuple[str | None, str, str | None]:
    if raw is None:
        return None, "read-error", "no content"
    if b"\0" in raw[:8192]:
        return None, "binary-skip", None
    marked = raw.startswith(b"\xef\xbb\xbf")
    body = raw[3:] if marked else raw
    text = body.decode("utf-8", "replace")
    if marked or "�" not in text:
        return text, "utf-8", None
    for encoding in ("gbk", "shift_jis"):
        try:
            return body.decode(encoding), encoding, None
        except UnicodeDecodeError:
            continue
    return None, "encoding-unsupported", None


def lines_of(files: DataFrame, text: str = "text", mode: str = "qualified", max_lines: int | None = None) -> DataFrame:
    """One row per line: the other columns of ``files``, line_no from 1, and line."""
    pattern = NEWLINES if mode == "name" else "\n"
    parts = F.split(F.col(text), pattern, -1)
    parts = parts if max_lines is None else F.slice(parts, 1, max_lines)
    keep = [F.col(c) for c in files.columns if c != text]
    return files.select(*keep, F.posexplode(parts).alias("p_", "line")).select(*[c for c in files.columns if c != text], (F.col("p_") + 1).alias("line_no"), "line")


def path_tree(paths: DataFrame, path: str = "rel_path") -> DataFrame:
    """Rows of the directory tree: parent, name, path, type (dir or file), depth, and turn among siblings.

    Directories come first, then files, both in binary name order. A path that is a file and a
    directory gives both rows.
    """
    parts = F.split(path, "/")
    deep = paths.select(F.col(path).alias("full"), parts.alias("parts")).distinct()
    levels = deep.select("full", "parts", F.explode(F.sequence(F.lit(1), F.size("parts"))).alias("depth"))
    node = F.array_join(F.slice("parts", 1, F.col("depth")), "/")
    parent = F.when(F.col("depth") > 1, F.array_join(F.expr("slice(parts, 1, depth - 1)"), "/")).otherwise("")
    kind = F.when(F.col("depth") == F.size("parts"), "file").otherwise("dir")
    rows = levels.select(parent.alias("parent"), F.element_at("parts", F.col("depth")).alias("name"), node.alias("path"), kind.alias("type"), "depth").distinct()
    return _ranked(rows)


def _ranked(rows: DataFrame) -> DataFrame:
    """Rows of a tree with ``turn``; ranks run within ranges of names, so that a directory with most entries is dealt out."""
    dealt = range_buckets(rows.withColumn("key_", F.concat(F.when(F.col("type") == "dir", "0").otherwise("1"), "name")), "key_")
    counts = dealt.groupBy(F.col("parent").alias("p_"), F.col("bucket").alias("b_")).agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("p_").orderBy("b_").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("p_", "b_", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    own = dealt.withColumn("own", F.row_number().over(Window.partitionBy("parent", "bucket").orderBy("key_")))
    placed = own.join(bases, (F.col("parent") == F.col("p_")) & (F.col("bucket") == F.col("b_")))
    return placed.select("parent", "name", "path", "type", "depth", (F.col("own") + F.col("base")).alias("turn"))
