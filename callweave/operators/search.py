"""Text search that attributes every hit to a definition."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callweave.operators.aggregates import range_buckets
from callweave.operators.resolve import line_owners
from callweave.plans.stored import stored
from callweave.sources.files import lines_of

MAX_HITS, MAX_LINES = 300, 3_000_000


def contains(column: str, query: str):
    """Case-insensitive substring."""
    return F.contains(F.lower(column), F.lower(F.lit(query)))


def search(lines: DataFrame, defs: DataFrame, sites: DataFrame, owners: DataFrame | None, query: str, current_file: str | None = None, max_hits: int | None = MAX_HITS) -> DataFrame:
    """Hits (kind, def_id, rel_path, line_no, code, turn) in reading order, at most ``max_hits``.

    Within a file, definitions come in order: a name hit is of kind ``definition``, else a hit in the
    signature is ``text``; then hits in the lines of the definition's calls. Lines not claimed by these
    follow; they belong to the line's owner, else to the file's last definition; a file without
    definitions has none. ``sites`` has def_id (its owner), rel_path, line_no, start_col and line;
    ``owners`` rel_path, line_no, def_id. Without ``owners`` these are found for files with matching lines
    alone, and ``sites`` needs no def_id. Blank queries find nothing. With ``current_file`` only that
    file is searched.
    """
    query = query.strip()
    if not query:
        lines = lines.where(F.lit(False))
    if current_file is not None:
        lines = lines.where(F.col("rel_path") == current_file)
    if current_file is not None or not query:
        defs = defs.join(lines.select("rel_path").distinct(), "rel_path", "left_semi")
        sites = sites.join(lines.select("rel_path").distinct(), "rel_path", "left_semi")
    if owners is None:
        matching = lines.where(contains("line", query)).select("rel_path", "line_no")
        near = defs.join(matching.select("rel_path").distinct(), "rel_path", "left_semi")
        owners = line_owners(near, matching).where("def_id is not null")
        sites = sites.where(contains("line", query)).drop("def_id").join(owners, ["rel_path", "line_no"])
    turn = lambda part, a, b, c, d: F.struct(F.lit(part).alias("p"), a.cast("long").alias("a"), b.cast("long").alias("b"), F.lit(c).alias("c"), d.cast("long").alias("d")).alias("turn")
    kind = F.when(contains("name", query), "definition").otherwise("text").alias("kind")
    by_def = defs.where(contains("name", query) | contains("signature", query)).select(
        kind, "def_id", "rel_path", F.col("start_line").alias("line_no"), F.col("signature").alias("code"), turn(0, F.col("start_line"), F.col("start_col"), 0, F.lit(0))
    )
    place = defs.select("def_id", F.col("start_line").alias("d_line"), F.col("start_col").alias("d_col"))
    by_call = sites.where(contains("line", query)).join(place, "def_id").select(
        F.lit("text").alias("kind"), "def_id", "rel_path", "line_no", F.col("line").alias("code"), turn(0, F.col("d_line"), F.col("d_col"), 1, F.col("line_no") * 100000 + F.col("start_col"))
    )
    claimed = by_def.select("rel_path", "line_no").unionByName(by_call.select("rel_path", "line_no")).distinct()
    last = defs.groupBy("rel_path").agg(F.max_by("def_id", F.struct("start_line", "start_col")).alias("last_id"))
    rest = lines.where(contains("line", query)).join(claimed, ["rel_path", "line_no"], "left_anti").join(last, "rel_path")
    owned = rest.join(owners.select("rel_path", "line_no", "def_id"), ["rel_path", "line_no"], "left")
    by_line = owned.select(
        F.lit("text").alias("kind"), F.coalesce("def_id", "last_id").alias("def_id"), "rel_path", "line_no", F.col("line").alias("code"), turn(1, F.col("line_no"), F.lit(0), 0, F.lit(0))
    )
    hits = by_def.unionByName(by_call).unionByName(by_line)
    hits = hits.groupBy("kind", "def_id", "rel_path", "line_no").agg(F.min_by("code", "turn").alias("code"), F.min("turn").alias("turn"))
    ordered = hits.select("kind", "def_id", "rel_path", "line_no", "code", "turn")
    return ordered if max_hits is None else ordered.orderBy("rel_path", "turn").limit(max_hits)


#: Files in the first reach of an early stop, and how much further each next one goes.
FIRST_FILES, FURTHER = 64, 8


def search_files(files: DataFrame, query: str, define, call, max_hits: int | None = MAX_HITS) -> tuple[DataFrame, DataFrame]:
    """``search`` over whole ``files(rel_path, language, text)``: hits, and the definitions of the files that were read.

    Lines, definitions (``define(lines)``) and sites (``call(lines)``) are only made of files whose text holds the query at
    all. With a limit files are read in path order, first a few, then more, until there are enough hits: what comes
    later in order can't be among the first.
    """
    found = files.where(contains("text", query.strip())) if query.strip() else files.limit(0)

    def run(part: DataFrame) -> tuple[DataFrame, DataFrame]:
        lines = lines_of(part)
        defs = stored(define(lines))
        return search(lines, defs, call(lines), None, query, max_hits=max_hits), defs

    if max_hits is None:
        return run(found)
    reach = FIRST_FILES
    while True:
        n, last = found.select("rel_path").orderBy("rel_path").limit(reach).agg(F.count(F.lit(1)), F.max("rel_path")).first()
        hits, defs = run(found if n < reach else found.where(F.col("rel_path") <= last))
        hits = stored(hits)
        if n < reach or hits.count() >= max_hits:
            return hits.orderBy("rel_path", "turn").limit(max_hits), defs
        reach *= FURTHER


def anchor_from_hit(hits: DataFrame, defs: DataFrame) -> DataFrame:
    """What a hit anchors: its definition (anchor_id), and for a hit in text the line that stays in focus."""
    text = F.col("kind") == "text"
    focus = [F.when(text, F.col(c)).alias(f"focus_{c}") for c in ("rel_path", "line_no", "code")]
    return hits.join(defs.select("def_id"), "def_id", "left_semi").select(F.col("def_id").alias("anchor_id"), "kind", "rel_path", "line_no", *focus)


def scan_budget(lines: DataFrame, budget: int = MAX_LINES) -> DataFrame:
    """Files with the lines before them in path order, and how many of theirs a budget leaves (``part``).

    The running sum runs within ranges of paths and over the ranges' totals, so that no task gets all files,
    however they lie in folders.
    """
    sizes = lines.groupBy("rel_path").agg(F.count(F.lit(1)).alias("n"))
    dealt = range_buckets(sizes, "rel_path")
    earlier = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = dealt.groupBy("bucket").agg(F.sum("n").alias("n")).select("bucket", earlier(Window.orderBy("bucket")).alias("base"))
    inside = dealt.withColumn("own", earlier(Window.partitionBy("bucket").orderBy("rel_path"))).join(F.broadcast(bases), "bucket")
    before = F.col("own") + F.col("base")
    return inside.select("rel_path", "n", before.alias("before"), F.greatest(F.lit(0), F.least(F.col("n"), budget - before)).alias("part"))
