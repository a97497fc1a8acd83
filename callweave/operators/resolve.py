"""Binding call sites to definitions, and attributing lines and positions to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RESOLVED, AMBIGUOUS, NOT_FOUND = "resolved", "unresolved-ambiguous", "unresolved-notfound"
FAN_OUT = 3


def qualified_id(*parts: Column | str) -> Column:
    """Parts joined by ``::``; a null part is empty."""
    return F.concat_ws("::", *[F.coalesce(F.col(p) if isinstance(p, str) else p, F.lit("")) for p in parts])


#: Lines are seen as blocks of 8 ** k lines for k up to this; the largest blocks bound what one window holds.
LEVELS = 3


def _blocks(start: Column, stop: Column) -> Column:
    """Blocks (level, number) that make up the lines from ``start`` to before ``stop``: at most 14 of every smaller level."""
    first = [F.shiftright(start + (8**k - 1), 3 * k) for k in range(LEVELS + 1)]
    last = [F.shiftright(stop, 3 * k) for k in range(LEVELS + 1)]

    def run(level: int, low: Column, high: Column) -> Column:
        block = lambda n: F.struct(F.lit(level).alias("level"), n.cast("long").alias("number"))
        return F.when(low < high, F.transform(F.sequence(low, high - 1), block)).otherwise(F.array(F.lit(None).cast("struct<level:int,number:bigint>")))

    parts = [run(LEVELS, first[LEVELS], last[LEVELS])]
    for k in range(LEVELS):
        # Larger blocks take the middle; without one the whole is the run on the left.
        middle = first[k + 1] <= last[k + 1]
        parts += [run(k, first[k], F.when(middle, first[k + 1] * 8).otherwise(last[k])), run(k, F.when(middle, last[k + 1] * 8), last[k])]
    return F.flatten(F.array(*parts))


def line_owners(defs: DataFrame, places: DataFrame, key: str = "def_id") -> DataFrame:
    """``places`` with ``key``: of the definitions that cover a place's line the one that starts last, null where none does.

    ``places`` has rel_path and line_no, any other columns and any number of rows a line; ``defs`` rel_path, start_line,
    start_col, end_line and ``key``. An end before the start covers the start alone. Of two that start on
    one line the later column wins, then the larger key. Ranges may be long, nested to any depth, or cross.

    A range is a few blocks of lines, a number that grows with the logarithm of its length, and of the ranges of one block
    only the last to start is kept. One sweep over the lines of a largest block carries the latest block of
    every level; those that reach a line are its candidates. No range becomes one row for each of its lines.
    """
    start, stop = F.col("start_line"), F.greatest("start_line", "end_line") + 1
    best = F.struct("start_line", "start_col", F.col(key).alias("id")).alias("best")
    pieces = defs.where("rel_path is not null").select("rel_path", best, F.explode(_blocks(start, stop)).alias("block")).where("block is not null")
    marks = pieces.groupBy("rel_path", "block").agg(F.max("best").alias("best"))
    at = F.expr("shiftleft(block.number, 3 * block.level)")
    asked = places.drop(key)
    rows = asked.select("rel_path", F.col("line_no").cast("long").alias("at"), F.lit(1).alias("turn"), F.struct(*asked.columns).alias("place"))
    marks = marks.select("rel_path", at.alias("at"), F.lit(0).alias("turn"), F.col("block.level").alias("level"), "best")
    both = rows.unionByName(marks, allowMissingColumns=True).withColumn("bucket", F.shiftright("at", 3 * LEVELS))
    sweep = Window.partitionBy("rel_path", "bucket").orderBy("at", "turn").rowsBetween(Window.unboundedPreceding, 0)
    latest = {f"l{k}": F.last(F.when(F.col("level") == k, F.struct("at", "best")), ignorenulls=True).over(sweep) for k in range(LEVELS + 1)}
    reaching = [F.when(F.shiftright(f"l{k}.at", 3 * k) == F.shiftright("at", 3 * k), F.col(f"l{k}.best")) for k in range(LEVELS + 1)]
    return both.withColumns(latest).where("turn = 1").select("place.*", F.greatest(*reaching)["id"].alias(key))


def resolve_name(sites: DataFrame, defs: DataFrame, fan_out: int = FAN_OUT) -> DataFrame:
    """Sites with target_id: up to ``fan_out`` definitions of the called name, those of the same file alone if any.

    ``sites`` has rel_path and callee, ``defs`` def_id, name, rel_path, start_line, start_col. Each tier is
    cut to ``fan_out`` rows a name before it joins, so that a name with many definitions doesn't
    multiply its sites. Sites without candidates have no row.
    """
    order = [F.col("rel_path"), F.col("start_line"), F.col("start_col"), F.col("def_id")]
    near = Window.partitionBy("name", "rel_path").orderBy(*order[1:])
    far = Window.partitionBy("name").orderBy(*order)
    files = defs.withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= fan_out)
    files = files.groupBy(F.col("name").alias("callee"), "rel_path").agg(F.sort_array(F.collect_list(F.struct("rank", "def_id"))).alias("near"))
    names = defs.withColumn("rank", F.row_number().over(far)).where(F.col("rank") <= fan_out)
    names = names.groupBy(F.col("name").alias("callee")).agg(F.sort_array(F.collect_list(F.struct("rank", "def_id"))).alias("far"))
    joined = sites.join(names, "callee").join(files, ["callee", "rel_path"], "left")
    return joined.select(*sites.columns, F.explode(F.coalesce("near", "far")).alias("t")).select(*sites.columns, "t.rank", F.col("t.def_id").alias("target_id"))


def resolve_qualified(sites: DataFrame, defs: DataFrame) -> DataFrame:
    """Sites with target_id and status, one row each.

    ``sites`` has rel_path, callee and caller_class (null: none), ``defs`` def_id, name, rel_path and
    class_name. Candidates of the same file decide if there are any, else those of all files. A single
    candidate is taken; of several the only one of the caller's class, or the only one without a class
    for a caller without. Only counts and one id per name, file and class are joined.
    """
    cls = F.coalesce("class_name", F.lit(""))

    def tier(keys: list[str], prefix: str) -> DataFrame:
        found = defs.withColumn("cls", cls).groupBy(*keys).agg(F.count(F.lit(1)).alias(f"{prefix}_n"), F.max("def_id").alias(f"{prefix}_id"))
        return found.withColumnRenamed("name", "callee")

    out = sites.withColumn("cls", F.coalesce("caller_class", F.lit("")))
    for keys, prefix in ((["name", "rel_path"], "sf"), (["name", "rel_path", "cls"], "sfc"), (["name"], "g"), (["name", "cls"], "gc")):
        out = out.join(tier(keys, prefix), ["callee", *keys[1:]], "left")
    pick = lambda a, b: F.when(F.col(f"{a}_n") == 1, F.col(f"{a}_id")).when(F.col(f"{b}_n") == 1, F.col(f"{b}_id"))
    target = F.when(F.col("sf_n").isNotNull(), pick("sf", "sfc")).otherwise(pick("g", "gc"))
    status = F.when(target.isNotNull(), RESOLVED).when(F.coalesce("sf_n", "g_n").isNull(), NOT_FOUND).otherwise(AMBIGUOUS)
    return out.select(*[F.col(c) for c in sites.columns], target.alias("target_id"), status.alias("status"))


def symbol_at(positions: DataFrame, defs: DataFrame, sites: DataFrame, strict: bool = False) -> DataFrame:
    """Positions (rel_path, line_no, col) with symbol_id: a definition's name there, else the target of a call there.

    A call without a target gives the first definition of its name, unless ``strict``. Columns start at 1.
    ``sites`` has callee, start_col, target_id; of several at one place the first column, then id, wins.
    """
    inside = (F.col("col") >= F.col("start_col")) & (F.col("col") < F.col("start_col") + F.length("symbol"))
    own = defs.select("rel_path", F.col("start_line").alias("line_no"), "start_col", F.col("name").alias("symbol"), "def_id", F.lit(0).alias("tier"))
    first = defs.groupBy(F.col("name").alias("callee")).agg(F.min_by("def_id", F.struct("rel_path", "start_line", "start_col")).alias("first_id"))
    calls = sites if strict else sites.join(first, "callee", "left")
    target = F.col("target_id") if strict else F.coalesce("target_id", "first_id")
    called = calls.select("rel_path", "line_no", "start_col", F.col("callee").alias("symbol"), target.alias("def_id"), F.lit(1).alias("tier"))
    hits = positions.join(own.unionByName(called), ["rel_path", "line_no"]).where(inside)
    best = hits.groupBy("rel_path", "line_no", "col").agg(F.min_by(F.struct("def_id"), F.struct("tier", "start_col", "def_id")).alias("b"))
    return best.select("rel_path", "line_no", "col", F.col("b.def_id").alias("symbol_id"))


def unresolved(sites: DataFrame, defs: DataFrame, limit: int | None = None) -> DataFrame:
    """Sites whose name no definition has; with a limit the first by file, line and column."""
    rows = sites.join(defs.select(F.col("name").alias("callee")).distinct(), "callee", "left_anti").select(*sites.columns)
    return rows if limit is None else rows.orderBy("rel_path", "line_no", "start_col").limit(limit)


def match_symbol(defs: DataFrame, text: str, rule: str = "text") -> DataFrame:
    """The one definition meant by a text.

    Rule "text": exact names before names that contain it in any case, functions before others, top-level
    code never; rule "json": the first that contains it. Ties go by file, line and column.
    """
    contains = F.contains(F.lower("name"), F.lower(F.lit(text)))
    order = [F.col("rel_path"), F.col("start_line"), F.col("start_col")]
    if rule == "json":
        return defs.where(contains).orderBy(*order).limit(1)
    found = defs.where(contains & (F.col("kind") != "topLevel"))
    return found.orderBy((F.col("name") != text), (F.col("kind") != "function"), *order).limit(1)


def first_definition(defs: DataFrame) -> DataFrame:
    """The first definition of every file."""
    return defs.groupBy("rel_path").agg(F.min_by("def_id", F.struct("start_line", "start_col")).alias("def_id"))


def snippet(lines: DataFrame, places: DataFrame, around: int = 10) -> DataFrame:
    """Lines within ``around`` of each place (rel_path, at), as far as the file goes."""
    wanted = places.select("rel_path", "at", F.explode(F.sequence(F.col("at") - around, F.col("at") + around)).alias("line_no"))
    return wanted.join(lines, ["rel_path", "line_no"]).select("rel_path", "at", "line_no", "line")
