"""Labels, shortening, classification and comment cleaning as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Name prefixes of each category, tested in this order.
CATEGORIES = {
    "io": "read|write|fetch|send|save|load|store|query|insert|update|delete|create|remove|get|set|post|put|patch",
    "handler": "handle|on|render|process|execute|run|start|init|main|serve|listen",
    "util": "format|parse|convert|transform|map|filter|reduce|sort|compare|validate|check|is|has|can|to|from",
}


def classify(name: Column | str, path: Column | str) -> Column:
    """Category by the lower-cased name's prefix; ``thirdparty`` below node_modules, else ``core``."""
    out = F.lit("core")
    for category, prefixes in reversed(CATEGORIES.items()):
        out = F.when(F.lower(name).rlike(f"^({prefixes})"), category).otherwise(out)
    return F.when(F.contains(_col(path), F.lit("node_modules")), "thirdparty").otherwise(out)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def visual_units(text: Column | str) -> Column:
    """Width in which characters beyond U+00FF count twice."""
    text = _col(text)
    return F.length(text) + F.length(F.regexp_replace(text, "[\\x{00}-\\x{ff}]", ""))


def slice_units(text: Column | str, units: Column | int, from_end: bool = False) -> Column:
    """The longest prefix (or suffix) that is no wider than ``units``."""
    text = _col(text)
    whole = F.reverse(text) if from_end else text
    units = F.lit(units) if isinstance(units, int) else units
    near = F.substr(whole, F.lit(1), units)  # a character is one unit wide at least
    chars = F.when(F.length(near) > 0, F.split(near, "")).otherwise(F.array().cast("array<string>"))
    start = F.struct(F.lit(0).alias("used"), F.lit(0).alias("n"), F.lit(True).alias("open"))

    def step(acc: Column, c: Column) -> Column:
        used = acc["used"] + F.length(c) + F.when(c.rlike("[^\\x{00}-\\x{ff}]"), 1).otherwise(0)
        fits = acc["open"] & (used <= units)
        return F.struct(F.when(fits, used).otherwise(acc["used"]).alias("used"), (acc["n"] + F.when(fits, F.length(c)).otherwise(0)).alias("n"), fits.alias("open"))

    n = F.aggregate(chars, start, step, lambda acc: acc["n"])
    out = F.substr(whole, F.lit(1), n)
    return F.reverse(out) if from_end else out


def ellipsize(text: Column | str, units: int) -> Column:
    """Cut to the width, the last character an ellipsis."""
    return F.when(visual_units(text) <= units, _col(text)).otherwise(F.concat(slice_units(text, max(1, units - 1)), F.lit("…")))


def ellipsize_middle(text: Column | str, units: int) -> Column:
    """Cut in the middle; the tail keeps 42 % of the width, 8 at least."""
    tail = max(8, int(units * 0.42))
    cut = F.concat(slice_units(text, units - tail - 1), F.lit("…"), slice_units(text, tail, from_end=True))
    return F.when(visual_units(text) <= units, _col(text)).otherwise(cut)


def wrap_name(name: Column | str, first: int = 19, second: int = 28) -> Column:
    """One or two lines: broken behind the last ``. _ -`` if that is far enough, else at a camel-case step, else hard."""
    name = _col(name)
    least = int(first * 0.45)
    head = slice_units(name, first + 1)
    mark = F.length(F.regexp_extract(head, r"^(.*)[._-]", 1))
    has_mark = head.rlike("[._-]") & (mark >= least)
    steps = F.sequence(F.least(F.lit(first), F.length(name) - 1), F.lit(least + 1), F.lit(-1))
    camel = F.filter(steps, lambda i: F.substr(name, i, F.lit(2)).rlike("^[a-z0-9][A-Z]$"))
    at = F.when(has_mark, mark + 1).when(F.size(camel) > 0, F.element_at(camel, 1)).otherwise(first)
    lines = F.array(F.substr(name, F.lit(1), at), ellipsize(F.substr(name, at + 1, F.length(name)), second))
    return F.when(visual_units(name) <= first, F.array(name)).otherwise(lines)


def compact_location(path: Column | str, line: Column | str, units: int = 32) -> Column:
    """The last two parts of the path and the line, cut in the middle."""
    parts = F.filter(F.split(F.regexp_replace(path, r"\\", "/"), "/"), lambda p: p != "")
    tail = F.when(F.size(parts) <= 2, parts).otherwise(F.slice(parts, -2, 2))
    return ellipsize_middle(F.concat(F.array_join(tail, "/"), F.lit(":"), _col(line).cast("string")), units)


def short_path(path: Column | str, keep: int = 3) -> Column:
    parts = F.split(path, "/")
    return F.array_join(F.when(F.size(parts) <= keep, parts).otherwise(F.slice(parts, -keep, keep)), "/")


def short_location(path: Column | str, line: Column | str) -> Column:
    return F.concat(F.element_at(F.split(path, "/"), -1), F.lit(":"), _col(line).cast("string"))


def qualified_name(class_name: Column | str, name: Column | str) -> Column:
    return F.concat_ws(".", _col(class_name), _col(name))


def level_label(level: Column | str) -> Column:
    level = _col(level)
    number = F.abs(level).cast("string")
    return F.when(level == 0, "anchor").when(level > 0, F.concat(F.lit("callee "), number)).otherwise(F.concat(F.lit("caller "), number))


def trim_code(code: Column | str, n: int = 150) -> Column:
    return F.substr(F.trim(code), F.lit(1), F.lit(n))


def shorten(text: Column | str, limit: int) -> Column:
    text = _col(text)
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.substr(text, F.lit(1), F.lit(limit - 1)), F.lit("…")))


def name_tokens(name: Column | str) -> Column:
    """Words of an identifier: ``_ - $`` part words, so do camel-case steps; the name itself if it has none."""
    # A space goes before a capital behind a small letter or digit, before the last capital of a run that small
    # letters follow, and between letters and digits.
    steps = F.regexp_replace(name, r"[^A-Za-z0-9]+", " ")
    for left, right in (("[a-z0-9]", "[A-Z]"), ("[A-Z]", "[A-Z][a-z]"), ("[A-Za-z]", "[0-9]"), ("[0-9]", "[A-Za-z]")):
        steps = F.regexp_replace(steps, f"(?<={left})(?={right})", " ")
    found = F.filter(F.split(steps, " "), lambda t: t != "")
    return F.when(F.size(found) > 0, found).otherwise(F.array(_col(name)))


def clean_comment(line: Column | str) -> Column:
    """A comment line without its first marker and without a closing one."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(line), r"^(///|//!|//|/\*\*|/\*|\*(?!/)|#)", ""), r"\*/$", ""))


def clean_doc(doc: Column | str, keep: int = 5) -> Column:
    """The first non-empty lines of a comment, cleaned."""
    lines = F.filter(F.transform(F.split(doc, "\n"), clean_comment), lambda x: x != "")
    return F.array_join(F.slice(lines, 1, keep), "\n")


def end_name(name: Column | str, node_id: Column | str) -> Column:
    """A node's name, else the second part of its id."""
    return F.coalesce(_col(name), F.try_element_at(F.split(node_id, "::"), F.lit(2)))


def first_sites(sites: Column | str, n: int = 6) -> Column:
    """The first sites of an edge and how many more it has."""
    return F.struct(F.slice(sites, 1, n).alias("shown"), F.greatest(F.size(sites) - n, F.lit(0)).alias("more"))


def top_calls(calls: Column | str, n: int) -> Column:
    return F.slice(calls, 1, n)


def brace_delta(text: Column | str) -> Column:
    return F.length(F.regexp_replace(text, "[^{]", "")) - F.length(F.regexp_replace(text, "[^}]", ""))


def has_brace_after(text: Column | str, offset: int) -> Column:
    return F.locate("{", text, offset + 1) > 0


def leading_indent(text: Column | str) -> Column:
    """Spaces count 1, tabs 4."""
    head = F.regexp_extract(text, "^([ \t]*)", 1)
    return F.length(head) + 3 * F.length(F.regexp_replace(head, " ", ""))
