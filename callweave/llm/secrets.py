"""Secret scan in DataFrame functions alone: rule spans, and strings of high sliding-window entropy.

A pattern's spans come from its matches and the gaps between them: both are cut by the same regular
expression, so their lengths in code points add up to positions. Candidate strings (long runs of
key-like characters) pass a window of ``WINDOW`` characters; an aggregate carries the counts of the
characters inside it, updates them and the sum of c * log2(c) by the character that enters and the
one that leaves, and keeps the first and last window above the threshold of the string's character
class. An allow-list suppresses what is known to be no secret: candidates end where base spans begin, allowed
strings inside a candidate cut it, and every part that is left is judged by itself.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.llm.common import free_name, table, text_or_empty

KINDS = ("assign", "access", "hex")
_ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_ACCESS = r"AKIA[A-Z0-9]{14,}+"
_HEX = r"[0-9a-f]{16,}+"
_CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}+"

WINDOW = 20
#: Elements that are summed up in one block of an array.
BLOCK = 128
#: Least entropy in bits a character, by class; letters alone and digits alone, with any punctuation, are mostly words and numbers.
THRESHOLDS = {"hex": 3.0, "mixed": 3.6, "letters": 3.7, "digits": 3.0}
#: Parts of candidates that are no secret: alphabets, repeats, words of examples. What surrounds them may be one.
ALLOW_INSIDE = r"(?i:abcdefghijklm|qwertyuiop|0123456789|1234567890|example|sample|placeholder|dummy|changeme)|(.)\1{7,}+"
#: Whole strings that look like keys and are none: paths and dashed words, ids with dashes.
ALLOW = [
    r"^[-=_+/]+$",
    r"^[A-Za-z]+([-_/+][A-Za-z]+)+=*$",
    r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",
]
_ALPHABET = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_=-"


#: Characters in one block of a text from which pieces are taken.
TEXT_BLOCK = 4096


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _before(values: Column, join, zero: int = 0) -> Column:
    """Array of what ``join`` makes of all ``values`` before each, in blocks, so that many elements aren't copied once for each."""
    walk = lambda xs, value: F.aggregate(
        xs,
        F.struct(F.lit(zero).alias("at"), F.array().cast("array<int>").alias("out")),
        lambda acc, x: F.struct(join(acc["at"], value(x)).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")),
    )

    def merged(blocks: Column) -> Column:
        bases = walk(blocks, lambda x: x["at"])["out"]
        return F.flatten(F.transform(F.arrays_zip(blocks.alias("b"), bases.alias("at")), lambda x: F.transform(x["b"]["out"], lambda at: join(at, x["at"]))))

    blocks = lambda xs: F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / BLOCK).cast("int")), lambda i: walk(F.slice(xs, i * BLOCK + 1, F.lit(BLOCK)), lambda x: x))
    some = lambda xs: _let(blocks(xs), merged)
    return _let(values, lambda xs: F.when(F.size(xs) > 0, some(xs)).otherwise(F.array().cast("array<int>")))


def _offsets(sizes: Column) -> Column:
    """Array of the sums of ``sizes`` before each element."""
    return _before(sizes, lambda a, b: a + b)


def _masked(text: Column, spans: Column, mask) -> Column:
    """``text`` with ``mask(length)`` in place of each of the ``spans`` (start, end), sorted by start; overlapping ones become one.

    Pieces are taken from blocks of the text, so that no span reads the text from its beginning.
    """
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.length(text) / TEXT_BLOCK).cast("int")), lambda i: F.substr(text, i * TEXT_BLOCK + 1, F.lit(TEXT_BLOCK)))

    def piece(held: Column, begin: Column, end: Column) -> Column:
        inside = lambda i: F.substr(F.get(held, i), F.greatest(F.lit(1), begin - i * TEXT_BLOCK + 1), F.least(F.lit(TEXT_BLOCK), end - i * TEXT_BLOCK) - F.greatest(F.lit(0), begin - i * TEXT_BLOCK))
        every = F.transform(F.sequence(F.floor(begin / TEXT_BLOCK).cast("int"), F.floor((end - 1) / TEXT_BLOCK).cast("int")), inside)
        return F.when(end > begin, F.array_join(every, "")).otherwise("")

    def whole(held: Column) -> Column:
        ends = F.transform(spans, lambda s: s["end"])
        zipped = F.arrays_zip(spans.alias("s"), _before(ends, F.greatest).alias("reach"))
        parts = F.transform(
            zipped,
            lambda z: F.concat(
                piece(held, z["reach"], F.greatest(z["reach"], z["s"]["start"])),
                # A span that begins where another still runs only masks what is left of it.
                mask(z["s"]["start"] >= z["reach"], F.greatest(z["s"]["end"], z["reach"]) - F.greatest(z["s"]["start"], z["reach"])),
            ),
        )
        return F.concat(F.array_join(parts, ""), piece(held, F.array_max(ends), F.length(text)))

    return F.when(F.size(spans) > 0, _let(blocks, whole)).otherwise(text)


def _placed(text: Column, pattern: str, matches: Column, value: Column) -> Column:
    """Array of (start, end, value): ``matches`` of the pattern in ``text`` with their positions."""
    gaps = F.split(text, pattern, -1)
    both = F.arrays_zip(matches.alias("m"), F.slice(gaps, 1, F.size(matches)).alias("g"))
    before = _offsets(F.transform(both, lambda x: F.length(x["g"]) + F.length(x["m"])))
    rows = F.arrays_zip(before.alias("at"), matches.alias("m"), F.slice(gaps, 1, F.size(matches)).alias("g"), value.alias("v"))
    start = lambda x: x["at"] + F.length(x["g"])
    out = F.transform(rows, lambda x: F.struct(start(x).alias("start"), (start(x) + F.length(x["m"])).alias("end"), x["v"].alias("value")))
    return F.when(F.size(matches) > 0, out).otherwise(F.array().cast("array<struct<start:int,end:int,value:string>>"))


def _codes(string: Column) -> Column:
    """The characters of a candidate by their places in the alphabet, from 0."""
    return F.transform(F.slice(F.split(string, ""), F.lit(1), F.length(string)), lambda c: F.instr(F.lit(_ALPHABET), c) - 1)


#: c * log2(c) for the counts of a window.
_BITS = [c * math.log2(c) if c > 1 else 0.0 for c in range(WINDOW + 2)]


def window_entropy(string: Column) -> Column:
    """(first, last) window start, from 0, above the threshold of the string's class; nulls where none is.

    The string is split once; every step takes one character into the window's counts and one out of them, and
    values used several times are bound, so that the time is in proportion to the length.
    """
    bits = lambda c: F.element_at(F.array(*[F.lit(b) for b in _BITS]), (c + 1).cast("int"))
    hexed = string.rlike("^[0-9a-fA-F]+$")
    letters, digits = string.rlike("[A-Za-z]"), string.rlike("[0-9]")
    limit = F.when(~letters & ~digits, 99.0).when(~digits, THRESHOLDS["letters"]).when(~letters, THRESHOLDS["digits"]).when(hexed, THRESHOLDS["hex"]).otherwise(THRESHOLDS["mixed"])
    # Counts of the alphabet's characters, at most WINDOW each: twelve of five bits in a long.
    start = F.struct(F.array_repeat(F.lit(0).cast("long"), -(-len(_ALPHABET) // 12)).alias("n"), F.lit(0.0).alias("s"), F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"))
    count = lambda n, c: F.call_function("shiftright", F.element_at(n, F.floor(c / 12).cast("int") + 1), c % 12 * 5).bitwiseAND(31)
    one = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), c % 12 * 5)
    full, empty = math.log2(WINDOW), F.lit(0).cast("long")

    def walk(codes: Column, least: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            moves = F.struct(F.get(codes, i).alias("enters"), F.when(i >= WINDOW, F.get(codes, i - WINDOW)).otherwise(-1).alias("leaves"))

            def counted(m: Column) -> Column:
                up = count(acc["n"], m["enters"])
                down = F.when(m["leaves"] >= 0, count(acc["n"], m["leaves"])).otherwise(0)
                return F.struct(m["enters"].alias("enters"), m["leaves"].alias("leaves"), up.alias("up"), down.alias("down"))

            def summed(m: Column) -> Column:
                change = bits(m["up"] + 1) - bits(m["up"]) + F.when(m["leaves"] >= 0, bits(m["down"] - 1) - bits(m["down"])).otherwise(0.0)
                s = acc["s"] + F.when(m["enters"] == m["leaves"], 0.0).otherwise(change)
                place = lambda c: F.floor(m[c] / 12)
                n = F.transform(acc["n"], lambda v, k: v + F.when(k == place("enters"), one(m["enters"])).otherwise(empty) - F.when((m["leaves"] >= 0) & (k == place("leaves")), one(m["leaves"])).otherwise(empty))
                return F.struct(n.alias("n"), s.alias("s"))

            def judged(x: Column) -> Column:
                high = (i >= WINDOW - 1) & (full - x["s"] / WINDOW >= least)
                at = i - (WINDOW - 1)
                return F.struct(x["n"].alias("n"), x["s"].alias("s"), F.coalesce(acc["first"], F.when(high, at)).cast("int").alias("first"), F.when(high, at).otherwise(acc["last"]).cast("int").alias("last"))

            return _let(_let(_let(moves, counted), summed), judged)

        return F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), start, step, lambda acc: F.struct(acc["first"].alias("first"), acc["last"].alias("last")))

    bound = _let(F.struct(_codes(string).alias("codes"), limit.alias("limit")), lambda b: F.when(b["limit"] < 99, walk(b["codes"], b["limit"])))
    return F.when(F.length(string) >= WINDOW, bound)


def _parts(x: Column) -> Column:
    """Array of (start, value): parts of candidate ``x``, of a window or more, between the allowed strings inside it."""
    own = F.array(F.struct(x["start"].alias("start"), x["value"].alias("value")))

    def between(gaps: Column) -> Column:
        sizes = F.transform(F.regexp_extract_all(x["value"], F.lit(ALLOW_INSIDE), F.lit(0)), lambda m: F.length(m))
        steps = F.transform(F.arrays_zip(gaps.alias("g"), sizes.alias("m")), lambda z: F.length(z["g"]) + F.coalesce(z["m"], F.lit(0)))
        rows = F.transform(F.arrays_zip(gaps.alias("g"), _offsets(steps).alias("at")), lambda z: F.struct((x["start"] + z["at"]).alias("start"), z["g"].alias("value")))
        return F.filter(rows, lambda p: F.length(p["value"]) >= WINDOW)

    return F.when(x["value"].rlike(ALLOW_INSIDE), _let(F.split(x["value"], ALLOW_INSIDE, -1), between)).otherwise(own)


def find_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with a struct column ``secrets``: ``base`` and ``added``, arrays of (start, rank, kind, end).

    Both are sorted by start, then kind as listed, so that ties have one order; positions are code points, ends exclusive. Base
    spans follow the rules; added ones (kind ``entropy``) overlap no base span. Null and empty texts have none.
    """
    t, found, placed, name = (free_name(docs, x) for x in ("t_", "f_", "p_", "secrets"))
    out = docs.withColumn(t, text_or_empty(text))
    c = F.col(t)
    out = out.withColumn(
        found,
        F.struct(
            F.regexp_extract_all(c, F.lit(_ASSIGN), F.lit(0)).alias("a"),
            F.regexp_extract_all(c, F.lit(_ASSIGN), F.lit(2)).alias("v"),
            F.regexp_extract_all(c, F.lit(_ACCESS), F.lit(0)).alias("k"),
            F.regexp_extract_all(c, F.lit(_HEX), F.lit(0)).alias("h"),
        ),
    )
    f = F.col(found)
    assign = F.filter(_placed(c, _ASSIGN, f["a"], f["v"]), lambda x: F.length(x["value"]) >= 12)
    span = lambda rank, kind: lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), x["end"].alias("end"))
    base = F.concat(
        F.transform(assign, span(0, "assign")),
        F.transform(_placed(c, _ACCESS, f["k"], f["k"]), span(1, "access")),
        F.transform(_placed(c, _HEX, f["h"], f["h"]), span(2, "hex")),
    )
    out = out.withColumn(placed, F.array_sort(base))
    # What base spans cover is blank for candidates, which end there.
    out = out.withColumn(t, _masked(c, F.col(placed), lambda _, size: F.repeat(F.lit(" "), size)))
    out = out.withColumn(found, F.regexp_extract_all(c, F.lit(_CANDIDATE), F.lit(0)))
    known = lambda x: _any([x["value"].rlike(a) for a in ALLOW])
    open_ = F.flatten(F.transform(F.filter(_placed(c, _CANDIDATE, f, f), lambda x: ~known(x)), _parts))
    scored = F.transform(F.filter(open_, lambda x: ~known(x)), lambda x: F.struct(x["start"].alias("at"), window_entropy(x["value"]).alias("w")))
    high = F.filter(scored, lambda x: x["w"]["first"].isNotNull())
    added = F.transform(
        high,
        lambda x: F.struct((x["at"] + x["w"]["first"]).alias("start"), F.lit(3).alias("rank"), F.lit("entropy").alias("kind"), (x["at"] + x["w"]["last"] + WINDOW).alias("end")),
    )
    return out.withColumn(name, F.struct(F.col(placed).alias("base"), added.alias("added"))).drop(t, found, placed)


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def redact(found: DataFrame, text: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """Replace the spans of ``find_secrets`` in the text; overlapping spans become one mask."""
    t = text_or_empty(text)
    spans = F.array_sort(F.concat("secrets.base", "secrets.added"))
    masked = _masked(t, spans, lambda fresh, _: F.when(fresh, mask).otherwise(""))
    return found.withColumn(text, F.when(F.size(spans) > 0, masked).otherwise(F.col(text))).drop("secrets")


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and entropy spans of every document; null and empty texts have none."""
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "secrets")
    count = lambda kind: F.size(F.filter("secrets.base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *[count(k) for k in KINDS],
        F.sha2(joined(F.col("secrets.base")), 256).alias("base_sha256"),
        joined(F.array_sort(F.concat("secrets.base", "secrets.added"))).alias("spans"),
    )
