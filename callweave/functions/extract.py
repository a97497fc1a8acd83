"""Definitions and call sites of one file, line by line.

This is the only place where state passes from line to line, so it runs per file inside an Arrow
function. Comments and strings are blanked by one regular expression per language family, which keeps
columns in place. Columns are code points from 0.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Names that are never calls or definitions.
KEYWORDS = frozenset(
    """
    if else for while switch case default return
    new throw throws try catch finally import export
    from function fun func def class struct interface
    enum extension protocol guard defer where when with
    assert require delete typeof instanceof in of do
    let const var static public private protected
    override open sealed abstract final suspend inline
    noinline crossinline expect actual external tailrec
    operator data companion object init super this
    async await yield break continue goto sizeof
    typedef typename namespace using template volatile
    register signed unsigned long short double float
    int char void bool auto constexpr noexcept
    as is not and or then each vararg
    """.split()
)

_NAME = r"[A-Za-z_$][\w$]*"

#: Words that introduce the name of a function or of a type.
INTRODUCERS = {
    "kotlin": {"function": ["fun"], "klass": ["class", "interface", "object"]},
    "swift": {"function": ["func"], "klass": ["class", "struct", "enum", "actor", "protocol", "extension"]},
    "java": {"klass": ["class", "interface", "enum", "record"]},
    "typescript": {"function": ["function"], "klass": ["class", "interface"]},
    "cfamily": {"klass": ["class", "struct", "enum", "union"]},
    "python": {"function": ["def"], "klass": ["class"]},
    "go": {"function": ["func"], "klass": ["type"]},
    "objc": {"klass": ["@interface", "@implementation", "@protocol"]},
}

Place = tuple[str, int]  # a name and its column


def _introduced(clean: str, words: list[str]) -> Iterator[tuple[Place, str]]:
    """Names behind an introducing word, each with what follows it; dotted names and receivers in parentheses are skipped."""
    for m in re.finditer(rf"(?<![\w$@])(?:{'|'.join(words)})\s+(?:\([^()]*\)\s*|(?:{_NAME}\.)+)?({_NAME})", clean):
        yield (m[1], m.start(1)), clean[m.end() :]


def _before_parenthesis(clean: str) -> tuple[str, Place, str] | None:
    """The line up to the name before its first parenthesis, the name, and what the parenthesis holds and what follows."""
    head, found, rest = clean.partition("(")
    m = re.search(rf"({_NAME})\s*$", head) if found else None
    return (head[: m.start()], (m[1], m.start(1)), rest) if m else None


def _typed(clean: str, ends: str) -> Place | None:
    """A name behind a type: ``Type name(...)`` and then one of ``ends``."""
    parts = _before_parenthesis(clean)
    if parts is None or not re.fullmatch(r"[\w$.<>?,\[\]:*&\s]*[\w$.<>?,\[\]:*&]\s+", parts[0]):
        return None
    stop = re.search(r"[;{}]", parts[2])
    closed = stop is not None and stop[0] in ends and parts[2][: stop.start()].rstrip().endswith(")")
    return parts[1] if closed else None


def _member(clean: str) -> Place | None:
    """A method of a class body: the line is ``name(...) {``."""
    parts = _before_parenthesis(clean)
    plain = parts is not None and parts[0].strip() in ("", "async") and re.match(r"[^)]*\)\s*\{", parts[2])
    return parts[1] if plain else None


def _assigned(clean: str) -> Place | None:
    """A variable that holds an arrow function: a declared name before ``=``, parameters alone between it and ``=>``."""
    head, sign, rest = clean.partition("=")
    words = head.split()
    declared = words[1:] if words[:1] == ["export"] else words
    if not sign or rest[:1] in ("=", ">") or len(declared) != 2 or declared[0] not in ("const", "let", "var") or not re.fullmatch(_NAME, declared[1]):
        return None
    value, arrow, _ = rest.partition("=>")
    value = value.strip()
    while value.startswith(("async", "function")):
        value = value.removeprefix("async").removeprefix("function").lstrip()
    plain = arrow and value.startswith("(") and value.find(")") == len(value) - 1
    return (declared[1], head.rindex(declared[1])) if plain else None


def _message(clean: str) -> Place | None:
    """A method with a sign and its type in parentheses before the name."""
    m = re.match(rf"\s*[-+]\s*\([^()]*\)\s*({_NAME})", clean)
    return (m[1], m.start(1)) if m and clean.rstrip().endswith("{") else None


def _candidates(clean: str, language: str) -> Iterator[tuple[str, Place | None]]:
    """What may be declared in a line, functions before types, in the order in which it is tried."""
    language = "typescript" if language == "javascript" else language
    words = INTRODUCERS.get(language, {})
    for place, rest in _introduced(clean, words.get("function", ["(?!)"])):
        if rest.lstrip().startswith("(") and (language != "go" or "{" in rest):
            yield "function", place
    if language == "typescript":
        yield from (("function", rule(clean)) for rule in (_assigned, _member))
    elif language in ("java", "cfamily"):
        yield "function", _typed(clean, "{;" if language == "java" else "{")
    elif language == "objc":
        yield "function", _message(clean)
    for place, rest in _introduced(clean, words.get("klass", ["(?!)"])):
        if language != "go" or re.match(r"\s+(?:struct|interface)", rest):
            yield "klass", place


_LONG_LINE = 500
TOP_LEVEL_SIGNATURE = "code outside any definition"

_STRING = r"\"(?:\\.|[^\"\\])*(?:\"|\\?$)|'(?:\\.|[^'\\])*(?:'|\\?$)"
_TICK = r"|`(?:\\.|[^`\\])*(?:`|\\?$)"
_OUTSIDE = {
    "python": re.compile(r"(?P<rest>//.*|#.*)|(?P<open>\"\"\"|''')|" + _STRING, re.S),
    "go": re.compile(r"(?P<rest>//.*|#.*)|(?P<open>/\*)|" + _STRING + _TICK, re.S),
}
_OTHER = re.compile(r"(?P<rest>//.*)|(?P<open>/\*)|" + _STRING + _TICK, re.S)
_CLOSE = {"python": re.compile("\"\"\"|'''")}
_C_CLOSE = re.compile(r"\*/")


def strip_line(line: str, language: str, in_block: bool) -> tuple[str, bool]:
    """The line with comments and strings blanked, and whether a block is open behind it."""
    outside, close = _OUTSIDE.get(language, _OTHER), _CLOSE.get(language, _C_CLOSE)
    out, at = [], 0
    while at < len(line):
        found = (close if in_block else outside).search(line, at)
        plain = line[at : found.start() if found else len(line)]
        out.append(" " * len(plain) if in_block else plain)
        if not found:
            break
        out.append(" " * len(found[0]))
        in_block = False if in_block else found.lastgroup == "open"
        at = found.end()
    return "".join(out), in_block


@dataclass
class Found:
    """A definition while its file is read."""

    name: str
    kind: str
    col: int
    line: int = 0
    end: int = 0
    signature: str = ""
    depth: int = 0
    body: bool = False
    calls: list[tuple[str, int, int, str]] = field(default_factory=list)


def declaration(clean: str, language: str) -> Found | None:
    """The line's one declaration: the first candidate whose name is no keyword and doesn't follow ``new``."""
    if len(clean) > _LONG_LINE:
        return None
    for kind, place in _candidates(clean, language):
        if place and place[0] not in KEYWORDS and not clean[: place[1]].strip().endswith("new"):
            return Found(place[0], kind, place[1])
    return None


def _type_arguments(clean: str, end: int) -> int:
    """Where the balanced angle brackets that close before ``end`` open; ``end`` where none do."""
    open_ = 0
    for at in range(end - 1, -1, -1):
        open_ += (clean[at] == ">") - (clean[at] == "<")
        if not open_:
            return at
    return end


def _name_before(clean: str, end: int) -> Place | None:
    """The name that ends before ``end``; what precedes a name's first letter in a run of word characters is not part of it."""
    start = end
    while start and (clean[start - 1].isalnum() or clean[start - 1] in "_$"):
        start -= 1
    while start < end and clean[start] == "$":
        start += 1
    if start < end and not (clean[start].isascii() and (clean[start].isalpha() or clean[start] == "_")):
        start = clean.find("$", start, end)
    return (clean[start:end], start) if 0 <= start < end else None


def _calls(clean: str) -> list[tuple[int, str]]:
    """Names before a parenthesis, with balanced type arguments between them or none, in the order of their columns."""
    found = []
    at = clean.find("(")
    while at >= 0:
        end = len(clean[:at].rstrip())
        place = _name_before(clean, _type_arguments(clean, end) if clean[end - 1 : end] == ">" else end)
        if place and place[0] not in KEYWORDS:
            found.append((place[1], place[0]))
        at = clean.find("(", at + 1)
    return sorted(found)


class _Braces:
    """Scopes by brace depth."""

    def __init__(self) -> None:
        self.depth, self.open = 0, []

    def line(self, raw: str, clean: str, no: int, own: Found | None) -> Iterator[tuple[Found | None, int, str]]:
        prefix = [0]
        for c in clean:
            prefix.append(prefix[-1] + (c == "{") - (c == "}"))
        if own:
            while self.open and not self.open[-1].body:
                self.open.pop()
            paren = clean.find("(", own.col)
            own.depth, own.body = self.depth + prefix[own.col], paren >= 0 and "{" in clean[paren + 1 :]
        holder = self.open[-1] if self.open else None
        for col, name in _calls(clean):
            mine = own is not None and col >= own.col
            if not (mine and col == own.col and name == own.name):
                yield (own if mine else holder), col, name
        if own:
            self.open.append(own)
        self.depth += prefix[-1]
        while self.open and not self.open[-1].body:
            self.open.pop().end = no
        while self.open and self.depth <= self.open[-1].depth:
            self.open.pop().end = no


class _Indents:
    """Scopes by indentation; with ``compat`` a blank line closes them and an end is the closing line itself."""

    def __init__(self, compat: bool) -> None:
        self.compat, self.open, self.last = compat, [], 0

    def line(self, raw: str, clean: str, no: int, own: Found | None) -> Iterator[tuple[Found | None, int, str]]:
        if not self.compat and not clean.strip():
            return
        head = raw[: len(raw) - len(raw.lstrip(" \t"))]
        indent = len(head) + 3 * head.count("\t")
        while self.open and indent <= self.open[-1].depth:
            self.open.pop().end = no if self.compat else self.last
        holder = self.open[-1] if self.open else None
        for col, name in _calls(clean):
            if not (own and col == own.col and name == own.name):
                yield holder, col, name
        if own:
            own.depth, own.end = indent, no
            self.open.append(own)
        self.last = no

    def finish(self) -> None:
        if not self.compat:
            for found in self.open:
                found.end = self.last


def extract(rel_path: str, language: str, lines: list[str], compat: bool = True) -> list[Found]:
    """Definitions of a file in order of line and column, with their calls; ownerless calls form one pseudo definition.

    ``compat`` keeps the known quirks of line-based scoping for indented languages.
    """
    scope = _Indents(compat) if language == "python" else _Braces()
    found: list[Found] = []
    loose: list[tuple[str, int, int, str]] = []
    in_block = False
    for no, raw in enumerate(lines, 1):
        clean, in_block = strip_line(raw, language, in_block)
        own = declaration(clean, language)
        if own:
            own.line, own.signature = no, raw
            found.append(own)
        for owner, col, name in scope.line(raw, clean, no, own):
            (loose if owner is None else owner.calls).append((name, no, col, raw))
    if isinstance(scope, _Indents):
        scope.finish()
    for f in found:
        f.end = f.end or len(lines)
    if loose:
        found.append(Found(f"top level of {rel_path.rsplit('/', 1)[-1]}", "topLevel", 0, loose[0][1], len(lines), TOP_LEVEL_SIGNATURE, calls=loose))
    unique = {(f.name, f.line, f.col): f for f in reversed(found)}
    return sorted(unique.values(), key=lambda f: (f.line, f.col))


Extractor = Callable[[str, str, list[str]], list[Found]]
_REGISTRY: dict[str, Extractor] = {}


def register_language(name: str, extractor: Extractor) -> None:
    """Use an own extractor for a language; it must be importable or picklable on the executors."""
    _REGISTRY[name] = extractor


def analyze(files: DataFrame, compat: bool = True) -> DataFrame:
    """One row per definition of ``files(rel_path, language, lines)``.

    Columns def_id, name, kind, rel_path, language, start_line, start_col, end_line, signature and
    ``calls``, an array of (callee, line_no, start_col, line). A file whose reading fails has one row
    of kind ``error`` with the message as signature.
    """
    registry = dict(_REGISTRY)
    call = "array<struct<callee:string,line_no:int,start_col:int,line:string>>"
    row = f"array<struct<name:string,kind:string,start_line:int,start_col:int,end_line:int,signature:string,calls:{call}>>"

    @F.pandas_udf(row)
    def run(paths: pd.Series, languages: pd.Series, lines: pd.Series) -> pd.Series:
        out = []
        for path, language, own in zip(paths, languages, lines, strict=True):
            try:
                use = registry.get(language)
                found = use(path, language, list(own)) if use else extract(path, language, list(own), compat)
            except Exception as e:  # a bad file must not end the project's analysis
                found = [Found("", "error", 0, signature=f"{type(e).__name__}: {e}")]
            out.append(
                [
                    {
                        "name": f.name,
                        "kind": f.kind,
                        "start_line": f.line,
                        "start_col": f.col,
                        "end_line": f.end,
                        "signature": f.signature,
                        "calls": [dict(zip(("callee", "line_no", "start_col", "line"), c, strict=True)) for c in f.calls],
                    }
                    for f in found
                ]
            )
        return pd.Series(out)

    rows = files.select("rel_path", "language", F.inline(run("rel_path", "language", "lines")))
    return rows.select(F.concat_ws("::", "rel_path", "name", "start_line", "start_col").alias("def_id"), *rows.columns)


def sites_of(defs: DataFrame) -> DataFrame:
    """Call sites (def_id, rel_path, callee, line_no, start_col, line) of analysed definitions."""
    return defs.select("def_id", "rel_path", F.inline("calls"))
