"""Functions, classes and calls of one file with ownership, for the five languages of "qualified" mode.

Python is read by its own parser. The brace languages are read by position: comments and strings are
blanked in place, braces are paired once, and headers found by pattern get the range of their body.
Ownership is then containment of positions. Lines and columns start at 1, columns count code points.
Declared subset: functions assigned to names and interfaces are no functions; a method needs a class
around it; object literals' methods and calls without parentheses are not seen.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_right
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.functions.extract import KEYWORDS, strip_line

#: Classes, functions and calls kept of one file.
LIMIT = 2000

_NAME = r"([A-Za-z_$][\w$]*)"
_CLASS = {
    "typescript": rf"\bclass\s+{_NAME}",
    "javascript": rf"\bclass\s+{_NAME}",
    "java": rf"\bclass\s+{_NAME}",
    "kotlin": rf"\b(?:class|interface)\s+{_NAME}",
}
_FUNCTION = {
    "typescript": rf"\bfunction\s*\*?\s*{_NAME}\s*(?:<[^>]*>)?\s*\(",
    "javascript": rf"\bfunction\s*\*?\s*{_NAME}\s*\(",
    "kotlin": rf"\bfun\s+(?:<[^>]*>\s*)?(?:[A-Za-z_][\w<>?, ]*\.)*{_NAME}\s*\(",
}
_METHOD = re.compile(rf"{_NAME}\s*(?:<[^>(]*>)?\s*\(")
_CALL = re.compile(rf"{_NAME}\s*(?:<[^>(){{}};]*>)?\s*\(")
_NEW = re.compile(rf"\bnew\s+(?:[A-Za-z_$][\w$]*\.)*{_NAME}")


def qualified_id(language: str, path: str, owner: str | None, name: str, signature: str) -> str:
    return "::".join((language, path, owner or "", name, signature))


def split_top(text: str, mark: str = ",") -> list[str]:
    """Parts between marks that no bracket encloses."""
    parts, depth, start = [], 0, 0
    for i, c in enumerate(text):
        depth += (c in "([{<") - (c in ")]}" or (c == ">" and text[i - 1 : i] not in "=-"))
        if c == mark and depth <= 0:
            parts.append(text[start:i])
            start = i + 1
    return [p.strip() for p in [*parts, text[start:]] if p.strip()]


def parameter(text: str, language: str) -> str:
    """A parameter's type where it is written, else its name."""
    if language == "java":
        return re.sub(r"^(?:final\s+|@\w+\s+)*", "", text).rpartition(" ")[0].strip() or text
    name, colon, kind = text.partition(":")
    if colon:
        return split_top(kind, "=")[0] if kind.strip() else name.strip()
    return name.partition("=")[0].strip()


class _Braces:
    """A file of a brace language with comments and strings blanked."""

    def __init__(self, text: str, language: str):
        self.language, self.lines = language, text.split("\n")
        clean, block = [], False
        for line in self.lines:
            out, block = strip_line(line, language, block)
            clean.append(out)
        self.clean = "\n".join(clean)
        self.starts = [0]
        for line in clean:
            self.starts.append(self.starts[-1] + len(line) + 1)
        self.pair: dict[int, int] = {}
        self.opens: list[int] = []
        self.parent: dict[int, int] = {}
        stack: list[tuple[str, int]] = []
        for m in re.finditer(r"[(){}\[\]]", self.clean):
            c = m[0]
            if c in "({[":
                self.opens.append(m.start())
                self.parent[m.start()] = stack[-1][1] if stack else -1
                stack.append((c, m.start()))
            elif stack and stack[-1][0] + c in ("()", "{}", "[]"):
                self.pair[stack.pop()[1]] = m.start()

    def around(self, at: int) -> int:
        """The innermost bracket that is open at a position, or -1."""
        k = bisect_right(self.opens, at - 1) - 1
        o = self.opens[k] if k >= 0 else -1
        while o >= 0 and self.pair.get(o, len(self.clean)) < at:
            o = self.parent[o]
        return o

    def place(self, at: int) -> tuple[int, int]:
        row = bisect_right(self.starts, at) - 1
        return row + 1, at - self.starts[row] + 1

    def body(self, paren: int) -> tuple[int, int, bool] | None:
        """Closing parenthesis, end of the definition, and whether it has a body in braces."""
        close = self.pair.get(paren)
        if close is None:
            return None
        tail = re.compile(r"[^{};=]*").match(self.clean, close + 1)
        if self.language == "java":
            tail = re.compile(r"\s*(?:throws[\w\s.,]*)?").match(self.clean, close + 1)
        elif self.language == "kotlin":
            tail = re.compile(r"\s*(?::[^{}=\n]*)?\s*").match(self.clean, close + 1)
        after = self.clean[tail.end() : tail.end() + 1]
        if after == "{":
            return close, self.pair.get(tail.end(), len(self.clean) - 1), True
        if self.language == "kotlin" and after == "=":
            stop = self.clean.find("\n", tail.end())
            return close, (stop if stop >= 0 else len(self.clean)) - 1, False
        return close, close, False


def _innermost(ranges: list[dict], at: int) -> dict | None:
    around = [r for r in ranges if r["from"] <= at <= r["to"]]
    return max(around, key=lambda r: r["from"], default=None)


def _comment_above(lines: list[str], row: int) -> str | None:
    """The comment that ends above a row; blank lines between them don't part them."""
    k = row - 1
    while k >= 0 and not lines[k].strip():
        k -= 1
    if k < 0:
        return None
    if lines[k].strip().endswith("*/"):
        start = next((r for r in range(k, -1, -1) if "/*" in lines[r]), None)
        return None if start is None else "\n".join(x.strip() for x in lines[start : k + 1])
    first = k
    while first >= 0 and lines[first].strip().startswith("//"):
        first -= 1
    return "\n".join(x.strip() for x in lines[first + 1 : k + 1]) or None


def _parse_braces(path: str, language: str, text: str) -> dict:
    src = _Braces(text, language)
    classes = []
    for m in re.finditer(_CLASS[language], src.clean):
        brace = src.clean.find("{", m.end())
        stop = re.compile(r"[;}]").search(src.clean, m.end())
        inside = brace >= 0 and (stop is None or brace < stop.start())
        classes.append({"name": m[1], "at": m.start(), "from": brace if inside else m.start(), "to": src.pair.get(brace, len(src.clean)) if inside else m.start()})
    classes = classes[:LIMIT]
    heads: dict[int, tuple[str, int]] = {}
    if language in _FUNCTION:
        heads.update({m.start(1): (m[1], m.end() - 1) for m in re.finditer(_FUNCTION[language], src.clean)})
    if language != "kotlin":
        depth_of = {}
        for c in classes:
            for m in _METHOD.finditer(src.clean, c["from"], c["to"]):
                depth_of.setdefault(m.start(1), (m, c))
        for at, (m, _) in depth_of.items():
            owner = _innermost(classes, at)
            direct = owner is not None and src.around(at) == owner["from"]
            found = src.body(m.end() - 1) if direct else None
            near = src.clean[max(owner["from"], at - 200) : at] if direct else ""
            before = near.rstrip(" \t")
            typed = re.search(r"[\w>\]]\s+$", near)
            is_method = direct and found and m[1] not in KEYWORDS - {"get", "set", "init", "data", "open"} and before[-1:] not in ".=(,:"
            if language == "java":
                is_method = is_method and (bool(typed) and not re.search(r"\b(?:new|return)\s+$", near) or (m[1] == owner["name"] and found[2]))
            elif is_method:
                is_method = found[2]
            if is_method:
                heads.setdefault(at, (m[1], m.end() - 1))
    functions = []
    for at, (name, paren) in sorted(heads.items()):
        found = src.body(paren)
        if not found:
            continue
        owner = _innermost(classes, at)
        inputs = [parameter(p, language) for p in split_top(src.clean[paren + 1 : found[0]])]
        line, col = src.place(src.clean.rfind("\n", 0, at) + 1 + len(re.match(r"\s*", src.clean[src.clean.rfind("\n", 0, at) + 1 : at])[0]))
        signature = f"({', '.join(inputs)})"
        functions.append(
            {"id": qualified_id(language, path, owner and owner["name"], name, signature), "name": name, "class_name": owner and owner["name"], "param_signature": signature, "start_line": line, "start_col": col,
             "end_line": src.place(found[1])[0], "doc_comment": _comment_above(src.lines, line - 1), "from": at, "to": found[1]}
        )
    functions = functions[:LIMIT]
    named = {f["from"] for f in functions} | set(heads)
    sites = {m.start(1): m[1] for m in _CALL.finditer(src.clean) if m[1] not in KEYWORDS and m.start(1) not in named}
    if language != "kotlin":
        sites.update({m.start(1): m[1] for m in _NEW.finditer(src.clean)})
    calls = []
    for at, name in sorted(sites.items())[:LIMIT]:
        line, col = src.place(at)
        owner = _innermost(functions, at)
        calls.append({"callee": name, "caller_id": owner and owner["id"], "line_no": line, "start_col": col, "code": src.lines[line - 1]})
    shown = [{"id": qualified_id(language, path, None, c["name"], ""), "name": c["name"], "start_line": src.place(c["at"])[0]} for c in classes]
    return {"functions": functions, "classes": shown, "calls": calls}


def _parse_python(path: str, text: str) -> dict:
    lines = text.split("\n")
    out: dict[str, list] = {"functions": [], "classes": [], "calls": []}

    def column(row: int, offset: int) -> int:
        return len(lines[row - 1].encode()[:offset].decode("utf-8", "ignore")) + 1

    def visit(node: ast.AST, owner: str | None, caller: str | None) -> None:
        for child in ast.iter_child_nodes(node):
            inner_owner, inner_caller = owner, caller
            if isinstance(child, ast.ClassDef):
                out["classes"].append({"id": qualified_id("python", path, None, child.name, ""), "name": child.name, "start_line": child.lineno})
                inner_owner = child.name
            elif isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef):
                a = child.args
                every = [*a.posonlyargs, *a.args, *([a.vararg] if a.vararg else []), *a.kwonlyargs, *([a.kwarg] if a.kwarg else [])]
                signature = f"({', '.join(ast.unparse(p.annotation) if p.annotation else p.arg for p in every)})"
                inner_caller = qualified_id("python", path, owner, child.name, signature)
                out["functions"].append(
                    {"id": inner_caller, "name": child.name, "class_name": owner, "param_signature": signature, "start_line": child.lineno, "start_col": column(child.lineno, child.col_offset),
                     "end_line": child.end_lineno, "doc_comment": ast.get_docstring(child, clean=False)}
                )
            elif isinstance(child, ast.Call):
                f = child.func
                name = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None
                if name:
                    row = f.end_lineno
                    out["calls"].append({"callee": name, "caller_id": caller, "line_no": row, "start_col": column(row, f.end_col_offset) - len(name), "code": lines[child.lineno - 1]})
            visit(child, inner_owner, inner_caller)

    visit(ast.parse(text), None, None)
    out["calls"].sort(key=lambda c: (c["line_no"], c["start_col"]))
    return {k: v[:LIMIT] for k, v in out.items()}


Parser = Callable[[str, str, str], dict]
_REGISTRY: dict[str, Parser] = {}


def register_syntax(language: str, parser: Parser) -> None:
    """Use an own parser for a language: (path, language, text) to functions, classes and calls."""
    _REGISTRY[language] = parser


def parse_text(path: str, language: str, text: str | None) -> dict:
    """Functions, classes, calls and error of one file; never raises. Empty text is an empty result."""
    try:
        if not text:
            found = {"functions": [], "classes": [], "calls": []}
        elif language in _REGISTRY:
            found = _REGISTRY[language](path, language, text)
        else:
            found = _parse_python(path, text) if language == "python" else _parse_braces(path, language, text)
        return {**found, "error": None}
    except Exception as e:  # a bad file must not end the project's analysis
        return {"functions": [], "classes": [], "calls": [], "error": f"{type(e).__name__}: {e}"}


_FUNCTION_ROW = "struct<id:string,name:string,class_name:string,param_signature:string,start_line:int,start_col:int,end_line:int,doc_comment:string>"
_CLASS_ROW = "struct<id:string,name:string,start_line:int>"
_CALL_ROW = "struct<callee:string,caller_id:string,line_no:int,start_col:int,code:string>"


def parse_files(files: DataFrame) -> DataFrame:
    """One row per file of ``files(rel_path, language, text)``: rel_path, language, functions, classes, calls, error."""
    registry = dict(_REGISTRY)

    @F.pandas_udf(f"functions array<{_FUNCTION_ROW}>, classes array<{_CLASS_ROW}>, calls array<{_CALL_ROW}>, error string")
    def run(paths: pd.Series, languages: pd.Series, texts: pd.Series) -> pd.DataFrame:
        _REGISTRY.update(registry)
        rows = [parse_text(*x) for x in zip(paths, languages, texts, strict=True)]
        for r in rows:
            for f in r["functions"]:
                f.pop("from", None)
                f.pop("to", None)
        return pd.DataFrame(rows, columns=["functions", "classes", "calls", "error"])

    return files.select("rel_path", "language", run("rel_path", "language", "text").alias("p")).select("rel_path", "language", "p.*")


def symbols_of(parsed: DataFrame) -> DataFrame:
    """Functions as definitions: def_id, name, rel_path, language, class_name, param_signature, lines and comment."""
    return parsed.select("rel_path", "language", F.inline("functions")).withColumnRenamed("id", "def_id")


def calls_of(parsed: DataFrame) -> DataFrame:
    """Call sites: rel_path, callee, caller_id, line_no, start_col, code."""
    return parsed.select("rel_path", F.inline("calls"))
