"""Languages by file extension."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions of each language, in both engines and in the viewer.
NAME_MODE = {
    "kotlin": ["kt", "kts"],
    "java": ["java"],
    "swift": ["swift"],
    "typescript": ["ts", "tsx", "mts", "cts"],
    "javascript": ["js", "jsx", "mjs", "cjs"],
    "cfamily": ["c", "h", "cpp", "hpp", "cc", "cxx", "hh"],
    "python": ["py"],
    "go": ["go"],
    "objc": ["m", "mm"],
}
QUALIFIED_MODE = {
    "typescript": ["ts", "mts", "cts", "tsx"],
    "javascript": ["js", "mjs", "cjs", "jsx"],
    "python": ["py"],
    "java": ["java"],
    "kotlin": ["kt", "kts"],
}
VIEWER = {
    "typescript": ["ts", "tsx"],
    "javascript": ["js", "jsx", "mjs", "cjs"],
    "python": ["py"],
    "java": ["java"],
    "kotlin": ["kt", "kts"],
    "json": ["json"],
    "css": ["css"],
    "scss": ["scss"],
    "less": ["less"],
    "html": ["html", "htm"],
    "xml": ["xml", "svg"],
    "markdown": ["md"],
    "yaml": ["yaml", "yml"],
    "go": ["go"],
    "rust": ["rs"],
    "c": ["c", "h"],
    "cpp": ["cpp", "cc", "hpp"],
    "csharp": ["cs"],
    "ruby": ["rb"],
    "php": ["php"],
    "shell": ["sh", "bash"],
    "sql": ["sql"],
}
COLLECTED = ["ts", "tsx", "js", "jsx", "mjs", "py", "java", "kt", "kts", "swift", "css", "html", "json", "md"]
DISPLAY_NAMES = {
    "kotlin": "Kotlin",
    "java": "Java",
    "swift": "Swift",
    "typescript": "TypeScript",
    "javascript": "JavaScript",
    "cfamily": "C/C++",
    "python": "Python",
    "go": "Go",
    "objc": "ObjC",
}


def extension(path: Column | str) -> Column:
    """Lower-cased text behind the last dot of the last path part; empty without a dot."""
    base = F.element_at(F.split(path, "/"), -1)
    return F.when(F.instr(base, ".") > 0, F.lower(F.element_at(F.split(base, "[.]"), -1))).otherwise("")


def _lookup(ext: Column, table: dict[str, list[str]], default: str | None) -> Column:
    out = F.lit(default)
    for language, extensions in reversed(table.items()):
        out = F.when(ext.isin(extensions), language).otherwise(out)
    return out


def detect_language(path: Column | str, mode: str = "name") -> Column:
    """Language of a path in ``mode`` "name" or "qualified"; null where it has none."""
    return _lookup(extension(path), NAME_MODE if mode == "name" else QUALIFIED_MODE, None)


def viewer_language(path: Column | str) -> Column:
    """Display language; ``plaintext`` where none is known."""
    return _lookup(extension(path), VIEWER, "plaintext")


def collected_language(path: Column | str, strict: bool = False) -> Column:
    """Language with which a collected file is parsed; unknown ones count as TypeScript unless ``strict``."""
    found = _lookup(extension(path), {k: [e for e in v if e in COLLECTED] for k, v in QUALIFIED_MODE.items()}, None)
    return found if strict else F.coalesce(found, F.lit("typescript"))
