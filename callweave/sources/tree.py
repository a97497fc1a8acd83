"""Directory trees as a Spark data source: listed by directory, excluded directories never opened.

The planner lists breadth first until there are enough directories to deal out; every partition then lists one of
them, in an executor. Directories that scans leave out are pruned before they are opened. Names that begin with ``.``
or ``_`` are listed like others, which Spark's own file sources never do. Directories behind links aren't entered; a
link to a file has the target's place, below the root or absolute. The tree must be on a file system that the driver and
all executors see under one path.
"""

from __future__ import annotations

import os
import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

#: Directories that are wanted before the planner stops listing.
WANTED = 64
SCHEMA = "rel_path string, parent string, name string, type string, link boolean, length long, path string"


class Listing(InputPartition):
    """One directory, by its path below the root; ``deep`` lists all below it, else its own entries alone."""

    def __init__(self, rel: str, deep: bool):
        super().__init__((rel, deep))
        self.rel, self.deep = rel, deep


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = os.path.realpath(options["path"].removeprefix("file://").removeprefix("file:"))
        self.excluded = frozenset(x for x in options.get("excluded", "").split("\n") if x)
        self.seconds = float(options["seconds"]) if options.get("seconds") else None
        self.wanted = int(options.get("partitions", WANTED))

    def _entries(self, rel: str) -> list[os.DirEntry]:
        """Entries of a directory by name; one that can't be read has none."""
        try:
            with os.scandir(os.path.join(self.root, rel)) as found:
                return sorted(found, key=lambda e: e.name)
        except OSError:
            return []

    def _enters(self, entry: os.DirEntry) -> bool:
        return entry.is_dir(follow_symlinks=False) and not entry.name.startswith(".") and entry.name not in self.excluded

    def partitions(self) -> list[Listing]:
        own, ahead = [], [""]
        while ahead and len(own) + len(ahead) < self.wanted:
            rel = ahead.pop(0)
            own.append(Listing(rel, False))
            ahead += [os.path.join(rel, e.name) for e in self._entries(rel) if self._enters(e)]
        return own + [Listing(rel, True) for rel in ahead]

    def read(self, partition: Listing) -> Iterator[tuple]:
        end = None if self.seconds is None else time.monotonic() + self.seconds
        ahead = [partition.rel]
        while ahead:
            rel = ahead.pop()
            for e in self._entries(rel):
                if end is not None and time.monotonic() > end:
                    return
                inside = os.path.join(rel, e.name)
                if e.is_dir(follow_symlinks=False):
                    if self._enters(e):
                        yield inside, rel, e.name, "dir", False, None, e.path
                        if partition.deep:
                            ahead.append(inside)
                elif e.is_file():
                    place = os.path.realpath(e.path) if e.is_symlink() else e.path
                    yield place.removeprefix(self.root + os.sep), rel, e.name, "file", e.is_symlink(), e.stat().st_size, e.path


class SourceTree(DataSource):
    """``spark.read.format("source_tree")`` with the options path, excluded (names, one a line), seconds and partitions.

    Rows are directories and files: rel_path (of a link its target's, absolute outside the root), parent, name, type (dir or
    file), link, length (null for directories) and path. Hidden directories are pruned, hidden files are listed.
    ``seconds`` bounds every partition's listing; what was found until then stays.
    """

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> TreeReader:
        return TreeReader(dict(self.options))


def read_tree(spark: SparkSession, root: str, excluded: list[str], seconds: float | None = None) -> DataFrame:
    """All entries of a tree; see ``SourceTree``."""
    spark.dataSource.register(SourceTree)
    reader = spark.read.format("source_tree").option("path", root).option("excluded", "\n".join(excluded))
    return (reader if seconds is None else reader.option("seconds", str(seconds))).load()
