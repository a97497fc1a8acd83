"""A project: source files with their definitions, call sites and bindings, and the reports over them."""

from __future__ import annotations

import argparse
import sys
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.functions.extract import analyze, sites_of
from callweave.functions.labels import trim_code
from callweave.functions.languages import DISPLAY_NAMES
from callweave.functions.syntax import calls_of, parse_files, symbols_of
from callweave.operators import graph, resolve, search
from callweave.plans.stored import stored
from callweave.sources import files as sources


class Project:
    """Tables of one project; each is computed once and kept in the shared folder."""

    def __init__(self, files: DataFrame, compat: bool = True):
        """``files`` has rel_path, language and lines (an array of strings)."""
        self.files = files
        self.compat = compat

    @classmethod
    def scan(cls, spark: SparkSession, root: str, options: sources.ScanOptions | None = None, compat: bool = True) -> Project:
        options = options or sources.ScanOptions()
        found = sources.list_files(spark, root, "name", options).withColumn("text", sources.decode_name_mode("content")).where("text is not null")
        lines = F.split("text", sources.NEWLINES, -1)
        return cls(found.select("rel_path", "language", lines.alias("lines") if options.max_lines is None else F.slice(lines, 1, options.max_lines).alias("lines")), compat)

    @cached_property
    def definitions(self) -> DataFrame:
        return stored(analyze(self.files, self.compat)).where("kind <> 'error'")

    @cached_property
    def sites(self) -> DataFrame:
        return sites_of(self.definitions)

    @cached_property
    def lines(self) -> DataFrame:
        return self.files.select("rel_path", "language", F.posexplode("lines").alias("p", "line")).select("rel_path", "language", (F.col("p") + 1).alias("line_no"), "line")

    @cached_property
    def owners(self) -> DataFrame:
        return resolve.line_owners(self.definitions, self.lines.select("rel_path", "line_no")).where("def_id is not null")

    @cached_property
    def edge_sites(self) -> DataFrame:
        """Bound call sites as (src, dst, site_file, site_line, site_col)."""
        bound = resolve.resolve_name(self.sites, self.definitions)
        return stored(bound.select(F.col("def_id").alias("src"), F.col("target_id").alias("dst"), F.col("rel_path").alias("site_file"), F.col("line_no").alias("site_line"), F.col("start_col").alias("site_col")))

    @cached_property
    def edges(self) -> DataFrame:
        """Edges; callees come by their first site, callers by the place of their definition."""
        places = self.definitions.select(F.col("def_id").alias("id"), F.col("rel_path").alias("file"), F.col("start_line").alias("line"))
        return graph.edge_groups(self.edge_sites, places)

    def languages(self) -> DataFrame:
        """Files per language, by display name."""
        name = F.col("language")
        for key, shown in DISPLAY_NAMES.items():
            name = F.when(F.col("language") == key, shown).otherwise(name)
        return self.files.groupBy(name.alias("language")).agg(F.count(F.lit(1)).alias("n")).orderBy("language")

    def match(self, text: str, rule: str = "text") -> DataFrame:
        return resolve.match_symbol(self.definitions, text, rule)

    def search(self, query: str, current_file: str | None = None) -> DataFrame:
        return search.search(self.lines, self.definitions, self.sites, self.owners, query, current_file)

    def call_graph(self, anchor: DataFrame, callee_depth: int = graph.UNBOUNDED, caller_depth: int = graph.UNBOUNDED, caps: graph.Caps | None = None) -> dict:
        """Nodes, induced edges, unresolved sites and flags around ``anchor(id)``."""
        caps = graph.NAME_CAPS if caps is None else caps
        nodes, cut = graph.walk(self.edges, anchor, callee_depth, caller_depth, "name", caps)
        chosen = self.sites.join(nodes.select(F.col("id").alias("def_id")), "def_id", "left_semi")
        missing = stored(resolve.unresolved(chosen, self.definitions, 61))
        return {
            "nodes": nodes.join(self.definitions.withColumnRenamed("def_id", "id"), "id").orderBy("level", "rel_path", "start_line"),
            "edges": graph.induced_edges(self.edges, nodes).orderBy(F.concat("src", F.lit(" -> "), "dst")),
            "unresolved": missing.orderBy("rel_path", "line_no", "start_col").limit(60),
            "truncated": cut,
            "unresolved_truncated": missing.count() > 60,
        }

    def json_report(self, symbol: str, callee_depth: int = graph.UNBOUNDED, caller_depth: int = graph.UNBOUNDED) -> DataFrame:
        """One row, one column ``report``: the session as JSON. Nodes are bounded by the graph's caps."""
        found = self.match(symbol, "json").select(F.col("def_id").alias("id"))
        g = self.call_graph(found, callee_depth, caller_depth)
        site = F.struct("callee", F.col("rel_path").alias("file"), F.col("line_no").alias("line"))
        nodes = g["nodes"].agg(F.sort_array(F.collect_list(F.struct("level", F.col("rel_path").alias("file"), F.col("start_line").alias("line"), "name", "kind"))).alias("nodes"))
        edges = g["edges"].agg(F.sort_array(F.collect_list(F.struct(F.col("src").alias("from"), F.col("dst").alias("to"), F.col("n_sites").alias("sites")))).alias("edges"))
        missing = g["unresolved"].agg(F.sort_array(F.collect_list(site)).alias("unresolved"))
        counts = self.files.agg(F.count(F.lit(1)).alias("files")), self.definitions.agg(F.count(F.lit(1)).alias("definitions"))
        one = lambda df: df.withColumn("k_", F.lit(1))
        row = one(counts[0])
        for part in (counts[1], nodes, edges, missing, found.select(F.col("id").alias("anchor"))):
            row = row.join(one(part), "k_", "left")
        fields = F.struct("anchor", "definitions", "edges", "files", "nodes", F.lit("").alias("root"), F.lit(symbol).alias("symbol"), F.lit(g["truncated"]).alias("truncated"), "unresolved")
        return row.select(F.to_json(fields, {"pretty": "true"}).alias("report"))

    def text_report(self, symbol: str | None, callee_depth: int = graph.UNBOUNDED, caller_depth: int = graph.UNBOUNDED) -> tuple[int, str]:
        """Exit code and a text report; every list in it has a fixed length."""
        out = [f"files: {self.files.count()}", f"definitions: {self.definitions.count()}"]
        out += [f"  {r.language}: {r.n}" for r in self.languages().collect()]
        if symbol is None:
            order = self.definitions.orderBy("rel_path", "start_line", "start_col").limit(40)
            return 0, "\n".join(out + [f"  {r.name} {r.rel_path}:{r.start_line}" for r in order.collect()])
        found = stored(self.match(symbol))
        if found.isEmpty():
            return 1, "\n".join([*out, f"no symbol matches {symbol}"])
        anchor = found.select(F.col("def_id").alias("id"))
        g = self.call_graph(anchor, callee_depth, caller_depth)
        nodes = g["nodes"].select("id", "level", "name", "rel_path", "start_line").collect()
        for level in sorted({n.level for n in nodes}, reverse=True):
            out.append(f"level {level}")
            out += [f"  {n.name} {n.rel_path}:{n.start_line}" for n in nodes if n.level == level]
        near = graph.anchor_adjacent(self.edge_sites, anchor).orderBy("site_file", "site_line", "site_col").limit(graph.NAME_CAPS.nodes).collect()
        out += ["call sites at the anchor"] + [f"  {s.src} -> {s.dst} line {s.site_line}" for s in near]
        missing = g["unresolved"].select("callee", "rel_path", "line_no", trim_code("line").alias("code")).limit(15).collect()
        out += ["unresolved"] + [f"  {m.callee} {m.rel_path}:{m.line_no} {m.code}" for m in missing]
        return 0, "\n".join([*out, f"nodes {len(nodes)}, edges {g['edges'].count()}, unresolved {g['unresolved'].count()}"])


class QualifiedProject:
    """A project whose calls have one target or none; functions are told apart by language, file, class, name and parameters."""

    def __init__(self, files: DataFrame):
        """``files`` has rel_path, language and text."""
        self.files = files

    @classmethod
    def scan(cls, spark: SparkSession, root: str) -> QualifiedProject:
        """The collected source files below a root; binary and undecodable ones are left out."""
        found = sources.decode_qualified_mode(sources.list_files(spark, root, "qualified"))
        return cls(found.where("text is not null").select("rel_path", "language", "text"))

    @cached_property
    def parsed(self) -> DataFrame:
        return stored(parse_files(self.files))

    @cached_property
    def definitions(self) -> DataFrame:
        """Functions: id, file, line, name, column, class_name, param_signature, language and doc_comment."""
        rows = symbols_of(self.parsed).dropDuplicates(["def_id"])
        return stored(rows.select(F.col("def_id").alias("id"), F.col("rel_path").alias("file"), F.col("start_line").cast("long").alias("line"), "name", F.col("start_col").alias("column"), "class_name", "param_signature", "language", "doc_comment"))

    @cached_property
    def calls(self) -> DataFrame:
        """Calls with their binding: src (null outside functions), dst (null unless bound), status, site and its text."""
        known = self.definitions.select(F.col("id").alias("def_id"), "name", F.col("file").alias("rel_path"), "class_name")
        caller = known.select(F.col("def_id").alias("caller_id"), F.col("class_name").alias("caller_class"))
        bound = resolve.resolve_qualified(calls_of(self.parsed).join(caller, "caller_id", "left"), known)
        site = [F.col("rel_path").alias("site_file"), F.col("line_no").alias("site_line"), F.col("start_col").alias("site_col")]
        return stored(bound.select(F.col("caller_id").alias("src"), F.col("target_id").alias("dst"), "status", *site, "callee", "code"))

    def match(self, text: str) -> DataFrame:
        """The function meant by a text: of the exact names, else of those that contain it in any case, the first by file and line."""
        found = self.definitions.where(F.contains(F.lower("name"), F.lower(F.lit(text))))
        return found.orderBy(F.col("name") != text, "file", "line", "column").limit(1)

    def graph(self, anchor: DataFrame, callee_depth: int = 5, caller_depth: int = 5, caps: graph.Caps | None = None) -> dict | None:
        """``graph.build_graph`` around ``anchor(id)``, with the usual caps unless others are given."""
        return graph.build_graph(self.definitions, self.calls, anchor, callee_depth, caller_depth, caps)

    def graphs(self, anchors: DataFrame, callee_depth: int = 5, caller_depth: int = 5, caps: graph.Caps | None = None) -> tuple[DataFrame, DataFrame]:
        """Nodes around every one of ``anchors(id)`` in one traversal, and the anchors that a cap cut."""
        edges = stored(graph.edge_groups(self.calls.drop("status", "callee", "code"), self.definitions))
        return graph.walk_many(edges, anchors, callee_depth, caller_depth, "qualified", caps or graph.QUALIFIED_CAPS)

    def json_report(self, symbol: str, callee_depth: int = 5, caller_depth: int = 5) -> DataFrame:
        """One row, one column ``report``: the graph as JSON, bounded by its caps; no row where no function matches."""
        found = stored(self.match(symbol).select("id"))
        g = self.graph(found, callee_depth, caller_depth)
        if g is None:
            return found.limit(0).select(F.col("id").alias("report"))
        listed = lambda df, name, *columns: df.agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(name)).withColumn("k_", F.lit(1))
        nodes = listed(g["nodes"], "nodes", "level", "file", "line", "name", "id", "parent", "child_ids", "has_children", "category")
        edges = listed(g["edges"], "edges", F.col("src").alias("from"), F.col("dst").alias("to"), "sites")
        missing = listed(g["unresolved"], "unresolved", F.col("site_file").alias("file"), F.col("site_line").alias("line"), F.col("site_col").alias("column"), "callee", "status")
        row = nodes.join(edges, "k_").join(missing, "k_").join(found.select(F.col("id").alias("anchor"), F.lit(1).alias("k_")), "k_")
        fields = F.struct("anchor", "edges", "nodes", F.lit(symbol).alias("symbol"), F.lit(g["truncated"]).alias("truncated"), "unresolved")
        return row.select(F.to_json(fields, {"pretty": "true"}).alias("report"))


def main(argv: list[str] | None = None) -> int:
    """Command line: a directory, and a symbol to build the graph around."""
    parser = argparse.ArgumentParser(prog="callweave")
    parser.add_argument("directory")
    parser.add_argument("--symbol")
    parser.add_argument("--depth", type=int, default=graph.UNBOUNDED)
    parser.add_argument("--caller-depth", type=int)
    parser.add_argument("--exclude", default="")
    parser.add_argument("--json", action="store_true")
    parser.add_argument("--mode", choices=["name", "qualified"], default="name")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if args.mode == "qualified":
        depth = 5 if args.depth == graph.UNBOUNDED else args.depth
        report = QualifiedProject.scan(spark, args.directory).json_report(args.symbol or "", depth, depth if args.caller_depth is None else args.caller_depth).first()
        print(report[0] if report else f"no symbol matches {args.symbol}")
        return 0 if report else 1
    options = sources.ScanOptions(extra_excludes=[x for x in args.exclude.split(",") if x])
    project = Project.scan(spark, args.directory, options)
    caller_depth = args.depth if args.caller_depth is None else args.caller_depth
    if args.json:
        print(project.json_report(args.symbol or "", args.depth, caller_depth).first()[0])
        return 0
    code, text = project.text_report(args.symbol, args.depth, caller_depth)
    print(text)
    return code


if __name__ == "__main__":
    sys.exit(main())
