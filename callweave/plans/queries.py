"""Registered queries: every operator on the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from callweave.functions import extract, labels, languages
from callweave.operators import aggregates, explain, graph, resolve, search, search_index
from callweave.plans.stored import stored
from callweave.sources import adapters, files

#: Extensions dealt to documents so that every language rule is met.
EXTENSIONS = ["kt", "java", "swift", "ts", "tsx", "mts", "js", "cjs", "c", "hpp", "py", "go", "m", "mm", "css", "html", "json", "md", "KTS", "rs", "txt", ""]


def _long(df: DataFrame) -> DataFrame:
    """All integer columns as long, so that results compare with other engines."""
    return df.select(*[F.col(c).cast("long").alias(c) if t in ("int", "smallint") else F.col(c) for c, t in df.dtypes])


def _named_files(spark: SparkSession, d: str) -> DataFrame:
    ext = F.element_at(F.array(*[F.lit(e) for e in EXTENSIONS]), (F.col("doc_id") % len(EXTENSIONS) + 1).cast("int"))
    docs = adapters.read(spark, d, "documents")
    return docs.select(F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit("."), ext)).alias("rel_path"), "n_chars")


def _page_paths(spark: SparkSession, d: str) -> DataFrame:
    plain = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    return adapters.read(spark, d, "pages").select(F.regexp_replace(plain, "/+$", "").alias("rel_path")).distinct()


def _defs(spark: SparkSession, d: str, lines: DataFrame | None = None) -> DataFrame:
    rows = adapters.definitions(adapters.document_lines(spark, d) if lines is None else lines)
    rows = rows.withColumn("start_col", F.lit(1)).withColumn("kind", F.lit("function"))
    rows = rows.withColumn("class_name", F.when(F.length("name") > 4, F.col("language")))
    return rows.withColumn("def_id", resolve.qualified_id("language", "rel_path", "class_name", "name", F.col("start_line").cast("string")))


def _sites(spark: SparkSession, d: str, lines: DataFrame | None = None) -> DataFrame:
    return adapters.call_sites(adapters.document_lines(spark, d) if lines is None else lines).withColumnRenamed("turn", "start_col")


def _owned_sites(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Sites with their owning definition, and definitions."""
    defs = stored(_defs(spark, d))
    return stored(resolve.line_owners(defs, _sites(spark, d))), defs


def _part_graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sites, edges and hub of the graph of all consecutive lines of orders."""
    sites = stored(adapters.part_sites(spark, d))
    edges = stored(graph.edge_groups(sites, adapters.part_definitions(spark, d), lists=False))
    return sites, edges, stored(graph.hub(edges))


def _nodes(df: DataFrame) -> DataFrame:
    df = stored(df)
    rows = df.join(graph.root_path(df), "id")
    return _long(rows.select("id", "level", F.coalesce("parent", F.lit(-1)).alias("parent"), F.array_join("ids", ">").alias("path")))


def detect_language(spark, d):
    found = _named_files(spark, d)
    return found.select(
        "rel_path",
        languages.detect_language("rel_path").alias("name_mode"),
        languages.detect_language("rel_path", "qualified").alias("qualified_mode"),
        languages.viewer_language("rel_path").alias("viewer"),
        languages.collected_language("rel_path").alias("collected"),
    )


def lang_histogram(spark, d):
    return aggregates.histogram(adapters.document_files(spark, d))


def lang_parse_stats(spark, d):
    docs = adapters.read(spark, d, "documents").select("doc_id", "lang", "text")
    lines = files.lines_of(docs.select("doc_id", F.col("lang").alias("language"), "text"))
    counts = lines.groupBy("doc_id", "language").agg(F.count_if(F.col("line").rlike("^[A-Za-z]{3}")).alias("functions"))
    marks = adapters.read(spark, d, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    joined = counts.join(marks, "doc_id", "left").withColumn("failed", F.coalesce(F.col("toxic") == 1, F.lit(False)))
    return aggregates.parse_stats(joined)


def split_lines(spark, d):
    docs = adapters.read(spark, d, "documents").select("doc_id", "text")
    return docs.select(
        "doc_id",
        F.size(F.split("text", files.NEWLINES, -1)).cast("long").alias("n_name_mode"),
        F.size(F.split("text", "\n", -1)).cast("long").alias("n_qualified_mode"),
    )


def path_tree(spark, d):
    return _long(files.path_tree(_page_paths(spark, d)))


def scan_caps(spark, d):
    options = files.ScanOptions()
    found = _named_files(spark, d).where(languages.detect_language("rel_path").isNotNull() & (F.col("n_chars") <= options.max_bytes))
    return found.select("rel_path", "n_chars").orderBy("rel_path").limit(options.max_files)


def scan_budget(spark, d):
    return _long(search.scan_budget(adapters.document_lines(spark, d)))


def collect_sources(spark, d):
    found = _named_files(spark, d).where(files.allowed("rel_path", "qualified") & languages.extension("rel_path").isin(languages.COLLECTED))
    return found.select("rel_path", languages.collected_language("rel_path", strict=True).alias("language"))


def read_decode(spark, d):
    docs = adapters.read(spark, d, "documents").select("doc_id", "text")
    marked = F.when(F.col("doc_id") % 3 == 0, F.concat(F.unhex(F.lit("EFBBBF")), F.encode("text", "UTF-8"))).when(F.col("doc_id") % 7 == 0, F.concat(F.encode("text", "UTF-8"), F.unhex(F.lit("00"))))
    raw = docs.select("doc_id", F.coalesce(marked, F.encode("text", "UTF-8")).alias("content"))
    return files.decode_qualified_mode(raw).select("doc_id", "encoding", F.coalesce(F.length("text"), F.lit(-1)).cast("long").alias("n_chars"))


def line_shape(spark, d):
    pages = adapters.read(spark, d, "pages").select("page_id", F.col("html").alias("text"))
    rows = files.lines_of(pages).where("line <> ''")
    shaped = rows.select(
        "page_id", "line_no", labels.brace_delta("line").alias("brace_delta"), labels.leading_indent("line").alias("indent"), labels.has_brace_after("line", 0).cast("int").alias("has_brace")
    )
    return _long(shaped)


def call_sites_regex(spark, d):
    pages = adapters.read(spark, d, "pages").select("page_id", F.col("html").alias("text"))
    names = F.regexp_extract_all("line", F.lit(r"([A-Za-z_$][A-Za-z0-9_$]*)(?:<[^<>]*>)? *\("), F.lit(1))
    rows = files.lines_of(pages).select("page_id", "line_no", F.posexplode(names).alias("turn", "callee"))
    return _long(rows.where(~F.col("callee").isin(sorted(extract.KEYWORDS))))


def extract_defs(spark, d):
    return _long(adapters.definitions(adapters.document_lines(spark, d)).select("rel_path", "name", "start_line", "end_line"))


def qualified_id(spark, d):
    return _defs(spark, d).select("rel_path", "def_id")


def first_definition(spark, d):
    return resolve.first_definition(_defs(spark, d))


def symbol_list(spark, d):
    return _long(_defs(spark, d).orderBy("rel_path", "start_line").limit(40).select("rel_path", "name", "start_line"))


def session_totals(spark, d):
    lines = adapters.document_lines(spark, d)
    return _long(lines.agg(F.count_distinct("rel_path").alias("files"), F.count_if(F.col("line").rlike("^[A-Za-z]{3}")).alias("definitions")))


def line_owner(spark, d):
    lines = adapters.document_lines(spark, d).select("rel_path", "line_no")
    owners = resolve.line_owners(_defs(spark, d), lines)
    return _long(owners.where("def_id is not null"))


def resolve_name(spark, d):
    lines = stored(adapters.document_lines(spark, d))
    found = resolve.resolve_name(_sites(spark, d, lines), _defs(spark, d, lines))
    return _long(found.select("rel_path", "line_no", "start_col", "callee", "rank", "target_id"))


def resolve_qualified(spark, d):
    sites, defs = _owned_sites(spark, d)
    caller = defs.select("def_id", F.col("class_name").alias("caller_class"))
    found = resolve.resolve_qualified(sites.join(caller, "def_id", "left"), defs)
    return _long(found.select("rel_path", "line_no", "start_col", "callee", "status", "target_id"))


def calls_by_caller(spark, d):
    sites, _ = _owned_sites(spark, d)
    return sites.where("def_id is not null").groupBy("def_id").agg(F.count(F.lit(1)).alias("n_calls"), F.count_distinct("callee").alias("n_names"))


def unique_calls(spark, d):
    sites, defs = _owned_sites(spark, d)
    return explain.unique_calls(sites, defs).select("def_id", F.array_join("calls", ",").alias("calls"))


def unresolved_calls(spark, d):
    lines = stored(adapters.document_lines(spark, d))
    return _long(resolve.unresolved(_sites(spark, d, lines), _defs(spark, d, lines)).select("rel_path", "line_no", "start_col", "callee"))


def explain_defs(spark, d):
    lines = adapters.document_lines(spark, d)
    defs = stored(_defs(spark, d).withColumn("signature", explain.declared("signature")))  # no more of a line than is said
    sites = resolve.line_owners(defs.select("def_id", "rel_path", "start_line", "start_col", "end_line"), _sites(spark, d).select("rel_path", "line_no", "start_col", "callee"))
    found = explain.explain(defs, explain.unique_calls(sites, defs), explain.leading_comments(defs, lines))
    return found.select("def_id", "summary", "basis", F.array_join("facts", " | ").alias("facts"))


def _hits(spark, d, max_hits: int | None) -> tuple[DataFrame, DataFrame]:
    return search.search_files(adapters.document_files(spark, d), "Tion", *_readers(spark, d), max_hits)


def _readers(spark, d):
    """How definitions and sites are made of lines."""
    return lambda lines: _defs(spark, d, lines), lambda lines: _sites(spark, d, lines)


def search_indexed(spark, d):
    """The first hits by way of a trigram index."""
    index = search_index.SearchIndex.build(adapters.document_files(spark, d))
    return _long(index.search("Tion", *_readers(spark, d))[0].select("kind", "def_id", "rel_path", "line_no"))


def search_text(spark, d):
    return _long(_hits(spark, d, search.MAX_HITS)[0].select("kind", "def_id", "rel_path", "line_no"))


def search_all(spark, d):
    return _long(_hits(spark, d, None)[0].select("kind", "def_id", "rel_path", "line_no"))


def anchor_from_hit(spark, d):
    """Every hit's anchor, its owner, and the statement that stays in focus."""
    return _long(search.anchor_from_hit(*_hits(spark, d, None)))


def symbol_at(spark, d):
    """What stands at every site's start, and at two fixed columns of every line."""
    lines = stored(adapters.document_lines(spark, d))
    defs = stored(_defs(spark, d, lines))
    sites = stored(adapters.placed_call_sites(lines))
    bound = resolve.resolve_qualified(sites.withColumn("caller_class", F.lit(None).cast("string")), defs)
    fixed = lines.where("line <> ''").select("rel_path", "line_no", F.explode(F.array(F.lit(2), F.lit(40))).alias("col"))
    places = fixed.unionByName(sites.select("rel_path", "line_no", F.col("start_col").alias("col"))).distinct()
    return _long(resolve.symbol_at(places, defs, bound))


def match_symbol(spark, d):
    defs = stored(_defs(spark, d))
    both = resolve.match_symbol(defs, "the").withColumn("rule", F.lit("text")).unionByName(resolve.match_symbol(defs, "the", "json").withColumn("rule", F.lit("json")))
    return both.select("rule", "def_id")


def snippet(spark, d):
    lines = stored(adapters.document_lines(spark, d))
    places = _defs(spark, d, lines).where(F.col("name") == "the").select("rel_path", F.col("start_line").alias("at"))
    return _long(resolve.snippet(lines, places))


def classify(spark, d):
    return _defs(spark, d).select("def_id", labels.classify("name", "rel_path").alias("category"))


def label_texts(spark, d):
    rows = adapters.read(spark, d, "documents").select("doc_id", F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("p"), "text")
    return _long(
        rows.select(
            "doc_id",
            labels.visual_units("text").alias("units"),
            labels.short_path("p", 2).alias("short_path"),
            labels.short_location("p", "doc_id").alias("short_location"),
            labels.trim_code("text").alias("code"),
            labels.shorten("text", 120).alias("short"),
            labels.level_label(F.col("doc_id") % 5 - 2).alias("level_label"),
        )
    )


def label_layout(spark, d):
    rows = adapters.read(spark, d, "documents").select("doc_id", "text", F.concat_ws("/", "source", "lang", "text").alias("p"))
    return rows.select("doc_id", F.array_join(labels.wrap_name("text"), "\n").alias("wrapped"), labels.compact_location("p", "doc_id").alias("location"))


def name_tokens(spark, d):
    return _defs(spark, d).select("def_id", F.array_join(labels.name_tokens(F.concat("name", F.lit("_"), F.initcap("name"))), " ").alias("tokens"))


def edge_group(spark, d):
    return _long(graph.edge_groups(adapters.part_sites(spark, d), lists=False).select("src", "dst", "n_sites", "first_file", "first_line"))


def edge_sites(spark, d):
    """The ordered list of sites of every edge."""
    edges = graph.edge_groups(adapters.part_sites(spark, d))
    return edges.select("src", "dst", F.array_join(F.transform("sites", lambda s: F.concat_ws(":", s["site_file"], s["site_line"])), ",").alias("sites"))


def node_degree(spark, d):
    return graph.node_degree(graph.edge_groups(adapters.part_sites(spark, d), lists=False))


def bfs_callees(spark, d):
    _, edges, anchor = _part_graph(spark, d)
    return _nodes(graph.walk(edges, anchor, 3, 0)[0])


def bfs_callers(spark, d):
    _, edges, anchor = _part_graph(spark, d)
    return _nodes(graph.walk(edges, anchor, 0, 3)[0])


def call_graph(spark, d):
    """The flagship: nodes within two steps on both sides, with their edges inside the graph."""
    _, edges, anchor = _part_graph(spark, d)
    nodes = stored(graph.walk(edges, anchor, 2, 2)[0])
    inside = graph.node_degree(graph.chain_edges(edges, nodes, 2, 2))
    joined = nodes.select("id", "level").join(inside, "id", "left")
    return _long(joined.select("id", "level", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_out", "n_in", "sites_out", "sites_in")]))


def build_graph_name(spark, d):
    _, edges, anchor = _part_graph(spark, d)
    return _nodes(graph.walk(edges, anchor, 3, 3, "name")[0])


def build_graph_name_edges(spark, d):
    _, edges, anchor = _part_graph(spark, d)
    nodes = stored(graph.walk(edges, anchor, 3, 3, "name")[0])
    return _long(graph.induced_edges(edges, nodes).select("src", "dst", "n_sites"))


def build_graph_qualified(spark, d):
    _, edges, anchor = _part_graph(spark, d)
    return _nodes(graph.walk(edges, anchor, 3, 3)[0])


def build_graph_qualified_edges(spark, d):
    _, edges, anchor = _part_graph(spark, d)
    nodes = stored(graph.walk(edges, anchor, 3, 3)[0])
    return _long(graph.chain_edges(edges, nodes, 3, 3).select("src", "dst", "n_sites"))


def graph_caps(spark, d):
    _, edges, anchor = _part_graph(spark, d)
    return _nodes(graph.walk(edges, anchor, 4, 4, "name", graph.NAME_CAPS)[0])


def graph_caps_qualified(spark, d):
    _, edges, anchor = _part_graph(spark, d)
    return _nodes(graph.walk(edges, anchor, 5, 5, "qualified", graph.QUALIFIED_CAPS)[0])


def graph_caps_edges(spark, d):
    """The first edges in the order of expansion, with the flag that there are more."""
    _, edges, anchor = _part_graph(spark, d)
    nodes = stored(graph.walk(edges, anchor, 3, 3, "qualified", graph.QUALIFIED_CAPS)[0])
    kept, cut = graph.capped_edges(edges, nodes, 3, 3, graph.QUALIFIED_CAPS.edges)
    return _long(kept.select("src", "dst", "n_sites", F.lit(cut).alias("truncated")))


def _graph_e(spark, d, depth: int = 2, caps: graph.Caps | None = None) -> dict:
    calls = stored(adapters.part_calls(spark, d))
    bound = calls.where("dst is not null").select("src", "dst").distinct().withColumn("n_sites", F.lit(1))
    anchor = graph.hub(bound)
    return graph.build_graph(adapters.part_definitions(spark, d), calls, anchor, depth, depth, caps or graph.Caps(edges=graph.QUALIFIED_CAPS.edges))


def _node_records(g: dict) -> DataFrame:
    flat = F.array_join("child_ids", ",").alias("children")
    return _long(g["nodes"].select("id", "level", F.coalesce("parent", F.lit(-1)).alias("parent"), flat, "has_children", "category", "file", "line", F.lit(g["truncated"]).alias("truncated")))


def build_graph_e(spark, d):
    """The qualified graph as one operator: node records, with its flag."""
    return _node_records(_graph_e(spark, d))


def build_graph_e_caps(spark, d):
    """The same with its usual depth and all its caps."""
    return _node_records(_graph_e(spark, d, 5, graph.QUALIFIED_CAPS))


def graph_totals(spark, d):
    """Numbers of nodes, edges, sites and unresolved calls of the qualified graph."""
    g = _graph_e(spark, d)
    return _long(graph.graph_totals(g["nodes"], g["edges"], g["unresolved"]))


def node_edges(spark, d):
    """The edges of the hub on both sides, as rows."""
    _, edges, anchor = _part_graph(spark, d)
    return _long(graph.node_edges(edges, anchor))


#: Anchors that the query of many graphs takes: the busiest parts.
MANY = 100


def reanchor(spark, d):
    """The graphs around the busiest parts, all in one traversal."""
    _, edges, _ = _part_graph(spark, d)
    busy = graph.node_degree(edges).orderBy(F.desc(F.col("n_out") * F.col("n_in")), "id").limit(MANY).select("id")
    nodes, cut = graph.walk_many(edges, busy, 3, 3, "qualified", graph.QUALIFIED_CAPS)
    flags = cut.withColumn("truncated", F.lit(True))
    rows = nodes.join(flags, "anchor", "left")
    return _long(rows.select("anchor", "id", "level", F.coalesce("parent", F.lit(-1)).alias("parent"), F.coalesce("truncated", F.lit(False)).alias("truncated")))


def hit_test(spark, d):
    """Which box of the row layout every event points at."""
    _, _, nodes, _ = _chain(spark, d)
    placed = graph.layout_rows(nodes.join(_part_names(spark, d), "id"))
    boxes = stored(placed.select("id", "x", "y", "width", "height", F.col("id").alias("turn")))
    events = adapters.read(spark, d, "events")
    points = events.select(F.col("event_id").alias("point_id"), (F.col("event_id") * 37 % 20001 - 10000).cast("double").alias("px"), ((F.col("user_id") * 53 + F.col("event_id")) % 800).cast("double").alias("py"))
    return _long(graph.hit_tests(boxes, points))


def unresolved_e(spark, d):
    """Calls of the graph's nodes that are bound to nothing; only the walk is needed for them."""
    calls = stored(adapters.part_calls(spark, d))
    edges = stored(graph.edge_groups(calls.where("dst is not null").drop("status"), adapters.part_definitions(spark, d), lists=False))
    nodes, _ = graph.walk(edges, graph.hub(edges), 2, 2)
    return _long(graph.unresolved_sites(calls, nodes).select("src", "site_file", "site_line", "status"))


def root_path(spark, d):
    """The chain from the anchor to every node."""
    _, edges, anchor = _part_graph(spark, d)
    return graph.root_path(graph.walk(edges, anchor, 3, 3)[0]).select("id", F.array_join("ids", ">").alias("ids"))


def full_chain(spark, d):
    """Everything that reaches or is reached from the hub, over the edges of all consecutive lines, cycles included."""
    _, edges, anchor = _part_graph(spark, d)
    return _nodes(graph.walk(edges, anchor, graph.UNBOUNDED, graph.UNBOUNDED)[0])


def _chain(spark, d) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    sites, edges, anchor = _part_graph(spark, d)
    nodes = stored(graph.walk(edges, anchor, 3, 3)[0])
    return sites, stored(graph.chain_edges(edges, nodes, 3, 3)), nodes, anchor


def child_ids(spark, d):
    _, edges, nodes, _ = _chain(spark, d)
    return graph.child_ids(edges, nodes).select("id", F.array_join("child_ids", ",").alias("children"))


def level_counts(spark, d):
    _, _, nodes, _ = _chain(spark, d)
    return _long(graph.level_counts(nodes))


def parent_edges(spark, d):
    _, edges, nodes, _ = _chain(spark, d)
    return _long(graph.parent_edges(edges, nodes))


def anchor_adjacent(spark, d):
    sites, _, anchor = _part_graph(spark, d)
    return _long(graph.anchor_adjacent(sites, anchor))


def focus_edges(spark, d):
    sites = stored(adapters.part_sites(spark, d))
    first = sites.agg(F.min(F.struct("site_file", "site_line")).alias("m")).select(F.col("m.site_file").alias("f"), F.col("m.site_line").alias("l"))
    joined = sites.join(F.broadcast(first), (F.col("site_file") == F.col("f")) & (F.col("site_line") == F.col("l")))
    return graph.focus_edges(joined, F.col("f"), F.col("l"))


def visible_nodes(spark, d):
    _, edges, nodes, anchor = _chain(spark, d)
    expanded = nodes.where("level between -1 and 1").select("id")
    return graph.visible_nodes(graph.child_ids(edges, nodes), anchor, expanded)


def collapse_subtree(spark, d):
    _, edges, nodes, _ = _chain(spark, d)
    expanded = stored(nodes.where("level between -2 and 2").select("id"))
    node = nodes.where("level = 1").orderBy("turn").limit(1).select("id")
    return graph.collapse_subtree(stored(graph.child_ids(edges, nodes)), expanded, node)


def visible_minus_agg(spark, d):
    _, edges, nodes, _ = _chain(spark, d)
    children = stored(graph.child_ids(edges, nodes))
    taken = graph.clusters(children, _categories(spark, d)).select(F.explode("members").alias("id"))
    return graph.visible_minus_agg(children, taken).select("id", F.array_join("child_ids", ",").alias("children"))


def _categories(spark, d) -> DataFrame:
    return adapters.read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") <= 25, "util").otherwise("core").alias("category"))


def clusters(spark, d):
    _, edges, nodes, _ = _chain(spark, d)
    found = graph.clusters(graph.child_ids(edges, nodes), _categories(spark, d))
    return _long(found.select("cluster_id", "parent", "n", F.array_join("members", ",").alias("members")))


def redirect_edges(spark, d):
    _, edges, nodes, _ = _chain(spark, d)
    found = graph.clusters(graph.child_ids(edges, nodes), _categories(spark, d))
    members = found.select(F.explode("members").alias("id"), "cluster_id").groupBy("id").agg(F.min("cluster_id").alias("cluster_id"))
    return _long(graph.redirect_edges(edges, stored(members)))


def expand_plan(spark, d):
    _, edges, nodes, anchor = _chain(spark, d)
    children = stored(graph.child_ids(edges, nodes))
    visible = graph.visible_nodes(children, anchor, anchor)
    node = nodes.where("level = 1").orderBy("turn").limit(1).select("id")
    return _long(graph.expand_plan(children, visible, node, _categories(spark, d)))


def layout_columns(spark, d):
    _, edges, nodes, _ = _chain(spark, d)
    turn = F.row_number().over(Window.partitionBy("level").orderBy("turn"))
    placed = graph.layout_columns(nodes.select("id", "level", turn.alias("turn")), edges)
    return _long(placed.select("id", "level", "x", "y"))


def layout_bounds(spark, d):
    _, edges, nodes, _ = _chain(spark, d)
    turn = F.row_number().over(Window.partitionBy("level").orderBy("turn"))
    placed = stored(graph.layout_columns(nodes.select("id", "level", turn.alias("turn")), edges))
    return graph.bounds(placed)


def edge_paths(spark, d):
    _, edges, nodes, _ = _chain(spark, d)
    turn = F.row_number().over(Window.partitionBy("level").orderBy("turn"))
    placed = stored(graph.layout_columns(nodes.select("id", "level", turn.alias("turn")), edges))
    return graph.edge_paths(placed, edges)


def _part_names(spark, d) -> DataFrame:
    return adapters.read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("rel_path"), F.col("p_size").alias("start_line"), F.lit("function").alias("kind"))


def layout_rows(spark, d):
    _, _, nodes, _ = _chain(spark, d)
    return _long(graph.layout_rows(nodes.join(_part_names(spark, d), "id")).select("id", "level", F.round("x", 6).alias("x"), "y", F.round("width", 6).alias("width")))


def progress_totals(spark, d):
    events = adapters.read(spark, d, "events").select("event_id", "event_type", F.col("user_id").cast("long").alias("user_id"))
    return aggregates.running_totals(events, "event_type", "event_id", F.floor(F.col("event_id") / 4096), "user_id")


QUERIES = {
    f.__name__: f
    for f in (
        detect_language, lang_histogram, lang_parse_stats, split_lines, path_tree, scan_caps, scan_budget, collect_sources, read_decode, line_shape,
        call_sites_regex, extract_defs, qualified_id, first_definition, symbol_list, session_totals, line_owner, resolve_name,
        resolve_qualified, calls_by_caller, unique_calls, unresolved_calls, explain_defs, search_text, search_all, symbol_at, match_symbol, snippet,
        classify, label_texts, label_layout, name_tokens, edge_group, node_degree, bfs_callees, bfs_callers, call_graph, edge_sites, build_graph_e, unresolved_e, root_path, graph_caps_edges, visible_minus_agg, anchor_from_hit, build_graph_name,
        build_graph_name_edges, build_graph_qualified, build_graph_qualified_edges, graph_caps, graph_caps_qualified, full_chain, child_ids,
        level_counts, parent_edges, anchor_adjacent, focus_edges, visible_nodes, collapse_subtree, clusters, redirect_edges, expand_plan,
        layout_columns, layout_bounds, edge_paths, layout_rows, progress_totals, build_graph_e_caps, graph_totals, node_edges, reanchor, hit_test, search_indexed,
    )
}
