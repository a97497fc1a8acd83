"""Levelled graphs around an anchor.

A node's ``turn`` is a number whose order within a level and side is that of a breadth-first queue: the parent's turn
comes first, then the order key of the edge. Each round sorts its new nodes by both over ranges and numbers them in
that order, so that a node carries one number however deep it lies. Callees are siblings in the order of
their first call site, callers in the order of their definitions. Each round is one join of the frontier with the
edges, one aggregation and one anti join, for one anchor or for many at once; the driver sees only whether a
frontier is empty.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callweave.functions import labels
from callweave.plans.stored import stored


@dataclass
class Caps:
    """Limits of a graph; None lifts one."""

    nodes: int | None = None
    per_level: int | None = None
    edges: int | None = None


NAME_CAPS = Caps(nodes=400, per_level=60)
QUALIFIED_CAPS = Caps(nodes=300, edges=500)
UNBOUNDED = 2**31 - 1


#: Rounds after which the tables of visited nodes are written as one.
COMPACT = 4


def edge_groups(sites: DataFrame, places: DataFrame | None = None, lists: bool = True) -> DataFrame:
    """Edges (src, dst, n_sites, first_file, first_line, sites, down, up) of sites (src, dst, site_file, site_line, ...).

    ``sites`` is the edge's list of distinct sites in the order of file, line and further columns; without ``lists``
    it is left out, and no edge gathers its sites. ``down``
    orders the callees of a node (first site, then id), ``up`` its callers (place of the caller's
    definition by ``places(id, file, line)``, first site, id). Sites without a source or a target make no edge.
    """
    sites = sites.where("src is not null and dst is not null")
    site = F.struct(*[c for c in sites.columns if c not in ("src", "dst")])
    if lists:
        grouped = sites.groupBy("src", "dst").agg(F.array_sort(F.collect_set(site)).alias("sites"))
        first, count = F.col("sites")[0], F.size("sites")
    else:
        grouped = sites.distinct().groupBy("src", "dst").agg(F.min(site).alias("first"), F.count(F.lit(1)).alias("n"))
        first, count = F.col("first"), F.col("n")
    if places is not None:
        grouped = grouped.join(places.select(F.col("id").alias("src"), F.col("file").alias("d_file"), F.col("line").cast("long").alias("d_line")), "src", "left")
    file, line = (F.col("d_file"), F.col("d_line")) if places is not None else (F.lit(""), F.lit(0).cast("long"))
    key = lambda file, line, end: F.struct(F.coalesce(file, F.lit("")).alias("file"), F.coalesce(line, F.lit(0).cast("long")).alias("line"), first.alias("site"), F.col(end).alias("id"))
    return grouped.select(
        "src", "dst", count.cast("long").alias("n_sites"), first["site_file"].alias("first_file"), first["site_line"].alias("first_line"), *(["sites"] if lists else []),
        key(F.lit(""), F.lit(0).cast("long"), "dst").alias("down"), key(file, line, "src").alias("up"),
    )


def _keyed(edges: DataFrame) -> DataFrame:
    """Edges with order keys; where there are none siblings are taken by id."""
    if "down" in edges.columns:
        return edges
    return edges.withColumns({"down": F.struct(F.col("dst").alias("id")), "up": F.struct(F.col("src").alias("id"))})


def node_degree(edges: DataFrame) -> DataFrame:
    """Edges and sites in and out of every node."""
    out = edges.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i"), F.col("n_sites").alias("so"), F.lit(0).alias("si"))
    into = edges.select(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i"), F.lit(0).alias("so"), F.col("n_sites").alias("si"))
    sums = [F.sum(c).cast("long").alias(n) for c, n in (("o", "n_out"), ("i", "n_in"), ("so", "sites_out"), ("si", "sites_in"))]
    return out.unionByName(into).groupBy("id").agg(*sums)


def hub(edges: DataFrame) -> DataFrame:
    """The node with the most out-edges times in-edges, the least id of equals: one row (id)."""
    degree = node_degree(edges.select("src", "dst").distinct().withColumn("n_sites", F.lit(1)))
    return degree.orderBy(F.desc(F.col("n_out") * F.col("n_in")), "id").limit(1).select("id")


def _step(front: DataFrame, edges: DataFrame, visited: DataFrame, side: int, level: int, caps: Caps) -> tuple[DataFrame, DataFrame | None]:
    """The next level on one side for every anchor, and with caps the anchors that had more than their room."""
    here, there, key = ("src", "dst", "down") if side > 0 else ("dst", "src", "up")
    ways = edges.select(F.col(here).alias("id"), F.col(there).alias("next"), F.col(key).alias("key"))
    reached = front.join(ways, "id").groupBy("anchor", F.col("next").alias("id_")).agg(F.min(F.struct("turn", "key", F.col("id").alias("parent"))).alias("way"))
    new = reached.withColumnRenamed("id_", "id").join(visited.select("anchor", "id"), ["anchor", "id"], "left_anti")
    columns = ["anchor", "id", F.lit(level).alias("level"), F.col("way.parent").alias("parent"), "turn"]
    most = min([c for c in (caps.per_level, None if caps.nodes is None else caps.nodes - 1) if c is not None], default=None)
    if most is None:
        ordered = new.repartitionByRange("way.turn", "way.key", "anchor").sortWithinPartitions("way.turn", "way.key", "anchor")
        return stored(ordered.withColumn("turn", F.monotonically_increasing_id()).select(*columns)), None
    place = F.row_number().over(Window.partitionBy("anchor").orderBy("way")).cast("long")
    first = new.withColumn("turn", place).where(F.col("turn") <= most + 1)
    taken = visited.groupBy("anchor").agg(F.count(F.lit(1)).alias("taken"))
    room = F.least(F.lit(most if caps.per_level is None else caps.per_level), F.lit(UNBOUNDED if caps.nodes is None else caps.nodes) - F.col("taken"))
    placed = stored(first.join(taken, "anchor").withColumn("room", room).select(*columns, "room"))
    return placed.where("turn <= room").drop("room"), placed.where("turn > room").select("anchor").distinct()


def walk_many(edges: DataFrame, anchors: DataFrame, callee_depth: int, caller_depth: int, mode: str = "qualified", caps: Caps | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes (anchor, id, level, parent, turn) around every one of ``anchors(id)``, and the anchors that a cap cut.

    All anchors take their rounds together; what is visited and every cap belong to an anchor alone, so that each has
    the graph it would have by itself. Levels are positive towards callees, negative towards callers. In mode
    "qualified" the sides take turns at each distance, callees first; in mode "name" all callees come before any
    caller. Either way a node that is taken blocks the other side there. An anchor without edges is a graph of one
    node; repeated anchors count once.
    """
    caps = caps or Caps()
    if "down" not in edges.columns:
        edges = _keyed(edges.where("src is not null and dst is not null")).groupBy("src", "dst").agg(F.min("down").alias("down"), F.min("up").alias("up"))
        edges = stored(edges)
    start = anchors.select(F.col("id").alias("anchor")).distinct()
    start = stored(start.select("anchor", F.col("anchor").alias("id"), F.lit(0).alias("level"), F.lit(None).cast(edges.schema["src"].dataType).alias("parent"), F.lit(0).cast("long").alias("turn")))
    visited, short, rounds = start, [], 0
    fronts, level = {1: start, -1: start}, {1: 0, -1: 0}
    depth = {1: callee_depth, -1: caller_depth}
    done = {side for side in depth if depth[side] <= 0}
    for side in _in_turn(depth, done) if mode == "qualified" else _by_side(depth, done):
        level[side] += side
        new, cut = _step(fronts[side], edges, visited, side, level[side], caps)
        if cut is not None:
            short.append(cut)
        if new.isEmpty():
            done.add(side)
            continue
        fronts[side], rounds = new, rounds + 1
        visited = visited.unionByName(new)
        if rounds % COMPACT == 0:
            visited = stored(visited)
    flags = start.select("anchor").limit(0)
    for f in short:
        flags = flags.unionByName(f)
    return visited, flags.distinct()


def walk(edges: DataFrame, anchor: DataFrame, callee_depth: int, caller_depth: int, mode: str = "qualified", caps: Caps | None = None) -> tuple[DataFrame, bool]:
    """``walk_many`` for one anchor: nodes (id, level, parent, turn), and whether a cap cut them."""
    nodes, short = walk_many(edges, anchor.limit(1), callee_depth, caller_depth, mode, caps)
    return nodes.drop("anchor"), caps is not None and not short.isEmpty()


def root_path(nodes: DataFrame) -> DataFrame:
    """(id, ids): the chain of parents of every node of ``nodes(id, parent)``, from its root to the node itself.

    Pointers double: every round joins each chain with that of the node it begins under, so that a depth of D takes
    log2(D) rounds. A node without a parent is a root, and so is one whose parent isn't among the nodes. Nodes of
    several anchors have a column ``anchor`` and are kept apart. Parents that form a cycle raise.
    """
    keys = [c for c in ("anchor",) if c in nodes.columns]
    chains = stored(nodes.select(*keys, "id", F.col("parent").alias("up"), F.array("id").alias("ids")))
    most, rounds = chains.count(), 0
    while not chains.where("up is not null").isEmpty():
        if 1 << rounds > 2 * most:
            raise ValueError("parents form a cycle")
        above = chains.select(*keys, F.col("id").alias("up"), F.col("up").alias("further"), F.col("ids").alias("before"))
        longer = chains.where("up is not null").join(above, [*keys, "up"], "left")
        longer = longer.select(*keys, "id", F.col("further").alias("up"), F.concat(F.coalesce("before", F.slice("ids", 1, 0)), "ids").alias("ids"))
        chains = stored(chains.where("up is null").unionByName(longer))
        rounds += 1
    return chains.select(*keys, "id", "ids")


def _in_turn(depth: dict[int, int], done: set[int]):
    """Sides in the order of a single queue, until both are done."""
    k = 1
    while len(done) < 2:
        for side in (1, -1):
            if k > depth[side]:
                done.add(side)
            if side not in done:
                yield side
        k += 1


def _by_side(depth: dict[int, int], done: set[int]):
    """All rounds of the callee side, then all of the caller side."""
    for side in (1, -1):
        k = 1
        while k <= depth[side] and side not in done:
            yield side
            k += 1


def induced_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges between chosen nodes."""
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(*edges.columns)


def _followed(edges: DataFrame, nodes: DataFrame, callee_depth: int, caller_depth: int) -> DataFrame:
    """Edges that the walk followed, each with its ``turn``: when it was followed first."""
    down = nodes.where((F.col("level") >= 0) & (F.col("level") < callee_depth)).select(F.col("id").alias("src"), F.col("level").alias("l"), F.col("turn").alias("t"))
    up = nodes.where((F.col("level") <= 0) & (F.col("level") > -caller_depth)).select(F.col("id").alias("dst"), F.col("level").alias("l"), F.col("turn").alias("t"))
    keyed = _keyed(edges)
    order = lambda side, key: F.struct(F.abs("l").alias("d"), F.lit(side).alias("s"), "t", F.col(key).alias("k")).alias("turn")
    rows = keyed.join(down, "src").select("src", "dst", order(0, "down")).unionByName(keyed.join(up, "dst").select("src", "dst", order(1, "up")))
    return rows.groupBy("src", "dst").agg(F.min("turn").alias("turn"))


def chain_edges(edges: DataFrame, nodes: DataFrame, callee_depth: int, caller_depth: int) -> DataFrame:
    """Edges that the walk followed: out of expanded callee-side nodes, into expanded caller-side nodes, between nodes."""
    return capped_edges(edges, nodes, callee_depth, caller_depth, None)[0]


def capped_edges(edges: DataFrame, nodes: DataFrame, callee_depth: int, caller_depth: int, cap: int | None) -> tuple[DataFrame, bool]:
    """``chain_edges``, the first ``cap`` of them in the order of expansion, and whether there were more."""
    rows, cut = _followed(edges, nodes, callee_depth, caller_depth), False
    if cap is not None:
        rows = stored(rows.orderBy("turn").limit(cap + 1))
        cut = rows.count() > cap
        rows = rows.orderBy("turn").limit(cap)
    kept = edges.join(rows.select("src", "dst"), ["src", "dst"], "left_semi").select(*edges.columns)
    return induced_edges(kept, nodes), cut


def child_ids(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, child_ids) from all kept edges between neighbouring levels of one side; a shared child is under each parent.

    Children are in sibling order; the anchor's callees come before its callers.
    """
    level = lambda end: nodes.select(F.col("id").alias(end), F.col("level").alias(f"l_{end}"))
    rows = _keyed(edges).select("src", "dst", "down", "up").join(level("src"), "src").join(level("dst"), "dst")
    down = rows.where("l_src >= 0 and l_dst = l_src + 1").select(F.col("src").alias("id"), F.struct(F.lit(0).alias("side"), F.col("down").alias("key"), F.col("dst").alias("child")).alias("c"))
    up = rows.where("l_dst <= 0 and l_src = l_dst - 1").select(F.col("dst").alias("id"), F.struct(F.lit(1).alias("side"), F.col("up").alias("key"), F.col("src").alias("child")).alias("c"))
    found = down.unionByName(up).groupBy("id").agg(F.array_sort(F.collect_set("c")).alias("c"))
    return found.select("id", F.transform("c", lambda c: c["child"]).alias("child_ids"))


def unresolved_sites(calls: DataFrame, nodes: DataFrame) -> DataFrame:
    """Calls (src, status, ...) of the nodes that are not resolved, ambiguous ones included; equal rows once."""
    return calls.where(F.col("status") != "resolved").join(nodes.select(F.col("id").alias("src")), "src", "left_semi").select(*calls.columns).distinct()


def build_graph(definitions: DataFrame, calls: DataFrame, anchor: DataFrame, callee_depth: int, caller_depth: int, caps: Caps | None = None) -> dict | None:
    """The qualified graph: nodes, edges, unresolved calls and one flag for every cap; None where the anchor is no definition.

    ``definitions`` has id, file, line, name; ``calls`` has src, dst (null unless bound), status, site_file,
    site_line and more columns of a site. Nodes have level, parent, child_ids, has_children, category
    and the definition's columns.
    """
    caps = QUALIFIED_CAPS if caps is None else caps
    anchor = stored(anchor.limit(1).join(definitions.select("id"), "id", "left_semi").select("id"))
    if anchor.isEmpty():
        return None
    bound = calls.where("dst is not null").select(*[c for c in calls.columns if c != "status"])
    edges = stored(edge_groups(bound, definitions, lists=False))
    found, cut_nodes = walk(edges, anchor, callee_depth, caller_depth, "qualified", caps)
    found = stored(found)
    kept, cut_edges = capped_edges(edges, found, callee_depth, caller_depth, caps.edges)
    # Lists of sites are gathered of the graph's edges alone.
    kept = stored(edge_groups(bound.join(kept.select("src", "dst").distinct(), ["src", "dst"], "left_semi"), definitions))
    none = F.array().cast(f"array<{found.schema['id'].dataType.simpleString()}>")
    nodes = found.drop("turn").join(child_ids(kept, found), "id", "left").withColumn("child_ids", F.coalesce("child_ids", none))
    nodes = nodes.withColumn("has_children", F.size("child_ids") > 0).join(definitions, "id")
    nodes = nodes.withColumn("category", labels.classify("name", "file"))
    return {"anchor": anchor, "nodes": nodes, "edges": kept, "unresolved": unresolved_sites(calls, found), "paths": root_path(found), "truncated": cut_nodes or cut_edges}


def level_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("level").agg(F.count(F.lit(1)).alias("n"))


def parent_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edge between every node and its parent, with its number of sites and first site."""
    ends = nodes.where("parent is not null").select(
        "id", "parent", F.when(F.col("level") > 0, F.col("parent")).otherwise(F.col("id")).alias("src"), F.when(F.col("level") > 0, F.col("id")).otherwise(F.col("parent")).alias("dst")
    )
    return ends.join(edges, ["src", "dst"]).select("id", "parent", "n_sites", "first_file", "first_line")


def anchor_adjacent(sites: DataFrame, anchor: DataFrame) -> DataFrame:
    """Sites on edges between the anchor and another node."""
    ids, others = anchor.limit(1).select("id"), sites.where("src <> dst")
    end = lambda e: others.join(ids.withColumnRenamed("id", e), e, "left_semi").select(*sites.columns)
    return end("src").unionByName(end("dst"))


def focus_edges(sites: DataFrame, file, line) -> DataFrame:
    """Edges that have a site at the statement."""
    return sites.where((F.col("site_file") == file) & (F.col("site_line") == line)).select("src", "dst").distinct()


def visible_nodes(children: DataFrame, anchor: DataFrame, expanded: DataFrame) -> DataFrame:
    """The anchor, and the children of expanded nodes."""
    shown = children.join(expanded.select("id"), "id", "left_semi").select(F.explode("child_ids").alias("id"))
    return anchor.select("id").unionByName(shown).distinct()


def visible_minus_agg(children: DataFrame, members: DataFrame) -> DataFrame:
    """(id, child_ids): children that no cluster has taken in, in their order; members(id) are taken in."""
    rows = children.select("id", F.posexplode("child_ids").alias("p", "child")).join(members.select(F.col("id").alias("child")).distinct(), "child", "left_anti")
    return rows.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "child"))), lambda c: c["child"]).alias("child_ids"))


def collapse_subtree(children: DataFrame, expanded: DataFrame, node: DataFrame) -> DataFrame:
    """What stays expanded when a node and its expanded descendants collapse."""
    gone = stored(node.select("id"))
    front = gone
    while True:
        below = children.join(front, "id", "left_semi").select(F.explode("child_ids").alias("id")).distinct()
        front = stored(below.join(expanded.select("id"), "id", "left_semi").join(gone, "id", "left_anti"))
        if front.isEmpty():
            return expanded.join(gone, "id", "left_anti")
        gone = gone.unionByName(front)


def expand_plan(children: DataFrame, visible: DataFrame, node: DataFrame, categories: DataFrame, limit: int = 30) -> DataFrame:
    """What expanding a node does: ``expand``, ``fold`` (its util children become one cluster) or ``refuse``."""
    new = children.join(node.select("id"), "id", "left_semi").select(F.explode("child_ids").alias("id")).distinct().join(visible.select("id"), "id", "left_anti")
    fresh = new.join(categories, "id", "left").select(F.lit(0).alias("s"), F.lit(1).alias("n"), F.coalesce((F.col("category") == "util").cast("int"), F.lit(0)).alias("u"))
    both = fresh.unionByName(visible.select("id").distinct().select(F.lit(1).alias("s"), F.lit(0).alias("n"), F.lit(0).alias("u")))
    counts = both.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(name) for c, name in (("s", "shown"), ("n", "new"), ("u", "utils"))])
    total = F.col("shown") + F.col("new")
    fold = (F.col("utils") >= 2) & (total - F.col("utils") + 1 <= limit)
    return counts.select("shown", "new", "utils", F.when(total <= limit, "expand").when(fold, "fold").otherwise("refuse").alias("action"))


def clusters(children: DataFrame, categories: DataFrame, category: str = "util", least: int = 2) -> DataFrame:
    """One cluster per parent with enough children of a category: cluster_id, parent, n, members."""
    rows = children.select(F.col("id").alias("parent"), F.explode("child_ids").alias("id")).join(categories.where(F.col("category") == category), "id")
    grouped = rows.groupBy("parent").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("id")).alias("members"))
    return grouped.where(F.col("n") >= least).select(F.concat(F.lit("cluster:"), F.col("parent").cast("string")).alias("cluster_id"), "parent", "n", "members")


def redirect_edges(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges with members (id, cluster_id) replaced by their cluster; loops go, of equal edges the first's sites stay."""
    renamed = lambda end: members.select(F.col("id").alias(end), F.col("cluster_id").alias(f"c_{end}"))
    rows = edges.join(renamed("src"), "src", "left").join(renamed("dst"), "dst", "left")
    end = lambda e: F.coalesce(f"c_{e}", F.col(e).cast("string"))
    rows = rows.select(end("src").alias("from_id"), end("dst").alias("to_id"), F.struct("src", "dst", "n_sites").alias("first"))
    kept = rows.where("from_id <> to_id").groupBy("from_id", "to_id").agg(F.min("first").alias("first"))
    return kept.select("from_id", "to_id", F.col("first.n_sites").alias("n_sites"))


def layout_rows(nodes: DataFrame) -> DataFrame:
    """Row layout: one row per level, nodes by file and line, centred. Adds x, y, width, height.

    ``nodes`` has id, level, name, rel_path, start_line and kind.
    """
    base = F.element_at(F.split("rel_path", "/"), -1)
    place = F.length(F.concat(base, F.lit(":"), F.col("start_line").cast("string")))
    width = F.greatest(F.lit(110.0), F.least(F.lit(330.0), F.length("name") * 7.6 + 26, place * 6.6 + 26))
    sized = nodes.withColumn("width", width).withColumn("height", F.when(F.col("kind") == "topLevel", 40.0).otherwise(48.0))
    lowest = nodes.agg(F.min("level")).first()[0] or 0
    order = Window.partitionBy("level").orderBy("rel_path", "start_line", "id").rowsBetween(Window.unboundedPreceding, 0)
    level = Window.partitionBy("level")
    left = F.sum(F.col("width") + 20).over(order) - F.col("width") - 20
    total = F.sum(F.col("width") + 20).over(level) - 20
    x = left - total / 2 + F.col("width") / 2
    return sized.withColumn("x", x).withColumn("y", (F.col("level") - lowest + 0.5) * 110.0)


NODE_WIDTH, NODE_HEIGHT, COLUMN_STEP, ROW_STEP = 224, 68, 316, 86


def layout_columns(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Column layout: a column per level, rows centred, ordered by the mean place of neighbours already placed.

    ``nodes`` has id, level, turn (input order). The pass goes outwards from level 0; a column starts in
    input order. Adds x and y. Only the list of levels reaches the driver.
    """
    both = edges.select(F.col("src").alias("id"), F.col("dst").alias("other")).unionByName(edges.select(F.col("dst").alias("id"), F.col("src").alias("other"))).where("id <> other")

    def centred(column: DataFrame, *order) -> DataFrame:
        w = Window.partitionBy("level").orderBy(*order)
        row = F.row_number().over(w) - 1 - (F.count(F.lit(1)).over(Window.partitionBy("level")) - 1) / 2
        return column.withColumn("y", row * float(ROW_STEP))

    levels = sorted(r[0] for r in nodes.select("level").distinct().collect())
    placed = stored(centred(nodes.where("level = 0"), "turn"))
    for level in [k for k in levels if k > 0] + [k for k in reversed(levels) if k < 0]:
        column = centred(nodes.where(F.col("level") == level), "turn")
        near = placed.unionByName(column).select(F.col("id").alias("other"), F.col("y").alias("oy"))
        centre = column.select("id").join(both, "id").join(near, "other").groupBy("id").agg(F.avg("oy").alias("c"))
        column = column.drop("y").join(centre, "id", "left").withColumn("c", F.coalesce("c", F.lit(0.0)))
        placed = placed.unionByName(stored(centred(column, "c", "turn").drop("c")))
    return placed.withColumn("x", F.col("level") * float(COLUMN_STEP) - NODE_WIDTH / 2)


def bounds(placed: DataFrame) -> DataFrame:
    """Box around a column layout."""
    return placed.agg(
        (F.min("x") - 28).alias("min_x"), (F.max("x") + NODE_WIDTH + 28).alias("max_x"), (F.min("y") - 34).alias("min_y"), (F.max("y") + NODE_HEIGHT + 18).alias("max_y")
    )


def hit_test(boxes: DataFrame, x: float, y: float, slack: float = 6.0) -> DataFrame:
    """The last drawn node (by turn) whose box around (x, y) holds the point."""
    inside = (F.abs(F.col("x") - x) <= F.col("width") / 2 + slack) & (F.abs(F.col("y") - y) <= F.col("height") / 2 + slack)
    return boxes.where(inside).orderBy(F.desc("turn")).limit(1)


def hit_tests(boxes: DataFrame, points: DataFrame, slack: float = 6.0) -> DataFrame:
    """(point_id, id) of every point of ``points(point_id, px, py)`` that a box holds: the last drawn, of equal turns the largest id.

    Boxes (id, x, y, width, height, turn) lie in grids whose cells double from grid to grid, each in the finest whose
    cells are no smaller than it is, so that it meets at most four of them. A point asks one cell of every grid in
    use, of which there are few, by equality. Nulls hit nothing.
    """
    reach = F.greatest("width", "height") + 2 * slack
    sized = boxes.withColumn("grid", F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(reach, F.lit(1.0))))).cast("int"))
    grids = sorted(r[0] for r in sized.where("grid is not null").select("grid").distinct().collect())
    cell = lambda at, grid: F.floor(at / F.pow(F.lit(2.0), grid))
    ends = lambda c, size: F.sequence(cell(F.col(c) - F.col(size) / 2 - slack, F.col("grid")), cell(F.col(c) + F.col(size) / 2 + slack, F.col("grid")))
    placed = sized.select("*", F.explode(ends("x", "width")).alias("cx")).select("*", F.explode(ends("y", "height")).alias("cy"))
    asked = points.select("point_id", "px", "py", F.explode(F.array(*[F.lit(g) for g in grids]).cast("array<int>")).alias("grid"))
    asked = asked.select("*", cell(F.col("px"), F.col("grid")).alias("cx"), cell(F.col("py"), F.col("grid")).alias("cy"))
    inside = (F.abs(F.col("x") - F.col("px")) <= F.col("width") / 2 + slack) & (F.abs(F.col("y") - F.col("py")) <= F.col("height") / 2 + slack)
    hits = asked.join(placed, ["grid", "cx", "cy"]).where(inside)
    return hits.groupBy("point_id").agg(F.max_by("id", F.struct("turn", "id")).alias("id"))


def node_edges(edges: DataFrame, node: DataFrame) -> DataFrame:
    """The edges of each of ``node(id)`` as rows: id, side (out or in), other, n_sites, first_file, first_line; a loop is on both sides."""
    ids = node.select("id")
    rows = lambda here, there, side: edges.select(F.col(here).alias("id"), F.lit(side).alias("side"), F.col(there).alias("other"), "n_sites", "first_file", "first_line")
    return rows("src", "dst", "out").unionByName(rows("dst", "src", "in")).join(ids, "id", "left_semi")


def graph_totals(nodes: DataFrame, edges: DataFrame, missing: DataFrame) -> DataFrame:
    """One row: numbers of nodes, edges, their sites, and unresolved calls."""
    one = lambda df, **sums: df.agg(*[F.coalesce(x, F.lit(0)).alias(n) for n, x in sums.items()])
    counted = one(edges, edges=F.count(F.lit(1)), sites=F.sum("n_sites"))
    return one(nodes, nodes=F.count(F.lit(1))).join(F.broadcast(counted)).join(F.broadcast(one(missing, unresolved=F.count(F.lit(1)))))


def edge_paths(placed: DataFrame, edges: DataFrame) -> DataFrame:
    """SVG cubic path of every edge between placed nodes."""
    at = lambda end: placed.select(F.col("id").alias(end), F.col("x").alias(f"x_{end}"), F.col("y").alias(f"y_{end}"))
    rows = edges.select("src", "dst").join(at("src"), "src").join(at("dst"), "dst")
    x1, y1 = F.col("x_src") + NODE_WIDTH, F.col("y_src") + NODE_HEIGHT / 2
    x2, y2 = F.col("x_dst"), F.col("y_dst") + NODE_HEIGHT / 2
    bend = F.greatest(F.abs(x2 - x1) / 2, F.lit(34.0))
    return rows.select("src", "dst", F.format_string("M %.1f %.1f C %.1f %.1f, %.1f %.1f, %.1f %.1f", x1, y1, x1 + bend, y1, x2 - bend, y2, x2, y2).alias("d"))
