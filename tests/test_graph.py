"""Levelled graphs: small shapes, collisions, caps, and random graphs against a queue in plain Python."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from callweave.operators import graph


def edges_of(spark, pairs):
    rows = [(a, b, 1, 0, 0) for a, b in pairs]
    return spark.createDataFrame(rows, "src long, dst long, n_sites long, first_file long, first_line long")


def levels(spark, pairs, anchor, down, up, mode="qualified", caps=None):
    nodes, cut = graph.walk(edges_of(spark, pairs), spark.createDataFrame([(anchor,)], "id long"), down, up, mode, caps)
    return {r.id: (r.level, r.parent) for r in nodes.collect()}, cut


def queue_walk(pairs, anchor, down, up, mode):
    out, into = {}, {}
    for a, b in sorted(set(pairs)):
        out.setdefault(a, []).append(b)
        into.setdefault(b, []).append(a)
    seen = {anchor: (0, None)}
    if mode == "qualified":
        queue = deque([anchor])
        while queue:
            x = queue.popleft()
            level = seen[x][0]
            steps = ([(y, level + 1) for y in sorted(out.get(x, []))] if 0 <= level < down else []) + ([(y, level - 1) for y in sorted(into.get(x, []))] if -up < level <= 0 else [])
            for y, at in steps:
                if y not in seen:
                    seen[y] = (at, x)
                    queue.append(y)
        return seen
    for side, near, depth in ((1, out, down), (-1, into, up)):
        queue = deque([(anchor, 0)])
        while queue:
            x, k = queue.popleft()
            if k < depth:
                for y in sorted(near.get(x, [])):
                    if y not in seen:
                        seen[y] = (side * (k + 1), x)
                        queue.append((y, k + 1))
    return seen


def test_collision_on_a_cycle(spark):
    cycle = [(1, 2), (2, 3), (3, 1), (3, 9)]
    assert levels(spark, cycle, 1, 3, 3, "name")[0] == {1: (0, None), 2: (1, 1), 3: (2, 2), 9: (3, 3)}
    assert levels(spark, cycle, 1, 3, 3)[0] == {1: (0, None), 2: (1, 1), 3: (-1, 1)}


@pytest.mark.parametrize("mode", ["name", "qualified"])
def test_random_graphs_match_a_queue(spark, mode):
    rng = random.Random(5)
    for _ in range(3):
        pairs = [(rng.randrange(14), rng.randrange(14)) for _ in range(24)]
        down, up = rng.randrange(4), rng.randrange(4)
        assert levels(spark, pairs, 3, down, up, mode)[0] == queue_walk(pairs, 3, down, up, mode)


def test_anchor_alone_self_loop_and_empty_table(spark):
    assert levels(spark, [(5, 6)], 1, 3, 3)[0] == {1: (0, None)}
    assert levels(spark, [], 1, 3, 3)[0] == {1: (0, None)}
    assert levels(spark, [(1, 1), (1, 2)], 1, 3, 3)[0] == {1: (0, None), 2: (1, 1)}
    nodes, _ = graph.walk(edges_of(spark, [(1, 1), (1, 2)]), spark.createDataFrame([(1,)], "id long"), 1, 1)
    assert sorted((r.src, r.dst) for r in graph.chain_edges(edges_of(spark, [(1, 1), (1, 2)]), nodes, 1, 1).collect()) == [(1, 1), (1, 2)]


def test_star_is_cut_at_sixty(spark):
    got, cut = levels(spark, [(0, k) for k in range(1, 66)], 0, graph.UNBOUNDED, graph.UNBOUNDED, "name", graph.NAME_CAPS)
    assert cut and len(got) == 61 and max(got) == 60
    got, cut = levels(spark, [(0, k) for k in range(1, 61)], 0, 1, 1, "name", graph.NAME_CAPS)
    assert not cut and len(got) == 61


def test_node_cap_counts_the_anchor(spark):
    got, cut = levels(spark, [(0, k) for k in range(1, 20)], 0, 3, 3, "qualified", graph.Caps(nodes=5))
    assert cut and sorted(got) == [0, 1, 2, 3, 4]


def test_full_chain(spark):
    got, cut = levels(spark, [(k, k + 1) for k in range(6)], 0, graph.UNBOUNDED, graph.UNBOUNDED, "name", graph.NAME_CAPS)
    assert got[6] == (6, 5) and not cut


def chain(spark):
    pairs = [(10, 1), (11, 1), (1, 2), (1, 3), (1, 4), (2, 5), (3, 5), (4, 6), (10, 99)]
    edges = edges_of(spark, pairs)
    nodes, _ = graph.walk(edges, spark.createDataFrame([(1,)], "id long"), 5, 5)
    return graph.chain_edges(edges, nodes, 5, 5), nodes


def test_diamond_child_is_under_both_parents(spark):
    edges, nodes = chain(spark)
    got = {r.id: r.child_ids for r in graph.child_ids(edges, nodes).collect()}
    assert got == {1: [2, 3, 4, 10, 11], 2: [5], 3: [5], 4: [6]}
    assert {r.id: r.parent for r in nodes.collect()}[5] == 2
    assert 99 not in {r.id for r in nodes.collect()}


def test_views_on_a_graph(spark):
    edges, nodes = chain(spark)
    children = graph.child_ids(edges, nodes)
    one = spark.createDataFrame([(1,)], "id long")
    assert sorted(r.id for r in graph.visible_nodes(children, one, one).collect()) == [1, 2, 3, 4, 10, 11]
    expanded = spark.createDataFrame([(1,), (2,), (4,)], "id long")
    assert sorted(r.id for r in graph.collapse_subtree(children, expanded, spark.createDataFrame([(2,)], "id long")).collect()) == [1, 4]
    categories = spark.createDataFrame([(2, "util"), (3, "util"), (4, "core")], "id long, category string")
    assert [(r.parent, r.n, r.members) for r in graph.clusters(children, categories).collect()] == [(1, 2, [2, 3])]
    members = spark.createDataFrame([(2, "c"), (3, "c")], "id long, cluster_id string")
    moved = {(r.from_id, r.to_id) for r in graph.redirect_edges(edges, members).collect()}
    assert ("1", "c") in moved and ("c", "5") in moved and ("c", "c") not in moved
    visible = spark.createDataFrame([(k,) for k in range(100, 126)], "id long")
    plan = lambda limit: graph.expand_plan(children, visible, one, categories, limit).first().action
    assert (plan(31), plan(30), plan(29)) == ("expand", "fold", "refuse")


def test_layouts(spark):
    nodes = spark.createDataFrame([(1, 0, 0), (2, -1, 1), (3, 1, 2), (4, 1, 3)], "id long, level int, turn int")
    edges = edges_of(spark, [(2, 1), (1, 3), (1, 4)])
    at = {r.id: (r.x, r.y) for r in graph.layout_columns(nodes, edges).collect()}
    assert at[2][0] < at[1][0] < at[3][0] and at[3][1] < at[4][1] and at[1] == (-112.0, 0.0)
    box = graph.bounds(graph.layout_columns(nodes, edges)).first()
    assert (box.min_x, box.max_x) == (-316 - 112 - 28, 316 - 112 + 224 + 28)
    rows = nodes.select("id", "level", F.lit("n").alias("name"), F.lit("a/b.kt").alias("rel_path"), F.col("id").alias("start_line"), F.lit("function").alias("kind"))
    placed = {r.id: (r.x, r.y, r.width) for r in graph.layout_rows(rows).collect()}
    assert placed[2] == (0.0, 55.0, 110.0) and placed[3] == (-65.0, 275.0, 110.0)
    boxes = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 10.0, 0), (2, 4.0, 0.0, 10.0, 10.0, 1)], "id long, x double, y double, width double, height double, turn int")
    assert graph.hit_test(boxes, 3.0, 0.0).first().id == 2 and graph.hit_test(boxes, 90.0, 0.0).isEmpty()
    path = graph.edge_paths(graph.layout_columns(nodes, edges), edges).where("src = 1 and dst = 3").first().d
    assert path.startswith("M 112.0 34.0 C ")


def test_full_chain_walks_every_edge_and_cycles(spark, tmp_path):
    from callweave.plans.queries import QUERIES

    orders = [[5, 3, 9], [3, 5], [9, 2, 5], [2, 7, 7, 1], [1, 4], [8, 6, 3], [6, 8], [30, 31], [5, 3]]
    rows = [(o, k, part, "RN"[(o + k) % 2], float(5 * k)) for o, parts in enumerate(orders) for k, part in enumerate(parts, 1)]
    table = spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_returnflag string, l_quantity double")
    table.union(table.limit(3)).write.parquet(f"{tmp_path}/lineitem.parquet")
    edges = {(a, b) for parts in orders for a, b in zip(parts, parts[1:])}
    degree = {n: sum(a == n for a, _ in edges) * sum(b == n for _, b in edges) for e in edges for n in e}
    anchor = min(degree, key=lambda n: (-degree[n], n))
    spark.createDataFrame([(n, f"brand {n % 3}", n % 4, "x") for n in range(40)], "p_partkey long, p_brand string, p_size int, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    calls = [(a, b, "resolved", o, k) for o, parts in enumerate(orders) for k, (a, b) in enumerate(zip(parts, parts[1:]), 1)]
    level, parent, *_ = queue_graph([(n, f"brand {n % 3}", n % 4, "x") for n in range(40)], calls, anchor, 99, 99, 999, 999)
    got = {r.id: (r.level, r.parent) for r in QUERIES["full_chain"](spark, str(tmp_path)).collect()}
    assert got == {n: (level[n], -1 if parent[n] is None else parent[n]) for n in level} and len(got) == 9


def queue_graph(definitions, calls, anchor, down, up, most_nodes, most_edges):
    """The qualified graph by a plain queue: levels, parents, children, edges with sites, unresolved calls, flag."""
    place = {i: (f, line) for i, f, line, _ in definitions}
    sites = {}
    for c in sorted(set(calls), key=lambda c: (c[3], c[4])):
        if c[1] is not None:
            sites.setdefault((c[0], c[1]), []).append((c[3], c[4]))
    callees = lambda x: sorted((b for a, b in sites if a == x), key=lambda b: (sites[x, b][0], b))
    callers = lambda x: sorted((a for a, b in sites if b == x), key=lambda a: (place.get(a, ("", 0)), sites[a, x][0], a))
    level, parent, edges, flag = {}, {}, [], False
    queue, waiting = deque([(anchor, 0, None)]), {anchor}
    while queue:
        x, at, above = queue.popleft()
        if len(level) >= most_nodes:
            flag = True
            break
        level[x], parent[x] = at, above
        steps = [(x, y, y, at + 1) for y in callees(x)] if 0 <= at < down else []
        steps += [(y, x, y, at - 1) for y in callers(x)] if -up < at <= 0 else []
        for a, b, y, there in steps:
            if (a, b) not in edges:
                if len(edges) >= most_edges:
                    flag = True
                else:
                    edges.append((a, b))
            if y not in waiting:
                waiting.add(y)
                queue.append((y, there, x))
    children = {}
    for a, b in edges:
        if a in level and b in level:
            if level[a] >= 0 and level[b] == level[a] + 1:
                children.setdefault(a, []).append(b)
            elif level[b] <= 0 and level[a] == level[b] - 1:
                children.setdefault(b, []).append(a)
    kept = {(a, b): sites[a, b] for a, b in edges if a in level and b in level}
    missing = {c for c in calls if c[2] != "resolved" and c[0] in level}
    return level, parent, children, kept, missing, flag


@pytest.mark.parametrize(("most_nodes", "most_edges"), [(1000, 1000), (9, 1000), (1000, 11), (6, 5)])
def test_build_graph_follows_sites_and_places(spark, most_nodes, most_edges):
    rng = random.Random(most_nodes + most_edges)
    ids = list(range(16))
    rng.shuffle(ids)
    definitions = [(i, rng.choice("cab"), rng.randrange(9), rng.choice(["load", "onTap", "formatX", "other"])) for i in ids]
    calls = []
    for _ in range(60):
        b = rng.choice(ids + [None])
        status = "resolved" if b is not None else rng.choice(["unresolved-ambiguous", "unresolved-notfound"])
        calls.append((rng.choice(ids), b, status, rng.choice("zyx"), rng.randrange(50)))
    calls += calls[:5]
    d = spark.createDataFrame(definitions, "id long, file string, line long, name string")
    c = spark.createDataFrame(calls, "src long, dst long, status string, site_file string, site_line long")
    level, parent, children, kept, missing, flag = queue_graph(definitions, calls, 3, 3, 2, most_nodes, most_edges)
    g = graph.build_graph(d, c, spark.createDataFrame([(3,)], "id long"), 3, 2, graph.Caps(nodes=most_nodes, edges=most_edges))
    nodes = {r.id: r for r in g["nodes"].collect()}
    assert {i: (r.level, r.parent) for i, r in nodes.items()} == {i: (level[i], parent[i]) for i in level}
    assert {i: r.child_ids for i, r in nodes.items() if r.has_children} == children
    assert {(r.src, r.dst): [tuple(s) for s in r.sites] for r in g["edges"].collect()} == kept
    assert {tuple(r[c] for c in ("src", "dst", "status", "site_file", "site_line")) for r in g["unresolved"].collect()} == missing
    assert g["truncated"] == flag
    for r in g["paths"].collect():
        chain = [r.id]
        while parent[chain[-1]] is not None:
            chain.append(parent[chain[-1]])
        assert r.ids == chain[::-1]
    assert graph.build_graph(d, c, spark.createDataFrame([(99,)], "id long"), 3, 2) is None


@pytest.mark.parametrize("mode", ["name", "qualified"])
def test_many_anchors_are_single_walks(spark, mode):
    rng = random.Random(8)
    pairs = [(rng.randrange(30), rng.randrange(30)) for _ in range(90)]
    edges = edges_of(spark, pairs)
    anchors = [3, 7, 7, 11, 99]
    for caps in (None, graph.Caps(nodes=9), graph.Caps(nodes=14, per_level=4)):
        nodes, cut = graph.walk_many(edges, spark.createDataFrame([(a,) for a in anchors], "id long"), 3, 2, mode, caps)
        got, flags = {}, {r.anchor for r in cut.collect()}
        for r in nodes.collect():
            got.setdefault(r.anchor, {})[r.id] = (r.level, r.parent)
        assert set(got) == set(anchors)
        for a in set(anchors):
            if caps is None:
                assert got[a] == queue_walk(pairs, a, 3, 2, mode)
            else:
                assert (got[a], a in flags) == levels(spark, pairs, a, 3, 2, mode, caps)


def test_deep_chains_carry_one_number(spark):
    """A node's row doesn't grow with its depth."""
    nodes, _ = graph.walk(edges_of(spark, [(k, k + 1) for k in range(60)]), spark.createDataFrame([(0,)], "id long"), graph.UNBOUNDED, 0)
    assert nodes.count() == 61 and not any("array" in t for _, t in nodes.dtypes)
    assert {r.id: r.level for r in nodes.collect()} == {k: k for k in range(61)}


def test_root_paths_double_pointers(spark):
    rng = random.Random(1)
    parent = {0: None} | {k: rng.randrange(max(0, k - 3), k) for k in range(1, 1500)} | {5000: 4999}
    got = {r.id: r.ids for r in graph.root_path(spark.createDataFrame(list(parent.items()), "id long, parent long")).collect()}
    for k in parent:
        chain = [k]
        while parent.get(chain[-1]) is not None:
            chain.append(parent[chain[-1]])
        assert got[k] == [c for c in chain[::-1] if c in parent]
    assert max(map(len, got.values())) > 500
    with pytest.raises(ValueError, match="cycle"):
        graph.root_path(spark.createDataFrame([(1, 2), (2, 1)], "id long, parent long"))


def test_points_hit_the_last_drawn_box(spark):
    rng = random.Random(4)
    boxes = [(k, rng.uniform(-900, 900), rng.uniform(-900, 900), rng.choice([0.0, 8.0, 90.0, 500.0, 3000.0]), rng.choice([1.0, 20.0, 800.0]), rng.randrange(50)) for k in range(60)]
    points = [(k, rng.uniform(-1000, 1000), rng.uniform(-1000, 1000)) for k in range(400)] + [(900, None, 1.0)]
    inside = lambda b, p: None not in p and abs(b[1] - p[1]) <= b[3] / 2 + 6 and abs(b[2] - p[2]) <= b[4] / 2 + 6
    want = {p[0]: max((b[5], b[0]) for b in boxes if inside(b, p))[1] for p in points if any(inside(b, p) for b in boxes)}
    b = spark.createDataFrame(boxes, "id long, x double, y double, width double, height double, turn int")
    p = spark.createDataFrame(points, "point_id long, px double, py double")
    assert {r.point_id: r.id for r in graph.hit_tests(b, p).collect()} == want and len(want) > 100
    assert graph.hit_tests(b.limit(0), p).isEmpty() and graph.hit_tests(b, p.limit(0)).isEmpty()


def test_edges_of_a_node_and_totals(spark):
    edges = edges_of(spark, [(1, 2), (3, 1), (1, 1), (2, 3)])
    one = spark.createDataFrame([(1,)], "id long")
    assert sorted((r.side, r.other) for r in graph.node_edges(edges, one).collect()) == [("in", 1), ("in", 3), ("out", 1), ("out", 2)]
    assert tuple(graph.graph_totals(one, edges, one.limit(0)).first()) == (1, 4, 4, 0)


def test_calls_of_parts_are_sorted_once_and_equal_a_join(spark, tmp_path):
    """Repeated lines, gaps and nulls; one read and one exchange of the lines, no join."""
    import random

    from callweave.sources import adapters

    rng = random.Random(4)
    pick = lambda n: rng.choice([None, *range(n)])
    rows = [(pick(8), pick(6), pick(5)) for _ in range(150)] + [(9, 2, 1), (9, 2, 1), (9, 3, 1)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    following = lambda o, k: {p for q, m, p in rows if None not in (o, k) and (q, m) == (o, k + 1)} or {None}
    status = lambda k, p: "resolved" if p is not None else "unresolved-ambiguous" if k is not None and k % 2 == 0 else "unresolved-notfound"
    want = {(s, p, status(k, p), o, k) for o, k, s in rows for p in following(o, k)}
    calls = adapters.part_calls(spark, str(tmp_path))
    got = [tuple(r) for r in calls.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    plan = calls._jdf.queryExecution().sparkPlan().toString() + calls._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and calls._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 2
