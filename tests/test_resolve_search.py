"""Binding, attribution, positions and search on small tables."""

import random

from pyspark.sql import functions as F

from callweave.operators import explain, resolve, search

DEFS = "def_id string, name string, rel_path string, class_name string, start_line int, start_col int, end_line int, kind string, signature string, language string"


def defs(spark, *rows):
    full = [(i, n, p, c, s, 1, e, "function", f"fun {n}()", "kotlin") for i, n, p, c, s, e in rows]
    return spark.createDataFrame(full, DEFS)


def test_qualified_decisions(spark):
    d = defs(
        spark,
        ("1", "one", "a", None, 1, 1), ("2", "two", "a", "K", 1, 1), ("3", "two", "a", None, 2, 2), ("4", "two", "b", "K", 1, 1),
        ("5", "far", "b", "K", 3, 3), ("6", "far", "b", "M", 4, 4), ("7", "dup", "c", "K", 1, 1), ("8", "dup", "c", "K", 2, 2),
    )
    sites = [("a", "one", None), ("a", "two", "K"), ("a", "two", None), ("a", "two", "X"), ("b", "two", "X"), ("a", "far", "M"), ("a", "far", None), ("a", "dup", "K"), ("a", "none", "K")]
    got = resolve.resolve_qualified(spark.createDataFrame(sites, "rel_path string, callee string, caller_class string"), d).collect()
    assert {(r.rel_path, r.callee, r.caller_class): (r.target_id, r.status) for r in got} == {
        ("a", "one", None): ("1", "resolved"),
        ("a", "two", "K"): ("2", "resolved"),
        ("a", "two", None): ("3", "resolved"),
        ("a", "two", "X"): (None, "unresolved-ambiguous"),
        ("b", "two", "X"): ("4", "resolved"),
        ("a", "far", "M"): ("6", "resolved"),
        ("a", "far", None): (None, "unresolved-ambiguous"),
        ("a", "dup", "K"): (None, "unresolved-ambiguous"),
        ("a", "none", "K"): (None, "unresolved-notfound"),
    }


def test_name_mode_prefers_the_file_and_stops_at_three(spark):
    d = defs(spark, *[(f"b{k}", "f", "b", None, k, k) for k in range(1, 6)], ("a1", "f", "a", None, 1, 1))
    sites = spark.createDataFrame([("a", "f"), ("c", "f"), ("b", "f"), ("c", "g")], "rel_path string, callee string")
    got = {}
    for r in resolve.resolve_name(sites, d).collect():
        got.setdefault(r.rel_path, []).append(r.target_id)
    assert {k: sorted(v) for k, v in got.items()} == {"a": ["a1"], "b": ["b1", "b2", "b3"], "c": ["a1", "b1", "b2"]}
    assert [r.callee for r in resolve.unresolved(sites, d).collect()] == ["g"]


def lines_to(spark, n, *paths):
    return spark.range(1, n + 1).select(F.explode(F.array(*[F.lit(p) for p in paths])).alias("rel_path"), F.col("id").cast("int").alias("line_no"))


def test_line_owners_last_start_wins(spark):
    d = defs(spark, ("outer", "outer", "a", None, 1, 6), ("inner", "inner", "a", None, 3, 5), ("tail", "tail", "a", None, 8, 0))
    got = {r.line_no: r.def_id for r in resolve.line_owners(d, lines_to(spark, 9, "a")).collect()}
    assert [got[k] for k in range(1, 10)] == ["outer", "outer", "inner", "inner", "inner", "outer", None, "tail", None]


def test_line_owners_against_every_pair(spark):
    """Nested, crossing, long and repeated ranges over several of the largest blocks; places keep their columns and repeats."""
    rng, n = random.Random(5), 7 * 8**resolve.LEVELS + 100
    ranges = [("a", k, k, n - k) for k in range(1, 60)]
    for k in range(60, 500):
        first = rng.randint(1, n)
        ranges.append((rng.choice("ab"), k, first, min(n, first + int(2 ** rng.uniform(0, 12)))))
    ranges += [("a", 500, 77, 77), ("a", 501, 77, 90), (None, 502, 1, n), ("b", 503, None, 9)]
    d = spark.createDataFrame([(p, f"{k:03}", a, 1, b) for p, k, a, b in ranges], "rel_path string, def_id string, start_line int, start_col int, end_line int")
    asked = [(rng.choice(["a", "b", "c", None]), rng.choice([None, *[rng.randint(1, n)] * 9]), k) for k in range(4000)]
    places = spark.createDataFrame([(*x, "own") for x in asked * 2], "rel_path string, line_no int, level int, best string")
    got = resolve.line_owners(d, places).collect()
    assert len(got) == 2 * len(asked) and {r.best for r in got} == {"own"}

    def plain(p, line):
        return max(((a, f"{k:03}") for q, k, a, b in ranges if None not in (p, line, a) and q == p and a <= line <= b), default=(0, None))[1]

    want = {k: (p, line, plain(p, line)) for p, line, k in asked}
    assert {r.level: (r.rel_path, r.line_no, r.def_id) for r in got} == want
    assert resolve.line_owners(d, places.limit(0)).isEmpty()
    assert {r.def_id for r in resolve.line_owners(d.limit(0), places).collect()} == {None}


def test_symbol_at(spark):
    d = defs(spark, ("1", "alpha", "a", None, 1, 9), ("2", "beta", "b", None, 1, 9))
    sites = spark.createDataFrame([("a", 2, 5, "beta", None), ("a", 3, 5, "nope", None), ("a", 1, 1, "beta", "2")], "rel_path string, line_no int, start_col int, callee string, target_id string")
    at = spark.createDataFrame([("a", 1, 3), ("a", 1, 6), ("a", 2, 8), ("a", 2, 9), ("a", 3, 5)], "rel_path string, line_no int, col int")
    assert {(r.line_no, r.col): r.symbol_id for r in resolve.symbol_at(at, d, sites).collect()} == {(1, 3): "1", (2, 8): "2", (3, 5): None}
    assert {(r.line_no, r.col): r.symbol_id for r in resolve.symbol_at(at, d, sites, strict=True).collect()}[(2, 8)] is None


def test_match_rules(spark):
    d = defs(spark, ("1", "getAll", "a", None, 1, 1), ("2", "get", "b", None, 1, 1))
    assert resolve.match_symbol(d, "get").first().def_id == "2"
    assert resolve.match_symbol(d, "GET", "json").first().def_id == "1"
    assert resolve.match_symbol(d, "zzz").isEmpty()


def test_search_scopes_claims_and_blank_queries(spark):
    lines = [("a", k, t) for k, t in enumerate(["fun save()", "  send(save)", "x", "save me"], 1)] + [("b", 1, "save"), ("c", 1, "fun saved()")]
    lines = spark.createDataFrame(lines, "rel_path string, line_no int, line string")
    d = defs(spark, ("1", "save", "a", None, 1, 3), ("3", "saved", "c", None, 1, 1))
    sites = spark.createDataFrame([("1", "a", "send", 2, 2, "  send(save)")], "def_id string, rel_path string, callee string, line_no int, start_col int, line string")
    owners = resolve.line_owners(d, lines)
    rows = lambda **kw: [(r.kind, r.def_id, r.rel_path, r.line_no) for r in search.search(lines, d, sites, owners, **kw).collect()]
    assert rows(query=" SAVE ") == [("definition", "1", "a", 1), ("text", "1", "a", 2), ("text", "1", "a", 4), ("definition", "3", "c", 1)]
    assert rows(query="save", current_file="c") == [("definition", "3", "c", 1)]
    assert rows(query="  ") == []
    assert len(rows(query="save", max_hits=2)) == 2


def test_scan_budget(spark):
    lines = spark.createDataFrame([(p, k) for p, n in (("a/1", 3), ("a/2", 2), ("b", 4)) for k in range(n)], "rel_path string, line_no int")
    assert sorted((r.rel_path, r.before, r.part) for r in search.scan_budget(lines, 6).collect()) == [("a/1", 0, 3), ("a/2", 3, 2), ("b", 5, 1)]


def test_explanations(spark):
    d = defs(spark, ("1", "loadUserName", "a", None, 4, 6), ("2", "main", "a", None, 8, 8))
    lines = spark.createDataFrame([("a", k, t) for k, t in enumerate(["/**", " * Reads the name.", " */", "fun loadUserName() {", "", "", "x", "fun main()"], 1)], "rel_path string, line_no int, line string")
    sites = spark.createDataFrame([("1", "open", 5, 1), ("1", "open", 6, 1), ("1", "loadUserName", 5, 9)], "def_id string, callee string, line_no int, start_col int")
    calls = explain.unique_calls(sites, d)
    got = {r.def_id: r for r in explain.explain(d, calls, explain.leading_comments(d, lines)).collect()}
    assert (got["1"].basis, got["1"].summary) == ("sourceComment", "Reads the name.")
    assert got["1"].facts[:2] == ["Lines 4-6", "Calls open"]
    assert got["2"].basis == "inferred" and got["2"].summary == "Meant to handle."
    bare = {r.def_id: r.summary for r in explain.explain(d, calls, explain.leading_comments(d, lines).limit(0)).collect()}
    assert bare["1"] == 'Meant to load "User Name". Works with open.'


def test_leading_comment_forms(spark):
    """Every case is a file whose definition is the last line given."""
    cases = {
        "real": ["# real", "# TODO later", "", "def f"],
        None: ["// far", "", "", "fun f"],
        "says this": ["// @tag", "// says this", "fun f"],
        "w" * 179 + "…": ["// " + "w" * 300, "fun f"],
        "of a block": ["code()", "", "/*", "  @param x", "  of a block", "*/", "fun f"],
        "first of twelve": ["// too far up", "// first of twelve", *["//"] * 11, "fun f"],
        "after an opening line": ["not this", "/* after an opening line", "// MARK: x", "", "fun f"],
        "doc": ["other */", "", "/** doc */", "fun f"],
        "unopened": ["", "unopened", "text */", "fun f"],
    }
    rows = [(f"{i}", k, t) for i, own in enumerate(cases.values()) for k, t in enumerate(own, 1)]
    rows += [("x", k, t) for k, t in enumerate(["code()", "fun g", "// inner", "*/", "fun h", "text */", "/* no", "", "y", "fun i"], 1)] + [("hash", 1, "# not python"), ("hash", 2, "fun j")]
    lines = spark.createDataFrame(rows, "rel_path string, line_no int, line string")
    d = [(f"d{i}", "f", f"{i}", None, len(own), len(own)) for i, own in enumerate(cases.values())] + [(n, n, "x", None, at, at) for n, at in (("g", 2), ("h", 5), ("i", 10))] + [("j", "j", "hash", None, 2, 2)]
    d = defs(spark, *d).withColumn("language", F.when(F.col("rel_path") == "0", "python").otherwise("kotlin"))
    got = {r.def_id: r.comment for r in explain.leading_comments(d, lines).collect()}
    assert {f"d{i}": got.get(f"d{i}") for i in range(len(cases))} == {f"d{i}": c for i, c in enumerate(cases)}
    assert got.get("g") is None and got["h"] == "inner" and got.get("i") is None and got.get("j") is None
    assert explain.leading_comments(d, lines.limit(0)).isEmpty()


def test_index_and_early_stop_give_the_hits_of_a_full_search(spark, tmp_path, monkeypatch):
    import random

    from callweave.operators.search_index import SearchIndex
    from callweave.plans import queries

    monkeypatch.setattr(search, "FIRST_FILES", 2)
    monkeypatch.setattr(search, "FURTHER", 2)
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcD") for _ in range(rng.randint(2, 8)))
    rows = [(f"f{k:02d}", "kotlin", "\n".join(" ".join(word() + rng.choice(["", ","]) for _ in range(4)) for _ in range(6))) for k in range(40)] + [("f99", "go", None), ("f98", "go", ""), ("f97", "go", "ab"), ("f96", "go", "İstanbul é🙂x")]
    files = spark.createDataFrame(rows, "rel_path string, language string, text string")
    define, call = queries._readers(spark, None)
    index = SearchIndex.build(files, str(tmp_path / "index"), 5)
    from callweave.sources.files import lines_of

    lines = lines_of(files)
    for query, limits in ((" DABC ", (3, None)), ("ab", (20,)), ("é🙂x", (3,))):
        for most in limits:
            pick = lambda hits: [(r.kind, r.def_id, r.rel_path, r.line_no) for r in hits.collect()]
            want = pick(search.search(lines, define(lines), call(lines), None, query, max_hits=most))
            got = [pick(search.search_files(files, query, define, call, most)[0]), pick(index.search(query, define, call, most)[0])]
            for g in got:
                assert (g if most else sorted(g, key=str)) == (want if most else sorted(want, key=str)), (query, most)
    texts = {r[0]: (r[2] or "").lower() for r in rows}
    for query in ("abcd", "dabc", "é🙂x"):
        chosen = {r.rel_path for r in index.files.join(index.candidates(query), ["range", "number"]).collect()}
        assert {p for p, t in texts.items() if query in t} <= chosen == {p for p, t in texts.items() if all(query[i : i + 3] in t for i in range(len(query) - 2))}


def test_comments_deal_lines_once(spark):
    """Lines meet their definitions in windows: no join brings whole lines together; repeated definitions of a line count once."""
    lines = spark.createDataFrame([("a", 1, "// says"), ("a", 2, "fun f"), ("b", 1, "# says"), ("b", 2, "def g"), ("c", 1, "// alone"), (None, 1, "// x")], "rel_path string, line_no int, line string")
    d = defs(spark, ("1", "f", "a", None, 2, 2), ("2", "f2", "a", None, 2, 2), ("3", "g", "b", None, 2, 2)).withColumn("language", F.when(F.col("rel_path") == "b", "python").otherwise("go"))
    found = explain.leading_comments(d, lines)
    assert sorted((r.def_id, r.comment) for r in found.collect()) == [("1", "says"), ("2", "says"), ("3", "says")]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
    long = spark.createDataFrame([("  " + "x" * 118 + " " + "y" * 40,), (" short ",), ("z" * 120,)], "s string")
    assert long.where(explain.declared("s") != explain.declared(explain.declared("s"))).isEmpty()


def test_index_lists_are_made_for_many_files_at_once(spark, tmp_path, monkeypatch):
    """One row for a trigram of a batch, whatever the number of its files; long texts in parts give the lists of the whole."""
    import pyarrow as pa

    from callweave.operators import search_index

    texts = [(0, 1, "abcabc"), (0, 2, "xabc"), (1, 1, "é🙂x"), (1, 2, "ab"), (1, 3, "")]
    batch = pa.RecordBatch.from_pydict({"range": [t[0] for t in texts], "number": [t[1] for t in texts], "text": [t[2] for t in texts]})
    rows = [r for out in search_index.lists_of_batches(iter([batch])) for r in out.to_pylist()]
    assert sorted((r["gram"], r["range"], tuple(r["numbers"])) for r in rows) == [("abc", 0, (1, 2)), ("bca", 0, (1,)), ("cab", 0, (1,)), ("xab", 0, (2,)), ("é🙂x", 1, (1,))]
    monkeypatch.setattr(search_index, "SORTED_CHARACTERS", 4)
    again = [r for out in search_index.lists_of_batches(iter([batch])) for r in out.to_pylist()]
    assert {(r["gram"], r["range"], n) for r in again for n in r["numbers"]} == {(r["gram"], r["range"], n) for r in rows for n in r["numbers"]}
    files = spark.createDataFrame([(f"f{t[0]}{t[1]}", "go", t[2].upper()) for t in texts] + [("g", "go", None)], "rel_path string, language string, text string")
    index = search_index.SearchIndex.build(files, str(tmp_path / "index"), 2)
    stored = {(r.gram, r.range, n) for r in index.lists.collect() for n in r.numbers}
    plain = index.files.select("range", "number", F.explode(search_index.grams(F.col("text"))).alias("gram"))
    assert stored == {(r.gram, r.range, r.number) for r in plain.collect()} and index.lists.groupBy("gram", "range").count().where("count > 1").isEmpty()
