"""Syntax-level extraction, and the graph built on it."""

from pyspark.sql import functions as F

from callweave.functions.syntax import calls_of, parse_files, parse_text, split_top, symbols_of
from callweave.operators import graph, resolve

TS = """// Greets.
function greet(name: string, n = 2) {
  log(name)
}

/** A box. */
class Box extends Base {
  constructor(size: Map<string, number>) {
    super(size)
    this.fill(new Item())
  }
  async fill(x) {
    if (x) { x.go() }
    const later = () => { wait() }
  }
}
function* run() { greet("run(1)") }
start()
"""


def shown(found):
    names = {f["id"]: f["name"] for f in found["functions"]}
    return [(c["callee"], names.get(c["caller_id"])) for c in found["calls"]]


def test_typescript():
    found = parse_text("a.ts", "typescript", TS)
    assert [(f["name"], f["class_name"], f["param_signature"], f["start_line"], f["end_line"]) for f in found["functions"]] == [
        ("greet", None, "(string, n)", 2, 4), ("constructor", "Box", "(Map<string, number>)", 8, 11), ("fill", "Box", "(x)", 12, 15), ("run", None, "()", 17, 17),
    ]
    assert [c["name"] for c in found["classes"]] == ["Box"] and found["error"] is None
    assert shown(found) == [("log", "greet"), ("fill", "constructor"), ("Item", "constructor"), ("go", "fill"), ("wait", "fill"), ("greet", "run"), ("start", None)]
    assert found["functions"][0]["doc_comment"] == "// Greets." and found["functions"][0]["id"] == "typescript::a.ts::::greet::(string, n)"
    assert (found["calls"][0]["line_no"], found["calls"][0]["start_col"], found["calls"][0]["code"]) == (3, 3, "  log(name)")


def test_java_and_kotlin():
    java = "class A {\n  A(int x) { init2(x); }\n  public List<String> get(final int a, String b) throws E {\n    return foo(new B(a));\n  }\n  abstract void none();\n}"
    found = parse_text("A.java", "java", java)
    assert [(f["name"], f["param_signature"]) for f in found["functions"]] == [("A", "(int)"), ("get", "(int, String)"), ("none", "()")]
    assert shown(found) == [("init2", "A"), ("foo", "get"), ("B", "get")]
    kotlin = "class K {\n  fun one(a: Int = f(1), b: List<Int>): Int {\n    return two(a)\n  }\n}\n\n// Doubles.\n\nfun String.two(x: Int) = x.times(2)\n"
    found = parse_text("k.kt", "kotlin", kotlin)
    assert [(f["name"], f["class_name"], f["param_signature"], f["doc_comment"]) for f in found["functions"]] == [("one", "K", "(Int, List<Int>)", None), ("two", None, "(Int)", "// Doubles.")]
    assert ("two", "one") in shown(found) and ("times", "two") in shown(found)


def test_python_errors_and_empty():
    text = 'class C:\n    def m(self, a: int, *r, k=1):\n        """Doc."""\n        return self.n(é(a))\n\nasync def top():\n    C().m(1)\n'
    found = parse_text("p.py", "python", text)
    assert [(f["name"], f["class_name"], f["param_signature"], f["doc_comment"]) for f in found["functions"]] == [("m", "C", "(self, int, r, k)", "Doc."), ("top", None, "()", None)]
    assert shown(found) == [("n", "m"), ("é", "m"), ("C", "top"), ("m", "top")]
    assert [c["start_col"] for c in found["calls"]] == [21, 23, 5, 9]
    assert parse_text("p.py", "python", "def (")["error"].startswith("SyntaxError") and parse_text("e.ts", "typescript", "")["functions"] == []
    assert parse_text("u.ts", "typescript", "function f( { g(")["error"] is None


def test_limits_and_splitting():
    many = "\n".join(f"function f{k}() {{ g{k}() }}" for k in range(2100))
    found = parse_text("m.js", "javascript", many)
    assert len(found["functions"]) == 2000 and len(found["calls"]) == 2000
    assert split_top("a: Map<x, y>, b = [1, 2], c => d") == ["a: Map<x, y>", "b = [1, 2]", "c => d"]


def test_qualified_graph(spark):
    files = [("a.ts", "typescript", "function a() { b(); b(); gone() }\nfunction b() { c.d() }"), ("c.ts", "typescript", "class C { d() { a() } }"), ("bad.py", "python", "def (")]
    parsed = parse_files(spark.createDataFrame(files, "rel_path string, language string, text string")).persist()
    assert [r.rel_path for r in parsed.where("error is not null").collect()] == ["bad.py"]
    defs, calls = symbols_of(parsed), calls_of(parsed)
    caller = defs.select(F.col("def_id").alias("caller_id"), F.col("class_name").alias("caller_class"))
    bound = resolve.resolve_qualified(calls.join(caller, "caller_id", "left"), defs)
    assert {(r.callee, r.status) for r in bound.collect()} == {("b", "resolved"), ("gone", "unresolved-notfound"), ("d", "resolved"), ("a", "resolved")}
    sites = bound.where("target_id is not null").select(F.col("caller_id").alias("src"), F.col("target_id").alias("dst"), F.col("rel_path").alias("site_file"), (F.col("line_no") * 1000 + F.col("start_col")).alias("site_line"))
    edges = graph.edge_groups(sites)
    assert sorted(r.n_sites for r in edges.collect()) == [1, 1, 2]
    anchor = defs.where("name = 'a'").select(F.col("def_id").alias("id"))
    nodes, _ = graph.walk(edges, anchor, 5, 5)
    assert {r.id.split("::")[3]: r.level for r in nodes.collect()} == {"a": 0, "b": 1, "d": -1}
