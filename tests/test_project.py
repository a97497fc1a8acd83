"""A whole project from files to reports, and incremental analysis."""

import json

from pyspark.sql import functions as F

from callweave.functions.extract import analyze, sites_of
from callweave.operators import graph, resolve
from callweave.plans.project import Project, QualifiedProject, main
from callweave.streaming import binding
from callweave.streaming.progress import analyze_stream, latest_definitions, progress_totals

TREE = {
    "a/Main.kt": "fun main() {\n    load()\n    missing()\n}\nfun load() {\n    parse()\n}",
    "b/Parse.kt": "// Parses text.\nfun parse() {\n    trim()\n}\nfun trim() {\n}",
}


def write(root):
    for path, text in TREE.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)


def test_reports(spark, tmp_path):
    write(tmp_path)
    project = Project.scan(spark, str(tmp_path))
    code, text = project.text_report("load")
    assert code == 0 and "level 0\n  load a/Main.kt:5" in text and "level -1\n  main" in text and "level 2\n  trim" in text
    assert project.text_report("absent")[0] == 1 and "main a/Main.kt:1" in project.text_report(None)[1]
    report = json.loads(project.json_report("main").first().report)
    assert report["files"] == 2 and report["definitions"] == 4 and [u["callee"] for u in report["unresolved"]] == ["missing"]
    assert {(e["from"].split("::")[1], e["to"].split("::")[1]) for e in report["edges"]} == {("main", "load"), ("load", "parse"), ("parse", "trim")}
    assert [(h.kind, h.line_no) for h in project.search("parse").collect()] == [("text", 6), ("definition", 2), ("text", 1)]
    assert [(r.language, r.n) for r in project.languages().collect()] == [("Kotlin", 2)]


def test_beyond_the_depth_is_not_unresolved(spark, tmp_path):
    write(tmp_path)
    project = Project.scan(spark, str(tmp_path))
    anchor = project.match("main").select(F.col("def_id").alias("id"))
    g = project.call_graph(anchor, 1, 1)
    assert sorted(r.name for r in g["nodes"].collect()) == ["load", "main"]
    assert [r.callee for r in g["unresolved"].collect()] == ["missing"] and not g["truncated"]


def test_incremental_analysis(spark, tmp_path):
    source, target = tmp_path / "in", tmp_path / "out"
    rows = lambda n: [(p, "kotlin", t.replace("main", f"main{n}").split("\n")) for p, t in TREE.items()]
    schema = "rel_path string, language string, lines array<string>"
    for n in (1, 2):
        spark.createDataFrame(rows(n), schema).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(schema).parquet(str(source))
        analyze_stream(stream, str(target), str(tmp_path / "ck")).awaitTermination()
    names = sorted(r.name for r in latest_definitions(spark.read.parquet(str(target))).collect())
    assert names == ["load", "main2", "parse", "trim"]


def test_progress(spark):
    events = spark.createDataFrame([("kotlin", 2, False), ("kotlin", 3, True), ("go", 1, False)], "language string, functions long, failed boolean")
    assert sorted(tuple(r) for r in progress_totals(events).collect()) == [("go", 1, 1, 0), ("kotlin", 2, 5, 1)]


QUALIFIED = {
    "pkg/__init__.py": "def start():\n    Loader().load()\n    helper()\n    absent()\n",
    "pkg/load.py": "class Loader:\n    def load(self):\n        self.parse()\n        helper()\n    def parse(self):\n        helper()\n",
    "pkg/a.py": "def helper():\n    twice()\ndef twice():\n    pass\n",
    "pkg/b.py": "def twice():\n    pass\n",
    "pkg/c.py": "def ask():\n    twice()\n",
    ".hidden.py": "def start():\n    pass\n",
}


def test_qualified_project(spark, tmp_path, capsys):
    for path, text in QUALIFIED.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    project = QualifiedProject.scan(spark, str(tmp_path))
    assert sorted((r.file, r.name) for r in project.definitions.collect() if r.name in ("start", "load")) == [("pkg/__init__.py", "start"), ("pkg/load.py", "load")]
    g = project.graph(project.match("load").select("id"))
    names = {r.id: r.name for r in g["nodes"].collect()}
    assert {(r.name, r.level) for r in g["nodes"].collect()} == {("load", 0), ("parse", 1), ("helper", 1), ("twice", 2), ("start", -1)}
    assert {(names[r.src], names[r.dst], r.n_sites) for r in g["edges"].collect()} == {("load", "parse", 1), ("load", "helper", 1), ("parse", "helper", 1), ("helper", "twice", 1), ("start", "load", 1)}
    assert {(r.callee, r.status) for r in g["unresolved"].collect()} >= {("absent", "unresolved-notfound")} and not g["truncated"]
    assert [r.name for r in project.graph(project.match("load").select("id"), 5, 5, graph.Caps(nodes=1))["nodes"].collect()] == ["load"]
    ambiguous = project.graph(project.match("ask").select("id"))["unresolved"].collect()
    assert [(r.callee, r.status, r.code.strip()) for r in ambiguous] == [("twice", "unresolved-ambiguous", "twice()")]
    nodes, cut = project.graphs(project.definitions.select("id"))
    assert nodes.where("level = 0").count() == project.definitions.count() and cut.isEmpty()
    report = json.loads(project.json_report("start").first().report)
    assert [n["name"] for n in report["nodes"] if n["level"] == 1] == ["helper", "load"] and report["anchor"].split("::")[3] == "start"
    assert project.json_report("nowhere").isEmpty()
    assert main([str(tmp_path), "--mode", "qualified", "--symbol", "parse"]) == 0 and json.loads(capsys.readouterr().out)["symbol"] == "parse"


def test_callers_come_by_the_place_of_their_definition(spark):
    files = [("z.kt", "kotlin", ["fun aim() {", "}"]), ("b.kt", "kotlin", ["fun late() {", "    aim()", "}"]), ("a.kt", "kotlin", ["", "fun early() {", "", "", "    aim()", "}"])]
    project = Project(spark.createDataFrame(files, "rel_path string, language string, lines array<string>"))
    anchor = project.match("aim").select(F.col("def_id").alias("id"))
    nodes, _ = graph.walk(project.edges, anchor, 1, 1, "name")
    assert [r.id.split("::")[1] for r in nodes.where("level = -1").orderBy("turn").collect()] == ["early", "late"]


def test_incremental_binding_equals_a_rebuild(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "rel_path string, language string, lines array<string>"
    body = lambda name, *calls: [f"fun {name}() {{", *[f"    {c}()" for c in calls], "}"]
    many = {f"n{k}.kt": body(f"n{k}", f"n{k + 1}", "shared") for k in range(30)}
    batches = [
        {**many, "s.kt": body("shared"), "t.kt": body("top", "missing", "n3")},
        {"s.kt": body("other"), "u.kt": body("missing", "n5")},
        {"n3.kt": ["", *body("n3", "missing")], "t.kt": None, "v.kt": body("n5", "top")},
    ]
    held, touched = {}, []
    for k, files in enumerate(batches):
        spark.createDataFrame([(p, "kotlin", t) for p, t in files.items()], schema).coalesce(1).write.mode("append").parquet(source)
        binding.bind_stream(spark.readStream.schema(schema).parquet(source), target, str(tmp_path / "ck")).awaitTermination()
        held.update(files)
        now = spark.createDataFrame([(p, "kotlin", t) for p, t in held.items() if t is not None], schema)
        definitions = analyze(now)
        columns = ["rel_path", "def_id", "callee", "line_no", "start_col"]
        want = resolve.resolve_name(sites_of(definitions), definitions).select(*columns, "rank", "target_id").collect()
        got = binding.current(spark, target, "bindings")
        assert sorted(map(tuple, got.where("target_id is not null").collect())) == sorted(map(tuple, want))
        sites = binding.current(spark, target, "sites").count()
        assert got.select(*columns).distinct().count() == sites
        touched.append((spark.read.parquet(f"{target}/bindings/batch={k}").select(*columns).distinct().count(), sites))
        assert graph.edge_groups(binding.bound_sites(spark, target)).count() > 20
    assert touched[0][0] == touched[0][1] and touched[2][0] < touched[2][1] / 3
    assert {r.name for r in spark.read.parquet(f"{target}/changes/batch=1").collect()} == {"shared", "other", "missing"}
