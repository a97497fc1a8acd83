"""Definitions and call sites of small inputs in every language, and the known quirks."""

import pytest

from callweave.functions.extract import extract, register_language, analyze, sites_of, strip_line


def owners(text, language, compat=True):
    return {f.name: [c[0] for c in f.calls] for f in extract("src/a.x", language, text.split("\n"), compat)}


def test_kotlin_bodies_and_expressions():
    text = "fun load(x: Int) {\n    open(x)\n    check(x)\n}\nfun pick() = first(second())\nfun idle() {\n    rest()\n}"
    assert owners(text, "kotlin") == {"load": ["check"], "pick": ["first", "second"], "idle": ["rest"]}


def test_nested_function_gives_calls_back_to_the_outer_one():
    text = "fun outer() {\n    fun inner() {\n        deep()\n    }\n    later()\n}"
    found = {f.name: f for f in extract("a.kt", "kotlin", text.split("\n"))}
    assert [c[0] for c in found["outer"].calls] == ["later"]
    assert [c[0] for c in found["inner"].calls] == ["deep"]
    assert found["inner"].line > found["outer"].line and found["inner"].end < found["outer"].end


def test_braces_in_strings_and_comments_do_not_count():
    text = 'fun a() {\n    say("}}}")\n    // }}}\n    /* } \n } */ more()\n}'
    assert owners(text, "kotlin") == {"a": ["say", "more"]}


def test_recursion_and_top_level():
    text = "fun again() {\n    again()\n}\nstart()"
    found = owners(text, "kotlin")
    assert found["again"] == ["again"]
    assert found["top level of a.x"] == ["start"]


@pytest.mark.parametrize(
    ("language", "text", "expected"),
    [
        ("java", "public class Box {\n  public void put(int a) {\n    if (a > 1) {\n      store(a);\n    }\n  }\n}", {"Box": [], "put": ["store"]}),
        ("swift", "struct Tree {\n  func grow() {\n    water()\n  }\n}\nextension Tree {\n  func cut() {\n    saw()\n  }\n}", {"Tree": [], "grow": ["water"], "cut": ["saw"]}),
        ("typescript", "const go = (x) => {\n  move(x)\n}\nfunction stop() {\n  halt()\n}\nclass Car {\n  drive(a) {\n    steer(a)\n  }\n}", {"go": ["move"], "stop": ["halt"], "Car": [], "drive": ["steer"]}),
        ("go", "func Run(a int) {\n  walk(a)\n}\nfunc (s *Srv) Serve(b int) {\n  s.accept(b)\n}", {"Run": ["walk"], "Serve": ["accept"]}),
        ("cfamily", "static int add(int a) {\n  return plus(a);\n}", {"add": ["plus"]}),
        ("objc", "- (void)tap:(id)s {\n  ping(s);\n}", {"tap": ["ping"]}),
    ],
)
def test_languages(language, text, expected):
    assert owners(text, language) == expected


def test_python_scopes_with_and_without_quirks():
    text = "def outer():\n    a1()\n    def inner():\n        b1()\n    a2()\nfree()"
    assert owners(text, "python") == {"outer": ["a1", "a2"], "inner": ["b1"], "top level of a.x": ["free"]}
    gap = "def f():\n    one()\n\n    two()"
    assert owners(gap, "python") == {"f": ["one"], "top level of a.x": ["two"]}
    assert owners(gap, "python", compat=False) == {"f": ["one", "two"]}


def test_end_of_an_open_python_definition():
    found = extract("a.py", "python", ["def f():", "    x()"])
    assert found[0].end == 1
    assert extract("a.py", "python", ["def f():", "    x()"], compat=False)[0].end == 2


def test_java_return_reads_as_declaration():
    found = owners("class A {\n  int get() {\n    return foo(1);\n  }\n}", "java")
    assert "foo" in found and found["get"] == []


def test_brace_on_the_next_line_owns_nothing():
    found = owners("void f(int a)\n{\n  g(a);\n}", "cfamily")
    assert found == {"top level of a.x": ["f", "g"]}


def test_strip_keeps_columns_and_block_state():
    clean, block = strip_line("x = 'a\\'b' + 1 // end", "typescript", False)
    assert clean == "x =        + 1       " and not block
    clean, block = strip_line("a /* b", "java", False)
    assert clean == "a     " and block
    assert strip_line("c */ d", "java", True) == ("     d", False)
    assert strip_line('"""doc', "python", False) == ("      ", True)
    assert strip_line("it's x", "go", False)[0] == "it    "


def test_analyze_on_spark_with_registry_errors_and_empty_files(spark):
    def broken(path, language, lines):
        raise ValueError("no grammar")

    register_language("toy", broken)
    files = spark.createDataFrame([("a.kt", "kotlin", ["fun f() {", "  g()", "}"]), ("b.toy", "toy", ["x"]), ("c.py", "python", [])], "rel_path string, language string, lines array<string>")
    rows = {r.rel_path: r for r in analyze(files).collect()}
    assert rows["a.kt"].def_id == "a.kt::f::1::4" and rows["a.kt"].end_line == 3
    assert rows["b.toy"].kind == "error" and "no grammar" in rows["b.toy"].signature
    assert "c.py" not in rows
    assert [(s.callee, s.line_no, s.start_col) for s in sites_of(analyze(files)).collect()] == [("g", 2, 2)]
