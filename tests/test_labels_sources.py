"""Label expressions, decoding, trees and scans."""

import os

from pyspark.sql import functions as F

from callweave.functions import labels, languages
from callweave.sources import files


def one(spark, text, *columns):
    return spark.createDataFrame([(text,)], "t string").select(*columns).first()


def test_widths_and_cuts(spark):
    r = one(spark, "ab漢c", labels.visual_units("t"), labels.slice_units("t", 3), labels.slice_units("t", 3, True), labels.ellipsize("t", 4), labels.ellipsize("t", 5))
    assert tuple(r) == (5, "ab", "漢c", "ab…", "ab漢c")
    assert one(spark, "", labels.visual_units("t"), labels.slice_units("t", 3))[1] == ""


def test_wrapped_names(spark):
    wrap = lambda t: one(spark, t, labels.wrap_name("t"))[0]
    assert wrap("short") == ["short"]
    assert wrap("configuration_loader_service") == ["configuration_", "loader_service"]
    assert wrap("loadConfigurationFromDisk") == ["loadConfiguration", "FromDisk"]
    assert wrap("a" * 60) == ["a" * 19, "a" * 27 + "…"]


def test_locations(spark):
    r = one(spark, "root/src/deep/File.kt", labels.compact_location("t", F.lit(7)), labels.short_path("t"), labels.short_location("t", F.lit(7)))
    assert tuple(r) == ("deep/File.kt:7", "src/deep/File.kt", "File.kt:7")
    long = one(spark, "a/" + "b" * 40 + ".kt", labels.compact_location("t", F.lit(12)))[0]
    assert long.endswith(":12") and len(long) == 32 and "…" in long


def test_names_and_comments(spark):
    r = one(spark, "parseHTTPResponse_v2", labels.name_tokens("t"), labels.classify("t", F.lit("src/a.ts")), labels.classify("t", F.lit("node_modules/a.ts")))
    assert r[0] == ["parse", "HTTP", "Response", "v", "2"] and (r[1], r[2]) == ("util", "thirdparty")
    kinds = [one(spark, n, labels.classify("t", F.lit("a")))[0] for n in ("getX", "onClick", "isX", "island", "once", "walk")]
    assert kinds == ["io", "handler", "util", "util", "handler", "core"]
    assert one(spark, "/** Says it. */", labels.clean_comment("t"))[0] == "Says it."
    assert one(spark, "// a\n//\n// b\n// c", labels.clean_doc("t", 2))[0] == "a\nb"
    assert one(spark, "ts::a.ts::K::f::()", labels.end_name(F.lit(None).cast("string"), "t"))[0] == "a.ts"
    assert one(spark, "\t  x{{}", labels.leading_indent("t"), labels.brace_delta("t"), labels.has_brace_after("t", 6))[:] == (6, 1, False)
    assert tuple(one(spark, "x", labels.first_sites(F.array(*[F.lit(k) for k in range(9)])))[0])[1] == 3


def test_extensions(spark):
    got = [one(spark, p, languages.detect_language("t"), languages.detect_language("t", "qualified"), languages.viewer_language("t"), languages.collected_language("t")) for p in ("a/b.KTS", "x.d/README", "b.hpp", "c.tar.py")]
    assert [tuple(g) for g in got] == [("kotlin", "kotlin", "kotlin", "kotlin"), (None, None, "plaintext", "typescript"), ("cfamily", None, "cpp", "typescript"), ("python", "python", "python", "python")]


def test_decoding(spark):
    raws = [(1, b"plain"), (2, b"\xef\xbb\xbfbom \xff"), (3, "漢字".encode("gbk")), (4, b"a\0b"), (5, b""), (6, None), (7, "テスト".encode("shift_jis")), (8, b"\xff\xff\xff")]
    rows = spark.createDataFrame(raws, "id int, content binary")
    got = {r.id: (r.text, r.encoding) for r in files.decode_qualified_mode(rows).collect()}
    assert got[1] == ("plain", "utf-8") and got[2] == ("bom �", "utf-8") and got[3] == ("漢字", "gbk") and got[4] == (None, "binary-skip")
    assert got[5] == ("", "utf-8") and got[6] == (None, "read-error") and got[7][1] in ("gbk", "shift_jis") and got[8] == (None, "encoding-unsupported")
    wide = spark.createDataFrame([(1, "hé".encode()), (2, "hé".encode("utf-16")), (3, b"\xff\xfea")], "id int, content binary")
    assert [r.t for r in wide.select("id", files.decode_name_mode("content").alias("t")).orderBy("id").collect()] == ["hé", "hé", None]


def test_lines(spark):
    rows = spark.createDataFrame([("a", "x\r\ny")], "rel_path string, text string")
    assert [r.line for r in files.lines_of(rows, mode="name").orderBy("line_no").collect()] == ["x", "", "y"]
    assert [r.line for r in files.lines_of(rows).orderBy("line_no").collect()] == ["x\r", "y"]


def test_tree(spark):
    paths = spark.createDataFrame([("b/z.kt",), ("b/a/c.kt",), ("a.kt",), ("b/z.kt",)], "rel_path string")
    got = [(r.parent, r.name, r.type) for r in files.path_tree(paths).orderBy("parent", "turn").collect()]
    assert got == [("", "b", "dir"), ("", "a.kt", "file"), ("b", "a", "dir"), ("b", "z.kt", "file"), ("b/a", "c.kt", "file")]


def make(root, tree):
    for path, text in tree.items():
        full = os.path.join(root, path)
        os.makedirs(os.path.dirname(full), exist_ok=True)
        with open(full, "wb") as f:
            f.write(text)


def test_scans(spark, tmp_path):
    make(tmp_path, {"src/a.kt": b"fun a() {\n b()\n}", "src/b.py": b"def b():\n  pass", ".git/c.py": b"x", "node_modules/d.js": b"x", "e.css": b"x", "big.go": b"x" * 90})
    name = lambda **kw: sorted(r.rel_path for r in files.list_files(spark, str(tmp_path), "name", files.ScanOptions(**kw)).collect())
    assert name() == ["big.go", "src/a.kt", "src/b.py"]
    assert name(max_bytes=50) == ["src/a.kt", "src/b.py"]
    assert name(max_files=1) == ["big.go"] and name(extra_excludes=["src"]) == ["big.go"]
    assert sorted((r.rel_path, r.language) for r in files.list_files(spark, str(tmp_path), "qualified").collect()) == [("e.css", "typescript"), ("src/a.kt", "kotlin"), ("src/b.py", "python")]


def test_label_layout_shows_the_end_of_long_texts(spark, tmp_path):
    from callweave.plans.queries import QUERIES

    texts = ["short", "a/b", "x" * 200 + "/folder/lastFile.py", "intro " * 30 + "/" + "漢字" * 40 + "/the end", "no slash " * 40, "d/" * 80 + "tail_of_a_very_long_file_name_here.ts", "é🙂" * 60]
    spark.createDataFrame([(k, "web", "en", t) for k, t in enumerate(texts)], "doc_id long, source string, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")

    def width(t):
        return sum(1 + (c > "ÿ") for c in t)

    def head(t, units):
        while width(t) > units:
            t = t[:-1]
        return t

    for r in QUERIES["label_layout"](spark, str(tmp_path)).collect():
        text = texts[r.doc_id]
        label = "/".join([x for x in f"web/en/{text}".split("/") if x][-2:]) + f":{r.doc_id}"
        assert r.location == (label if width(label) <= 32 else head(label, 18) + "…" + head(label[::-1], 13)[::-1])
        assert r.wrapped == text if width(text) <= 19 else r.wrapped.replace("\n", "").rstrip("…") in text


def test_trees_list_hidden_names_and_links(spark, tmp_path):
    root = tmp_path / "root"
    for name in ["pkg/__init__.py", "pkg/_own.py", "pkg/.hidden.py", "_build/x.kt", "build/no.kt", ".git/no.kt", "deep/a/b/c/d.kt", "deep/node_modules/no.kt", "z.kt", "a.txt", "big.kt"]:
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text("x" * (50 if name == "big.kt" else 1))
    (root / "empty").mkdir()
    outside = tmp_path / "elsewhere.kt"
    outside.write_text("fun far()")
    (root / "link.kt").symlink_to(outside)
    (root / "pkg/inner.kt").symlink_to(root / "z.kt")
    (root / "dirlink").symlink_to(root / "deep")
    (tmp_path / "alias").symlink_to(root)
    options = files.ScanOptions(max_bytes=40)
    got = {(r.rel_path, bytes(r.content)) for r in files.list_files(spark, str(tmp_path / "alias"), "name", options).collect()}
    plain = {(p, b"x") for p in ["pkg/__init__.py", "pkg/_own.py", "pkg/.hidden.py", "_build/x.kt", "deep/a/b/c/d.kt", "z.kt"]}
    assert got == plain | {(str(outside), b"fun far()")}
    capped = files.list_files(spark, str(root), "name", files.ScanOptions(max_files=2, extra_excludes=["pkg"]))
    assert sorted(r.rel_path for r in capped.collect()) == sorted([str(outside), "_build/x.kt"])
    qualified = sorted(r.rel_path for r in files.list_files(spark, f"file://{root}", "qualified").collect())
    assert qualified == ["_build/x.kt", "big.kt", "deep/a/b/c/d.kt", "pkg/__init__.py", "pkg/_own.py", "z.kt"]
    tree = [(r.parent, r.name, r.type, r.turn) for r in files.list_tree(spark, str(root)).orderBy("parent", "turn").collect()]
    assert [t[1:] for t in tree if t[0] == ""] == [(n, k, i) for i, (n, k) in enumerate([("_build", "dir"), ("deep", "dir"), ("empty", "dir"), ("pkg", "dir"), ("a.txt", "file"), ("big.kt", "file"), ("z.kt", "file")], 1)]
    assert ("deep/a", "b", "dir", 1) in tree and ("pkg", "__init__.py", "file", 1) in tree


def test_trees_are_pruned_before_they_are_opened(tmp_path):
    from callweave.sources import tree

    for k in range(40):
        (tmp_path / f"d{k}" / "e").mkdir(parents=True)
        (tmp_path / f"d{k}" / "e" / "f.kt").write_text("")
    (tmp_path / "build" / "deep").mkdir(parents=True)
    opened = []
    reader = tree.TreeReader({"path": str(tmp_path), "excluded": "build\nd3", "partitions": "50"})
    plain = reader._entries
    reader._entries = lambda rel: opened.append(rel) or plain(rel)
    parts = reader.partitions()
    rows = [r[0] for p in parts for r in reader.read(p)]
    assert len(rows) == len(set(rows)) == 39 * 3 and not [o for o in opened if o.startswith(("build", "d3/")) or o == "d3"]
    assert sum(p.deep for p in parts) >= 30 and len(parts) >= 50
    slow = tree.TreeReader({"path": str(tmp_path), "seconds": "-1"})
    assert not [r for p in slow.partitions() for r in slow.read(p)]
