"""Ranked search, hard negatives and licences against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from callweave.llm import balltree, common, licences, negatives
from callweave.llm.terms import terms

_TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
_FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_terms(text):
    return [m.translate(_FOLD) for m in _TERM.findall(text or "")]


@pytest.mark.parametrize("text", [None, "", "  ", "É'É Été_x-A9\x1cz\x85q\xa0r 漢字🙂ok", "ÄÖ İstanbul \x00a\x7fb"])
def test_terms(text):
    assert [t.decode() for t in terms(text)] == plain_terms(text)


def plain_ranking(docs, items, top):
    held = [(d, Counter(plain_terms(t))) for d, t in docs]
    held = [(d, c, sum(c.values())) for d, c in held if c]
    n_docs, n_terms = len(held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(plain_terms(text))
    out = []
    for item, words in wanted.items():
        scores = []
        for d, c, n in held:
            m = 50 + (50 * n * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in words if t in c)
            if s > 0:
                scores.append((-s, d is None, d))
        out += [(item, k + 1, d, -s) for k, (s, _, d) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:top])]
    return sorted(out, key=str)


def random_texts(rng, n, words=60):
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 4))) for _ in range(words)]
    weights = [1 / (k + 1) for k in range(words)]
    return [" ".join(rng.choices(vocabulary, weights, k=rng.randint(0, 40))) for _ in range(n)]


def test_ranked(spark, awkward, monkeypatch):
    monkeypatch.setattr(balltree, "TREE_DOCS", 64)
    monkeypatch.setattr(balltree, "BLOCK_ITEMS", 8)
    rng = random.Random(3)
    texts = random_texts(rng, 500)
    docs = [(i, t) for i, t in enumerate([*texts, *texts[:60]])] + [(None, texts[0]), (77, texts[0]), (9000, None), (9001, ""), (9002, " " * 5000), (9003, "abc " * 50_000)]
    items = [(i, t) for i, t in enumerate(random_texts(rng, 30))] + [(3, "a b"), (50, None), (51, ""), (52, "nowhere")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3).withColumn("n", F.lit("extra")).withColumn("terms", F.lit(1))
    got = balltree.ranked(frame, spark.createDataFrame(items, "item_id long, text string"), 20)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_ranking(docs, items, 20)


def test_ranked_empty(spark, nothing, awkward):
    items = spark.createDataFrame([(1, "alpha")], "item_id long, text string")
    assert balltree.ranked(nothing, items).count() == 0
    assert balltree.ranked(awkward, items.limit(0)).count() == 0
    assert [r.doc_id for r in balltree.ranked(awkward, items).collect()] == [1]


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(5)
    sizes = rng.integers(1, 12, 700)
    term = np.concatenate([np.sort(rng.choice(300, s, replace=False)) for s in sizes])
    value = rng.integers(0, 10**10, len(term))
    value[rng.integers(0, len(value), 300)] = 0
    tree = balltree.BallTree(np.arange(700), sizes, term, value, leaf=8, slices=64)
    opened = 0
    for _ in range(50):
        item = np.sort(rng.choice(320, 6, replace=False))
        chosen = np.zeros(320, bool)
        chosen[item] = True
        first = np.cumsum(sizes) - sizes
        score = np.add.reduceat(value * chosen[term], first)
        for level, bound in enumerate(tree.ceilings(item)):
            for i, b in enumerate(bound):
                docs = tree.ids[tree.bounds[level][i] : tree.bounds[level][i + 1]]
                assert not len(docs) or score[docs].max() <= b
        (s, ids), n = tree.search(item, chosen, (np.zeros(0, np.int64), np.zeros(0, np.int64)), 10)
        want = [d for d in np.lexsort((np.arange(700), -score)) if score[d] > 0][:10]
        assert ids.tolist() == want and s.tolist() == score[want].tolist()
        opened += n
    assert opened < 50 * (1 << tree.height) * 0.8


def test_query_blocks(spark):
    rows = spark.range(200).withColumn("text", F.repeat(F.lit("x"), F.col("id").cast("int")))
    parts = common.query_blocks(rows, "id", F.length("text"), 30, 1 << 20)
    assert sum(p.count() for p in parts) == 200 and max(p.count() for p in parts) <= 30
    parts = common.query_blocks(rows, "id", F.length("text"), 1000, 1500)
    sizes = [[r.id for r in p.collect()] for p in parts]
    assert sorted(x for s in sizes for x in s) == list(range(200)) and all(sum(s) <= 1500 for s in sizes)


def plain_negatives(rows, anchors, positives=5, negatives=10):
    width = max(len(v) for *_, v in rows)
    full = [(i, label, np.array([*v, *[0] * (width - len(v))], np.int64)) for i, label, v in rows]
    out = []
    for a, label, v in [r for r in full if r[0] in anchors]:
        scored = sorted((-int(v @ w), i, other) for i, other, w in full if i != a)
        for s, p, _ in [x for x in scored if x[2] == label][:positives]:
            fits = [(-n, i) for n, i, other in scored if other != label and 30 * -s <= 100 * -n <= 90 * -s]
            out += [(a, p, k + 1, i, -s, n) for k, (n, i) in enumerate(fits[:negatives])]
    return sorted(out)


@pytest.mark.parametrize(("seed", "size", "width"), [(1, 300, 8), (2, 260, 64), (3, 200, 3)])
def test_mine(spark, monkeypatch, seed, size, width):
    monkeypatch.setattr(negatives, "BLOCK_ROWS", 16)
    monkeypatch.setattr(negatives, "TILE_ROWS", 50)
    monkeypatch.setattr(negatives, "TILE_ANCHORS", 4)
    rng = np.random.default_rng(seed)
    rows = [(int(i), int(rng.integers(0, 4)), [int(x) for x in rng.integers(-6, 9, width)]) for i in range(size)]
    rows += [(5, 1, rows[5][2]), (5, 2, rows[7][2]), (901, 9, [0] * width), (902, 1, []), (903, 1, rows[1][2][:2])] + [(1000 + k, k % 2, rows[0][2]) for k in range(40)]
    frame = spark.createDataFrame(rows, "vec_id long, label long, v array<long>").repartition(4).withColumn("window", F.lit("extra"))
    odd = spark.createDataFrame([(None, 1, [1]), (77777, None, [1]), (77778, 1, None), (77779, 1, [1, None])], "vec_id long, label long, v array<long>").withColumn("window", F.lit("x"))
    anchors = {i for i, *_ in rows if i % 10 == 0 or i in (5, 901, 902)}
    got = negatives.mine(frame.unionByName(odd), frame.where(F.col("vec_id").isin(sorted(anchors))))
    assert sorted(tuple(r) for r in got.collect()) == plain_negatives(rows, anchors)


def test_mine_empty(spark):
    rows = spark.createDataFrame([(100, 1, [1, 2]), (1, 1, [2, 2])], "vec_id long, label long, v array<long>")
    assert negatives.mine(rows, rows.limit(0)).count() == 0
    assert negatives.mine(rows.limit(0), rows.limit(0)).count() == 0
    assert negatives.mine(rows, rows.where("vec_id = 100")).count() == 0


def test_index_leaves_out_and_loses_nothing():
    rng = np.random.default_rng(0)
    for width in (1, 3, 64, 100):
        for least in (-50, 0, 1, 20_000, 60_000, -(1 << 62)):
            a, y = rng.integers(-200, 200, (9, width)), rng.integers(-200, 200, (300, width))
            y[5] = 0
            got = sorted(zip(*(x.tolist() for x in negatives.pairs_above(a, y, np.full(9, least))), strict=True))
            score = a @ y.T
            assert got == sorted((int(i), int(j), int(score[i, j])) for i, j in zip(*np.nonzero(score >= least), strict=True))
    big = np.full((2, 4), 1 << 29)
    assert negatives.pairs_above(big, big, np.array([1, (1 << 60) + 1]))[2].tolist() == [1 << 60, 1 << 60]


def plain_places(text):
    words = plain_terms(text)
    out = []
    for phrase, label in licences.PHRASES.items():
        p = phrase.split()
        out += [(i, label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    return sorted(out)


def test_matching_statistics_and_places():
    rng = random.Random(11)
    templates = [("t1", "a b a b c a b"), ("t2", "b c a a b d"), ("t3", "d"), ("t4", "a b a b c a b")]
    scanner = licences.Scanner(templates, {"a b": "x", "b a b c": "y", "c": "z"})
    runs = {tuple(w[i:j]) for w in [*[t.split() for _, t in templates], ["a", "b"], ["b", "a", "b", "c"], ["c"]] for i in range(len(w)) for j in range(i + 1, len(w) + 1)}
    for _ in range(300):
        words = [rng.choice("abcde") for _ in range(rng.randint(0, 30))]
        want = []
        for end in range(1, len(words) + 1):
            size = max((n for n in range(1, end + 1) if tuple(words[end - n : end]) in runs), default=0)
            if size:
                want.append((end, size))
        got = list(scanner.statistics([w.encode() for w in words]))
        assert [(e, n) for e, n, _ in got] == want
        for end, size, state in got:
            found = {(k, e) for k, e in scanner.automaton.ends[state] if k < 4}
            run = words[end - size : end]
            assert found == {(k, e) for k, (_, t) in enumerate(templates) for e in range(size, len(t.split()) + 1) if t.split()[e - size : e] == run}
        want = sorted((i, label) for p, label in [("a b", "x"), ("b a b c", "y"), ("c", "z")] for i in range(len(words)) if words[i : i + len(p.split())] == p.split())
        assert scanner.scan(" ".join(words))["places"] == want


def test_chain_is_best():
    rng = random.Random(2)

    def brute(group):
        best = 0
        for mask in range(1, 1 << len(group)):
            own = [group[i] for i in range(len(group)) if mask >> i & 1]
            if all(a[0] + a[2] <= b[0] and a[1] + a[2] <= b[1] for a, b in zip(own, own[1:], strict=False)):
                best = max(best, sum(a[2] for a in own))
        return best

    for _ in range(300):
        group = sorted((rng.randint(0, 30), rng.randint(0, 20), rng.randint(1, 6)) for _ in range(rng.randint(1, 8)))
        start, end, cover = licences._chain(group)
        assert cover == brute(group) and start < end


def test_licences(spark, awkward, nothing):
    mit = dict(licences.TEMPLATES)["mit"]
    broken = mit.split()
    broken[10:10] = ["really"] * 7
    broken[40] = "altered"
    bsd = dict(licences.TEMPLATES)["bsd"]
    prose = "the rights to use and the following conditions of a program that is free " * 40
    rows = [
        (1, f"{prose} {mit} {prose}"), (2, " * ".join(broken)), (3, prose), (4, "MIT\nLICENSE, cc-by, CC BY and the Apache-License gnu general public license"), (5, None), (6, ""),
        (7, f"{prose * 200} {bsd.upper()} {prose * 200} cc by"), (8, f"{mit} " * 300), (9, " ".join(mit.split()[:30])), (9, f"{bsd} {mit}"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("licences", F.lit("extra"))
    found = licences.find_licences(docs)
    got = {(r.doc_id, r.text): r.licences_ for r in found.collect()}
    for (_, text), f in got.items():
        assert f.n_words == len(plain_terms(text)) and [tuple(p) for p in f.places] == plain_places(text)
    spans = lambda k: [(s.label, round(s.share, 2)) for s in got[rows[k - 1]].spans]
    n = len(plain_terms(prose))
    assert [tuple(s) for s in got[rows[0]].spans] == [("mit", n, n + len(plain_terms(mit)), 1.0)]
    assert [s[0] for s in spans(2)] == ["mit"] and 0.9 < spans(2)[0][1] < 1
    assert spans(3) == spans(4) == spans(5) == spans(6) == spans(9) == [] and len(got[rows[3]].places) == 4 + 1 - 0
    assert spans(7) == [("bsd", 1.0)] and spans(8) == [("mit", 1.0)] and spans(10) == [("bsd", 1.0), ("mit", 1.0)]
    assert licences.find_licences(awkward).count() == awkward.count() and licences.find_licences(nothing).count() == 0
