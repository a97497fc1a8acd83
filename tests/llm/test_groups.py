"""URL filter, near duplicates, SimHash, repeated substrings and the pipeline against brute force."""

import hashlib
import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from callweave.llm import common, neardup, packing, simhash, substrings, url_filter
from callweave.llm.common import connected_components
from callweave.llm.shingles import shingle_sets

SMALL = "/root/testdata/sf0.001"


def plain_rule(url, rules):
    if url is None or "://" not in url:
        return "", "", None
    host, path = re.match(r"([^/?#]*)([^?#]*)", url.partition("://")[2], re.S).groups()
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    best = None
    for _, rule in rules:
        h, slash, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith(slash + p) and (best is None or len(rule) > len(best)):
            best = rule
    return host, path, best


URLS = [
    "http://WWW.Example.com/en/a?x#y", "https://example.com/en/", "https://example.com", "http://a.b.net/es/1", "http://net/fr/", "x://notnet/es/", "no scheme", "", None,
    "http://u:p@h.com:80/en/", "a://b.com/c://d.net/es/", "ftp://.com/", "http://é.com/ü", "http://a.net/es", "http://example.com.net/en/es/",
]


def test_url_rules(spark, awkward, nothing):
    rows = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    block = {r for v, r in url_filter.RULES if v == "block"}
    want = {k: (*plain_rule(u, url_filter.RULES), "block" if plain_rule(u, url_filter.RULES)[2] in block else "allow") for k, u in enumerate(URLS)}
    assert {r.page_id: tuple(r.judged) for r in url_filter.filter_urls(rows, url_filter.RULES).collect()} == want
    table = spark.createDataFrame(url_filter.RULES, "verdict string, rule string")
    assert {r.page_id: tuple(r.judged) for r in url_filter._filter_by_join(rows, table, "url", "allow", "judged").collect()} == want
    assert {r.page_id: tuple(r.judged) for r in url_filter.filter_urls(rows, table).collect()} == want
    assert url_filter.filter_urls(awkward, url_filter.RULES, "text").count() == awkward.count()
    assert url_filter.filter_urls(nothing, [], "text").count() == 0
    assert {r.judged.verdict for r in url_filter.filter_urls(rows, [], default="block").collect()} == {"block"}


def test_url_index_confirms_strings(tmp_path, monkeypatch):
    monkeypatch.setattr(url_filter.xxhash, "xxh64_intdigest", lambda raw: len(raw))  # every equal length collides
    url_filter.write_index([("block", "a.com/"), ("allow", "b.com/"), ("block", "b.com/")], str(tmp_path / "i"))
    index = url_filter.DigestIndex(str(tmp_path / "i"))
    found = index.find(["a.com/", "b.com/", "c.com/", "long.com/"])
    assert (found >= 0).tolist() == [True, True, False, False] and index.block[found[:2]].tolist() == [1, 1]


def test_components(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000 + k, 1001 + k) for k in range(40)] + [(5, 5)]
    parent = {x: x for p in pairs for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: find(x) for p in pairs if p[0] != p[1] for x in p}


def test_components_stop_at_stars(spark, monkeypatch):
    """Stars are recognised by their first minima: one written table beside the edges, and no round that changes nothing."""
    written = []
    monkeypatch.setattr(common, "cut", lambda df, own=common.cut: written.append(1) or own(df))
    star = [(k % 7, 10 + k) for k in range(90)]
    assert {(r.id, r.component) for r in connected_components(spark.createDataFrame(star, "a long, b long")).collect()} == {(x, a) for a, b in star for x in (a, b)}
    assert len(written) == 2
    chain = [(k, k + 1) for k in range(5)]
    assert {r.component for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()} == {0}
    assert connected_components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0


def plain_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def plain_components(rows, threshold=80):
    sets = {}
    for i, t in rows:
        if i is not None:
            sets.setdefault(i, []).append(plain_set(t))
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    flat = [(i, s) for i, own in sets.items() for s in own if s]
    for (i, a), (j, b) in combinations(flat, 2):
        both = len(a & b)
        if 100 * both >= threshold * (len(a) + len(b) - both):
            x, y = find(i), find(j)
            parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def family(rng, n, words, edits):
    base = [f"w{rng.randrange(4000)}" for _ in range(words)]
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randrange(edits + 1)):
            own[rng.randrange(words)] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize(("limit", "threshold"), [(1024, 85), (12, 85), (12, 80)])
def test_near_duplicates(spark, monkeypatch, limit, threshold):
    monkeypatch.setattr(neardup, "GROUP_ROWS", limit)
    rng = random.Random(limit)
    texts = family(rng, 60, 120, 5) + family(rng, 40, 40, 3) + [" ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(1, 60))) for _ in range(40)]
    texts += ["One two", "one TWO", "one two three", "", None, " \n"] + texts[:3]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), threshold).collect()
    want = plain_components(rows, threshold)
    assert {r.doc_id: (r.component_id, r.n_shingles, r.kept) for r in got} == {i: (want[i], len(plain_set(t)), want[i] == i) for i, t in rows}


def test_weakly_similar_texts_stay_in_small_groups(spark, monkeypatch):
    """Texts of a template, 0.3 alike, meet by chance in buckets; no comparison takes in what these chain together."""
    monkeypatch.setattr(neardup, "GROUP_ROWS", 40)
    rng = random.Random(1)
    shared = " ".join(f"t{k}" for k in range(50))
    texts = [f"{shared} " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(50)) for _ in range(300)]
    texts += [texts[5] + " more", texts[9] + " words", texts[9] + " here"]
    rows = list(enumerate(texts))
    seen = []
    real = neardup._sized

    def watched(groups):
        small, large = real(groups)
        if "delta" in groups.columns:
            seen.append(groups.groupBy("grp").count().agg({"count": "max"}).first()[0])
        return small, large

    monkeypatch.setattr(neardup, "_sized", watched)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain_components(rows) and max(seen, default=0) <= 120


def test_near_duplicates_of_awkward_rows(spark, awkward, nothing):
    got = neardup.near_duplicates(awkward).collect()
    assert len(got) == awkward.count()
    assert all(r.kept and r.component_id is None for r in got if r.doc_id is None) and all(r.kept for r in got)
    assert neardup.near_duplicates(nothing).count() == 0


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(0)
    a = np.unique(rng.integers(0, 2**63, 900, dtype=np.uint64))
    b = np.unique(np.concatenate([a[:600], rng.integers(0, 2**63, 300, dtype=np.uint64)]))
    ra, rb, both = neardup.registers([a, b, np.union1d(a, b)])
    assert (np.maximum(ra, rb) == both).all() and not neardup.registers([a[:0]]).any()
    assert abs((ra == rb).mean() - 0.5) < 0.15
    assert neardup.possible(np.stack([ra, rb, ra]), np.array([len(a), len(b), len(a)]), 0, np.array([1, 2])).tolist() == [2]


def test_shingles_are_those_of_the_words():
    rng = random.Random(3)
    texts = ["", "a", "A b\tc", "É x y z w", " a  b c d e f "] + [" ".join(rng.choice("ab") for _ in range(rng.randrange(30))) for _ in range(50)]
    sets = shingle_sets([t.encode() for t in texts])
    assert [len(s) for s in sets] == [len(plain_set(t)) for t in texts]
    for (i, s), (j, t) in combinations(list(enumerate(sets)), 2):
        assert len(np.intersect1d(s, t)) == len(plain_set(texts[i]) & plain_set(texts[j]))


def test_simhash_rows_and_search(spark, awkward, nothing):
    rng = random.Random(6)
    texts = {k * 7 % 1000: " ".join(rng.choice(["the", "cat", "sat", "漢", f"w{k % 5}"]) for _ in range(rng.randrange(40))) for k in range(300)}
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r for r in simhash.fingerprints(rows).collect()}
    ids = sorted(texts, reverse=True)
    for k, i in enumerate(ids):
        t, n = texts[i], texts[ids[(k + 1) % len(ids)]]
        half = len(t) // 2
        edited = t[: len(t) - half] + n[:half]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert got[i].next_fp == got[ids[(k + 1) % len(ids)]].fp
    found = {r.fp: r.near for r in simhash.within_radius(rows.where("doc_id % 100 = 0").join(simhash.fingerprints(rows).select("doc_id", "fp"), "doc_id"), simhash.fingerprints(rows)).collect()}
    for i in texts:
        if i % 100 == 0:
            assert found[got[i].fp] == sum(bin((got[i].fp ^ o.fp) & (2**64 - 1)).count("1") <= simhash.RADIUS for o in got.values())
    assert simhash.fingerprints(awkward).count() == awkward.count() and simhash.fingerprints(nothing).count() == 0
    one = simhash.fingerprints(spark.createDataFrame([(4, "ab cd")], "doc_id long, text string")).first()
    assert one.edited_sha256 == hashlib.sha256(b"ab ab").hexdigest() and one.next_fp == one.fp


def test_successors_across_buckets(spark, monkeypatch):
    """Clustered ids, one id with a third of the rows, nulls: every row has the next row's text, and buckets stay small."""
    monkeypatch.setattr(simhash, "BUCKET_ROWS", 4)
    monkeypatch.setattr(simhash, "SEGMENTS", 8)
    rng = random.Random(2)
    ids = [*range(100), *[10**12 + k for k in range(60)], *[77] * 100, *[None] * 40]
    rows = [(i, f"text {k} {rng.random()}") for k, i in enumerate(ids)]
    for few in (200_000, 0):
        monkeypatch.setattr(simhash, "BROADCAST_BUCKETS", few)
        found = simhash.with_next(spark.createDataFrame(rows, "doc_id long, text string"))
        tie = {r.text: r.tie for r in found.select("text", simhash.F.xxhash64("text").alias("tie")).collect()}
        order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), -tie[r[1]]))
        want = {t: order[(k + 1) % len(order)][1] for k, (_, t) in enumerate(order)}
        got = found.collect()
        assert {r.text: r.next for r in got if not r.halo} == want
        assert max(Counter(r.bucket for r in got).values()) <= 30


def test_simhash_votes_are_those_of_the_words(spark):
    words = ["a", "b", "a", "c", "a"]
    r = simhash.votes(spark.createDataFrame([(1, " ".join(words)), (2, ""), (3, " \n ")], "k long, text string"), ["k"]).collect()
    fp = {x.k: x.fp for x in r}
    hashes = {x.w: x.h for x in spark.createDataFrame([(w,) for w in "abc"], "w string").selectExpr("w", "xxhash64(w) h").collect()}
    want = sum((2 * sum((hashes[w] >> i) & 1 for w in words) > len(words)) << i for i in range(64))
    assert fp[1] & (2**64 - 1) == want and fp[2] == fp[3] == 0


def plain_removal(texts, length):
    """(n_bytes, n_removed, n_spans, kept) of every text, by counting all strings of the length."""
    raws = [(t or "").encode() for t in texts]
    counts = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        hit = np.zeros(len(r) + 1, int)
        for i in range(len(r) - length + 1):
            if counts[r[i : i + length]] > 1:
                hit[i] += 1
                hit[i + length] -= 1
        covered = np.cumsum(hit)[:-1] > 0
        kept = np.frombuffer(r, np.uint8)[~covered].tobytes()
        out.append((len(r), int(covered.sum()), int((covered & ~np.concatenate([[False], covered[:-1]])).sum()), kept))
    return out


def test_common_prefixes_by_increasing_value():
    rng = np.random.default_rng(5)
    for n, letters, bound in [(1, 2, 3), (40, 2, 4), (300, 2, 9), (300, 4, 50)]:
        text = np.concatenate([rng.integers(1, letters + 1, n - 1), [0]])
        text[n // 2 : n // 2 + n // 4] = text[: n // 4]
        text[-1] = 0
        order = substrings.sorted_suffixes(text, bound)
        rows = [text[i : i + bound].tolist() for i in order]
        assert rows == sorted(rows) and sorted(order.tolist()) == list(range(n))
        found = substrings.common_prefixes(text, order, bound)
        for i in range(1, n):
            a, b = text[order[i - 1] :], text[order[i] :]
            k = next((j for j in range(min(len(a), len(b), bound)) if a[j] != b[j]), min(len(a), len(b), bound))
            assert found[i] == k


@pytest.mark.parametrize(("kinds", "part", "length", "passage"), [(5000, 1 << 20, 400, 250), (8, 1500, 400, None), (8, 1500, 250, None), (5000, 1500, 90, 41)])
def test_repeated_substrings(spark, monkeypatch, kinds, part, length, passage):
    monkeypatch.setattr(substrings, "CORE_KINDS", kinds)
    monkeypatch.setattr(substrings, "BLOCK_SYMBOLS", 16_000)
    monkeypatch.setattr(substrings, "PART", part)
    rng = random.Random(kinds)
    words = ["".join(rng.choice("abcdé") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passages = [make(150) for _ in range(3)]
    texts = []
    for _ in range(60):
        p = rng.choice(passages)
        texts.append(f"{make(rng.randrange(60))} {p[rng.randrange(80) : len(p) - rng.randrange(200)]} {make(rng.randrange(60))}")
    texts += [None, "", "ab" * 1200, "ab" * 150, "x" * 399, "x" * 400, "y" * 401, make(700), texts[0], texts[0]]
    rows = [(k if k % 20 else None, t) for k, t in enumerate(texts)] + [(7, texts[7]), (9, texts[20])]
    texts += [texts[7], texts[20]]
    got = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), length=length, passage=passage).collect()
    want = sorted((str(i), *w, s[1]) for (i, _), w, s in zip(rows, plain_removal(texts, length), plain_removal(texts, passage or length), strict=True))
    assert sorted((str(r.doc_id), r.cleaned.n_bytes, r.cleaned.n_removed, r.cleaned.n_spans, bytes(r.cleaned.kept), r.cleaned.n_shared) for r in got) == want


def test_repeated_substrings_of_awkward_rows(spark, awkward, nothing):
    assert substrings.remove_repeats(awkward).count() == awkward.count() and substrings.remove_repeats(nothing).count() == 0


def test_pipeline(spark):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, kept = docs.columns, docs
    for name, stage in pipeline.STAGES[:-1]:
        rows = kept.select("doc_id", "text").collect()
        before = {r.doc_id for r in rows}
        kept = stage(spark, kept, SMALL).persist()
        assert kept.columns == columns
        after = [r.doc_id for r in kept.select("doc_id").collect()]
        assert len(set(after)) == len(after) and set(after) <= before
        if name == "near_dedup":
            assert set(plain_components([(r.doc_id, r.text) for r in kept.collect()]).values()) == set(after)
        if name == "substring_dedup":
            left = plain_removal([r.text for r in rows], substrings.PASSAGE)
            want = {r.doc_id: k.decode(errors="ignore") if n else r.text for r, (_, n, _, k) in zip(rows, left, strict=True)}
            assert {r.doc_id: r.text for r in kept.collect()} == {i: t for i, t in want.items() if t.strip(" ")}
            assert any(n for _, n, _, _ in left)
    assert not kept.where("text rlike 'AKIA[A-Z0-9]{16}'").count() and kept.where("n_chars <> length(text)").isEmpty()
    assert len(after) > 0.7 * docs.count()
    rows = pipeline.run(spark, SMALL).collect()
    assert {r.doc_id for r in rows} == set(after)
    assert max(Counter(s for r in rows for s in [r.sequence_id] * r.length).values()) <= packing.CAPACITY


def test_memory_of_a_group():
    """A group's verification takes a small multiple of its sets, and gives the links of all pairs."""
    import tracemalloc

    rng = np.random.default_rng(5)
    kinds = [rng.integers(1, 1 << 63, 8000, dtype=np.uint64) for _ in range(10)]
    sets = [np.unique(np.concatenate([kinds[i % 10][rng.random(8000) < 0.95], rng.integers(1, 1 << 63, 50 * (i % 7), dtype=np.uint64)])) for i in range(60)]
    sizes = np.array([len(s) for s in sets])
    tracemalloc.start()
    found = neardup.links_in_group(list(range(60)), sizes, sets, None, 80)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 * sizes.sum()
    share = lambda a, b: len(np.intersect1d(sets[a], sets[b])) / len(np.union1d(sets[a], sets[b]))
    assert all(share(a, b) >= 0.8 for a, b in found)
    want = {(a, b) for a, b in combinations(range(60), 2) if share(a, b) >= 0.8}
    joined = {i: {i} for i in range(60)}
    for a, b in found:
        both = joined[a] | joined[b]
        joined.update(dict.fromkeys(both, both))
    assert all(b in joined[a] for a, b in want) and want


def test_work_of_a_group(monkeypatch):
    """Members connected already aren't compared again, and a comparison makes a few numbers a pair, not a grid of them."""
    import tracemalloc

    rng = np.random.default_rng(6)
    base = rng.integers(1, 1 << 63, 60, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(60) < 0.99], rng.integers(1, 1 << 63, 1, dtype=np.uint64)])) for _ in range(300)]
    sizes, regs = np.array([len(s) for s in sets]), neardup.registers(sets)
    compared = []
    monkeypatch.setattr(neardup, "possible", lambda *a, own=neardup.possible: compared.append(len(a[3])) or own(*a))
    assert len(neardup.links_in_group(list(range(300)), sizes, sets, regs, 80)) == 299
    assert sum(compared) < 10 * 300
    tracemalloc.start()
    neardup.possible(regs, sizes, 0, np.arange(1, 300), 80)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 299 * 1600


@pytest.mark.parametrize("threshold", [80, 85])
def test_likelihood_against_a_grid(threshold):
    """The exclusion in closed form equals the one by trying many similarities, but for pairs at the very edge."""
    rng = np.random.default_rng(7)
    regs = rng.integers(0, 3, (400, neardup.REGISTERS)).astype(np.uint16)
    for i in range(1, 400):  # all shares of equal registers
        keep = rng.random(neardup.REGISTERS) < i / 400
        regs[i, keep] = regs[0, keep]
    sizes = rng.integers(80, 101, 400)
    found = set(neardup.possible(regs, sizes, 0, np.arange(1, 400), threshold).tolist())
    at = np.arange(1, 100_000) / 100_000
    for i in range(1, 400):
        a, b = sizes[0], sizes[i]
        if 100 * min(a, b) < threshold * max(a, b):
            assert i not in found
            continue
        j = at[(a > b * at) & (b > a * at)]
        same, more, less = (regs[i] == regs[0]).sum(), (regs[i] < regs[0]).sum(), (regs[i] > regs[0]).sum()
        score = same * np.log(j) + more * np.log((a - b * j) / (a + b)) + less * np.log((b - a * j) / (a + b))
        gap = score.max() - score[j >= threshold / 100 - 0.005].max()
        assert abs(gap - neardup.NATS) < 0.1 or (i in found) == (gap <= neardup.NATS)
    assert 20 < len(found) < 380
