"""Exact ranked search by ball trees over sparse document vectors.

A document's vector has, for each term, what that term adds to the score of an item that holds it, so that a
score is the inner product with the item's vector of ones. The texts are read once: every document becomes its
term counts within the items' vocabulary, from which Spark derives the corpus statistics. Each task then builds
ball trees over bounded numbers of its documents. A node has a centroid and one radius for each slice of the
vocabulary; centroid score plus the sum of slice radius times the norm of the item's part in the slice is no
less than the score of any document below it. Floating-point bounds are rounded up by more than their error.
Subtrees are opened best first until none can reach the item's k-th score so far; leaves are scored in integers.
The best of all tasks are ranked at the end.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from callweave.llm.common import cut, frugal, query_blocks, small_batches, table
from callweave.llm.terms import terms

TOP = 50
#: Largest block of items that is searched at once.
BLOCK_ITEMS, BLOCK_BYTES = 256, 1 << 20
#: Documents and vector entries of a tree, documents of a leaf, slices of the vocabulary with a radius of their own.
TREE_DOCS, TREE_ENTRIES, LEAF, SLICES = 2048, 1 << 20, 16, 512
_LAST = np.iinfo(np.int64).max


def _flat(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions of all entries of the rows that start at ``starts``."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


class BallTree:
    """A complete binary tree over documents with entries (term, value), all values whole numbers from 0."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, term: np.ndarray, value: np.ndarray, leaf: int = LEAF, slices: int = SLICES):
        self.height = max(0, math.ceil(math.log2(max(1, len(ids) / leaf))))
        bounds = [np.array([0, len(ids)])]
        for _ in range(self.height):
            mid = (bounds[-1][1:] + bounds[-1][:-1]) // 2
            bounds.append(np.insert(bounds[-1], np.arange(1, len(bounds[-1])), mid))
        self.bounds, self.slices = bounds, slices
        order = self._arrange(sizes, term, value.astype(np.float64))
        pos = _flat((np.cumsum(sizes) - sizes)[order], sizes[order])
        self.ids, self.sizes = ids[order], sizes[order]
        self.term, self.value = term[pos], value[pos]
        self.first = np.concatenate([[0], np.cumsum(self.sizes)])
        self._summarise()

    def _arrange(self, sizes: np.ndarray, term: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Order of documents in which every node's documents are neighbours: halves by nearness to two far documents."""
        first = np.cumsum(sizes) - sizes
        norm = np.add.reduceat(x * x, first) if len(first) else np.zeros(0)
        work = np.zeros(int(term.max()) + 1 if len(term) else 1)
        order = np.arange(len(sizes))
        for level in range(self.height):
            edges = self.bounds[level]
            for a, b, mid in zip(edges[:-1], edges[1:], self.bounds[level + 1][1::2], strict=True):
                if b - a < 2:
                    continue
                docs = order[a:b]
                pos, starts = _flat(first[docs], sizes[docs]), np.cumsum(sizes[docs]) - sizes[docs]
                t, v = term[pos], x[pos]

                def with_doc(k: int, docs=docs, t=t, v=v, starts=starts) -> np.ndarray:
                    own = slice(first[docs[k]], first[docs[k]] + sizes[docs[k]])
                    work[term[own]] = x[own]
                    out = np.add.reduceat(v * work[t], starts)
                    work[term[own]] = 0
                    return out

                one = int((norm[docs] - 2 * with_doc(0)).argmax())
                near_one = with_doc(one)
                other = int((norm[docs] - 2 * near_one).argmax())
                lean = near_one - with_doc(other) - (norm[docs[one]] - norm[docs[other]]) / 2
                order[a:b] = docs[np.argpartition(-lean, mid - a)] if mid < b else docs
        return order

    def _summarise(self) -> None:
        """Centroids by term and radii by slice, from the leaves up."""
        n, g, leaves = len(self.ids), self.slices, 1 << self.height
        x, part, doc = self.value.astype(np.float64), self.term % g, np.repeat(np.arange(n), self.sizes)
        squares = np.bincount(doc * g + part, weights=x * x, minlength=n * g).reshape(n, g)
        node = np.repeat(np.arange(leaves), np.diff(self.bounds[-1]))
        key, place = np.unique(self.term * leaves + node[doc], return_inverse=True)
        total = np.bincount(place, weights=x, minlength=len(key))
        self.levels = []
        for level in range(self.height, -1, -1):
            width, edges = 1 << level, self.bounds[level]
            count = np.maximum(np.diff(edges), 1)
            who, what = key % width, key // width
            centre = total / count[who]
            around = np.bincount(who * g + what % g, weights=centre * centre, minlength=width * g).reshape(width, g)
            owner = np.repeat(np.arange(width), np.diff(edges))
            cross = np.bincount(doc * g + part, weights=x * centre[place], minlength=n * g).reshape(n, g)
            size = squares + around[owner]
            far = np.maximum(size - 2 * cross, 0) + size * 1e-10  # more than the rounding of these sums
            live = np.flatnonzero(np.diff(edges))
            radius = np.zeros((width, g))
            radius[live] = np.sqrt(np.maximum.reduceat(far, edges[:-1][live], axis=0)) if n else 0
            low = np.searchsorted(what, np.arange(int(what[-1]) + 2) if len(what) else np.zeros(1, np.int64))
            self.levels.append((who, centre, low, radius))
            if level:
                up = what * (width // 2) + who // 2  # still sorted
                fresh = np.concatenate([[True], up[1:] != up[:-1]])
                key, total, place = up[fresh], np.add.reduceat(total, np.flatnonzero(fresh)), (np.cumsum(fresh) - 1)[place]
        self.levels.reverse()

    def ceilings(self, item: np.ndarray) -> list[np.ndarray]:
        """For every level the nodes' bounds on the score of an item's terms."""
        part, count = np.unique(item % self.slices, return_counts=True)
        weight = np.sqrt(count)
        out = []
        for level, (who, centre, low, radius) in enumerate(self.levels):
            known = item[item < len(low) - 1]
            pos = _flat(low[known], low[known + 1] - low[known])
            near = np.bincount(who[pos], weights=centre[pos], minlength=1 << level)
            out.append(np.floor((near + radius[:, part] @ weight) * (1 + 1e-9) + 1))
        return out

    def search(self, item: np.ndarray, chosen: np.ndarray, best: tuple[np.ndarray, np.ndarray], k: int) -> tuple[tuple[np.ndarray, np.ndarray], int]:
        """The k best (scores, ids) of ``best`` and the tree's documents, and the number of leaves scored.

        ``chosen`` is true at the item's terms. Only scores above 0 count; of equal ones the smaller id is better.
        """
        score, ids = best
        ceilings = self.ceilings(item)
        queue, opened = [(-ceilings[0][0], 0, 0)], 0
        while queue:
            bound, level, i = heapq.heappop(queue)
            if -bound < max(1, score[-1] if len(score) >= k else 1):
                break
            if level < self.height:
                for child in (2 * i, 2 * i + 1):
                    heapq.heappush(queue, (max(bound, -ceilings[level + 1][child]), level + 1, child))
                continue
            a, b = self.bounds[level][i : i + 2]
            if a == b:
                continue
            opened += 1
            pos = slice(self.first[a], self.first[b])
            own = np.add.reduceat(self.value[pos] * chosen[self.term[pos]], self.first[a:b] - self.first[a])
            good = np.flatnonzero(own >= max(1, score[-1] if len(score) >= k else 1))
            if len(good):
                score, ids = np.concatenate([score, own[good]]), np.concatenate([ids, self.ids[a:b][good]])
                top = np.lexsort((ids, -score))[:k]
                score, ids = score[top], ids[top]
        return (score, ids), opened


def _vectors(docs: DataFrame, vocabulary) -> DataFrame:
    """(doc_id, n, terms, counts) of documents with terms: all terms counted, those of the vocabulary listed."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        for batch in batches:
            size, term, count, ends = [], [], [], [0]
            for text in batch.column(1):
                words = terms(text.as_py())
                held = [(known[w], c) for w, c in Counter(words).items() if w in known]
                size.append(len(words))
                term += [t for t, _ in held]
                count += [c for _, c in held]
                ends.append(len(term))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (term, count)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), *lists], ["doc_id", "n", "terms", "counts"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n long, terms array<int>, counts array<int>").where("n > 0")


def _hits(vectors: DataFrame, shared, top: int) -> DataFrame:
    """(item, doc_id, score): the best of every task's documents, ``item`` by its place in the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights, n_docs, n_terms = shared.value
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(items)
        chosen = np.zeros(len(weights), bool)
        for batch in batches:
            ids = batch.column(0).fill_null(_LAST).to_numpy(zero_copy_only=False)
            n = batch.column(1).to_numpy()
            sizes = np.diff(batch.column(2).offsets.to_numpy())
            term, tf = (batch.column(c).flatten().to_numpy().astype(np.int64) for c in (2, 3))
            m = 50 + 50 * n * n_docs // n_terms
            value = weights[term] * (1_000_000_000 * tf // (1000 * tf + 20 * np.repeat(m, sizes)))
            ends = np.cumsum(sizes)
            live = np.flatnonzero(sizes)
            a = 0
            while a < len(live):
                before = ends[live[a]] - sizes[live[a]]
                b = min(a + TREE_DOCS, max(a + 1, int(np.searchsorted(ends[live], before + TREE_ENTRIES, "right"))))
                rows = live[a:b]
                pos = slice(before, ends[rows[-1]])
                tree = BallTree(ids[rows], sizes[rows], term[pos], value[pos])
                for k, item in enumerate(items):
                    chosen[item] = True
                    best[k], _ = tree.search(item, chosen, best[k], top)
                    chosen[item] = False
                a = b
        who = np.repeat(np.arange(len(items)), [len(s) for s, _ in best])
        score, ids = (np.concatenate([b[x] for b in best] or [np.zeros(0, np.int64)]) for x in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(who, pa.int64()), pa.array(ids, pa.int64(), mask=ids == _LAST), pa.array(score, pa.int64())], ["item", "doc_id", "score"])

    return vectors.mapInArrow(run, "item long, doc_id long, score long")


def ranked(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents of ``docs(doc_id long, text)`` for each of ``items(item_id, text)``.

    Only scores above 0 count; equal scores come by ascending doc_id, null last. Every row of documents is a
    document of its own, also if it repeats an id; rows of one item_id are one item with the terms of all of
    them. Null and empty texts and texts without terms are no documents and find nothing; without documents
    or items the result is empty. Items are searched in blocks of bounded size, each reading the documents once.
    """
    spark = docs.sparkSession
    found = []
    for block in query_blocks(items.select("item_id", "text"), "item_id", F.coalesce(F.octet_length("text"), F.lit(0)), BLOCK_ITEMS, BLOCK_BYTES):
        held: dict = {}
        for row in block.collect():
            held.setdefault(row.item_id, set()).update(terms(row.text))
        names = sorted(held, key=lambda x: (x is None, x))
        vocabulary = {t: i for i, t in enumerate(sorted(set().union(*held.values())))}
        with small_batches(spark):
            vectors = cut(_vectors(docs, spark.sparkContext.broadcast(vocabulary)))
        n_docs, n_terms = vectors.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = np.zeros(len(vocabulary), np.int64)
        for row in vectors.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
            df[row.t] = row["count"]
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)
        queries = [np.array(sorted(vocabulary[t] for t in held[x]), np.int64) for x in names]
        hits = _hits(vectors, spark.sparkContext.broadcast((queries, weights, n_docs, n_terms)), top)
        ids = spark.createDataFrame([(i, x) for i, x in enumerate(names)], f"item long, item_id {items.schema['item_id'].dataType.simpleString()}")
        found.append(hits.join(F.broadcast(ids), "item").select("item_id", "doc_id", "score"))
    hits = found[0]
    for more in found[1:]:
        hits = hits.unionByName(more)
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return hits.withColumn("rank", place).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of every benchmark item."""
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH words AS (
  SELECT row_number() OVER () AS doc, doc_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents WHERE text IS NOT NULL),
held AS (SELECT doc, doc_id, w, len(w) AS n FROM words WHERE len(w) > 0),
total AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM held),
tf AS (SELECT doc, term, count(*) AS tf FROM (SELECT doc, unnest(w) AS term FROM held) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
items AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
weights AS (SELECT item_id, term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS weight FROM items JOIN df USING (term), total),
score AS (
  SELECT item_id, doc, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM weights JOIN tf USING (term) JOIN held USING (doc), total GROUP BY ALL),
placed AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM score WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM placed WHERE rank <= 50
"""
