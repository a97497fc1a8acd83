"""Hard-negative mining by threshold joins over an inverted index with bounds on norms.

A window belongs to an anchor: its k best partners with a score between two limits, of the same or of another
label. All windows of a block of anchors are filled together, in rounds. A round asks only for scores above a
threshold; windows that are still open ask again below it, with a lower one, until they are full or their limit
is reached. In a round every task indexes its rows dimension by dimension. From the dimension on where the norm
of a row's rest times that of any anchor's rest stays below the least threshold, a row isn't indexed. Partial
scores accumulate over the indexed dimensions; a pair is dropped once partial score and the product of the
remaining norms miss the anchor's threshold, and what is left gets its exact integer score. Within a task
thresholds rise as windows fill. Anchors are a stated query set, taken in blocks of bounded size against all rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from callweave.llm.common import cut, discard, query_blocks, table

POSITIVES, NEGATIVES = 5, 10
#: Limits of a negative's score in hundredths of the positive's.
LOW, HIGH = 30, 90
#: Largest block of anchors, and how many of them meet a part of the index at once.
BLOCK_ROWS, BLOCK_BYTES, TILE_ANCHORS, TILE_ROWS = 1024, 32 << 20, 128, 8192
#: Dimensions after which partial scores are looked at.
STRIDE = 32
#: Thresholds of positives' rounds, in hundredths of the anchor's norm times the rows' mean norm, and how far into its window a negatives' round reaches.
DEPTHS, REACHES = (80, 50, 20), (0.25, 0.5)
_UNBOUNDED = 1 << 62
_HIT = "window long, vec_id long, score long"


def norms_after(x: np.ndarray) -> np.ndarray:
    """(rows, dimensions + 1): the norm of each row from a dimension on."""
    out = np.zeros((len(x), x.shape[1] + 1))
    out[:, :-1] = np.sqrt(np.cumsum((x * x)[:, ::-1], axis=1)[:, ::-1])
    return out


def pairs_above(anchors: np.ndarray, rows: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, score) of all pairs whose score is no less than the anchor's threshold."""
    a, y = anchors.astype(np.float64), rows.astype(np.float64)
    rest_a, rest_y = norms_after(a), norms_after(y)
    lowest, size = least.min(initial=_UNBOUNDED), y.shape[1]
    covered = rest_y * (rest_a.max(axis=0, initial=0) * (1 + 1e-9)) < lowest
    covered[:, -1] = True
    indexed = covered.argmax(axis=1)
    index = np.where(np.arange(size) < indexed[:, None], y, 0).T
    slack = 1e-9 * rest_a[:, :1]
    live = np.flatnonzero(indexed > 0) if lowest > 0 else np.arange(len(y))
    partial = np.zeros((len(a), len(live)))
    for at in range(0, size, STRIDE):
        stop = min(size, at + STRIDE)
        partial += a[:, at:stop] @ index[at:stop, live]
        done = np.minimum(indexed[live], stop)  # up to here the row's dimensions are in the partial score
        possible = partial + rest_a[:, done] * rest_y[live, done] + slack * rest_y[live, 0] >= least[:, None]
        some = possible.any(axis=0)
        if not some.all():
            live, partial, possible = live[some], partial[:, some], possible[:, some]
    who, place = np.nonzero(possible) if size else np.nonzero(np.zeros((len(a), len(live)), bool) >= least[:, None])
    what = live[place]
    score = np.empty(len(who), np.int64)
    for i in range(0, len(who), 1 << 16):
        part = slice(i, i + (1 << 16))
        score[part] = np.einsum("ij,ij->i", anchors[who[part]], rows[what[part]])
    keep = score >= least[who]
    return who[keep], what[keep], score[keep]


def _first(window: np.ndarray, score: np.ndarray, vec: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each window."""
    order = np.lexsort((vec, -score, window))
    w = window[order]
    start = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]])) if len(w) else np.zeros(0, np.int64)
    rank = np.arange(len(w)) - np.repeat(start, np.diff(np.concatenate([start, [len(w)]])))
    return order[rank < k]


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """Lists of numbers as rows of ``width``, filled up with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width), np.int64)
    owner = np.repeat(np.arange(len(column)), sizes)
    out[owner, np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = column.flatten().to_numpy()
    return out


def _round(rows: DataFrame, shared, k: int, same: bool) -> DataFrame:
    """Each task's k best hits of every open window in this round's range of scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, vectors, order, windows = shared.value
        windows = windows.copy()
        by_anchor = windows.groupby("anchor", sort=True)
        turn = by_anchor.cumcount().to_numpy()
        used = np.array(sorted(by_anchor.groups), np.int64)
        slot = np.full((len(used), turn.max(initial=0) + 1), -1)
        slot[np.searchsorted(used, windows["anchor"]), turn] = np.arange(len(windows))
        low, high = windows["low"].to_numpy().copy(), windows["high"].to_numpy()
        held = [np.zeros(0, np.int64)] * 3
        fresh: list[list[np.ndarray]] = []

        def settle() -> None:
            nonlocal held, fresh
            every = [np.concatenate(x) for x in zip(held, *fresh, strict=True)]
            best = _first(every[0], every[1], every[2], k)
            held, fresh = [x[best] for x in every], []
            count = np.bincount(held[0], minlength=len(low))
            last = np.full(len(low), _UNBOUNDED)
            np.minimum.at(last, held[0], held[1])
            full = count >= k
            low[full] = last[full]  # an equal score may still win by its id

        for batch in batches:
            for begin in range(0, batch.num_rows, TILE_ROWS):
                tile = batch.slice(begin, TILE_ROWS)
                vec, label = tile.column(0).to_numpy(), tile.column(1).to_numpy()
                x = _matrix(tile.column(2), vectors.shape[1])[:, order]
                for i in range(0, len(used), TILE_ANCHORS):
                    who = used[i : i + TILE_ANCHORS]
                    own = slot[i : i + TILE_ANCHORS]
                    least = np.where(own >= 0, low[own], _UNBOUNDED).min(axis=1)
                    a, y, score = pairs_above(vectors[who], x, least)
                    a_in, good = who[a], (label[y] == labels[who[a]]) == same
                    good &= vec[y] != ids[a_in]
                    a, y, score = a[good], y[good], score[good]
                    for j in range(own.shape[1]):
                        w = own[a, j]
                        fits = (w >= 0) & (score >= low[w]) & (score <= high[w])
                        fresh.append([w[fits], score[fits], vec[y[fits]]])
                settle()
        at = windows["window"].to_numpy()[held[0]]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (at, held[2], held[1])], ["window", "vec_id", "score"])

    return rows.select("vec_id", "label", "v").mapInArrow(run, _HIT)


def _filled(rows: DataFrame, block: tuple, windows: pd.DataFrame, k: int, same: bool) -> list[DataFrame]:
    """Tables of hits that together hold the k best of every window.

    ``windows`` has window, anchor, low, high and a list of falling thresholds ``steps`` that ends with ``low``.
    """
    sc = rows.sparkSession.sparkContext
    found, windows = [], windows.assign(have=0)
    while len(windows):
        step = windows["steps"].map(lambda s: s[0]).clip(lower=windows["low"]).astype(np.int64)
        ask = windows[["window", "anchor", "high"]].assign(low=step)
        shared = sc.broadcast((*block, ask[ask["low"] <= ask["high"]]))
        hits = cut(_round(rows, shared, k, same))
        found.append(hits)
        count = {r.window: r["count"] for r in hits.groupBy("window").count().collect()}
        windows = windows.assign(have=windows["have"] + windows["window"].map(count).fillna(0).astype(np.int64), high=np.minimum(windows["high"], step - 1))
        windows["steps"] = windows["steps"].map(lambda s: s[1:])
        windows = windows[(windows["have"] < k) & (windows["steps"].map(len) > 0) & (windows["low"] <= windows["high"])]
        shared.unpersist()
    return found


def _ranked(found: list[DataFrame], k: int) -> DataFrame:
    hits = found[0]
    for more in found[1:]:
        hits = hits.unionByName(more)
    place = F.row_number().over(Window.partitionBy("window").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", place).where(F.col("rank") <= k)


def mine(rows: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """Hard negatives of ``anchors`` among ``rows``, both (vec_id long, label long, v array<long>).

    Returns (anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor its best
    ``positives`` rows of the same label, and for each of these the best ``negatives`` rows of other labels whose
    score lies between ``low`` and ``high`` hundredths of the positive's. Equal scores come by ascending id. Rows of an
    anchor's own id are never its partners; repeated rows are partners of their own. Rows with a null in any of the
    columns take no part. Shorter vectors are filled up with zeros. Scores must fit a long. Without anchors, or
    where nothing fits, there are no rows.
    """
    spark = rows.sparkSession
    whole = "vec_id is not null and label is not null and v is not null and not exists(v, x -> x is null)"
    rows = cut(rows.select("vec_id", "label", "v").where(whole))
    width, mean = rows.agg(F.coalesce(F.max(F.size("v")), F.lit(0)), F.coalesce(F.avg(F.sqrt(F.expr("aggregate(v, 0d, (s, x) -> s + x * x)"))), F.lit(0.0))).first()
    out = None
    names = "window long, anchor_id long, positive_id long, positive_score long"
    for part in query_blocks(anchors.select("vec_id", "label", "v").where(whole), "vec_id", F.size("v") * 8, BLOCK_ROWS, BLOCK_BYTES):
        own = sorted(((r.vec_id, r.label, r.v) for r in part.collect()), key=lambda r: r[:2])
        ids, labels = (np.array([r[i] for r in own], np.int64) for i in (0, 1))
        vectors = np.zeros((len(own), max([width, *[len(r[2]) for r in own]])), np.int64)
        for i, r in enumerate(own):
            vectors[i, : len(r[2])] = r[2]
        order = np.argsort(-(vectors.astype(np.float64) ** 2).sum(axis=0), kind="stable")  # strong dimensions first, so that rests are small
        block = (ids, labels, vectors[:, order], order)
        norms = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1))
        steps = [[*[math.ceil(d / 100 * n * mean) for d in DEPTHS], -_UNBOUNDED] for n in norms]
        wanted = pd.DataFrame({"window": np.arange(len(own)), "anchor": np.arange(len(own)), "low": -_UNBOUNDED, "high": _UNBOUNDED, "steps": steps})
        found = _filled(rows, block, wanted, positives, True)
        chosen = sorted(tuple(r) for r in _ranked(found, positives).select("window", "rank", "vec_id", "score").collect()) if found else []
        discard(*found)
        limits = [(-(-low * s // 100), high * s // 100) for *_, s in chosen]
        wanted = pd.DataFrame(
            {
                "window": np.arange(len(chosen)),
                "anchor": np.array([c[0] for c in chosen], np.int64),
                "low": np.array([a for a, _ in limits], np.int64),
                "high": np.array([b for _, b in limits], np.int64),
                "steps": [[*[b - int((b - a) * r) for r in REACHES], a] for a, b in limits],
            }
        )
        wanted = wanted[wanted["low"] <= wanted["high"]]
        found = _filled(rows, block, wanted, negatives, False)
        if not found:
            continue
        told = spark.createDataFrame([(i, int(ids[a]), vec, s) for i, (a, _, vec, s) in enumerate(chosen)], names)
        hits = _ranked(found, negatives).join(F.broadcast(told), "window")
        mined = hits.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        out = mined if out is None else out.unionByName(mined)
    empty = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    return spark.createDataFrame([], empty) if out is None else out


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of all embeddings whose id is divisible by 100, every seventh label moved on by one."""
    raw = table(spark, sf_dir, "embeddings")
    sound = "vec_id is not null and label is not null and embedding is not null and not exists(embedding, x -> x is null or isnan(x) or abs(x) = float('inf'))"
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).cast("long")
    rows = raw.where(sound).select("vec_id", label.alias("label"), F.expr("transform(embedding, x -> floor(256 * cast(x as double)))").alias("v"))
    return mine(rows, rows.where("vec_id % 100 = 0"))


ORACLE = """
WITH sound AS (
  SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
score AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same,
    CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM sound a JOIN sound b ON a.vec_id <> b.vec_id
  WHERE a.vec_id % 100 = 0),
positive AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM score WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT p.anchor_id, positive_id,
  CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other) AS INTEGER) AS rank,
  other AS negative_id, positive_score, score AS negative_score
FROM positive p JOIN score s ON p.anchor_id = s.anchor_id AND NOT same
  AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""
