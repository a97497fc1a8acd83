"""Language identification by a byte convolutional network, trained in numpy.

Bytes are embedded, filters of widths 2 to 5 run over windows of fixed length, their maxima over a
window pass a dense layer and a softmax. A text is cut into windows that cover all of it; its
prediction is the mean of its windows' probabilities, weighted by their letters. Training takes a
bounded, documented sample of labelled rows (at most ``ROWS_PER_LANG`` a language, evenly fewer beyond
``MAX_LANGS`` languages, and ``WINDOWS_PER_ROW`` windows of each, spread over the whole text) and learns only from text and label. The weights are a
few kilobytes and travel with the task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from callweave.llm.common import cut, discard, free_name, frugal, table, text_or_empty

WINDOW = 128
WIDTHS = (2, 3, 4, 5)
FILTERS = 6
EMBED = 4
#: Bound of the training sample.
ROWS_PER_LANG, MAX_LANGS, WINDOWS_PER_ROW = 400, 64, 6
EPOCHS, BATCH, RATE = 6, 64, 0.01
UNDETERMINED = "und"

#: A letter is what Unicode gives a category of L*; numbers such as a half or a circled one are none.
_LETTER = regex.compile(r"\p{L}")
_LETTER_BYTE = np.zeros(256, np.float32)
_LETTER_BYTE[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_TALL = max(WIDTHS)


def windows_of(raw: bytes) -> np.ndarray:
    """All windows of a text, the last filled up with zeros: (n, WINDOW) bytes; consecutive windows share no byte."""
    n = max(1, -(-len(raw) // WINDOW))
    return np.frombuffer(raw.ljust(n * WINDOW, b"\0"), np.uint8).reshape(n, WINDOW)


class ByteCNN:
    """Weights, forward and backward pass."""

    def __init__(self, langs: list[str], seed: int = 1):
        rng = np.random.default_rng(seed)
        self.langs = langs
        k = FILTERS * len(WIDTHS)
        self.embed = rng.normal(0, 0.5, (256, EMBED)).astype(np.float32)
        self.mask = np.zeros((_TALL, EMBED, k), np.float32)
        for i, w in enumerate(WIDTHS):
            self.mask[:w, :, i * FILTERS : (i + 1) * FILTERS] = 1
        self.kernel = (rng.normal(0, 0.4, self.mask.shape) * self.mask).astype(np.float32)
        self.bias = np.zeros(k, np.float32)
        self.dense = rng.normal(0, 0.3, (k, len(langs))).astype(np.float32)
        self.offset = np.zeros(len(langs), np.float32)

    def _columns(self, x: np.ndarray) -> np.ndarray:
        """(windows, positions, _TALL * EMBED) inputs of the filters."""
        padded = np.zeros((len(x), WINDOW + _TALL - 1), np.uint8)
        padded[:, :WINDOW] = x
        e = np.ascontiguousarray(self.embed[padded])
        s = e.strides
        view = np.lib.stride_tricks.as_strided(e, (len(x), WINDOW, _TALL * EMBED), (s[0], s[1], s[2]))
        return np.ascontiguousarray(view).reshape(len(x) * WINDOW, -1)

    def _pooled(self, x: np.ndarray):
        columns = self._columns(x)
        out = (columns @ self.kernel.reshape(_TALL * EMBED, -1)).reshape(len(x), WINDOW, -1)
        return columns, out

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        _, out = self._pooled(x)
        hidden = np.maximum(out.max(axis=1) + self.bias, 0)
        z = hidden @ self.dense + self.offset
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        columns, out = self._pooled(x)
        at = out.argmax(axis=1)
        n, k = at.shape
        pooled = np.take_along_axis(out, at[:, None, :], axis=1)[:, 0] + self.bias
        hidden = np.maximum(pooled, 0)
        z = hidden @ self.dense + self.offset
        z = np.exp(z - z.max(axis=1, keepdims=True))
        dz = z / z.sum(axis=1, keepdims=True)
        dz[np.arange(n), y] -= 1
        dz /= n
        dh = (dz @ self.dense.T) * (pooled > 0)
        picked = columns[(np.arange(n)[:, None] * WINDOW + at).ravel()].reshape(n, k, _TALL, EMBED)
        dkernel = np.einsum("nk,nkwe->wek", dh, picked) * self.mask
        dinput = dh[:, :, None, None] * self.kernel.transpose(2, 0, 1)[None]
        padded = np.zeros((n, WINDOW + _TALL - 1), np.uint8)
        padded[:, :WINDOW] = x
        where = at[:, :, None] + np.arange(_TALL)
        symbols = padded[np.arange(n)[:, None, None], where]
        dembed = np.zeros_like(self.embed)
        np.add.at(dembed, symbols.ravel(), dinput.reshape(-1, EMBED))
        return {"embed": dembed, "kernel": dkernel, "bias": dh.sum(0), "dense": hidden.T @ dz, "offset": dz.sum(0)}

    def fit(self, x: np.ndarray, y: np.ndarray, seed: int = 2) -> ByteCNN:
        """Adam on the cross entropy; every language has the same weight in an epoch's draws."""
        rng = np.random.default_rng(seed)
        share = 1 / np.bincount(y, minlength=len(self.langs))[y]
        share /= share.sum()
        moments: dict[str, list] = {}
        step = 0
        for epoch in range(EPOCHS):
            order = rng.choice(len(x), len(x), p=share)
            for i in range(0, len(order), BATCH):
                step += 1
                for name, g in self.gradients(x[order[i : i + BATCH]], y[order[i : i + BATCH]]).items():
                    m, v = moments.setdefault(name, [np.zeros_like(g), np.zeros_like(g)])
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    rate = RATE * (1 - epoch / EPOCHS) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                    setattr(self, name, (getattr(self, name) - rate * m / (np.sqrt(v) + 1e-8)).astype(np.float32))
        return self

    def predict(self, texts: list[str | None], group: int = 512) -> tuple[list[str], list[float]]:
        """Language and probability of whole texts; ``und`` and 0 for null and texts without a letter."""
        langs, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
        live = [i for i, t in enumerate(texts) if isinstance(t, str) and _LETTER.search(t)]
        if not self.langs:
            return langs, scores
        sums = np.zeros((len(live), len(self.langs)))
        weight = np.zeros(len(live))
        pending: list[np.ndarray] = []
        owner: list[np.ndarray] = []

        def flush() -> None:
            if pending:
                x, who = np.concatenate(pending), np.concatenate(owner)
                for a in range(0, len(x), group):
                    part = x[a : a + group]
                    w = _LETTER_BYTE[part].sum(axis=1) + 1e-6
                    np.add.at(sums, who[a : a + group], self.probabilities(part) * w[:, None])
                    np.add.at(weight, who[a : a + group], w)
                pending.clear()
                owner.clear()

        held = 0
        for k, i in enumerate(live):
            x = windows_of(texts[i].encode())
            pending.append(x)
            owner.append(np.full(len(x), k))
            held += len(x)
            if held >= 4 * group:
                flush()
                held = 0
        flush()
        p = sums / np.maximum(weight, 1e-9)[:, None]
        for k, i in enumerate(live):
            best = int(p[k].argmax())
            langs[i], scores[i] = self.langs[best], float(min(1.0, p[k, best]))
        return langs, scores


def held_out(doc_id: str = "doc_id"):
    """Documents that are never learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame) -> ByteCNN:
    """Learn from a bounded sample of ``docs(doc_id, text, lang)``, chosen by a hash of doc_id and text.

    Distinct texts are thinned by the hash to about twice what a language needs before they are ranked, so that
    no task sees more than that of a language. The least hash of a language always stays, so that none is left
    out. Repeated rows and rows of equal hash count once. Only text and label are learnt from. Without labelled rows the network knows no
    language and predicts ``und``.
    """
    rows = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    rows = rows.withColumn("h", F.xxhash64("text"))
    order = F.xxhash64("h", F.lit(7))
    distinct = cut(rows.select("lang", "h").distinct())
    counts = cut(distinct.groupBy("lang").agg(F.count(F.lit(1)).alias("texts"), F.min(order).alias("least")))
    share = F.pmod(order, F.lit(1 << 30)) / F.lit(float(1 << 30))
    known = F.broadcast(counts) if counts.count() <= MAX_LANGS else counts
    thin = distinct.join(known, "lang").where((share * F.col("texts") < 2 * ROWS_PER_LANG) | (order == F.col("least"))).select("lang", "h")
    ranked = thin.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy(order, "h"))).where(F.col("n") <= ROWS_PER_LANG)
    bound = ROWS_PER_LANG * MAX_LANGS
    keys = ranked.orderBy("n", "lang").limit(bound).collect()  # the first of every language, then the second ones
    if not keys:
        return ByteCNN([])
    if len(keys) == bound and keys[-1].n == 1:  # more languages than rows: one row of each
        keys = ranked.where("n = 1").collect()
    discard(distinct, counts)

    @F.pandas_udf("array<binary>")
    def spread(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            x = windows_of(t.encode())
            out.append([x[i].tobytes() for i in sorted({int(k) for k in np.linspace(0, len(x) - 1, WINDOWS_PER_ROW)})])
        return pd.Series(out)

    chosen = docs.sparkSession.createDataFrame([(r.lang, r.h) for r in keys], rows.select("lang", "h").schema)
    once = rows.join(F.broadcast(chosen), ["lang", "h"]).groupBy("h", "lang").agg(F.min("text").alias("text"))
    sample = once.select("h", "lang", spread("text").alias("windows")).collect()
    sample = sorted((r.h, r.lang, w) for r in sample for w in map(bytes, r.windows))
    langs = sorted({lang for _, lang, _ in sample})
    x = np.stack([np.frombuffer(w, np.uint8) for _, _, w in sample])
    y = np.array([langs.index(lang) for _, lang, _ in sample])
    return ByteCNN(langs).fit(x, y)


def predict(docs: DataFrame, model: ByteCNN, text: str = "text") -> DataFrame:
    """``docs`` with a struct column ``language``: lang_pred and score.

    Null and empty texts and texts without a letter get ``und`` and 0; so does every text where no
    language was learnt. Of equally likely languages the first by name is taken. Texts are taken whole,
    in windows, so that a very long text takes no more memory than a few of them.
    """

    @F.pandas_udf("lang_pred string, score double")
    @frugal
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            langs, scores = model.predict(texts.tolist())
            yield pd.DataFrame({"lang_pred": langs, "score": scores})

    return docs.withColumn(free_name(docs, "language"), run(text_or_empty(text)))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document; ``und`` for null texts and texts without a letter."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = predict(docs.select("doc_id", "text"), train(docs))
    return found.select("doc_id", held_out().alias("held_out"), "language.lang_pred", "language.score")
