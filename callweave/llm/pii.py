"""Personal data: rule spans, and more spans chosen by gradient-boosted trees.

Rules with checks (Luhn, octets, digit counts) give the base spans, which always stay. High-recall
generators then propose overlapping candidates: digit groups of any punctuation, addresses with a
spelt or spaced ``at``, account-like codes. Boosted trees score them by format and context; Platt
scaling and a threshold for a wanted precision, both fitted on a held-out fold, select the spans to
add, best first, none overlapping another or a base span.

The trees learn from a bounded sample of documents (``SAMPLE_DOCS``): positive are base spans and
degraded copies of them in their own context (no plus sign, other separators, spelt ``at``, dots in
brackets), negative are candidates that touch no base span and everyday numbers (dates, times, counts,
versions, article numbers), put between words of the same text. Positives of a degraded form carry no
trace of the rule that found them, so that the trees rank format and context and not the rule.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.llm.common import free_name, frugal, table, text_or_empty

KINDS = ("email", "ip", "card", "phone")
#: Bounds of the training sample: documents, and candidates taken of each.
SAMPLE_DOCS, SAMPLE_CANDIDATES = 4000, 48
#: Degraded and everyday forms made of one base span.
FORMS = 6
#: Least precision, on the held-out fold, that the threshold must reach.
PRECISION = 0.98
ROUNDS, DEPTH, SHRINK, BINS = 40, 3, 0.3, 16

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")

_NUMBER = re.compile(r"(?<![A-Za-z0-9])\(?[0-9](?:[\x20().\-/\[\]]{0,3}[0-9]){6,}(?![A-Za-z0-9])")
_SPELT_DOMAIN = re.compile(r" ?[A-Za-z0-9-]{1,63}(?:(?:\.| \. | ?\(dot\) ?| ?\[dot\] ?| dot )[A-Za-z0-9-]{2,63})+")  # a dot and a space end a sentence
_ACCOUNT = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_CUES = re.compile(r"(?i)(phone|tel|call|fax|mobile|mail|contact|card|visa|iban|account|ssn|passport|\bip\b|address)")
_AT = re.compile(r"@|\(at\)|\[at\]| at ")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the rules, kinds in the listed order, each by start."""
    out = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append(("email", start, found.end()))
            done = found.end()
        at = text.find("@", max(at + 1, done))
    if not _DIGITS.search(text):
        return out
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if 16 <= m.end() - m.start() <= 40:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return out


def _addresses(text: str) -> list[tuple[int, int]]:
    """The address around every ``at`` mark; one that runs into the next address ends before it, if it can."""
    found = []
    for m in _AT.finditer(text):
        domain = _SPELT_DOMAIN.match(text, m.end())
        if not domain:
            continue
        start = stop = m.start() - text.endswith(" ", 0, m.start())
        while start > max(0, stop - 64) and text[start - 1] in _LOCAL:
            start -= 1
        if start < stop:
            found.append((start, m.end(), domain.end()))
    out = []
    for k, (start, at, end) in enumerate(found):
        following = found[k + 1][0] if k + 1 < len(found) else end
        short = _SPELT_DOMAIN.match(text, at, following) if at < following < end else None
        out.append((start, short.end() if short else end))
    return out


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Overlapping proposals of the generators; text without digits and ``at`` has none."""
    out = []
    if _DIGITS.search(text):
        out += [("number", *m.span()) for m in _NUMBER.finditer(text)]
        out += [("account", *m.span()) for m in _ACCOUNT.finditer(text)]
    out += [("mail", s, e) for s, e in _addresses(text)]
    return sorted(set(out), key=lambda c: (c[1], c[2], c[0]))


def features(text: str, start: int, end: int) -> list[float]:
    """Format and context of one span."""
    span = text[start:end]
    digits = "".join(c for c in span if c in "0123456789")
    groups = [len(g) for g in re.findall(r"[0-9]+", span)]
    before, after = text[max(0, start - 40) : start], text[end : end + 20]
    return [
        len(span),
        len(digits),
        len(groups),
        max(groups, default=0),
        min(groups, default=0),
        span.count(" "),
        span.count("-"),
        span.count("."),
        span.count("("),
        span.count("/"),
        sum(c.isalpha() for c in span) / len(span),
        float(span[:1] == "("),
        float(bool(digits) and luhn(digits)),
        float(len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in re.findall(r"[0-9]+", span))),
        float(bool(_AT.search(span))),
        float(len(groups) > 1 and len(set(groups[:-1])) == 1),
        float(bool(_CUES.search(before))),
        float(before[-1:].isalnum()),
        float(after[:1].isalnum()),
        sum(c in "0123456789" for c in before) / (len(before) + 1),
        sum(c in "0123456789" for c in after) / (len(after) + 1),
        len(re.findall(r"[.] ", span)),
        len(re.split(r"[^A-Za-z]", span)[-1]),
        len(re.match(r"[^ (\[@]*", span)[0]),
        sum(c.isupper() for c in span),
        span.count("["),
        span.count(" dot ") + span.count("(dot)"),
        len(groups[-1:]) and groups[-1],
        len(groups[:1]) and groups[0],
        float(len(digits) in (8, 14) and 19 <= int((re.findall("[0-9]{4}", span) or ["0"])[0][:2]) <= 20),
    ]


def everyday(text: str, start: int, end: int, turn: int) -> tuple[str, int, int]:
    """A number that is nobody's, between two words of the text, away from the given span; what it is follows from span and turn."""
    seed = zlib.crc32(f"{text[start:end]}{start}-{turn}".encode())
    digit = lambda k, n: str((seed >> k) % 10**n).rjust(n, "0")
    year, month, day = 1970 + seed % 70, 1 + (seed >> 3) % 12, 1 + (seed >> 5) % 28
    clock = f"{(seed >> 7) % 24:02d}:{(seed >> 9) % 60:02d}:{(seed >> 11) % 60:02d}"
    span = (
        f"{year}-{month:02d}-{day:02d}",
        f"{day:02d}.{month:02d}.{year}",
        f"{month}/{day}/{year}-{month}/{day + 1}/{year}",
        f"{year}-{month:02d}-{day:02d} {clock[:2]}",
        f"{digit(3, 3)} {digit(5, 3)} {digit(7, 3)}",
        f"{digit(2, 7)}",
        f"{digit(1, 1)}.{digit(4, 2)}.{digit(6, 3)}.{digit(8, 4)}",
        f"{digit(2, 4)}-{digit(9, 6)}",
        f"{digit(1, 10)}{digit(6, 4)}",
        f"{digit(3, 6)} / {digit(5, 6)}",
    )[seed % 10]
    gap = text.find(" ", (start + len(text) // 2 + seed % 97) % max(1, len(text)))
    before, after = (text[max(0, gap - 59) : gap + 1], text[gap : gap + 30]) if gap >= 0 else ("", " ")
    return before + span + after, len(before), len(before) + len(span)


def degraded(text: str, kind: str, start: int, end: int, turn: int) -> tuple[str, int, int]:
    """A base span in a form that its rule would miss, in its own context; ``turn`` chooses the form."""
    span = text[start:end]
    turn += zlib.crc32(span.encode()) % 97
    if kind == "phone":
        digits = "".join(c for c in span if c in "0123456789")
        a, b, c = digits[-10:-7], digits[-7:-4], digits[-4:]
        plain = span[1:]
        forms = (plain, plain.replace(" ", "-"), plain.partition(" ")[2] or plain, f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}")
        span = forms[turn % len(forms)] if a else plain
    elif kind == "email":
        local, _, domain = span.partition("@")
        if turn % 2:
            local = re.match("[A-Za-z]*", local)[0] or local  # a name without numbers
        if turn // 2 % 2 and domain.count(".") > 1:
            domain = domain.partition(".")[2]
        span = local + (" at ", "(at)", " [at] ")[turn % 3] + domain
        span = span.replace(".", (".", " dot ", "(dot)")[turn // 3 % 3])
    elif kind == "card":
        digits = "".join(c for c in span if c in "0123456789")
        span = (".", "/", "  ")[turn % 3].join(digits[i : i + 4] for i in range(0, len(digits), 4))
    else:
        span = span.replace(".", ("[.]", " . ")[turn % 2])
    around = text[max(0, start - 60) : start] + span + text[end : end + 30]
    return around, min(60, start), min(60, start) + len(span)


class Trees:
    """Boosted trees on binned features, with calibration."""

    def __init__(self):
        self.edges: list[np.ndarray] = []
        self.trees: list[list[tuple[int, int, float]]] = []
        self.scale, self.shift, self.threshold = 1.0, 0.0, 2.0

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(self.edges)], axis=1)

    def _raw(self, x: np.ndarray) -> np.ndarray:
        b, out = self._binned(x), np.zeros(len(x))
        for tree in self.trees:
            node = np.zeros(len(x), np.int64)
            feature = np.array([t[0] for t in tree])
            cut = np.array([t[1] for t in tree])
            value = np.array([t[2] for t in tree])
            for _ in range(DEPTH):
                inner = feature[node] >= 0
                right = b[np.arange(len(x)), np.maximum(feature[node], 0)] > cut[node]
                node = np.where(inner, 2 * node + 1 + right, node)
            out += value[node]
        return out

    def _grow(self, b: np.ndarray, g: np.ndarray, h: np.ndarray) -> list[tuple[int, int, float]]:
        tree = [(-1, 0, 0.0)] * (2 ** (DEPTH + 1) - 1)
        rows = {0: np.arange(len(b))}
        for node in range(len(tree)):
            own = rows.pop(node, None)
            if own is None:
                continue
            gs, hs = g[own].sum(), h[own].sum()
            best = (1e-3, -1, 0)
            if node < 2**DEPTH - 1 and len(own) >= 8:
                for k in range(b.shape[1]):
                    gk = np.cumsum(np.bincount(b[own, k], g[own], BINS + 1))
                    hk = np.cumsum(np.bincount(b[own, k], h[own], BINS + 1))
                    gain = gk**2 / (hk + 1) + (gs - gk) ** 2 / (hs - hk + 1) - gs**2 / (hs + 1)
                    c = int(gain[:-1].argmax())
                    if gain[c] > best[0]:
                        best = (float(gain[c]), k, c)
            tree[node] = (best[1], best[2], SHRINK * gs / (hs + 1))
            if best[1] >= 0:
                side = b[own, best[1]] > best[2]
                rows[2 * node + 1], rows[2 * node + 2] = own[~side], own[side]
        return tree

    def fit(self, x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> Trees:
        """Grow on rows of fold 0, calibrate and set the threshold on the others."""
        grow = fold == 0
        if len(set(y[grow])) < 2 or len(set(y[~grow])) < 2:
            return self
        self.edges = [np.unique(np.quantile(x[grow, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])]
        b, z = self._binned(x[grow]), np.zeros(int(grow.sum()))
        for _ in range(ROUNDS):
            p = 1 / (1 + np.exp(-z))
            self.trees.append(self._grow(b, y[grow] - p, np.maximum(p * (1 - p), 1e-6)))
            last, self.trees = self.trees, self.trees[-1:]
            z += self._raw(x[grow])
            self.trees = last
        raw, truth = self._raw(x[~grow]), y[~grow].astype(float)
        for _ in range(200):  # Platt scaling by gradient steps
            p = 1 / (1 + np.exp(-(self.scale * raw + self.shift)))
            self.scale -= 0.05 * float(((p - truth) * raw).mean())
            self.shift -= 0.5 * float((p - truth).mean())
        p = self.score(x[~grow])
        order = np.argsort(-p, kind="stable")
        good = np.cumsum(truth[order]) / np.arange(1, len(order) + 1) >= PRECISION
        if good.any():
            self.threshold = max(0.5, float(p[order][np.flatnonzero(good)[-1]]))
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probabilities; zeros before training."""
        if not self.trees:
            return np.zeros(len(x))
        return 1 / (1 + np.exp(-(self.scale * self._raw(x) + self.shift)))


def _training_rows(text: str) -> list[tuple[list[float], int]]:
    """Labelled rows of one text; of more than ``SAMPLE_CANDIDATES`` those at even distances, of every origin alike."""
    base = base_spans(text)
    held = sorted((s, e) for _, s, e in base)
    reach = np.maximum.accumulate([e for _, e in held]).tolist() if held else []
    origins = [[(text, s, e, 1) for _, s, e in base], [(*degraded(text, *b, turn), 1) for b in base for turn in range(FORMS)], [(*everyday(text, s, e, turn), 0) for _, s, e in base for turn in range(FORMS)], []]
    for _, s, e in candidates(text):
        k = bisect_left(held, (e,))
        if not k or reach[k - 1] <= s:
            origins[3].append((text, s, e, 0))
    share = SAMPLE_CANDIDATES // 4
    picked = [r for rows in origins for r in (rows if len(rows) <= share else [rows[k * len(rows) // share] for k in range(share)])]
    return [(features(t, s, e), y) for t, s, e, y in picked]


def train(docs: DataFrame) -> Trees:
    """Fit on at most ``SAMPLE_DOCS`` texts that hold a digit or ``@``, chosen by a hash of the text; repeated texts count once.

    Without such texts, or without both labels in both folds, the trees are empty and add nothing.
    """
    spark = docs.sparkSession
    texts = docs.where(F.col("text").rlike("[0-9@]")).select(F.xxhash64("text").alias("h"), "text")
    ids = texts.select("h").distinct().orderBy(F.xxhash64("h", F.lit(7)), "h").limit(SAMPLE_DOCS).collect()
    if not ids:
        return Trees()
    chosen = spark.createDataFrame(ids, "h long")

    @F.pandas_udf("array<struct<x:array<double>,y:int>>")
    def rows(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"x": x, "y": y} for x, y in _training_rows(t)] for t in texts])

    once = texts.join(F.broadcast(chosen), "h").groupBy("h").agg(F.min("text").alias("text"))
    found = once.select("h", rows("text").alias("rows")).select("h", F.inline("rows")).collect()
    found = sorted((r.h, tuple(r.x), r.y) for r in found)
    if not found:
        return Trees()
    fold = np.array([h % 3 == 0 for h, _, _ in found]).astype(int)
    return Trees().fit(np.array([x for _, x, _ in found]), np.array([y for _, _, y in found]), fold)


def added_spans(text: str, base: list[tuple[str, int, int]], trees: Trees) -> list[tuple[str, int, int]]:
    """Candidates whose calibrated score passes the threshold, best first, none overlapping another span.

    Of equal scores the first by place wins, then the shorter one.
    """
    free = candidates(text)
    if base:
        held = sorted((s, e) for _, s, e in base)
        reach = np.maximum.accumulate([e for _, e in held]).tolist()
        free = [c for c in free if not (k := bisect_left(held, (c[2],))) or reach[k - 1] <= c[1]]
    if not free:
        return []
    scores = trees.score(np.array([features(text, s, e) for _, s, e in free]))
    out: list[tuple[str, int, int]] = []
    taken: list[tuple[int, int]] = []
    for k in np.argsort(-scores, kind="stable"):
        kind, s, e = free[k]
        if scores[k] < trees.threshold:
            break
        at = bisect_left(taken, (s, e))
        if (not at or taken[at - 1][1] <= s) and (at == len(taken) or e <= taken[at][0]):
            taken.insert(at, (s, e))
            out.append((f"x_{kind}", s, e))
    return sorted(out)


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def find_pii(docs: DataFrame, trees: Trees, text: str = "text") -> DataFrame:
    """``docs`` with a struct column ``pii``: base and added spans as arrays of (kind, start, end).

    Positions are code points, ends exclusive. Null and empty texts have no spans. With an untrained
    model nothing is added.
    """
    span = "array<struct<kind:string,start:int,end:int>>"

    @F.pandas_udf(f"base {span}, added {span}")
    @frugal
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for t in texts:
                base = base_spans(t)
                both = (base, added_spans(t, base, trees))
                rows.append(tuple([{"kind": k, "start": s, "end": e} for k, s, e in spans] for spans in both))
            yield pd.DataFrame(rows, columns=["base", "added"])

    return docs.withColumn(free_name(docs, "pii"), run(text_or_empty(text)))


def redact(found: DataFrame, text: str = "text", mask: str = "[PII]") -> DataFrame:
    """Replace all spans of ``find_pii`` in the text; overlapping spans become one mask."""

    @F.pandas_udf("string")
    def run(texts: pd.Series, base: pd.Series, added: pd.Series) -> pd.Series:
        out = []
        for t, a, b in zip(texts, base, added, strict=True):
            spans = sorted((s["start"], s["end"]) for s in [*a, *b])
            parts, at = [], 0
            for s, e in spans:
                if s >= at:
                    parts += [t[at:s], mask]
                at = max(at, e)
            out.append("".join([*parts, t[at:]]))
        return pd.Series(out)

    return found.withColumn(text, run(text_or_empty(text), "pii.base", "pii.added")).drop("pii")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base spans and those that the trees add, of every document; null and empty texts have none."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_pii(docs, train(docs))
    line = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    count = lambda kind: F.size(F.filter("pii.base", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *[count(k) for k in KINDS],
        F.sha2(line("pii.base"), 256).alias("base_sha256"),
        line(F.concat("pii.base", "pii.added")).alias("spans"),
    )
