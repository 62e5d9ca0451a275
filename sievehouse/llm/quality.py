"""Text quality by a generalised additive model with pairwise interactions.

Shallow trees are boosted in cycles, one feature at a time, and summed up into
a lookup table for each feature, then for the strongest pairs of features. A
score adds one table entry for each term.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written

FEATURES = (
    "log_chars", "log_words", "mean_word", "longest_word", "upper", "digit", "space", "newline", "end_marks", "commas",
    "bars", "bangs", "symbols", "other_marks", "distinct_words", "repeated_word", "commonest_word", "short_words", "capital_words", "distinct_lines",
)
#: Classes of characters: 0 letter, 1 upper case, 2 digit, 3 space, 4 newline, then marks.
_MARKS = {".?": 5, ",;:": 6, "|": 7, "!": 8, "#$%&*@^~_=+<>\\/{}[]": 9}


def _classes() -> np.ndarray:
    out = np.full(0x10000, 10, np.uint8)
    for code in range(0x10000):
        c = chr(code)
        if c.isalpha():
            out[code] = 1 if c.isupper() else 0
        elif c.isdigit():
            out[code] = 2
        elif c.isspace():
            out[code] = 3
    out[ord("\n")] = 4
    for marks, i in _MARKS.items():
        for c in marks:
            out[ord(c)] = i
    return out


_CLASS = _classes()


def features(text: str | None) -> list[float]:
    """The features of a whole text (null: empty)."""
    text = text or ""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    share = np.bincount(_CLASS[np.minimum(codes, 0xFFFF)], minlength=11) / max(1, len(codes))
    words = text.split()
    n = max(1, len(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    distinct = set(words)
    index = {w: i for i, w in enumerate(distinct)}
    ids = np.fromiter(map(index.__getitem__, words), np.int64, len(words))
    lines = text.split("\n")
    return [
        np.log1p(len(codes)), np.log1p(len(words)), sizes.sum() / n, np.log1p(sizes.max(initial=0)),
        share[1], share[2], share[3], share[4], share[5], share[6], share[7], share[8], share[9], share[10],
        len(distinct) / n, (ids[1:] == ids[:-1]).sum() / n, np.bincount(ids, minlength=1).max() / n,
        (sizes <= 3).sum() / n, sum(map(str.istitle, words)) / n, len(set(lines)) / len(lines),
    ]


@dataclass
class AdditiveModel:
    edges: list[np.ndarray]  # inner edges of each feature's bins
    base: float
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        z = np.full(len(x), self.base)
        for j, t in enumerate(self.tables):
            z += t[b[:, j]]
        for (i, j), t in zip(self.pairs, self.pair_tables, strict=True):
            z += t[b[:, i], b[:, j]]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, rate: float, ridge: float) -> np.ndarray:
    """A table over bins: a tree of so many leaves, grown by the best split each time."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        best = (1e-9, None, None)
        for k, (a, b) in enumerate(parts):
            if b - a < 2:
                continue
            gl, hl = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1]
            gs, hs = g[a:b].sum(), h[a:b].sum()
            gain = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
            at = int(gain.argmax())
            if gain[at] > best[0]:
                best = (gain[at], k, a + at + 1)
        if best[1] is None:
            break
        a, b = parts[best[1]]
        parts[best[1] : best[1] + 1] = [(a, best[2]), (best[2], b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = rate * g[a:b].sum() / (h[a:b].sum() + ridge)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray, rate: float, ridge: float) -> tuple[np.ndarray, float]:
    """(table, gain): one split in the first feature, then one in the second on either side."""

    def worth(gs: np.ndarray, hs: np.ndarray) -> np.ndarray:
        return gs**2 / (hs + ridge)

    best = (-1.0, None)
    g_rows, h_rows = np.cumsum(g, axis=0), np.cumsum(h, axis=0)
    for cut in range(1, len(g)):
        sides, gain = [], 0.0
        for gs, hs, rows in ((g_rows[cut - 1], h_rows[cut - 1], slice(0, cut)), (g_rows[-1] - g_rows[cut - 1], h_rows[-1] - h_rows[cut - 1], slice(cut, None))):
            gc, hc = np.cumsum(gs), np.cumsum(hs)
            each = worth(gc[:-1], hc[:-1]) + worth(gc[-1] - gc[:-1], hc[-1] - hc[:-1])
            at = int(each.argmax()) if len(each) else 0
            gain += each[at] if len(each) else worth(gc[-1], hc[-1])
            sides.append((rows, at + 1))
        if gain > best[0]:
            best = (gain, sides)
    out = np.zeros(g.shape)
    for rows, at in best[1] or []:
        for cols in (slice(0, at), slice(at, None)):
            out[rows, cols] = rate * g[rows, cols].sum() / (h[rows, cols].sum() + ridge)
    return out, float(best[0] - worth(g.sum(), h.sum()))


def fit_additive_model(x: np.ndarray, y: np.ndarray, cycles: int = 120, pair_cycles: int = 40, pairs: int = 5, bins: int = 48, leaves: int = 3, rate: float = 0.15, ridge: float = 1.0) -> AdditiveModel:
    """Cyclic gradient boosting, single features first and then pairs on what is left."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = AdditiveModel(edges, float(np.log(share / (1 - share))), [np.zeros(len(e) + 1) for e in edges], [], [])
    b = model.bins(x)
    z = np.full(len(x), model.base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        return y - p, p * (1 - p)

    for _ in range(cycles):
        for j, t in enumerate(model.tables):
            g, h = slopes()
            step = _tree(np.bincount(b[:, j], g, len(t)), np.bincount(b[:, j], h, len(t)), leaves, rate, ridge)
            t += step
            z += step[b[:, j]]

    def grid(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        g, h = slopes()
        shape = len(model.tables[i]), len(model.tables[j])
        at = b[:, i] * shape[1] + b[:, j]
        return np.bincount(at, g, shape[0] * shape[1]).reshape(shape), np.bincount(at, h, shape[0] * shape[1]).reshape(shape)

    wide = [j for j in range(x.shape[1]) if len(edges[j]) > 0]
    ranked = sorted(((_pair_tree(*grid(i, j), rate, ridge)[1], i, j) for i, j in combinations(wide, 2)), reverse=True)
    for _, i, j in ranked[:pairs]:
        model.pairs.append((i, j))
        model.pair_tables.append(np.zeros((len(model.tables[i]), len(model.tables[j]))))
    for _ in range(pair_cycles):
        for (i, j), t in zip(model.pairs, model.pair_tables, strict=True):
            step = _pair_tree(*grid(i, j), rate, ridge)[0]
            t += step
            z += step[b[:, i], b[:, j]]
    return model


def train_quality_model(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", most: int = 20_000) -> AdditiveModel | None:
    """Fits on a bounded sample, at most `most` labelled rows by the order of a
    hash of key and label; None without a labelled text. Null keys and labels
    are left out, repeated label rows count once. Of documents with one key
    that with the least features stands for all, so the driver gets `most`
    rows at most. The sample's keys are broadcast, their number being bounded."""
    rows = labels.select(F.col(key).alias("key"), F.col(label).cast("double").alias("y")).where("key is not null and y is not null").distinct()
    rows = written(rows.orderBy(F.xxhash64("key", "y"), "key", "y").limit(most), "quality-sample")
    chosen = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(rows), "key").select("key", "y", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(v.as_py()) for v in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.float64()))], ["key", "y", "x"])

    found = chosen.mapInArrow(run, T.StructType([chosen.schema["key"], T.StructField("y", T.DoubleType()), T.StructField("x", T.ArrayType(T.DoubleType()))]))
    got = found.groupBy("key", "y").agg(F.min("x").alias("x")).toPandas()
    if got.empty:
        return None
    got = got.sort_values(["key", "y"], kind="stable")
    return fit_additive_model(np.array(got["x"].tolist()), (got["y"].to_numpy() > 0.5).astype(float))


def score_quality(docs: DataFrame, model: AdditiveModel | None, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """docs with score (0 to 1, higher: label 1 is likelier) and predicted (1 if
    the score reaches threshold). Null texts are scored as empty ones, and equal
    texts alike, each row for itself; a score is that of the whole text, however
    long. Without a model every score is 0.5, and so is a tie of both labels.
    Existing columns of these names are replaced."""
    docs = docs.drop("score", "predicted")
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            x = np.array([features(v.as_py()) for v in batch.column(at)]).reshape(-1, len(FEATURES))
            score = np.full(len(x), 0.5) if model is None else model.score(x)
            columns = [*batch.columns, pa.array(score), pa.array((score >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "score", "predicted"])

    return docs.mapInArrow(run, schema)
