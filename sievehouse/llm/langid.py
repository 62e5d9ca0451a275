"""Language identification by sparse multinomial logistic regression.

Features are TF-IDF weights of hashed character 1- to 3-grams. The weights are
fitted by follow-the-regularised-leader with elastic-net penalties, and the
scores calibrated with one temperature.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BITS = 15
BUCKETS = 1 << BITS
_LETTERS = np.array([chr(c).isalpha() for c in range(0x10000)])
_ODD = np.uint32(0x9E3779B1)


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, counts) of the whole text's character 1- to 3-grams. Letters
    count in lower case, a run of anything else as one space."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where((codes > 0xFFFF) | _LETTERS[np.minimum(codes, 0xFFFF)], codes, np.uint32(32))
    codes = codes[np.concatenate([[True], (codes[1:] != 32) | (codes[:-1] != 32)])]
    one = codes * _ODD
    two = (one[:-1] ^ (one[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA77) + codes[1:]
    three = (two[:-1] ^ (two[:-1] >> np.uint32(13))) * np.uint32(0xC2B2AE3D) + codes[2:]
    grams = np.concatenate([one, two * _ODD, three * _ODD]) >> np.uint32(32 - BITS)
    counts = np.bincount(grams, minlength=BUCKETS)
    found = np.flatnonzero(counts)
    return found, counts[found]


@dataclass
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # buckets x languages
    bias: np.ndarray
    temperature: float = 1.0

    def features(self, found: np.ndarray, counts: np.ndarray) -> np.ndarray:
        x = (1 + np.log(counts)) * self.idf[found]
        norm = np.sqrt(x @ x)
        return x / norm if norm else x

    def logits(self, found: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self.features(found, counts) @ self.weights[found] + self.bias

    def predict(self, text: str) -> tuple[str, float]:
        z = self.logits(*ngram_counts(text)) / self.temperature
        p = np.exp(z - z.max())
        best = int(p.argmax())
        return self.languages[best], float(p[best] / p.sum())


def _fit(examples: list[tuple], languages: list[str], idf: np.ndarray, epochs: int, alpha: float, beta: float, l1: float, l2: float) -> LanguageModel:
    """FTRL-proximal over the sample, every fifth example kept for the temperature."""
    k = len(languages)
    model = LanguageModel(languages, idf, np.zeros((BUCKETS, k)), np.zeros(k))
    z, n, zb, nb = np.zeros((BUCKETS, k)), np.zeros((BUCKETS, k)), np.zeros(k), np.zeros(k)

    def weight(z: np.ndarray, n: np.ndarray, l1: float) -> np.ndarray:
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2))

    train = [(model.features(f, c), f, y) for i, (f, c, y) in enumerate(examples) if i % 5]
    for _ in range(epochs):
        for x, found, y in train:
            w, b = weight(z[found], n[found], l1), weight(zb, nb, 0.0)
            s = x @ w + b
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1
            g = x[:, None] * p
            grown = n[found] + g * g
            z[found] += g - (np.sqrt(grown) - np.sqrt(n[found])) / alpha * w
            n[found] = grown
            zb += p - (np.sqrt(nb + p * p) - np.sqrt(nb)) / alpha * b
            nb += p * p
    model.weights, model.bias = weight(z, n, l1), weight(zb, nb, 0.0)
    kept = [(model.logits(f, c), y) for i, (f, c, y) in enumerate(examples) if i % 5 == 0]
    if kept:
        s, y = np.array([a for a, _ in kept]), np.array([b for _, b in kept])

        def loss(log_t: float) -> float:
            u = s / np.exp(log_t)
            u = u - u.max(axis=1, keepdims=True)
            nll = (np.log(np.exp(u).sum(axis=1)) - u[np.arange(len(y)), y]).mean()
            return float(nll + 0.5 * log_t**2 / len(y))  # a wide prior about 1, for samples without an error

        low, high, ratio = np.log(0.02), np.log(20.0), (np.sqrt(5) - 1) / 2
        for _ in range(40):
            a, b = high - ratio * (high - low), low + ratio * (high - low)
            low, high = (low, b) if loss(a) < loss(b) else (a, high)
        model.temperature = float(np.exp((low + high) / 2))
    return model


def train_language_model(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_language: int = 800, most_languages: int = 256, epochs: int = 2, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01) -> LanguageModel | None:
    """Fits a model; None if no row has a language and a letter.

    Document frequencies cover all labelled rows. The weights are fitted on a
    bounded sample: about per_language rows of each language, chosen by a hash
    of key and text. The model has a column of weights for each language, so
    only the most_languages most frequent ones are learned, ties by name; texts
    in others are predicted as one of these. Rows with a null or empty language or without a letter
    are left out; repeated rows are repeated examples.
    """
    rows = labelled.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang")).where("lang is not null and lang != '' and text rlike '\\\\p{L}'")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for value in batch.column(0):
                total[ngram_counts(value.as_py())[0]] += 1
                n += 1
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *found.tolist()], pa.int32()), pa.array([n, *total[found].tolist()], pa.int64())], ["bucket", "n"])

    df = rows.select("text").mapInArrow(frequencies, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    seen = {r.bucket: r.n for r in df}
    if not seen.get(-1):
        return None
    idf = np.array([np.log((1 + seen[-1]) / (1 + seen.get(b, 0))) + 1 for b in range(BUCKETS)])

    sizes = {r.lang: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_languages).collect()}
    draw = F.pmod(F.xxhash64("key", F.length("text"), F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
    size = F.create_map(*[F.lit(x) for pair in sizes.items() for x in pair])
    chosen = rows.where(draw * F.try_element_at(size, F.col("lang")) < per_language)

    def featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [ngram_counts(v.as_py()) for v in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([f.astype(np.int32) for f, _ in pairs], pa.list_(pa.int32())), pa.array([c.astype(np.int32) for _, c in pairs], pa.list_(pa.int32()))],
                ["lang", "draw", "found", "counts"],
            )

    sample = chosen.select("lang", draw.alias("draw"), "text").mapInArrow(featurize, "lang string, draw double, found array<int>, counts array<int>")
    got = sorted(((r.draw, r.lang, np.array(r.found), np.array(r.counts)) for r in sample.toLocalIterator()), key=lambda r: (r[0], r[1]))
    languages = sorted({r[1] for r in got})
    if not languages:
        return None
    at = {x: i for i, x in enumerate(languages)}
    return _fit([(f, c, at[x]) for _, x, f, c in got], languages, idf, epochs, alpha, beta, l1, l2)


def identify_language(docs: DataFrame, model: LanguageModel | None, text: str = "text") -> DataFrame:
    """docs with lang_pred and score (the calibrated probability).

    A text that is null or has no letter, and any text without a model, is
    und with score 0. Of languages that tie the first by name is taken; equal
    texts get equal results, each row for itself. Existing columns of these
    names are replaced. The model has a fixed size for each language and is broadcast.
    """
    docs = docs.drop("lang_pred", "score")
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            guesses = []
            for value in batch.column(at):
                value = value.as_py() or ""
                guesses.append(model.predict(value) if model is not None and any(map(str.isalpha, value)) else ("und", 0.0))
            columns = [*batch.columns, pa.array([g for g, _ in guesses], pa.string()), pa.array([s for _, s in guesses], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, schema)
