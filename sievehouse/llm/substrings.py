"""Removal of long word sequences that occur more than once.

A count-min sketch prefilters: partitions sketch their windows, the sketches
are merged, and only windows whose merged estimate is two or more are grouped
exactly. A sketch never counts too low, so no repeated window is lost.

A window enters the sketch by its anchor, the smallest hash of the word
8-grams within it. Neighbouring windows share anchors, so about one word in
fourteen is sketched. Equal windows have equal anchors at equal places, so an
anchor's count is never below that of a window.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written

#: Words of an anchor, and the two rows of the sketch with 2^27 cells each (16 MB a row once only "two or more" is kept).
GRAM, ROWS, CELL_BITS = 8, 2, 27
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE2 = np.uint64(0xC2B2AE3D27D4EB4F)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Rolling:
    """Hashes of all runs of so many words, as polynomials modulo 2^64."""

    def __init__(self, base: np.uint64):
        self.base, self.inverse = base, np.uint64(pow(int(base), -1, 1 << 64))
        self.up, self.down = _powers(base, 1024), _powers(self.inverse, 1024)

    def __call__(self, words: np.ndarray, size: int) -> np.ndarray:
        while len(self.up) <= len(words):
            self.up, self.down = _powers(self.base, 2 * len(self.up)), _powers(self.inverse, 2 * len(self.down))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * self.down[: len(words)], dtype=np.uint64)])
        return (sums[size:] - sums[:-size]) * self.up[: len(words) - size + 1]


_ROLL, _ROLL2 = _Rolling(_BASE), _Rolling(_BASE2)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _slide(x: np.ndarray, size: int, best) -> np.ndarray:
    """best over each run of size values."""
    step = 1
    while 2 * step <= size:
        x = best(x[:-step], x[step:])
        step *= 2
    return best(x[: len(x) - (size - step)], x[size - step :]) if size > step else x


def word_hashes(text: str | None) -> tuple[list[bytes], np.ndarray]:
    words = (text or "").encode("utf-8", "surrogatepass").split()
    digest = xxhash.xxh64_intdigest
    return words, np.array([digest(w) for w in words], np.uint64)


def anchors(hashes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(anchor of each window, anchors at distinct places) of one text."""
    gram = min(GRAM, window)
    grams = _mixed(_ROLL(hashes, gram))
    span = window - gram + 1
    least = _slide(grams, span, np.minimum)
    pad = np.zeros(span - 1, np.uint64)
    chosen = _slide(np.concatenate([pad, least, pad]), span, np.maximum) == grams
    return least, grams[chosen]


def _cells(values: np.ndarray) -> list[np.ndarray]:
    mask = np.uint64((1 << CELL_BITS) - 1)
    return [(values >> np.uint64(CELL_BITS * r)) & mask for r in range(ROWS)]


def sketch(docs: DataFrame, window: int, text: str = "text") -> list[np.ndarray]:
    """The merged sketch as one bitmap for each row: the cells that count two or more.

    Each task sums up its cells, and Spark merges them. The driver gets words
    of 64 cells, ROWS * 2^CELL_BITS / 64 at most whatever the input.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, size = [], 0

        def out() -> pa.RecordBatch:
            values, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *found]), return_counts=True)
            cells = [c + np.uint64(r << CELL_BITS) for r, c in enumerate(_cells(values))]
            counts = np.minimum(n, 2).astype(np.int8)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(cells).astype(np.int64)), pa.array(np.tile(counts, ROWS))], ["cell", "n"])

        for batch in batches:
            for value in batch.column(0):
                hashes = word_hashes(value.as_py())[1]
                if len(hashes) >= window:
                    found.append(anchors(hashes, window)[1])
                    size += len(found[-1])
                if size > 4_000_000:
                    yield out()
                    found, size = [], 0
        yield out()

    cells = docs.select(text).mapInArrow(run, "cell bigint, n tinyint").groupBy("cell").agg(F.sum("n").alias("n")).where("n > 1")
    words = cells.groupBy(F.shiftright("cell", 6).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(cell & 63 as int))")).alias("bits"))
    got = words.toArrow()
    bitmap = np.zeros(ROWS << (CELL_BITS - 6), np.uint64)
    bitmap[got["word"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    return list(bitmap.reshape(ROWS, -1))


def _estimated_repeated(bitmaps: list[np.ndarray], values: np.ndarray) -> np.ndarray:
    out = np.ones(len(values), bool)
    for bitmap, cells in zip(bitmaps, _cells(values), strict=True):
        out &= (bitmap[cells >> np.uint64(6)] >> (cells & np.uint64(63)) & np.uint64(1)).astype(bool)
    return out


def _candidates(docs: DataFrame, window: int, bitmaps, text: str) -> DataFrame:
    """(h1, h2crc, doc, place) for windows that may be repeated, packed because
    they are most of what is shuffled: 96 bits of two hashes of the words, 96
    bits of two of the text, and in place the first word's place, times two,
    plus one if the window is known to occur twice. Of the equal windows of one
    batch one is sent so, and the others' places, which need no more counting,
    as rows with h1 null."""
    sent = docs.sparkSession.sparkContext.broadcast(bitmaps)
    names = ["h1", "h2crc", "doc", "place"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmaps = sent.value

        def out(parts: list[tuple], copies: dict[tuple[int, int], int]) -> Iterator[pa.RecordBatch]:
            if not parts:
                return
            doc = np.concatenate([np.full(len(at), d[0], np.uint64) for d, at, _, _ in parts])
            crc = np.concatenate([np.full(len(at), d[1], np.uint64) for d, at, _, _ in parts])
            at, h1, h2 = (np.concatenate([p[i] for p in parts]) for i in (1, 2, 3))
            many = np.concatenate([np.full(len(p[1]), copies[p[0]] > 1) for p in parts])
            order = np.lexsort((h2, h1))
            doc, crc, at, h1, h2, many = (x[order] for x in (doc, crc, at, h1, h2, many))
            fresh = np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])
            begin, again = np.flatnonzero(fresh), np.flatnonzero(~fresh)
            twice = (np.diff(np.append(begin, len(h1))) > 1) | np.logical_or.reduceat(many, begin)
            nulls = np.concatenate([np.zeros(len(begin), bool), np.ones(len(again), bool)])
            h1, h2crc, doc, place = (np.concatenate([x[begin], x[again]]) for x in (h1, h2 << np.uint64(32) | crc, doc, 2 * at))
            place[: len(begin)] += twice
            yield pa.RecordBatch.from_arrays([pa.array(h1.view(np.int64), mask=nulls), *(pa.array(x.view(np.int64)) for x in (h2crc, doc, place))], names)

        parts, copies, size = [], {}, 0
        for batch in batches:
            for value in batch.column(0):
                value = value.as_py() or ""
                raw = value.encode("utf-8", "surrogatepass")
                doc = xxhash.xxh64_intdigest(raw, 42), zlib.crc32(raw)
                if doc in copies:
                    copies[doc] += 1
                    continue
                hashes = word_hashes(value)[1]
                if len(hashes) < window:
                    continue
                copies[doc] = 1
                at = np.flatnonzero(_estimated_repeated(bitmaps, anchors(hashes, window)[0]))
                if len(at):
                    h1, h2 = _ROLL(hashes, window)[at], _ROLL2(_mixed(hashes), window)[at] >> np.uint64(32)
                    parts.append((doc, at, h1, h2))
                    size += len(at)
                if size > 1_000_000 or len(copies) > 200_000:
                    yield from out(parts, copies)
                    parts, copies, size = [], {}, 0
        yield from out(parts, copies)

    return docs.select(text).mapInArrow(run, "h1 bigint, h2crc bigint, doc bigint, place bigint")


def _repeated(candidates: DataFrame) -> DataFrame:
    """(doc, crc, at) of the windows that occur twice or more, by runs of equal
    hashes. A task holds one Arrow batch and one row of a run that goes on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, waiting = None, None  # the last run's hashes, and its row if it is the only one so far
        for batch in batches:
            known = np.asarray(batch.column(0).is_null())
            rows = [np.asarray(c.fill_null(0)) for c in batch.columns]
            done = [x[known] for x in rows[1:]]
            h1, h2crc, doc, place = (x[~known] for x in rows)
            if waiting is not None:
                h1, h2crc, doc, place = (np.concatenate([[w], x]) for w, x in zip(waiting, (h1, h2crc, doc, place), strict=True))
                waiting = None
            if len(h1):
                h2 = h2crc >> 32
                begin = np.flatnonzero(np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]))
                sizes = np.diff(np.append(begin, len(h1)))
                many = np.add.reduceat(1 + (place & 1), begin) > 1
                if key == (h1[0], h2[0]):
                    many[0] = True
                key = (h1[-1], h2[-1])
                if not many[-1]:
                    waiting = tuple(x[begin[-1]] for x in (h1, h2crc, doc, place))
                    key = None
                keep = np.repeat(many, sizes)
                done = [np.concatenate([x, y[keep]]) for x, y in zip(done, (h2crc, doc, place), strict=True)]
            crc, at = done[0].astype(np.uint32).view(np.int32), (done[2] >> 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(done[1]), pa.array(crc), pa.array(at)], ["doc", "crc", "at"])

    spread = F.coalesce("h1", F.xxhash64("doc", "place"))
    return candidates.repartition(spread).sortWithinPartitions("h1", "h2crc").mapInArrow(run, "doc bigint, crc int, at int")


def repeated_windows(docs: DataFrame, window: int = 35, text: str = "text") -> DataFrame:
    """(doc, crc, places): for each text that holds a repeated window, the
    XXH64 of the text (seed 42), its CRC-32 as a signed integer, and the first
    words' places."""
    found = _repeated(_candidates(docs, window, sketch(docs, window, text), text))
    return written(found.groupBy("doc", "crc").agg(F.collect_set("at").alias("places")), "repeated-windows")


def remove_repeats(docs: DataFrame, window: int = 35, text: str = "text", with_kept: bool = True) -> DataFrame:
    """docs with n_words, n_removed, kept_sha256 and, with with_kept, kept.

    A window is so many consecutive words of one row; every word covered by a
    window whose words also start anywhere else, in the same row included, is
    removed; kept joins the other words by one space. Windows are judged on
    the input. Words are unchanged runs of anything but space and U+0009 to
    U+000D. A null text has no words; repeated rows are copies of each other;
    other columns stay, those with the new names are replaced. Texts
    and windows are identified by 96 bits of two hashes, words by 64 bits.
    """
    docs = docs.drop("n_words", "n_removed", "kept_sha256", "kept")
    places = repeated_windows(docs, window, text)
    places = places.select(F.col("doc").alias("__found"), F.col("crc").alias("__found_crc"), F.col("places").alias("__places"))
    whole = F.coalesce(text, F.lit(""))
    signed = F.crc32(whole.cast("binary")).bitwiseXOR(F.lit(1 << 31)) - (1 << 31)
    keyed = docs.withColumns({"__doc": F.xxhash64(whole), "__crc": signed.cast("int")})
    joined = keyed.join(places, (F.col("__doc") == F.col("__found")) & (F.col("__crc") == F.col("__found_crc")), "left").drop("__doc", "__crc", "__found", "__found_crc")
    at, names = docs.columns.index(text), [*docs.columns, "n_words", "n_removed", "kept_sha256", *(["kept"] if with_kept else [])]
    fields = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())]
    schema = T.StructType([*docs.schema.fields, *fields, *([T.StructField("kept", T.StringType())] if with_kept else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, removed, hashes, texts = [], [], [], []
            for value, starts in zip(batch.column(at), batch.column(len(batch.columns) - 1), strict=True):
                words = (value.as_py() or "").encode("utf-8", "surrogatepass").split()
                gone = 0
                counts.append(len(words))
                if starts.is_valid:
                    edges = np.zeros(len(words) + 1, np.int32)
                    begin = np.asarray(starts.values)
                    edges[begin] += 1
                    edges[begin + window] -= 1
                    stay = np.cumsum(edges[:-1]) == 0
                    words = [words[i] for i in np.flatnonzero(stay)]
                    gone = counts[-1] - len(words)
                removed.append(gone)
                texts.append(kept := b" ".join(words))
                hashes.append(hashlib.sha256(kept).hexdigest())
            columns = [*batch.columns[:-1], pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(hashes, pa.string())]
            if with_kept:
                columns.append(pa.array(texts, pa.binary()).cast(pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names)

    return joined.mapInArrow(run, schema)
