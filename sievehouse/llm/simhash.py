"""Near-duplicates by 64-bit SimHash fingerprints and deletion-variant signatures."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written

#: Fingerprints that differ in so many bits at most are linked. Of two segments one then differs in at most one bit.
MAX_BITS = 3
#: A bucket with more fingerprints is split by variants of the bits that its key leaves open.
BUCKET = 2048
SEED = 42


def simhash(text: str | None, size: int = 3) -> int:
    """The fingerprint of a whole text: a bit is 1 if it is set in over half of
    the hashes of its word shingles, repeats included. Fewer words than size
    make one shingle, no word makes 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return digest(joined, SEED)
    ends = list(accumulate(len(w) + 1 for w in words))
    hashes = np.array([digest(joined[s : e - 1], SEED) for s, e in zip([0, *ends], ends[size - 1 :])], "<u8")
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = bits.sum(axis=0, dtype=np.int64) * 2 > len(hashes)
    return int(np.packbits(ones, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", size: int = 3) -> DataFrame:
    """docs with the column fingerprint (a long; replaced if it exists). A null text counts as empty."""
    docs = docs.drop("fingerprint")
    schema = T.StructType([*docs.schema.fields, T.StructField("fingerprint", T.LongType())])
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([simhash(v.as_py(), size) for v in batch.column(at)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], [*batch.schema.names, "fingerprint"])

    return docs.mapInArrow(run, schema)


def _variants(value: Column, low: int, width: int, tag: int) -> list[Column]:
    """width variants of the bits [low, low + width) of value, each with one bit
    as a wildcard, tagged so that no two kinds are equal."""
    part = F.shiftrightunsigned(value, low).bitwiseAND(F.lit((1 << width) - 1))
    return [part.bitwiseAND(F.lit(((1 << width) - 1) ^ (1 << b))).bitwiseOR(F.lit((tag * 64 + b) << width)) for b in range(width)]


def _joined(fps: np.ndarray) -> np.ndarray:
    """(n, 2) pairs that join the fingerprints of one bucket as links of MAX_BITS or fewer bits do."""
    left, pairs = np.ones(len(fps), bool), []
    while left.any():
        root = int(left.argmax())
        left[root] = False
        edge = [root]
        while edge:
            near = left & (np.bitwise_count(fps ^ fps[edge.pop()]) <= MAX_BITS)
            found = np.flatnonzero(near)
            left[found] = False
            edge += found.tolist()
            pairs += [(fps[root], fps[i]) for i in found]
    return np.array(pairs, np.uint64).reshape(-1, 2)


def _links(rows: DataFrame, split: bool) -> DataFrame:
    """Links among rows (key, fingerprint) with equal keys, as (null, a, b).
    With split, the rows of buckets with over BUCKET of them come back as
    (key, fingerprint, null). A task holds one Arrow batch and, of a bucket
    that goes on in the next, BUCKET rows at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(key: int | None, a: np.ndarray, b: np.ndarray | None) -> pa.RecordBatch:
            none = pa.nulls(len(a), pa.int64())
            keys = none if key is None else pa.array(np.full(len(a), key, np.int64))
            return pa.RecordBatch.from_arrays([keys, pa.array(a), none if b is None else pa.array(b)], ["key", "a", "b"])

        def pairs_of(found: list[np.ndarray]) -> pa.RecordBatch:
            p = np.unique(np.concatenate([np.zeros((0, 2), np.uint64), *found]), axis=0).view(np.int64)
            return out(None, p[:, 0].copy(), p[:, 1].copy())

        key, held, hot = 0, np.zeros(0, np.int64), False
        for batch in batches:
            keys, fps = (np.asarray(c) for c in batch.columns)
            if hot:
                goes_on = int(np.argmax(keys != key)) if (keys != key).any() else len(keys)
                yield out(key, fps[:goes_on], None)
                keys, fps = keys[goes_on:], fps[goes_on:]
            elif len(held):
                keys, fps = np.concatenate([np.full(len(held), key, np.int64), keys]), np.concatenate([held, fps])
            if not len(keys):
                continue
            cuts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
            sizes, last = np.diff(cuts), int(cuts[-2])
            key, held, hot = int(keys[last]), fps[last:], False
            if split and len(held) > BUCKET:
                yield out(key, held, None)
                held, hot = held[:0], True
            two = cuts[:-2][sizes[:-1] == 2]
            a, b = fps[two].view(np.uint64), fps[two + 1].view(np.uint64)
            near = np.bitwise_count(a ^ b) <= MAX_BITS
            found = [np.stack([a[near], b[near]], axis=1)]
            for i in np.flatnonzero(sizes[:-1] > 2).tolist():
                part = fps[cuts[i] : cuts[i + 1]]
                if split and len(part) > BUCKET:
                    yield out(int(keys[cuts[i]]), part, None)
                else:
                    found.append(_joined(part.view(np.uint64)))
            yield pairs_of(found)
        yield pairs_of([_joined(held.view(np.uint64))])

    # Equal keys are adjacent within a task.
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, "key bigint, a bigint, b bigint")


def _keyed(rows: DataFrame, keys: list[Column]) -> DataFrame:
    return rows.select(F.explode(F.array(*keys)).alias("key"), "fingerprint")


def links(nodes: DataFrame, fingerprint: str = "fingerprint") -> DataFrame:
    """Pairs (a, b) of different fingerprints whose connected components are
    those of all pairs with MAX_BITS or fewer different bits. nodes holds each
    fingerprint once.

    Both 32-bit segments give 32 variants with one wildcard bit; fingerprints
    that share a variant are compared. A bucket emits a spanning forest, not
    its pairs. A bucket over BUCKET fingerprints is divided, and no link is
    lost: of the other segment's halves one differs in at most one bit, then
    one of the quarters of what is open. What three keys leave open allows
    BUCKET different fingerprints.
    """
    f = F.col("fingerprint")
    low = lambda x, bits: x.bitwiseAND(F.lit((1 << bits) - 1))
    nodes = nodes.select(F.col(fingerprint).alias("fingerprint"))
    found = written(_links(_keyed(nodes, [*_variants(f, 0, 32, 1), *_variants(f, 32, 32, 2)]), True), "simhash-links")
    all_links = found.where("key is null")
    hot = found.where("key is not null").select("key", F.col("a").alias("fingerprint"))
    if not hot.isEmpty():
        # Bits of a key: 2 for the segment, 6 for the wildcard, 32 for the value.
        opened = F.when(F.shiftrightunsigned("key", 38) == 1, F.shiftrightunsigned(f, 32)).otherwise(low(f, 32))
        rows = hot.withColumn("open", opened)
        halves = [*_variants(F.col("open"), 0, 16, 1), *_variants(F.col("open"), 16, 16, 2)]
        found = written(_links(_keyed(rows, [F.shiftleft("key", 24).bitwiseOR(h) for h in halves]), True), "simhash-links")
        all_links = all_links.unionByName(found.where("key is null"))
        hot = found.where("key is not null").select("key", F.col("a").alias("fingerprint"))
        if not hot.isEmpty():
            opened = F.when(F.shiftrightunsigned("key", 62) == 1, F.shiftrightunsigned(f, 32)).otherwise(low(f, 32))
            opened = F.when(low(F.shiftrightunsigned("key", 22), 2) == 1, F.shiftrightunsigned(opened, 16)).otherwise(low(opened, 16))
            rows = hot.withColumn("open", opened)
            quarters = [*_variants(F.col("open"), 0, 8, 1), *_variants(F.col("open"), 8, 8, 2)]
            found = written(_links(_keyed(rows, [F.xxhash64("key", q) for q in quarters]), False), "simhash-links")
            all_links = all_links.unionByName(found.where("key is null"))
    return all_links.select("a", "b").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for each node of edges (a, b) but the roots: root is the
    smallest node that it is connected to. Alternates the large-star and the small-star step
    until nothing changes; each round ends in a written table. A node with
    many neighbours is summed up before the shuffle, and Spark splits it in
    the join."""
    now = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("connected components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _labelled(found: DataFrame) -> DataFrame:
    """(fingerprint, component_id, root) for the rows (key, fingerprint)."""
    nodes = written(found.groupBy("fingerprint").agg(F.min("key").alias("first")), "simhash-nodes")
    roots = components(links(nodes))
    rooted = nodes.join(roots, nodes["fingerprint"] == roots["node"], "left").select("fingerprint", "first", F.coalesce("root", "fingerprint").alias("root"))
    firsts = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return written(rooted.join(firsts, "root").select("fingerprint", "component_id", "root"), "simhash-labels")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3) -> DataFrame:
    """One row for each row of docs: key, fingerprint, component_id.

    Fingerprints link at MAX_BITS or fewer differing bits; component_id is the
    smallest key reachable over links, itself included (null only where all
    keys of a component are null). Null and empty texts have the fingerprint
    zero and are linked like any other. Repeated rows come back repeated.
    Copies share a fingerprint, so links are sought among distinct ones.
    """
    found = fingerprints(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), size=size).select("key", "fingerprint")
    found = written(found, "simhash")
    return found.join(_labelled(found), "fingerprint").select(F.col("key").alias(key), "fingerprint", "component_id")


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3) -> DataFrame:
    """docs with one row of each component left: one of those with its smallest
    key and, among them, the smallest fingerprint. Columns are unchanged. The
    row is chosen by its number, so texts are shuffled once and never sorted."""
    marked = written(fingerprints(docs, text, size).withColumn("__row", F.monotonically_increasing_id()), "simhash")
    rows = marked.select(F.col(key).alias("key"), "fingerprint", "__row")
    labels = _labelled(rows.select("key", "fingerprint"))
    firsts = rows.join(labels, "fingerprint").where(F.col("key").eqNullSafe(F.col("component_id")))
    stay = written(firsts.groupBy("root").agg(F.min(F.struct("key", "fingerprint", "__row"))["__row"].alias("__row")).select("__row"), "simhash-stay")
    kept = marked.join(stay.hint("shuffle_hash"), "__row", "left_semi")
    return kept.select(*docs.columns)
