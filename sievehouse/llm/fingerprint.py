"""Document fingerprints by one-permutation MinHash."""

from __future__ import annotations

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import let, shingle_hashes

#: Bins, and the low-order bits kept of each; both powers of two.
BINS, BITS = 128, 4


#: So many places are drawn for an empty bin one by one; then the full bins are asked which comes first.
DRAWS = 8


def _draws(bins: int) -> tuple[list[int], list[int]]:
    """Where each bin's sequence of draws starts and its odd step: the k-th
    draw of bin i is (start + step * k) mod bins, which meets every bin once."""

    def hashed(i: int, salt: int) -> int:
        """Spark's xxhash64 of the two ints."""
        seed = xxhash.xxh64_intdigest(i.to_bytes(4, "little"), 42)
        return xxhash.xxh64_intdigest(salt.to_bytes(4, "little"), seed)

    return [hashed(i, 1) & (bins - 1) for i in range(bins)], [hashed(i, 2) & (bins - 1) | 1 for i in range(bins)]


def fingerprint(text: Column, size: int = 5, bins: int = BINS, bits: int = BITS) -> Column:
    """The packed fingerprint of a whole text as lower-case hex.

    Each word shingle is hashed once; the top bits name its bin and the least
    hash of a bin stays. An empty bin takes the value of the first full one
    among places drawn by hashes of its own number (optimal densification), so
    all fingerprints draw alike. Stored are low-order bits of each value hashed
    with its bin, so that bins which share a value agree by chance only once.
    A text without a word, null or empty, has no shingle and gets zeros.
    """
    if bits != 4:
        raise ValueError("a hex digit holds four bits")
    shift = 64 - (bins.bit_length() - 1)
    # One row in each bin that no shingle beats; the top bits of signed longs sort as (bin + bins / 2) mod bins.
    last = [(b << shift) | ((1 << shift) - 1) for b in range(bins)]
    void = F.array(*[F.lit(x - (1 << 64) if x >= 1 << 63 else x) for x in last])
    place = lambda h: F.shiftrightunsigned(h, shift)
    is_void = lambda h: h.bitwiseOR(F.lit(-(1 << shift))) == -1
    starts, steps = _draws(bins)
    ints = lambda values: F.array(*[F.lit(x) for x in values])
    drawn = [ints([(a + b * k) % bins for a, b in zip(starts, steps, strict=True)]) for k in range(DRAWS)]
    start_of, inverse_of = ints(starts), ints([pow(b, -1, bins) for b in steps])

    def least(h: Column) -> Column:
        """The least hash of each bin, null for an empty one, in the order of signed longs."""
        firsts = F.filter(h, lambda x, i: (i == 0) | (place(x) != place(F.get(h, i - 1))))
        return F.transform(firsts, lambda x: F.when(~is_void(x), x))

    def dense(m: Column) -> Column:
        def by_hand(full: Column) -> Column:
            def first_full(i: Column) -> Column:
                """The full bin whose place comes first among the draws of bin i."""
                turn = lambda x, j: ((place(x).cast("int") + bins // 2 - F.get(start_of, i) + bins) * F.get(inverse_of, i)).bitwiseAND(F.lit(bins - 1)) * bins + j
                return F.get(full, F.array_min(F.transform(full, turn)).bitwiseAND(F.lit(bins - 1)))

            draw = lambda i: [F.get(m, F.get(d, i)) for d in drawn]
            many = F.transform(m, lambda x, i: F.coalesce(x, *draw(i), first_full(i)))
            few = F.transform(m, lambda x, i: F.coalesce(x, first_full(i)))
            values = F.when(F.size(full) == bins, m).when(F.size(full) >= bins // DRAWS, many).otherwise(few)
            digits = F.transform(values, lambda x, i: F.hex(F.xxhash64(x, i).bitwiseAND(F.lit(15))))
            return F.when(F.size(full) > 0, F.lower(F.array_join(digits, ""))).otherwise(F.lit("0" * bins))

        return let(F.array_compact(m), by_hand)

    return let(let(F.sort_array(F.concat(shingle_hashes(text, size), void)), least), dense)


def likeness(a: Column, b: Column, bits: int = BITS) -> Column:
    """Estimated share of shingles in common, 0 to 1. Of two different values
    one in 2^bits agrees in the bits kept; that bias is taken off."""
    chance = 2.0**-bits
    same = F.aggregate(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    raw = (same / F.greatest(F.length(a), F.lit(1)) - chance) / (1 - chance)
    return F.when(a == b, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)))


def _range_of(key: Column, cuts: list[int]) -> Column:
    """(bucket, cut): the number of cuts (ascending) at or below key, less one,
    and the last of them. Cuts are asked by blocks, so a row meets about twice the root of their number."""
    width = max(1, int(len(cuts) ** 0.5))
    blocks = [cuts[i : i + width] for i in range(0, len(cuts), width)]
    longs = lambda values: F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")
    below = lambda values: F.size(F.filter(values, lambda c: c <= key)) - 1
    nested = F.split(F.lit(";".join(",".join(map(str, b)) for b in blocks)), ";")

    def within(block: Column) -> Column:
        inner = F.split(F.get(nested, block), ",").cast("array<bigint>")
        return let(inner, lambda x: let(below(x), lambda i: F.struct((block * width + i).alias("bucket"), F.get(x, i).alias("cut"))))

    return let(below(longs([b[0] for b in blocks])), within)


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text", rows_each: int = 1500) -> DataFrame:
    """(key, text, next_text, copy, bucket, place, k): each row beside the text of its successor by key.

    Rows are dealt to buckets, ranges of keys that begin at keys of the table,
    and a window over each bucket finds the successor. The rows that begin a
    bucket are copied (copy is true) to the end of the one before; those of
    the first bucket to the end of the last, so the last row is followed by
    the first. Rows with equal keys are ordered by text; null keys come first.
    Whole texts are shuffled once; the window spills what it can't hold.
    """
    k = F.coalesce(F.col(key).cast("bigint"), F.lit(-(1 << 63)))
    rows = docs.select(k.alias("k"), F.col(key).alias(key), F.coalesce(F.col(text), F.lit("")).alias("text"))
    count = rows.count()
    parts = max(1, min(1 << 16, count // rows_each))
    at = [i / parts for i in range(parts)]
    found = rows.agg(F.min("k").alias("low"), F.percentile_approx("k", at, 4 * parts + 100).alias("cuts")).first()
    cuts = sorted({found.low, *found.cuts}) if count else [0]
    rows = rows.withColumn("r", _range_of(F.col("k"), cuts)).select("*", F.col("r.bucket").alias("b"), (F.col("k") == F.col("r.cut")).alias("begins"))
    here = lambda b, copy, place: F.struct(b.cast("int").alias("bucket"), F.lit(copy).alias("copy"), place.alias("place"))
    before = F.pmod(F.col("b") - 1, F.lit(len(cuts)))
    spots = F.when(F.col("begins"), F.array(here(F.col("b"), False, F.lit(0)), here(before, True, (F.col("b") == 0).cast("int")))).otherwise(F.array(here(F.col("b"), False, F.lit(0))))
    dealt = rows.select("k", key, "text", F.explode(spots).alias("spot")).select("k", key, "text", "spot.*")
    return dealt.withColumn("next_text", F.lead("text").over(successor()))


def successor():
    return W.partitionBy("bucket").orderBy("place", "k", "text")


def compare_with_edited(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5) -> DataFrame:
    """Fingerprints every text and an edited text, whose last quarter is
    replaced by the beginning of the next document: key, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    A null text counts as empty. One row comes back for each row."""
    rows = with_next(docs, key, text)
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - quarter), F.substring(F.col("next_text"), F.lit(1), quarter))
    marked = rows.select(
        "bucket", "place", "k", "copy", key, F.col("text"), n.cast("long").alias("n_chars"),
        fingerprint(F.col("text"), size).alias("fingerprint"),
        F.when(~F.col("copy"), edited).alias("edited"),
    )
    marked = marked.withColumns(
        {"edited_sha256": F.sha2("edited", 256), "edited_fingerprint": F.when(~F.col("copy"), fingerprint(F.col("edited"), size)), "next_fingerprint": F.lead("fingerprint").over(successor())}
    )
    return marked.where(~F.col("copy")).select(
        key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
