"""Benchmark decontamination: short test items found inside long documents.

Items are divided by the number of their shingles, and each keeps as its
sketch so many of its shingle hashes as its size class needs: if an item of q
shingles shares a share t of them with a document, it lacks at most
q - ceil(t q) in it, so one of any q - ceil(t q) + 1 of its shingles is in the
document. Which ones is free, so a sketch takes those in the fewest texts, the
smaller hash first: a phrase that many items and documents share is in no
sketch. A document, however long, is probed with all its shingles, as the
Jaccard likeness of a short item and a long document is next to nothing. What
of its shingles is in any item is kept, and candidates are verified by exact
containment from that alone, so texts never move.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shingle_hashes, text_key, written

SIZE, CONTAINED = 5, Fraction(4, 5)


def _enough(shared: Column, total: Column, least: Fraction) -> Column:
    return shared * least.denominator >= total * least.numerator


def item_shingles(items: DataFrame, item: str = "item_id", text: str = "text", size: int = SIZE) -> DataFrame:
    """(item, shingles, n_item, size_class) for items with a word; repeated rows once."""
    shingles = F.array_sort(F.array_distinct(shingle_hashes(F.col(text), size)))
    rows = items.select(F.col(item), shingles.alias("shingles")).withColumn("n_item", F.size("shingles")).where("n_item > 0").distinct()
    return rows.withColumn("size_class", F.ceil(F.log2("n_item")).cast("int"))


def item_sketches(items: DataFrame, in_texts: DataFrame, item: str = "item_id", least: Fraction = CONTAINED) -> DataFrame:
    """(item, h): each item's shingles (item, shingles, size_class) that are in
    the fewest texts by in_texts (h, n), as many as its size class needs."""
    upper = F.pow(F.lit(2), F.col("size_class")).cast("int")
    needed = upper - F.ceil(upper * least.numerator / least.denominator).cast("int") + 1
    each = items.select(item, "n_item", needed.alias("needed"), F.explode("shingles").alias("h")).join(in_texts, "h", "left")
    rarest = F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "h")))
    chosen = each.groupBy(item, "n_item", "needed").agg(rarest.alias("all"))
    return chosen.select(item, F.explode(F.slice("all", F.lit(1), F.col("needed"))).alias("x")).select(item, "x.h")


def contained_items(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", size: int = SIZE, least: Fraction = CONTAINED) -> DataFrame:
    """(key, item, n_shared, n_item, containment) for each document and item
    with a share of at least `least` of the item's distinct shingles in the document.

    Words are lower-cased runs of anything but space and U+0009 to U+000D. A
    text of fewer than five words is one shingle; one without a word, null or
    empty, is in no pair. Repeated rows give one pair; equal texts are
    candidates together. Shingles of items are joined by their hash: Spark
    broadcasts them only if the table written for them is below its threshold,
    else it shuffles both sides and splits hot shingles. Only hashes that are
    in an item go on, once a text, and their counts are summed up before they
    are shuffled.
    """
    of_docs = docs.select(F.col(key).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("text_key", text_key(F.col("text")))
    known = written(item_shingles(items.select(F.col(item).alias("item"), F.col(text).alias("text")), "item", "text", size), "item-shingles")
    wanted = written(known.select(F.explode("shingles").alias("h")).distinct(), "item-hashes")
    shingles = of_docs.select("text_key", F.explode(F.array_distinct(shingle_hashes(F.col("text"), size))).alias("h"))
    matched = written(shingles.join(wanted, "h", "left_semi").distinct(), "matched-shingles")
    probes = written(item_sketches(known, matched.groupBy("h").agg(F.count("*").alias("n")), "item", least), "item-sketches")
    candidates = matched.join(probes, "h").select("text_key", "item").distinct()
    of_texts = matched.groupBy("text_key").agg(F.collect_set("h").alias("held"))
    both = candidates.join(of_texts, "text_key").join(known.select("item", "shingles", "n_item"), "item")
    found = both.withColumn("n_shared", F.size(F.array_intersect("held", "shingles"))).where(_enough(F.col("n_shared"), F.col("n_item"), least))
    found = written(found.select("text_key", "item", "n_shared", "n_item"), "item-texts")
    pairs = of_docs.select("doc", "text_key").join(found, "text_key")
    return pairs.select(F.col("doc").alias(key), F.col("item").alias(item), F.col("n_shared").cast("long").alias("n_shared"), F.col("n_item").cast("long").alias("n_item"), (F.col("n_shared") / F.col("n_item")).alias("containment")).distinct()


def decontaminate(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id") -> DataFrame:
    """docs without those that contain an item. Columns are unchanged. A null or
    empty text contains none and stays; equal texts, repeated rows included, stay or go together."""
    texts = docs.select(text_key(F.col(text)).alias("doc"), F.col(text).alias("text"))
    found = written(contained_items(texts, items.select(F.col(item).alias(item), F.col(text).alias("text")), "doc", "text", item).select(F.col("doc").alias("__found")).distinct(), "contaminated")
    marked = docs.withColumn("__doc", text_key(F.col(text)))
    return marked.join(found, F.col("__doc") == F.col("__found"), "left_anti").select(*docs.columns)
