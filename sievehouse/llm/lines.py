"""Removal of lines that an earlier document holds, by levelled sorted runs.

A run holds keys of lines with the id that held each first. It is a table
bucketed and sorted by key, so a batch is merged with all runs after one
shuffle of its own keys, and runs never move. Each batch adds the keys that no
run had as a run of level 0; when a level has `fanout` runs they are compacted
into one of the next level. Texts don't take part: only 16 bytes of hashes,
an id and a place stand for a line until the lines that go are known.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_path, join_hot, let, shared_folder, written

#: What is stripped from a line's ends, and the fewest characters of a key that counts.
SPACE, LEAST_CHARS = " \t\n\x0b\x0c\r", 10
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lines_of(text: Column) -> Column:
    """The lines of a text; null and empty texts have one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return F.translate(F.trim(line, F.lit(SPACE)), _UPPER, _UPPER.lower())


def hashed_lines(docs: DataFrame, id: str = "doc_id", text: str = "text", least: int = LEAST_CHARS, other: Sequence[str] = ()) -> DataFrame:
    """(doc, row, at, h, g) for each line whose key has at least so many
    characters: the document, a hash of its text, the line's place and two
    hashes of its key; then the other columns named."""
    lines = docs.select(F.col(id).alias("doc"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("row"), *other, F.posexplode(lines_of(F.col(text))).alias("at", "line"))
    keys = lines.select("doc", "row", "at", *other, line_key(F.col("line")).alias("key")).where(F.length("key") >= least)
    return keys.select("doc", "row", "at", F.xxhash64("key").alias("h"), F.xxhash64(F.lit(1), "key").alias("g"), *other)


@contextmanager
def _sorted_buckets(spark: SparkSession):
    """Lets Spark rely on the order of buckets of one file, as all runs have."""
    name = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class LineIndex:
    """Keys of all lines seen so far, in levels of sorted runs.

    add takes hashed lines of the next batch and returns those that go. The
    first document of the first batch with a key owns it. Runs live in the
    folder that driver and executors share; close deletes them. If a batch is
    added again, the same lines go.
    """

    def __init__(self, spark: SparkSession, fanout: int = 4):
        if fanout < 2:
            raise ValueError("a level holds two runs at least")
        self.spark, self.fanout = spark, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]
        self._paths: dict[str, str] = {}

    def runs(self) -> list[DataFrame]:
        """All runs, largest first: (h, g, owner)."""
        return [self.spark.table(name).where("fresh").select("h", "g", "owner") for level in reversed(self.levels) for name in level]

    def _write(self, keys: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        self._paths[name] = f"{shared_folder(self.spark)}/{name}"
        table = keys.write.partitionBy("fresh").bucketBy(self.buckets, "h", "g").sortBy("h", "g").format("parquet")
        with _sorted_buckets(self.spark):
            table.option("path", self._paths[name]).saveAsTable(name)
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        drop_path(self.spark, self._paths.pop(name))

    def compact(self) -> int:
        """Makes one run of each level that is full, and returns how many levels were."""
        full = 0
        for i in range(len(self.levels)):
            names = self.levels[i]
            if len(names) < self.fanout:
                continue
            both = self.spark.table(names[0]).where("fresh")
            for name in names[1:]:
                both = both.unionByName(self.spark.table(name).where("fresh"))
            merged = self._write(both.repartition(self.buckets, "h", "g"))
            if i + 1 == len(self.levels):
                self.levels.append([])
            self.levels[i + 1].append(merged)
            self.levels[i] = []
            for name in names:
                self._drop(name)
            full += 1
        return full

    def add(self, lines: DataFrame) -> DataFrame:
        """(doc, row, places): the places of the lines that go, for each
        document of the batch that loses any; a written table.

        A key of no run belongs to the batch's smallest id (null: the last).
        Counts are summed up before the shuffle, and lines of hot keys are
        resolved where they are."""
        self.compact()
        keys = lines.groupBy("h", "g").agg(F.struct(F.min("doc").alias("doc")).alias("first"), (F.count("doc") < F.count("*")).alias("nulls"), F.max("doc").alias("last"), F.count("*").alias("n"))
        owner = []
        for i, run in enumerate(self.runs()):
            keys = keys.join(run.withColumnRenamed("owner", f"owner{i}").hint("merge"), ["h", "g"], "left")
            owner.append(F.col(f"owner{i}"))
        known = F.coalesce(*owner) if owner else F.lit(None).cast(keys.schema["first"].dataType)
        several = F.col("nulls") | (F.col("first.doc") != F.col("last"))
        looked = keys.select("h", "g", F.coalesce(known, "first").alias("owner"), F.coalesce(several, F.lit(False)).alias("several"), "n", known.isNull().alias("fresh"))
        name = self._write(looked)
        self.levels[0].append(name)
        written_keys = self.spark.table(name)
        total = written_keys.agg(F.sum("n")).head()[0] or 0
        again = written_keys.where("not fresh or several").select("h", "g", "owner", "n")
        gone = join_hot(lines, again, ["h", "g"], "n", total).where(~F.col("doc").eqNullSafe(F.col("owner.doc")))
        return written(gone.groupBy("doc", "row").agg(F.collect_list("at").alias("places")), "line-places")

    def close(self) -> None:
        for name in list(self._paths):
            self._drop(name)
        self.levels = [[]]


def _batch_of(docs: DataFrame, id: str, batches: int) -> Column:
    """The number of a document's batch: ranges of ids with about as many
    documents each, null ids in the last. Equal ids share a batch."""
    at = [F.lit(i / batches) for i in range(1, batches)]
    cuts = docs.agg(F.percentile_approx(id, F.array(*at))).head()[0] if at else None
    return sum((F.coalesce(F.col(id) > cut, F.lit(True)).cast("int") for cut in sorted(set(cuts or []))), F.lit(0))


def drop_repeated_lines(docs: DataFrame, id: str = "doc_id", text: str = "text", batches: int = 4, fanout: int = 3, least: int = LEAST_CHARS) -> DataFrame:
    """docs with n_lines, n_dropped and kept, the lines that stay joined by \\n.

    A line's key is the line without space and U+0009 to U+000D at its ends
    and with A-Z in lower case. A key of at least `least` characters that
    several documents hold loses all its lines but those of the document with
    the smallest id, which keeps all of its own. Batches are ranges of the
    numeric ids in ascending order, so the result doesn't depend on their
    number: it says how much is sorted at once.

    A null or empty text is one empty line, which stays. Rows with equal ids
    are one document; null ids are one document, the last. Other columns stay,
    those with the new names are replaced. An empty table stays empty.
    """
    docs, spark = docs.drop("n_lines", "n_dropped", "kept"), docs.sparkSession
    numbered = docs.select(F.col(id).alias("doc"), F.col(text).alias("text"), _batch_of(docs, id, batches).alias("batch"))
    lines = written(hashed_lines(numbered, "doc", "text", least, ["batch"]), "hashed-lines", ["batch"])
    index, gone = LineIndex(spark, fanout), None
    for batch in range(batches):
        places = index.add(lines.where(F.col("batch") == batch).drop("batch"))
        gone = places if gone is None else gone.unionByName(places)
    index.close()
    gone = gone.select(F.col("doc").alias("__doc"), F.col("row").alias("__found"), F.col("places").alias("__places"))
    keyed = docs.withColumn("__row", F.xxhash64(F.coalesce(text, F.lit(""))))
    joined = keyed.join(gone, F.col(id).eqNullSafe(F.col("__doc")) & (F.col("__row") == F.col("__found")), "left")
    n = F.size(lines_of(F.col(text)))
    stay = F.array_except(F.sequence(F.lit(0), n - 1), "__places")
    kept = let(lines_of(F.col(text)), lambda each: F.array_join(F.transform(stay, lambda i: F.get(each, i)), "\n"))
    return joined.select(
        *docs.columns,
        n.cast("long").alias("n_lines"),
        F.coalesce(F.size("__places"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("__places").isNull(), F.coalesce(text, F.lit(""))).otherwise(kept).alias("kept"),
    )
