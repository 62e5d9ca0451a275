"""Small helpers that the training-data operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Space and U+0009 to U+000D separate words.
WORD_BREAK = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    The cluster names it in spark.checkpoint.dir. Where that is unset, only a
    session of one machine, as in tests, gets a temporary folder; any other fails.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="sievehouse-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: The tables that this process wrote and hasn't dropped, by the folder they are in.
_WRITTEN: list[str] = []


def written(df: DataFrame, name: str, by: Sequence[str] = ()) -> DataFrame:
    """df as a Parquet table in the shared folder, in a folder for each value
    of the columns `by`: its lineage ends there, and a lost executor costs no
    more than the tasks that ran on it. It stays until drop_written is called."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    df.write.partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def finished(make: Callable[[], DataFrame], name: str) -> tuple[DataFrame, str]:
    """The table written of what make returns, and its path; the tables that
    were written on the way to it are deleted."""
    begin = len(_WRITTEN)
    df = written(make(), name)
    for path in _WRITTEN[begin:-1]:
        drop_path(df.sparkSession, path)
    del _WRITTEN[begin:-1]
    return df, _WRITTEN[-1]


def drop_table(spark: SparkSession, path: str) -> None:
    """Deletes a table that written or finished made."""
    drop_path(spark, path)
    _WRITTEN.remove(path)


def drop_written(spark: SparkSession) -> int:
    """Deletes the tables that written made in this process, and returns their
    number. Call it once the results that read them are saved."""
    paths, _WRITTEN[:] = list(_WRITTEN), []
    for path in paths:
        drop_path(spark, path)
    return len(paths)


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: A key with more than one in so many of all rows is hot, if it has this many rows at least.
HOT_SHARE, HOT_ROWS = 1000, 1000


def join_hot(rows: DataFrame, keyed: DataFrame, on: list[str], count: str, total: int) -> DataFrame:
    """The inner join of rows to keyed, which has each key once and in count
    how many of the total rows have it. Hot keys, HOT_SHARE of them at most
    whatever the input, are broadcast, so their rows stay where they are; only
    rows of the other keys are shuffled. count is left out."""
    limit = max(HOT_ROWS, total // HOT_SHARE)
    hot, cold = keyed.where(F.col(count) > limit).drop(count), keyed.where(F.col(count) <= limit).drop(count)
    still = rows.join(F.broadcast(hot), on)
    moved = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(cold, on)
    return still.unionByName(moved)


def text_key(text: Column) -> Column:
    """What stands for a whole text (null: empty) in a join: 96 bits of two
    different hashes and its length, so that different texts don't meet at any size of corpus."""
    text = F.coalesce(text, F.lit(""))
    return F.struct(F.xxhash64(text).alias("h"), F.crc32(text.cast("binary")).alias("c"), F.length(text).alias("n"))


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once a row, also inside lambdas."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column, lower: bool = True) -> Column:
    """The words of a text (null: none)."""
    text = F.coalesce(text, F.lit(""))
    parts = F.split(F.lower(text) if lower else text, WORD_BREAK)
    return F.filter(parts, lambda w: w != "")


def shingle_hashes(text: Column, size: int, lower: bool = True) -> Column:
    """64-bit hashes of the word shingles, repeats included. Fewer words than
    size make one shingle of the whole sequence; no word makes none."""
    word_hashes = F.transform(words_of(text, lower), lambda w: F.xxhash64(w))

    def shingles(h: Column) -> Column:
        n = F.size(h)
        whole = F.when(n == 0, F.array().cast("array<bigint>")).otherwise(
            F.array(F.aggregate(h, F.lit(7).cast("bigint"), lambda a, x: F.xxhash64(a, x)))
        )
        each = F.transform(
            F.sequence(F.lit(0), n - size),
            lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(size)]),
        )
        return F.when(n < size, whole).otherwise(each)

    return let(word_hashes, shingles)
