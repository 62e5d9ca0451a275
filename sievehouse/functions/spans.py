"""Running sums over long groups, without a window that holds a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def sum_before(rows: DataFrame, by: list[str], at: Column, order: list[str], value: str, name: str, span: int) -> DataFrame:
    """rows with name, the sum of value over the earlier rows of the same group.

    A group is cut into spans of at, a number that grows with order; sums of
    earlier spans come from a table with one row a span, and only rows of one
    span are sorted together. Nulls of at come first. Rows of null groups are one group."""
    keys = F.struct(*by)
    rows = rows.withColumns({"__by": keys, "__span": F.coalesce(F.floor(at / span).cast("bigint"), F.lit(-(1 << 62)))})
    spans = rows.groupBy("__by", "__span").agg(F.sum(value).alias("__n"))
    earlier = F.sum("__n").over(W.partitionBy("__by").orderBy("__span").rowsBetween(W.unboundedPreceding, -1))
    spans = spans.select("__by", "__span", F.coalesce(earlier, F.lit(0)).alias("__before"))
    inside = F.sum(value).over(W.partitionBy("__by", "__span").orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    out = rows.join(spans, ["__by", "__span"]).withColumn(name, F.col("__before") + F.coalesce(inside, F.lit(0)))
    return out.drop("__by", "__span", "__before")
