"""Package names against known lists: look-alikes and known-bad names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def look_alikes(names: DataFrame, known: DataFrame, distance: int = 1, name: str = "name", known_name: str = "known") -> DataFrame:
    """(name, known) for names that differ from a known one by at most distance
    edits and not by none. An equi-join on shared deletion variants finds the
    pairs, so the sides are never crossed: strings within d edits share a
    variant with up to d characters deleted."""

    def variants(col: str):
        out = F.array(F.col(col))
        for _ in range(distance):
            longer = F.flatten(F.transform(out, lambda s: F.transform(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))), lambda i: F.concat(F.left(s, i - 1), F.substring(s, i + 1, F.length(s))))))
            out = F.array_distinct(F.concat(out, longer))
        return F.explode(out).alias("variant")

    left = names.select(F.col(name).alias("name")).distinct().select("name", variants("name"))
    right = known.select(F.col(known_name).alias("known")).distinct().select("known", variants("known"))
    pairs = left.join(right, "variant").select("name", "known").distinct()
    return pairs.where((F.col("name") != F.col("known")) & (F.levenshtein("name", "known") <= distance))
