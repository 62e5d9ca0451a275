"""Caps at the report boundary."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Caps in characters.
ASSET = {"name": 255, "identifier": 1024, "content": 200_000}
ARTIFACT = {"name": 200, "path": 1024, "content": 200_000}


def clamp(value: Column, most: int) -> Column:
    """value, or if it is longer than most its beginning and a fingerprint of
    the whole, so that different values stay different. Null stays null."""
    short = F.concat(F.left(value, F.lit(max(1, most - 12))), F.lit("…#"), F.left(F.sha2(value, 256), F.lit(10)))
    return F.when(F.length(value) > most, short).otherwise(value)


def redact(value: Column) -> Column:
    """The two ends of a long value; nothing of a short one."""
    return F.when(F.length(value) > 8, F.concat(F.left(value, F.lit(3)), F.lit("…"), F.right(value, F.lit(2)))).otherwise("…")
