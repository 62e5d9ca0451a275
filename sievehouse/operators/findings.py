"""Findings as arrays within a document's row: building, ordering, grading.

A rule catalogue becomes one projection: an array of conditions with literal
patterns, so each pattern is compiled once and no row is multiplied or moved.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.regexes import let
from ..plans.signals import SEVERITIES, WEIGHTS

TYPE = "array<struct<label:string,severity:string,category:string,line:int,offset:int>>"


def finding(label: Column, severity: Column | str, category: str, prefix: Column | None) -> Column:
    """One finding; prefix is the text before it, or null where it has no place."""
    from ..functions.text import line_after

    level = F.lit(severity) if isinstance(severity, str) else severity
    place = F.lit(None).cast("int") if prefix is None else line_after(prefix).cast("int")
    offset = F.lit(None).cast("int") if prefix is None else F.length(prefix)
    return F.struct(label.alias("label"), level.alias("severity"), F.lit(category).alias("category"), place.alias("line"), offset.alias("offset"))


def none() -> Column:
    return F.array().cast(TYPE)


def gather(parts: list[Column]) -> Column:
    """An array of the findings that are there, in order."""
    return F.array_compact(F.array(*parts)) if parts else none()


def rank(severity: Column) -> Column:
    out = F.lit(0)
    for name, r in SEVERITIES.items():
        out = F.when(severity == name, r).otherwise(out)
    return out


def weight(severity: Column) -> Column:
    out = F.lit(0)
    for name, w in WEIGHTS.items():
        out = F.when(severity == name, w).otherwise(out)
    return out


def verdict_of(worst: Column) -> Column:
    return F.when(worst >= 5, "BLOCK").when(worst >= 4, "FLAG").otherwise("ALLOW")


def grade(found: Column) -> Column:
    """(verdict, risk_score, n): the worst severity decides, weights add up to 100 at most. No findings: ALLOW, 0."""
    worst = F.coalesce(F.array_max(F.transform(found, lambda x: rank(x["severity"]))), F.lit(0))
    score = F.aggregate(found, F.lit(0), lambda s, x: s + weight(x["severity"]))
    return F.struct(verdict_of(worst).alias("verdict"), F.least(F.lit(100), score).alias("risk_score"), F.size(found).alias("n"))


def top(found: Column) -> Column:
    """The first finding of the worst severity, or null."""
    worst = F.array_max(F.transform(found, lambda x: rank(x["severity"])))
    return let(worst, lambda w: F.get(F.filter(found, lambda x: rank(x["severity"]) == w), F.lit(0)))


def keep_first(found: Column, key) -> Column:
    """found without those whose key an earlier one has."""
    return F.filter(found, lambda x, i: ~F.exists(F.slice(found, F.lit(1), i), lambda y: key(y) == key(x)))


def downrank(found: Column) -> Column:
    """Findings in quoted text count as LOW; concealed ones keep their severity."""
    return F.transform(found, lambda x: x.withField("severity", F.when(x["mark"] == 1, "LOW").otherwise(x["severity"])))
