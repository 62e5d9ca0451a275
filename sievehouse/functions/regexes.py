"""Patterns are kept in one neutral dialect and rewritten for each engine.

In the neutral dialect a word boundary is ASCII, a dollar stands for the very
end of the text, and letters fold by ASCII only. Java reads both of the first
two otherwise, so they are rewritten here and nowhere else.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BOUNDARY = "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def java(pattern: str, ignore_case: bool = False) -> str:
    """The pattern for Spark's rlike and regexp functions."""
    out, i, in_class = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            pair = pattern[i : i + 2]
            out.append(_BOUNDARY if pair == "\\b" and not in_class else pair)
            i += 2
            continue
        if in_class and c == "[":
            out.append("\\[")
        elif c == "$" and not in_class:
            out.append("\\z")
        else:
            out.append(c)
        in_class = c == "[" or in_class and c != "]"
        i += 1
    return ("(?i)" if ignore_case else "") + "".join(out)


def re2(pattern: str, ignore_case: bool = False) -> str:
    """The pattern as a DuckDB string literal's content; None-safe use is up to the caller: RE2 has no lookaround."""
    return (("(?i)" if ignore_case else "") + pattern).replace("'", "''")


def portable(pattern: str) -> bool:
    """Whether RE2 can compile the pattern: no lookaround, no backreference."""
    return not any(x in pattern for x in ("(?=", "(?!", "(?<=", "(?<!", "\\1"))


def holds(low: Column, needs: tuple[tuple[str, ...], ...]) -> Column:
    """Whether a lower-cased text holds one literal of each group. Plain search
    is many times faster than a pattern, so it goes before one."""
    out = None
    for group in needs:
        some = None
        for x in group:
            some = F.contains(low, F.lit(x)) if some is None else some | F.contains(low, F.lit(x))
        out = some if out is None else out & some
    return F.lit(True) if out is None else out


def matches(text: Column, pattern: str, ignore_case: bool = False) -> Column:
    return text.rlike(java(pattern, ignore_case))


def first(text: Column, pattern: str, ignore_case: bool = False, group: int = 0) -> Column:
    """The first match, empty if there is none."""
    return F.regexp_extract(text, java(pattern if group else f"({pattern})", ignore_case), group or 1)


def before_first(text: Column, pattern: str, ignore_case: bool = False) -> Column:
    """The text before the first match (all of it without a match)."""
    return F.split(text, java(pattern, ignore_case), 2)[0]


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once a row, also inside lambdas."""
    return F.transform(F.array(value), body)[0]
