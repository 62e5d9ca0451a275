"""Lines, places and masked regions of texts."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .regexes import let

LINE_BREAK = "\\r?\\n"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), LINE_BREAK)


def explode_lines(docs: DataFrame, text: str = "text", only: Column | None = None) -> DataFrame:
    """docs without its text, one row a line: line (from 1), line_text. A null
    text has one empty line. With only, the lines of the rows where it is true."""
    rest = [c for c in docs.columns if c not in (text, "line", "line_text")]
    return _one_a_line(docs, rest, lines_of(F.col(text)), only).select(*rest, F.col("line"), F.col("x").alias("line_text"))


def _one_a_line(docs: DataFrame, rest: list[str], lines: Column, only: Column | None) -> DataFrame:
    """(rest, line, x). The outer explode keeps Spark from cutting texts a second time, as a filter."""
    rows = docs.select(*rest, F.posexplode_outer(lines if only is None else F.when(only, lines)).alias("line", "x"))
    return (rows if only is None else rows.where("line is not null")).withColumn("line", F.col("line") + 1)


def line_after(prefix: Column) -> Column:
    """The 1-based line on which the text after prefix begins."""
    return F.length(prefix) - F.length(F.replace(prefix, F.lit("\n"), F.lit(""))) + 1


def context_lines(lines: Column, line: Column, around: int = 3, chars: int = 400) -> Column:
    """(start_line, snippet): the lines around a line, joined and clipped."""
    begin = F.greatest(F.lit(1), line - around)
    return F.struct(begin.alias("start_line"), F.left(F.array_join(F.slice(lines, begin, line + around - begin + 1), "\n"), F.lit(chars)).alias("snippet"))


def chunk_of(offset: Column, size: int = 1000) -> Column:
    """The ordinal of the fixed-size chunk that holds a 0-based offset."""
    return F.floor(offset / size).cast("int")


def fenced_lines(text: Column) -> Column:
    """Array of (line_text, in_fence) of a text's lines: whether a line
    delimits or is inside a fenced block. The lines between two delimiters are
    cut out together, so a long text costs no more than its length."""

    def cut(lines: Column, marks: Column) -> Column:
        def region(j: Column) -> Column:
            begin, end = F.when(j == 0, 0).otherwise(F.get(marks, j - 1)), F.coalesce(F.get(marks, j), F.size(lines))
            return F.transform(F.slice(lines, begin + 1, end - begin), lambda x, i: F.struct(x.alias("line_text"), ((j % 2 == 1) | ((i == 0) & (j > 0))).alias("in_fence")))

        return F.flatten(F.transform(F.sequence(F.lit(0), F.size(marks)), region))

    mark = lambda x: F.trim(x).rlike("^(```|~~~)")
    marks = lambda lines: F.array_compact(F.transform(lines, lambda x, i: F.when(mark(x), i)))
    return let(lines_of(text), lambda lines: let(marks(lines), lambda m: cut(lines, m)))


def explode_fenced(docs: DataFrame, text: str = "text", only: Column | None = None) -> DataFrame:
    """explode_lines with in_fence; nothing is shuffled."""
    rest = [c for c in docs.columns if c not in (text, "line", "line_text", "in_fence")]
    return _one_a_line(docs, rest, fenced_lines(F.col(text)), only).select(*rest, "line", "x.line_text", "x.in_fence")


#: What opens a region that is not live text, and how each region ends. 1: quoted, 2: concealed from a reader.
_OPEN = re.compile(r"```|~~~|['\"`]|//|(?<!\S)#|/\*|<!--|/")
_QUOTED = {q: re.compile(rf"(?:\\.|[^\\{q}])*(?:{q}|\\?\Z)", re.S) for q in "'\"`"}
_PATTERN = re.compile(r"(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^\\/\[\n])*(?:/|\n|\Z)", re.S)
_BEFORE_PATTERN = frozenset("=(,[{;:!&|?+*~%^<>")


def mask_intervals(text: str) -> list[tuple[int, int, int]]:
    """(start, end, mark) of quoted text, comments, patterns and fenced blocks
    (mark 1) and of HTML comments (mark 2), in code points. Regions are found
    from left to right; one that never ends reaches to the end of the text."""
    out, at, last = [], 0, ""

    def until(needle: str, start: int) -> int:
        found = text.find(needle, start)
        return len(text) if found < 0 else found + len(needle)

    while m := _OPEN.search(text, at):
        begin, opener = m.span()[0], m.group()
        last = text[at:begin].rstrip()[-1:] or last
        end, mark = begin, 1
        if opener in ("```", "~~~"):
            nl = text.find("\n", begin)
            close = re.compile(r"\n[ \t]*" + re.escape(opener)).search(text, nl) if nl >= 0 else None
            end, last = close.end() if close else len(text), ""
        elif opener in _QUOTED:
            end, last = _QUOTED[opener].match(text, begin + 1).end(), opener
        elif opener in ("//", "#"):
            end = until("\n", begin)
        elif opener == "/*":
            end = until("*/", begin + 2)
        elif opener == "<!--":
            end, mark = until("-->", begin + 4), 2
        elif last in _BEFORE_PATTERN and last:
            end, last = _PATTERN.match(text, begin + 1).end(), "/"
        else:
            at, last = begin + 1, "/"
            continue
        out.append((begin, end, mark))
        at = end
    return out


_INTERVALS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("mark", T.IntegerType())]))


@F.pandas_udf(_INTERVALS)
def mask_of(texts: pd.Series) -> pd.Series:
    """Masked regions of each text; null for null, so callers pass only texts that have something to look up."""
    return texts.map(lambda t: None if t is None else [{"start": a, "end": b, "mark": m} for a, b, m in mask_intervals(t)])


def mark_at(mask: Column, offset: Column) -> Column:
    """0, 1 or 2: the mark of the region that holds an offset."""
    return F.coalesce(F.get(F.filter(mask, lambda r: (r["start"] <= offset) & (offset < r["end"])), F.lit(0))["mark"], F.lit(0))
