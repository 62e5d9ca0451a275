"""Texts read by their brackets and string literals, as folds over tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .regexes import let

#: String literals of the three quotes; loops are possessive, as Java's others recurse.
SINGLE, DOUBLE, BACKTICK = (q + f"[^{q}\\\\]*+(?:\\\\[\\s\\S][^{q}\\\\]*+)*+" + q for q in "'\"`")
LITERAL = f"{SINGLE}|{DOUBLE}|{BACKTICK}"
#: A literal, a quote that nothing closes with all after it, a bracket, or a run of anything else.
TOKEN = f"{LITERAL}|['\"`][\\s\\S]*+|[()\\[\\]{{}}]|[^'\"`()\\[\\]{{}}]++"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def in_literal(prefix: Column) -> Column:
    """Whether the text after a prefix of a source is inside a string literal.

    The three quotes open literals, or, three times the same, long ones; both
    go on over lines and heed backslashes. Outside of them a # hides the rest
    of its line. Null is not inside."""
    loop = lambda q: f"[^{q}\\\\]*+(?:(?:\\\\[\\s\\S]|{q}(?!{q}{q}))[^{q}\\\\]*+)*+"
    long = "|".join(f"{3 * q}{loop(q)}{3 * q}" for q in "'\"`")
    short = "|".join(f"(?!{3 * q}){x}" for q, x in zip("'\"`", (SINGLE, DOUBLE, BACKTICK), strict=True))
    rest = F.regexp_replace(prefix, f"#[^\\n]*+|{long}|{short}", "")
    return F.coalesce(rest.rlike("['\"`]"), F.lit(False))


def first_call(text: Column) -> Column:
    """What stands between the first ( of a text and the bracket that closes
    it; literals hide theirs. Empty where nothing closes it, or without any."""
    rest = F.when(F.instr(text, "(") > 0, F.substring(text, F.instr(text, "("), F.length(text))).otherwise("")

    def inside(parts: Column) -> Column:
        start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("n"), F.lit(0).alias("end"))

        def step(s: Column, t: Column) -> Column:
            depth = s["depth"] + F.when(t == "(", 1).when(t == ")", -1).otherwise(0)
            return F.struct(depth.alias("depth"), (s["n"] + 1).alias("n"), F.when((s["end"] == 0) & (depth == 0), s["n"] + 1).otherwise(s["end"]).alias("end"))

        return F.aggregate(parts, start, step, lambda s: F.when(s["end"] > 2, F.array_join(F.slice(parts, F.lit(2), F.greatest(s["end"] - 2, F.lit(0))), "")).otherwise(""))

    return let(tokens(rest), inside)


def has_top_comma(text: Column) -> Column:
    """Whether a comma stands outside of all brackets and literals."""
    start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("found"))

    def step(s: Column, t: Column) -> Column:
        depth = s["depth"] + F.when(t.isin("(", "[", "{"), 1).when(t.isin(")", "]", "}"), -1).otherwise(0)
        here = (s["depth"] == 0) & F.contains(t, F.lit(",")) & ~t.rlike("^['\"`]")
        return F.struct(depth.alias("depth"), (s["found"] | here).alias("found"))

    return F.aggregate(tokens(text), start, step, lambda s: s["found"])


def indented_json(text: Column, by: int = 2) -> Column:
    """A compact JSON text with line breaks and indentation; empty objects and arrays stay closed."""
    parts = F.regexp_extract_all(text, F.lit(f"{DOUBLE}|[{{}}\\[\\]:,]|[^\\s\"{{}}\\[\\]:,]++"), F.lit(0))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("depth"), F.lit(",").alias("last"))

    def step(s: Column, t: Column) -> Column:
        opens, closes = t.isin("{", "["), t.isin("}", "]")
        after_open = s["last"].isin("{", "[")
        depth = s["depth"] + F.when(opens, 1).when(closes, -1).otherwise(0)
        line = lambda n: F.concat(F.lit("\n"), F.repeat(F.lit(" " * by), n))
        before = (
            F.when(t == ",", "").when(t == ":", "").when(closes, F.when(after_open, "").otherwise(line(depth)))
            .when(s["last"] == ":", " ").when(s["out"] == "", "").otherwise(line(s["depth"]))
        )
        return F.struct(F.concat(s["out"], before, t).alias("out"), depth.alias("depth"), t.alias("last"))

    return F.aggregate(parts, start, step, lambda s: s["out"])
