"""Frontmatter of instruction files, read line by line as a fold."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .regexes import let

BLOCK = "^\\x{FEFF}?---\\r?\\n([\\s\\S]*?)\\r?\\n---\\r?\\n?"
_ITEM, _FIELD = "^\\s*-\\s+(.*)\\z", "^([A-Za-z0-9_.-]+)\\s*:\\s*(.*)\\z"
_VALUE = "struct<one:string,many:array<string>>"


def _bare(text: Column) -> Column:
    return F.regexp_replace(text, "^[\"']|[\"']\\z", "")


def as_list(text: Column) -> Column:
    """The entries of a list on one line, in brackets or without."""
    parts = F.split(F.regexp_replace(text, "^\\[|\\]\\z", ""), "[,\\n]+")
    return F.filter(F.transform(parts, lambda t: F.trim(_bare(t), F.lit(" \t\r\n"))), lambda t: t != "")


def frontmatter(text: Column) -> Column:
    """map of name to (one, many): a field's value, or its entries if it is a
    list in brackets or of lines that begin with a dash; both null for a field
    without a value.

    Blank lines and comments are passed over, and so is what is neither a field
    nor an entry, such as deeper levels; a later field of a name takes the place
    of the earlier one, unless it is empty. A byte-order mark may stand first.
    Texts without a frontmatter, and nulls, have an empty map."""
    block = F.regexp_extract(F.coalesce(text, F.lit("")), BLOCK, 1)
    lines = F.filter(F.split(block, "\\r?\\n"), lambda x: ~x.rlike("^\\s*(#|\\z)"))
    empty = F.create_map().cast(f"map<string,{_VALUE}>")
    start = F.struct(F.lit(None).cast("string").alias("key"), empty.alias("data"))

    def put(data: Column, key: Column, one: Column, many: Column) -> Column:
        value = F.struct(one.cast("string").alias("one"), many.cast("array<string>").alias("many"))
        return F.map_concat(F.map_filter(data, lambda k, _: k != key), F.create_map(key, value))

    def step(s: Column, line: Column) -> Column:
        item, name = line.rlike(_ITEM) & s["key"].isNotNull(), F.regexp_extract(line, _FIELD, 1)
        value = F.trim(F.regexp_extract(line, _FIELD, 2), F.lit(" \t\r\n"))
        entry = _bare(F.trim(F.regexp_extract(line, _ITEM, 1), F.lit(" \t\r\n")))
        # A field never has the empty name, so it is safe to look it up where a line is none.
        before, known = F.try_element_at(s["data"], F.coalesce(s["key"], F.lit(""))), F.try_element_at(s["data"], name)
        listed = F.array_append(F.coalesce(before["many"], F.array().cast("array<string>")), entry)
        no_list, no_value = F.lit(None).cast("array<string>"), F.lit(None).cast("string")
        as_field = (
            F.when(value == "", put(s["data"], name, known["one"], known["many"])).when(value.startswith("["), put(s["data"], name, no_value, as_list(value)))
            .otherwise(put(s["data"], name, _bare(value), no_list))
        )
        return (
            F.when(item, F.struct(s["key"].alias("key"), put(s["data"], F.coalesce(s["key"], F.lit("")), no_value, listed).alias("data")))
            .when(name != "", F.struct(name.alias("key"), as_field.alias("data"))).otherwise(s)
        )

    return let(lines, lambda each: F.aggregate(each, start, step, lambda s: s["data"]))


def entries(data: Column, name: str) -> Column:
    """The entries of a field of frontmatter: of a list its own, of a value what commas part."""
    v = F.try_element_at(data, F.lit(name))
    listed = F.filter(F.transform(v["many"], lambda t: F.trim(t, F.lit(" \t\r\n"))), lambda t: t != "")
    return F.coalesce(listed, as_list(v["one"]), F.array().cast("array<string>"))
