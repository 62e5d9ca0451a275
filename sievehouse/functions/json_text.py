"""What a model reads of a JSON value: its texts, harvested by a fold over tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .brackets import DOUBLE

_TOKEN = f"{DOUBLE}|[{{}}\\[\\]:,]|[^\\s\"{{}}\\[\\]:,]++"
#: Levels that are looked into, characters after which nothing more is entered, and the key whose value is no prose.
MOST_DEPTH, MOST_CHARS, BINARY = 12, 256 * 1024, "blob"


def unquoted(token: Column) -> Column:
    """The text of a JSON string literal."""
    plain = F.substring(token, F.lit(2), F.length(token) - 2)
    return F.when(F.contains(token, F.lit("\\")), F.from_json(F.concat(F.lit("["), token, F.lit("]")), "array<string>")[0]).otherwise(plain)


def texts_of(value: Column, depth: int = MOST_DEPTH, chars: int = MOST_CHARS) -> Column:
    """The texts of a JSON value in the order in which they stand, joined by
    newlines; names of fields are none, and what is below `blob` isn't prose.

    Values deeper than `depth` aren't entered, nor is anything once more than
    `chars` characters were read, but the texts of an object that was entered
    are all read. Null and broken JSON have none. The fold holds the open
    brackets and what was read; a document is one row and nothing is shuffled."""
    start = F.struct(
        F.lit("").alias("open"), F.lit(0).alias("skip"), F.lit(False).alias("key"), F.lit(False).alias("blob"), F.lit("").alias("out"), F.lit(0).alias("chars"), F.lit(False).alias("any"),
    )

    def step(s: Column, t: Column) -> Column:
        level = F.length(s["open"])
        in_object = F.right(s["open"], F.lit(1)) == "{"
        opens, closes, text = t.isin("{", "["), t.isin("}", "]"), F.startswith(t, F.lit('"'))
        is_key = text & in_object & s["key"]
        skipping, over = s["skip"] > 0, s["chars"] > chars
        blocked = s["blob"] | (level > depth) | over
        skip = (
            F.when(opens & ~skipping & blocked, level + 1).when(closes & (s["skip"] == level), 0).otherwise(s["skip"])
        )
        read = text & ~is_key & ~skipping & ~s["blob"] & (in_object | ((level <= depth) & ~over))
        said = F.when(read, unquoted(t)).otherwise("")
        open_ = F.when(opens, F.concat(s["open"], t)).when(closes, F.left(s["open"], level - 1)).otherwise(s["open"])
        return F.struct(
            open_.alias("open"), skip.alias("skip"), F.when(opens, t == "{").when(t == ",", in_object).when(t == ":", False).otherwise(s["key"]).alias("key"),
            F.when(is_key, t == f'"{BINARY}"').when(t == ":", s["blob"]).otherwise(False).alias("blob"),
            F.when(read, F.concat(s["out"], F.when(s["any"], "\n").otherwise(""), said)).otherwise(s["out"]).alias("out"), (s["chars"] + F.length(said)).alias("chars"), (s["any"] | read).alias("any"),
        )

    valid = F.try_parse_json(value).isNotNull()
    folded = F.aggregate(F.regexp_extract_all(value, F.lit(_TOKEN), F.lit(0)), start, step, lambda s: s["out"])
    return F.when(valid, folded).otherwise("")


def compact(value: Column, chars: int = 20_000) -> Column:
    """A JSON value's text cut to so many characters; empty for null."""
    return F.left(F.coalesce(value, F.lit("")), F.lit(chars))


def descriptor_text(entry: Column, method: Column) -> Column:
    """What an entry of a listing puts before the model: its name, titles and
    descriptions, and of tools the annotations and the schema of the input,
    names of parameters included. Empty parts are left out."""
    field = lambda k: F.coalesce(F.get_json_object(entry, f"$.{k}"), F.lit(""))
    whole = lambda k: compact(F.get_json_object(entry, f"$.{k}"))
    tool = F.array(field("name"), field("description"), whole("annotations"), whole("inputSchema"))
    other = F.array(field("name"), field("title"), field("description"), field("uri"), field("uriTemplate"), whole("arguments"))
    return F.array_join(F.filter(F.when(method == "tools/list", tool).otherwise(other), lambda x: x != ""), "\n")
