"""What a repository says of findings: baselines, ignore rules, markers in texts, thresholds."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.regexes import let
from ..functions.text import lines_of
from . import findings as FN

MARKER = "scan-ignore"
FIRST_LINES = 5
_LEVELS = {"critical": 5, "high": 4, "medium": 3, "low": 2, "none": 99}


def finding_key(path: Column, category: Column, label: Column) -> Column:
    """A key of a finding that doesn't change when lines move."""
    return F.sha2(F.to_json(F.struct(path.alias("p"), category.alias("c"), label.alias("l"))), 256)


def since_baseline(found: DataFrame, baseline: DataFrame) -> DataFrame:
    """found (path, category, label, ...) without the findings of the same key in baseline."""
    key = finding_key(F.col("path"), F.col("category"), F.col("label"))
    return found.withColumn("__key", key).join(baseline.select(key.alias("__key")).distinct(), "__key", "left_anti").drop("__key")


def glob_pattern(glob: str) -> str:
    """A pattern of a glob: ** is any path, * any part of a name, ? one
    character. A glob without a slash fits a name in any folder, and one that
    ends in a slash all below a folder."""
    body = glob.strip() + ("**" if glob.strip().endswith("/") else "")
    out = "" if "/" in body.rstrip("*/") else "(?:.*/)?"
    for piece in re.findall(r"\*\*/|\*\*|\*|\?|[^*?]+", body.removeprefix("/")):
        out += {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(piece) or re.sub(r"([^A-Za-z0-9/_-])", r"\\\1", piece)
    return f"^{out}\\z"


def ignored(path: Column, label: Column, rules: list[str]) -> Column:
    """Whether a rule, `glob` or `glob :: part of a title`, names a finding. Blank rules and those that begin with # are none."""
    out = F.lit(False)
    for rule in rules:
        if rule.strip() and not rule.lstrip().startswith("#"):
            glob, _, title = (x.strip() for x in rule.partition("::"))
            hit = path.rlike(glob_pattern(glob))
            out = out | (hit & F.contains(F.lower(label), F.lit(title.lower())) if title else hit)
    return F.coalesce(out, F.lit(False))


def unmarked(found: Column, text: Column, marker: str = MARKER) -> Column:
    """The findings of a text but those on a line with the marker or on the
    line below one; none if one of the first lines opts the whole text out."""
    whole = marker + "-file"
    lines = lines_of(text)
    opted = F.exists(F.slice(lines, 1, FIRST_LINES), lambda x: F.contains(x, F.lit(whole)))
    on = lambda n: F.coalesce(F.contains(F.replace(F.get(lines, n), F.lit(whole), F.lit("")), F.lit(marker)), F.lit(False))
    kept = F.filter(found, lambda x: ~F.coalesce(on(x["line"] - 1) | on(x["line"] - 2), F.lit(False)))
    return F.when(~F.contains(text, F.lit(marker)) | text.isNull(), found).when(opted, FN.none()).otherwise(kept)


def policy_verdict(found: Column, block: str = "critical", flag: str = "high", allow: tuple[str, ...] = ()) -> Column:
    """The verdict by thresholds of severity; findings whose label holds a part in allow don't count."""
    def counts(x: Column) -> Column:
        out = F.lit(True)
        for part in allow:
            out = out & ~F.contains(F.lower(x["label"]), F.lit(part.lower()))
        return out

    worst = F.coalesce(F.array_max(F.transform(F.filter(found, counts), lambda x: FN.rank(x["severity"]))), F.lit(0))
    return F.when(worst >= _LEVELS[block], "BLOCK").when(worst >= _LEVELS[flag], "FLAG").otherwise("ALLOW")


def stricter(a: Column, b: Column) -> Column:
    """The stricter of two verdicts; null counts as none."""
    return F.when((a == "BLOCK") | (b == "BLOCK"), "BLOCK").when((a == "FLAG") | (b == "FLAG"), "FLAG").otherwise(F.coalesce(a, b))


def totals(verdicts: DataFrame, verdict: str = "verdict") -> DataFrame:
    """One row (scanned, blocked, flagged) of a batch."""
    v = F.col(verdict)
    return verdicts.agg(F.count("*").alias("scanned"), F.count_if(v == "BLOCK").alias("blocked"), F.count_if(v == "FLAG").alias("flagged"))


def _glob_columns(glob: Column) -> tuple[Column, Column, Column]:
    """(pattern, folder, name) of a glob: glob_pattern as a column, the folder
    that every match lies below, as far as the glob spells it out, and what it
    spells out of a match's name: all of it (=), its begin (<), its end (>) or nothing (empty)."""
    body = F.concat(glob, F.when(F.endswith(glob, F.lit("/")), "**").otherwise(""))
    anchored = F.contains(F.regexp_replace(body, "[*/]+\\z", ""), F.lit("/"))
    inner = F.regexp_replace(body, "^/", "")
    piece = lambda t: (
        F.when(t == "**/", "(?:.*/)?").when(t == "**", ".*").when(t == "*", "[^/]*").when(t == "?", "[^/]").otherwise(F.regexp_replace(t, "([^A-Za-z0-9/_-])", "\\\\$1"))
    )
    pieces = F.regexp_extract_all(inner, F.lit("\\*\\*/|\\*\\*|\\*|\\?|[^*?]+"), F.lit(0))
    pattern = F.concat(F.lit("^"), F.when(anchored, "").otherwise("(?:.*/)?"), F.array_join(F.transform(pieces, piece), ""), F.lit("\\z"))
    folder = F.regexp_extract(inner, "^([^*?]*)/", 1)
    last = F.regexp_extract(inner, "([^/]*)\\z", 1)
    head = F.left(inner, F.length(inner) - F.length(last))
    begins = head.rlike("^([\\s\\S]*[^*]/)?(\\*\\*/)*\\z")  # else a ** before the last slash may end within a name
    begin, end = F.regexp_extract(last, "^([^*?]*)", 1), F.regexp_extract(last, "([^*?]*)\\z", 1)
    name = (
        F.when(begins & (last != "") & (begin == last), F.concat(F.lit("="), last))
        .when(begins & (begin != "") & ~F.contains(last, F.lit("**")), F.concat(F.lit("<"), begin))
        .when(end != "", F.concat(F.lit(">"), end)).otherwise("")
    )
    return pattern, F.when(anchored, folder).otherwise(""), name


def _name_keys(path: Column) -> Column:
    """All names of _glob_columns that a path may answer to."""
    def keys(base: Column) -> Column:
        size = F.length(base)
        some = F.when(size > 0, F.sequence(F.lit(1), size)).otherwise(F.array().cast("array<int>"))
        return F.concat(
            F.array(F.lit(""), F.concat(F.lit("="), base)),
            F.transform(some, lambda n: F.concat(F.lit("<"), F.left(base, n))), F.transform(some, lambda n: F.concat(F.lit(">"), F.right(base, n))),
        )

    return let(F.regexp_extract(path, "([^/]*)\\z", 1), keys)


def ignore_rules(files: DataFrame, by: list[str], text: str = "text") -> DataFrame:
    """(by, pattern, folder, name, title) of the rules in ignore files (by, text), one
    a line, `glob` or `glob :: part of a title`. Blank lines, comments and null
    texts have none; a rule that several files state counts once."""
    lines = files.select(*by, F.explode(lines_of(F.col(text))).alias("rule")).withColumn("rule", F.trim(F.col("rule"), F.lit(" \t\r")))
    rules = lines.where((F.col("rule") != "") & ~F.col("rule").startswith("#"))
    glob, at = F.trim(F.split("rule", "::", 2)[0]), F.instr("rule", "::")
    title = F.when(at > 0, F.lower(F.trim(F.substring(F.col("rule"), at + 2, F.length("rule"))))).otherwise("")
    pattern, folder, name = _glob_columns(F.col("glob"))
    return rules.select(*by, glob.alias("glob"), title.alias("title")).select(*by, pattern.alias("pattern"), folder.alias("folder"), name.alias("name"), "title").distinct()


def without_ignored(found: DataFrame, rules: DataFrame, by: list[str]) -> DataFrame:
    """found (by, path, label, ...) without the findings that a rule of theirs
    names. Rules are data, not conditions of the plan: a path meets the rules
    whose folder is one of those above it and which spell out its name, or its
    begin or end, as far as they spell any, by an equality, and is then matched.
    So it doesn't meet all rules that hold in every folder. Null paths and labels are never ignored."""
    key, rest = [*by, "path", "label"], [c for c in found.columns if c not in (*by, "path", "label")]
    names = found.groupBy(*key).agg(F.collect_list(F.struct(F.lit(0).alias("__0"), *rest)).alias("__rows"))  # so that found is computed once
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    meets = F.flatten(F.transform(F.array_distinct(above), lambda x: F.transform(_name_keys(F.col("path")), lambda n: F.xxhash64(x, n))))
    near = names.select(*key, "__rows", F.posexplode_outer(F.when(F.col("path").isNotNull(), meets)).alias("__n", "__meets"))
    near = near.withColumn("__rows", F.when(F.coalesce("__n", F.lit(0)) == 0, F.col("__rows")))
    met = near.join(rules.withColumn("__meets", F.xxhash64("folder", "name")), [*by, "__meets"], "left")
    titled = (F.col("title") == "") | F.contains(F.lower("label"), F.col("title"))
    met = met.select(*key, "__rows", F.coalesce(F.col("label").isNotNull() & F.regexp_like("path", F.col("pattern")) & titled, F.lit(False)).alias("__hit")).where("__hit or __rows is not null")
    left = met.groupBy(*key).agg(F.bool_or("__hit").alias("__hit"), F.first("__rows", True).alias("__rows")).where("not __hit")
    return left.select(*key, F.explode("__rows").alias("__row")).select(*key, "__row.*").select(*found.columns)


def baseline_file(found: DataFrame, by: list[str]) -> DataFrame:
    """(by, text): a baseline of each repository's findings as JSON, their keys in order."""
    key = finding_key(F.col("path"), F.col("category"), F.col("label"))
    return found.groupBy(*by).agg(F.to_json(F.struct(F.array_sort(F.collect_set(key)).alias("findings"))).alias("text"))


def since_baseline_files(found: DataFrame, files: DataFrame, by: list[str], text: str = "text") -> DataFrame:
    """found without the findings whose keys the baseline files (by, text) of
    their repository list. Unreadable files list none."""
    listed = files.select(*by, F.explode(F.from_json(text, "findings array<string>")["findings"]).alias("__key")).distinct()
    keyed = found.withColumn("__key", finding_key(F.col("path"), F.col("category"), F.col("label")))
    return keyed.join(listed, [*by, "__key"], "left_anti").select(*found.columns)
