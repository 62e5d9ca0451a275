"""Modules that scripts load by a computed name, and which of those names are fixed paths all the same."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.brackets import BACKTICK, DOUBLE, SINGLE, first_call, has_top_comma
from ..functions.regexes import java, let

# The rule, declarations that look like a call, the path module's names and its pure builders.
DYNAMIC = r"""(?<![.\w])require\s*\(\s*[^'"\s)]|(?<![.\w])import\s*\(\s*[^'"\s)]"""
_DECLARED = r"\b(?:function|async|get|set|static|private|public|protected|readonly)\s*\*?\s*$"
_PATH_MODULE = r"""['"](?:node:)?path(?:/(?:posix|win32))?['"]"""
_BINDING = rf"(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*require\(\s*{_PATH_MODULE}\s*\)|import\s+(?:\*\s+as\s+)?([A-Za-z_$][\w$]*)\s+from\s*{_PATH_MODULE}"
_CONSTANT = r"(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*([^\n;]+)"
_PATHISH = r"__dirname|__filename|import\.meta\.url|process\.cwd|os\.(?:homedir|tmpdir)|fileURLToPath|new\s+URL|\.(?:join|resolve|normalize)\s*\("
_BUILDERS = "join|resolve|normalize|relative|dirname|basename|extname"
_FIXED = r"__dirname|__filename|import\.meta\.url|process\.cwd|os\.(?:homedir|tmpdir)|fileURLToPath|require\.resolve|new\s+URL|String\.raw"
_MEMBERS = r"\.(?:href|pathname|toString|toLowerCase|toUpperCase|trim|normalize|valueOf)\b"
#: How far before a match a declaration is looked for.
_BEFORE = 24


def _names_pattern(names: Column) -> Column:
    return F.array_join(F.transform(names, lambda n: F.replace(n, F.lit("$"), F.lit("\\$"))), "|")


def path_names(text: Column) -> Column:
    """The names that a script binds the path module to; path itself always is one."""
    found = F.regexp_extract_all(text, F.lit(java(_BINDING)), F.lit(0))
    names = F.transform(found, lambda m: F.coalesce(F.nullif(F.regexp_extract(m, java(_BINDING), 1), F.lit("")), F.regexp_extract(m, java(_BINDING), 2)))
    return F.array_union(F.array(F.lit("path")), F.coalesce(names, F.array().cast("array<string>")))


def is_fixed_path(argument: Column, paths: Column, constants: Column) -> Column:
    """Whether an expression is one fixed path: nothing with a name is left
    once literals, builders of paths and constants are taken out. Of a template
    literal the expressions in it count. Empty arguments aren't."""
    template = F.regexp_extract_all(argument, F.lit(f"{BACKTICK}|[^`]++|`"), F.lit(0))
    opened = F.array_join(F.transform(template, lambda t: F.when(
        t.rlike("^`[\\s\\S]*`\\z") & (F.length(t) > 1), F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(t, F.lit("\\$\\{([^{}]*)\\}"), F.lit(1)), " , "), F.lit(" "))).otherwise(t)), "")
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(opened, SINGLE, " "), DOUBLE, " "), java(_MEMBERS), " ")
    edge = java(r"\b")
    tokens = F.concat(
        F.lit(f"{edge}(?:(?:"), _names_pattern(paths), F.lit(f")(?:\\.(?:posix|win32))?\\.(?:{_BUILDERS})|{_FIXED}"),
        F.when(F.size(constants) > 0, F.concat(F.lit("|"), _names_pattern(constants))).otherwise(""), F.lit(f"){edge}"),
    )
    left = F.regexp_replace(bare, tokens, F.lit(" "))
    return ~left.rlike("[A-Za-z0-9_$]") & F.coalesce(F.trim(argument) != "", F.lit(False))


def constant_paths(text: Column, paths: Column) -> Column:
    """The names that a script declares as fixed paths. A declaration counts if
    it mentions a path or a constant found before it, so a plain text under a
    name hides nothing. Two passes, as one may stand before what it builds on."""
    found = F.regexp_extract_all(text, F.lit(java(_CONSTANT)), F.lit(0))
    declared = F.transform(found, lambda m: F.struct(F.regexp_extract(m, java(_CONSTANT), 1).alias("name"), F.trim(F.regexp_replace(F.regexp_extract(m, java(_CONSTANT), 2), "[,;]\\s*\\z", "")).alias("value")))
    edge = java(r"\b")

    def step(known: Column, d: Column) -> Column:
        builds = (F.size(known) > 0) & F.regexp_like(d["value"], F.concat(F.lit(f"{edge}(?:"), F.when(F.size(known) > 0, _names_pattern(known)).otherwise("-"), F.lit(f"){edge}")))
        pathish = d["value"].rlike(java(_PATHISH))
        fixed = ~F.array_contains(known, d["name"]) & (pathish | builds) & is_fixed_path(d["value"], paths, known)
        return F.when(fixed, F.array_append(known, d["name"])).otherwise(known)

    return let(declared, lambda all_: F.aggregate(F.concat(all_, all_), F.array().cast("array<string>"), step))


def loads_nothing_hidden(statement: Column, prefix: Column, paths: Column, constants: Column) -> Column:
    """Whether a match of DYNAMIC after prefix is harmless: a declaration of
    that name, a call with several arguments (import takes them), or a fixed path."""
    rest = F.substring(statement, F.length(prefix) + 1, F.length(statement))
    declared = F.right(prefix, F.lit(_BEFORE)).rlike(java(_DECLARED))
    several = ~rest.rlike(java(r"^\s*import\b")) & has_top_comma(first_call(rest))
    return declared | several | is_fixed_path(first_call(rest), paths, constants)
