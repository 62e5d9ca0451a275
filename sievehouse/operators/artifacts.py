"""Instructions, hooks and commands that assistants load from vendors' folders."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import wire
from ..functions.brackets import indented_json
from ..sources.files import without_comments

# Folders of vendors in a home (user) or a working folder (project).
ROOTS = [
    ("claude-code", "user", ".claude"), ("claude-code", "project", ".claude"), ("cursor", "user", ".cursor"), ("cursor", "project", ".cursor"),
    ("codex", "user", ".codex"), ("codex", "project", ".codex"), ("gemini", "user", ".gemini"), ("gemini", "project", ".gemini"),
    ("windsurf", "project", ".windsurf"), ("opencode", "user", ".opencode"), ("opencode", "project", ".opencode"), ("copilot", "project", ".github"),
]
SETTINGS = ["settings.json", "settings.local.json", "hooks.json", "config.toml"]
MOST_ARTIFACTS = 400

# Switches that approve without asking, by their name without separators, in the order tried.
SWITCHES = [
    ("yolo|yolomode|enableyolo", "YOLO mode", "CRITICAL"),
    ("autoapprove|alwaysallow|autoallow|autoaccept|autoconfirm", "auto-approve", "HIGH"),
    ("autorun|autoexecute|autoexec|runwithoutasking|executewithoutconfirmation", "auto-run commands", "CRITICAL"),
    ("skippermissions|bypasspermissions|disableapproval|noconfirm", "approval disabled", "CRITICAL"),
    ("autoapprovemcp|alwaysallowmcp|autotrustmcp|enableallprojectmcpservers", "MCP auto-trust", "HIGH"),
    ("alwaysallowreadonly|autoapproveread", "read auto-approve", "MEDIUM"),
    ("alwaysallowwrite|autoapprovewrite|autoacceptedits", "write auto-approve", "HIGH"),
]
MOST_DEPTH, MOST_SWITCHES = 6, 40
_SWITCH = {name: (label, severity) for names, label, severity in SWITCHES for name in names.split("|")}


def vendor_of_path(path: Column) -> Column:
    """The vendor whose folder a path lies in, else project."""
    out = F.lit("project")
    for vendor in ("zed", "gemini", "vscode", "cursor"):
        out = F.when(path.rlike(f"[\\\\/]\\.{vendor}[\\\\/]"), vendor).otherwise(out)
    return out


def extension(path: Column) -> Column:
    """The lower-cased extension; empty for names without one and names that only begin with a dot."""
    return F.regexp_extract(F.lower(F.substring_index(path, "/", -1)), "^.+\\.([^.]*)\\z", 1)


def artifact_kind(path: Column, vendor: Column) -> Column:
    """skill, hook, subagent, command or null, by where a file below a vendor's
    folder lies. Of the vendor copilot, commands are those below prompts or
    chat modes alone."""
    low = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    base, ext = F.substring_index(low, "/", -1), extension(low)
    command = low.rlike("(^|/)(commands?|prompts?|workflows?)/") & ext.isin("md", "toml")
    other = (vendor == "copilot") & ~low.rlike("(^|/)(prompts|chatmodes)/")
    return (
        F.when(base == "skill.md", "skill").when(base.isin(*SETTINGS), "hook").when(low.rlike("(^|/)(sub)?agents?/") & (ext == "md"), "subagent")
        .when(command, F.when(F.coalesce(other, F.lit(False)), None).otherwise("command")).when((vendor == "copilot") & low.rlike("(^|/)chatmodes/") & (ext == "md"), "subagent")
    )


def declared_name(text: Column) -> Column:
    """The name that a frontmatter declares, 120 characters at most, or null."""
    block = F.regexp_extract(text, "^---\\r?\\n([\\s\\S]*?)\\r?\\n---", 1)
    name = F.regexp_replace(F.trim(F.regexp_extract(block, "(?m)^name:\\s*(.+)$", 1)), "^[\"']|[\"']\\z", "")
    return F.nullif(F.left(name, F.lit(120)), F.lit(""))


def canonical_hooks(text: Column) -> Column:
    """The hooks of a settings document as the only field of a JSON text, in
    their own order and indented by two; null if it has none, or is no JSON
    object. Numbers stand as they were written."""
    bare = without_comments(text)
    hooks = F.when(F.try_parse_json(bare).isNotNull(), F.get_json_object(bare, "$.hooks"))
    return F.when(hooks.rlike("^[\\[{][^\\]}]"), indented_json(F.concat(F.lit('{"hooks":'), hooks, F.lit("}"))))


def canonical_grant(mode: Column, allow: Column, deny: Column, ask: Column, trust_all: Column) -> Column:
    """The smallest permission document of a posture as JSON; null if it grants nothing."""
    some = lambda a: F.when(F.size(a) > 0, a)
    permissions = F.struct(mode.alias("defaultMode"), some(allow).alias("allow"), some(deny).alias("deny"), some(ask).alias("ask"))
    has = mode.isNotNull() | (F.coalesce(F.size(allow), F.lit(0)) + F.coalesce(F.size(deny), F.lit(0)) + F.coalesce(F.size(ask), F.lit(0)) > 0)
    doc = F.to_json(F.struct(F.when(has, permissions).alias("permissions"), F.when(trust_all, True).alias("enableAllProjectMcpServers")))
    return F.nullif(doc, F.lit("{}"))


def artifacts(files: DataFrame) -> DataFrame:
    """files (path, vendor, text, ...) that are artifacts, with kind, name,
    artifact_path and content. Of settings files only the hooks are kept, and
    those without any are no artifacts, nor are files whose text is null. A
    name is declared, else taken from the path. Fields are clamped last."""
    kind = artifact_kind(F.col("path"), F.col("vendor"))
    rows = files.withColumn("kind", kind).where("kind is not null")
    rows = rows.withColumn("content", F.when(F.col("kind") == "hook", canonical_hooks(F.col("text"))).otherwise(F.col("text"))).where("content is not null")
    base = F.substring_index("path", "/", -1)
    folder = F.substring_index(F.regexp_replace("path", "/[^/]*\\z", ""), "/", -1)
    taken = F.when(F.col("kind") == "skill", folder).when(F.col("kind") == "hook", F.concat(base, F.lit(" · hooks"))).otherwise(F.regexp_replace(base, "(?i)\\.(md|toml)\\z", ""))
    caps = wire.ARTIFACT
    return rows.withColumns({
        "name": wire.clamp(F.left(F.coalesce(declared_name(F.col("content")), taken), F.lit(200)), caps["name"]),
        "artifact_path": wire.clamp(F.col("path"), caps["path"]), "content": F.left("content", F.lit(caps["content"])),
    })


def kind_counts(found: DataFrame) -> DataFrame:
    """(kind, n), the most frequent first, ties by kind."""
    return found.groupBy("kind").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "kind")


def cap_artifacts(found: DataFrame, machine: str, order: str, most: int = MOST_ARTIFACTS) -> tuple[DataFrame, DataFrame]:
    """(kept, capped): the first rows of each machine by order (unique in a
    machine), and (machine, reason, path) of the first row beyond them, one for
    each machine that was cut. Rows are limited before they are moved."""
    nth = F.row_number().over(W.partitionBy(machine).orderBy(order))
    ranked = found.withColumn("__nth", nth).where(F.col("__nth") <= most + 1)
    capped = ranked.where(F.col("__nth") == most + 1).select(machine, F.lit("artifact-cap").alias("reason"), "path")
    return ranked.where(F.col("__nth") <= most).drop("__nth"), capped


def _walk(node: object, depth: int, trail: str, out: list[dict]) -> None:
    if depth > MOST_DEPTH or len(out) >= MOST_SWITCHES:
        return
    pairs = node.items() if isinstance(node, dict) else enumerate(node)
    for key, value in pairs:
        where = f"{trail}.{key}" if trail else str(key)
        rule = _SWITCH.get("".join(c for c in str(key).split(".")[-1].lower() if not (c in "_-" or c.isspace())))
        listed = isinstance(value, list)
        if rule and (value is True or value in ("true", "always") or (listed and value)):
            out.append({"key": where, "label": rule[0], "severity": rule[1], "value": f"{len(value)} entries" if listed else str(value).lower()})
        if isinstance(value, (dict, list)):
            _walk(value, depth + 1, where, out)


_FOUND = T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("key", "label", "severity", "value")]))


@F.pandas_udf(_FOUND)
def _switches(texts: pd.Series) -> pd.Series:
    def one(text: str | None) -> list[dict]:
        out: list[dict] = []
        try:
            node = json.loads(text) if text else None
        except (ValueError, RecursionError):
            return out
        if isinstance(node, (dict, list)):
            _walk(node, 0, "", out)
        return out

    return texts.map(one)


def switches(text: Column) -> Column:
    """The switches of a settings document (comments allowed) that are on: key
    is the whole path, of at most seven levels; a document has 40 or a few more
    at most. Null and unreadable texts have none. Only texts that hold a
    switch's name, separators left out, are walked."""
    bare = F.lower(F.regexp_replace(text, "[_\\-\\s]", ""))
    near = bare.rlike("\"(?:[^\"]*\\.)?(?:" + "|".join(names for names, _, _ in SWITCHES) + ")\"") | F.contains(text, F.lit("\\u"))
    return F.coalesce(_switches(F.when(near, without_comments(text))), F.array().cast(_FOUND))
