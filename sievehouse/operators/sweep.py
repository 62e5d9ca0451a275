"""Sweeps of folders: which directories are walked, what in them is active, and what fits in a report."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.files import IGNORED, without_comments
from .artifacts import MOST_ARTIFACTS
from .inventory import MOST_BUNDLED

# Bounds of a walk of working folders, of a walk of vendors' folders, and of a report.
MOST_DEPTH, MOST_WORK_DIRS, MOST_VENDOR_DIRS, MOST_BYTES = 6, 40_000, 4_000, 4_000_000
# Folders that no vendor's walk enters, catalogues of plugins, and trees that are catalogues whatever they hold.
VENDOR_IGNORED = [
    "node_modules", ".git", "dist", "build", "out", "coverage", "__pycache__", ".venv", "venv", "site-packages", ".next", ".turbo", "target",
    "projects", "todos", "statsig", "shell-snapshots", "history", "logs", "cache",
]
MARKETPLACE = "(^|/)plugins/marketplaces/([^/]+)/"
STAGED = "(?i)(^|/)(\\.tmp|tmp|temp|vendor_imports|bundled-marketplaces|backups?)/"
#: Files below a vendor's folder that say which plugins are installed, and the field that does.
INSTALLED = {"plugins/installed_plugins.json": "plugins", "settings.json": "enabledPlugins", "settings.local.json": "enabledPlugins"}


def walked_dirs(dirs: DataFrame, machine: str = "machine", root: str = "root", order: str = "ord", path: str = "path", most: int = MOST_WORK_DIRS, depth: int = MOST_DEPTH, ignored: list[str] = IGNORED) -> tuple[DataFrame, DataFrame]:
    """(walked, capped): the directories that a bounded breadth-first walk of
    each machine's roots visits, and the machines whose budget is used up.

    dirs is (machine, root, ord, path): every directory at or below a root,
    once for each root it is below; ord is the root's place. A directory counts
    if it lies at most `depth` levels down and no folder between the root and
    it is ignored; its depth and place are added. One that several roots reach
    is the first root's, by ord and then name. Roots go in order, then levels, then names: a parent is
    before its children, so the first `most` are whole walks. Spark ranks only
    `most` rows a machine before it moves them. Null paths are left out."""
    below = F.substring(F.col(path), F.length(root) + 2, F.length(path))
    parts = F.when(F.col(path) == F.col(root), F.array().cast("array<string>")).otherwise(F.split(below, "/"))
    rows = dirs.where(F.col(path).isNotNull() & ((F.col(path) == F.col(root)) | F.col(path).startswith(F.concat(root, F.lit("/")))))
    rows = rows.select(machine, root, order, path, parts.alias("parts")).withColumn("depth", F.size("parts"))
    skip = F.array(*map(F.lit, ignored))
    rows = rows.where((F.col("depth") <= depth) & ~F.arrays_overlap(F.col("parts"), skip))
    first = rows.groupBy(machine, path).agg(F.min(F.struct(F.col(order).alias("ord"), F.col(root).alias("root"), "depth", "parts")).alias("f"))
    nth = F.row_number().over(W.partitionBy(machine).orderBy("f.ord", "f.root", "f.depth", "f.parts"))
    ranked = first.withColumn("place", nth).where(F.col("place") <= most)
    walked = ranked.select(machine, F.col("f.root").alias(root), path, F.col("f.depth").alias("depth"), "place")
    return walked, ranked.where(F.col("place") == most).select(machine, F.lit("walk-budget").alias("reason"))


def installed_marketplaces(files: DataFrame, by: list[str], path: str = "path", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """((by, known), (by, marketplace)) of vendors' folders (by).

    files holds, by folder, the paths below it and texts of all or some of the
    sources in INSTALLED. The marketplaces that any of them names are joined: of
    plugin@marketplace the part after the @, of other names the whole, and of
    an entry also its marketplace or else its source. known is false where a
    source is there but can't be read: then nothing can be ruled out, which is
    not the same as a folder whose sources name nothing. A null text is no source."""
    rows = files.where(F.col(path).isin(*INSTALLED) & F.col(text).isNotNull()).select(*by, F.col(path).alias("path"), without_comments(F.col(text)).alias("body"))
    rows = rows.withColumn("ok", F.try_parse_json("body").isNotNull())
    known = rows.groupBy(*by).agg(F.bool_and("ok").alias("known"))
    fields = F.from_json(F.when(F.col("ok"), F.col("body")), "plugins map<string,variant>, enabledPlugins map<string,variant>")
    is_list = F.col("path") == "plugins/installed_plugins.json"
    entries = rows.withColumn("s", fields).select(*by, is_list.alias("list"), F.explode(F.map_entries(F.when(is_list, F.col("s.plugins")).otherwise(F.col("s.enabledPlugins")))).alias("e"))
    key, value = F.col("e.key"), F.col("e.value")
    named = F.when(F.instr(key, "@") > 0, F.substring(key, F.instr(key, "@") + 1, F.length(key))).otherwise(key)
    quoted = lambda k: F.to_json(F.try_variant_get(value, f"$.{k}", "variant"))
    said = F.coalesce(F.nullif(quoted("marketplace"), F.lit("null")), F.nullif(quoted("source"), F.lit("null")))
    source = F.when(F.col("list") & said.startswith('"'), F.coalesce(F.try_variant_get(value, "$.marketplace", "string"), F.try_variant_get(value, "$.source", "string")))
    names = entries.select(*by, F.explode(F.array_compact(F.array(named, source))).alias("marketplace"))
    return known, names.distinct()


def activations(found: DataFrame, known: DataFrame, marketplaces: DataFrame, by: list[str], vendor: str = "vendor", path: str = "path") -> DataFrame:
    """found (by, vendor, path) with marketplace, catalogue and activation.

    What lies in a staged tree is available, and counted under vendor:tree.
    Below a catalogue of plugins it is active where its marketplace is
    installed, available where it isn't, and unknown where that can't be told;
    elsewhere it is active. catalogue is what an available one is counted under."""
    staged = F.nullif(F.lower(F.regexp_extract(path, STAGED, 2)), F.lit(""))
    market = F.when(staged.isNull(), F.nullif(F.regexp_extract(path, MARKETPLACE, 2), F.lit("")))
    rows = found.withColumns({"__staged": staged, "marketplace": market})
    there = marketplaces.withColumn("__there", F.lit(True))
    rows = rows.join(known.withColumnRenamed("known", "__known"), by, "left").join(there, [*by, "marketplace"], "left")
    state = (
        F.when(F.col("__staged").isNotNull(), "available").when(F.col("marketplace").isNull(), "active")
        .when(~F.coalesce("__known", F.lit(True)), "unknown").when(F.col("__there"), "active").otherwise("available")
    )
    label = F.when(F.col("__staged").isNotNull(), F.concat_ws(":", vendor, "__staged")).otherwise(F.col("marketplace"))
    rows = rows.withColumn("activation", state).withColumn("catalogue", F.when(F.col("activation") == "available", label))
    return rows.select(*found.columns, "marketplace", "catalogue", "activation")


def available_counts(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, catalogue, n) of what is available but not active; such files are counted, not listed."""
    return rows.where("activation = 'available'").groupBy(*by, "catalogue").agg(F.count("*").alias("n"))


def within_budgets(files: DataFrame, machine: str, bytes_: int = MOST_BYTES, artifacts: int = MOST_ARTIFACTS, bundled: int = MOST_BUNDLED) -> DataFrame:
    """files with outcome: kept, byte-budget, artifact-cap, bundle-cap, or null
    for what is passed over.

    files is (machine, skill, site, place, size, charge): artifacts have no
    skill, files that a skill brings along name its place; size is the file's,
    charge what reporting it takes of the budget, null for a file that is
    looked at but no artifact. A machine's artifacts go first, by site and
    place, then the files of each skill in order. A file larger than what is
    left is reported as left out, and smaller ones after it still fit. Once a
    machine has all its artifacts, the next file of each site is reported and
    the rest of the site passed over; a skill's likewise. Whether one fits
    depends on all before it, so a machine's narrow rows pass in order, a batch
    at a time, with three numbers as the state; machines are apart."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, left, count, group, in_group, closed = object(), 0, 0, None, 0, False
        for batch in batches:
            out = []
            for m, skill, site, size, charge in zip(*(batch[c].tolist() for c in ("__machine", "__skill", "site", "size", "charge")), strict=True):
                if m != now:
                    now, left, count, group = m, bytes_, 0, None
                if (skill, site) != group:
                    group, in_group, closed = (skill, site), 0, False
                full = in_group >= bundled if skill >= 0 else count >= artifacts
                if closed or (pd.isna(charge) and not full):
                    out.append(None)
                elif full:
                    closed = True
                    out.append("bundle-cap" if skill >= 0 else "artifact-cap")
                elif size > left:
                    out.append("byte-budget")
                else:
                    left -= charge
                    in_group += 1
                    count += skill < 0
                    out.append("kept")
            yield batch.drop(columns=["__machine", "__skill"]).assign(outcome=out)

    rows = files.withColumns({"__machine": F.to_json(F.struct(machine)), "__skill": F.coalesce("skill", F.lit(-1)).cast("bigint")})
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields)
    return rows.repartition("__machine").sortWithinPartitions("__machine", "__skill", "site", "place").mapInPandas(run, fields + ", outcome string")


def capped_rows(rows: DataFrame, machine: str) -> DataFrame:
    """(machine, reason, path) of what within_budgets left out for a reason."""
    return rows.where("outcome is not null and outcome != 'kept'").select(machine, F.col("outcome").alias("reason"), "path")


def unread(path: Column) -> Column:
    """Whether a file that a skill brings along is reported by its path alone: its extension is no text's."""
    return ~F.lower(F.regexp_extract(F.substring_index(path, "/", -1), "\\.([^.]*)\\z", 1)).isin(*TEXTS)


# Extensions of files whose text is reported.
TEXTS = [
    "md", "mdc", "markdown", "txt", "toml", "json", "jsonc", "yaml", "yml", "sh", "bash", "zsh", "ps1", "bat", "cmd", "py", "js", "mjs", "cjs", "ts",
    "rb", "pl", "lua", "sql", "env", "cfg", "ini", "conf",
]
