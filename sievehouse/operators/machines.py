"""Machines by what lies on them: tools and runtimes by their folders and processes, settings by vendor, roots of work."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.files import IGNORED

#: Paths are below a base: the home, the working folder, or a folder of applications' data.
# Fixed values: (kind, vendor, name, probes), a probe being (base, path); the first that exists is where a tool was found.
PROBES = [
    ("assistant", "cursor", "Cursor", [("home", ".cursor")]),
    ("assistant", "claude", "Claude Desktop", [("appdata", "Claude"), ("home", "Library/Application Support/Claude"), ("home", ".config/Claude")]),
    ("assistant", "windsurf", "Windsurf", [("home", ".codeium/windsurf")]),
    ("assistant", "continue", "Continue", [("home", ".continue")]),
    ("assistant", "zed", "Zed", [("home", ".config/zed"), ("home", "Library/Application Support/Zed")]),
    ("assistant", "cody", "Sourcegraph Cody", [("code-user", "globalStorage/sourcegraph.cody-ai")]),
    ("assistant", "copilot", "GitHub Copilot (VS Code)", [("code-user", "globalStorage/github.copilot"), ("code-user", "globalStorage/github.copilot-chat")]),
    ("assistant", "tabnine", "Tabnine", [("home", ".tabnine"), ("localappdata", "TabNine")]),
    ("local-runtime", "ollama", "Ollama", [("home", ".ollama"), ("localappdata", "Ollama")]),
    ("local-runtime", "lmstudio", "LM Studio", [("home", ".lmstudio"), ("home", ".cache/lm-studio"), ("localappdata", "LM Studio")]),
    ("local-runtime", "jan", "Jan", [("home", "jan"), ("home", ".jan"), ("appdata", "Jan")]),
    ("local-runtime", "gpt4all", "GPT4All", [("home", ".cache/gpt4all"), ("home", "Library/Application Support/nomic.ai/GPT4All"), ("localappdata", "nomic.ai/GPT4All")]),
    ("local-runtime", "huggingface", "Hugging Face cache", [("home", ".cache/huggingface"), ("hf-home", "hub")]),
    ("local-runtime", "localai", "LocalAI", [("home", ".localai")]),
    ("local-runtime", "textgen", "Text Generation WebUI", []),
    ("local-runtime", "vllm", "vLLM", []),
    ("autonomous", "claude-code", "Claude Code", [("home", ".claude.json"), ("home", ".claude")]),
    ("autonomous", "cursor", "Cursor", [("home", ".cursor")]),
    ("autonomous", "windsurf", "Windsurf", [("home", ".codeium/windsurf")]),
    ("autonomous", "gemini", "Gemini CLI", [("home", ".gemini")]),
    ("autonomous", "codex", "OpenAI Codex CLI", [("home", ".codex")]),
    ("autonomous", "copilot", "GitHub Copilot CLI", [("home", ".copilot")]),
    ("autonomous", "cline", "Cline", [("code-user", "globalStorage/saoudrizwan.claude-dev")]),
    ("autonomous", "roo", "Roo Code", [("code-user", "globalStorage/rooveterinaryinc.roo-cline")]),
    ("autonomous", "aider", "Aider", [("home", ".aider.conf.yml"), ("cwd", ".aider.conf.yml"), ("home", ".aider")]),
]
# Parts of the names of processes that a runtime runs as.
PROCESSES = {
    "ollama": ["ollama"], "lmstudio": ["lm studio", "lmstudio", "lms"], "jan": ["jan"], "gpt4all": ["gpt4all"], "localai": ["local-ai", "localai"],
    "textgen": ["text-generation", "oobabooga"], "vllm": ["vllm"],
}
# Fixed values: (vendor, base, path, scope) of the settings that each vendor reads, in the order read.
SOURCES = [
    ("claude-code", "home", ".claude/settings.json", "user"), ("claude-code", "home", ".claude.json", "user"), ("claude-code", "home", ".claude/settings.local.json", "user"),
    ("claude-code", "cwd", ".claude/settings.json", "project"), ("claude-code", "cwd", ".claude/settings.local.json", "project"),
    ("gemini", "home", ".gemini/settings.json", "user"), ("gemini", "cwd", ".gemini/settings.json", "project"),
    ("codex", "home", ".codex/config.json", "user"), ("codex", "home", ".codex/settings.json", "user"),
    ("cursor", "home", ".cursor/settings.json", "user"), ("cursor", "home", ".cursor/mcp.json", "user"), ("cursor", "cwd", ".cursor/mcp.json", "project"),
    ("cursor", "cwd", ".cursor/settings.json", "project"), ("cursor", "cursor-user", "User/settings.json", "user"),
    ("windsurf", "home", ".codeium/windsurf/settings.json", "user"), ("windsurf", "home", ".codeium/windsurf/mcp_config.json", "user"), ("windsurf", "cwd", ".windsurf/mcp.json", "project"),
    ("cline", "cline-storage", "settings/cline_mcp_settings.json", "user"), ("cline", "home", ".cline/settings.json", "user"),
    ("roo", "roo-storage", "settings/mcp_settings.json", "user"), ("roo", "cwd", ".roo/settings.json", "project"),
    ("copilot", "home", ".copilot/config.json", "user"),
]
# Folders of a home below which work is kept.
WORK = [
    "Desktop", "Documents", "source", "source/repos", "repos", "Repos", "projects", "Projects", "dev", "Dev", "Developer", "git", "Git", "code", "Code", "workspace", "Workspace",
    "work", "src", "go/src", "ghq", "OneDrive/Desktop", "OneDrive/Documents",
]
MOST_ROOTS = 500


def _probe_table(spark) -> DataFrame:
    rows = [(kind, vendor, name, base, path, i) for kind, vendor, name, probes in PROBES for i, (base, path) in enumerate(probes)]
    return spark.createDataFrame(rows, "kind string, vendor string, name string, base string, path string, ord int")


def installed_tools(paths: DataFrame, processes: DataFrame, machine: str = "machine") -> DataFrame:
    """(machine, kind, vendor, name, identifier, running) of the assistants,
    runtimes and autonomous tools on each machine.

    paths is (machine, base, path) of what exists, processes (machine, process).
    A tool is found at the first of its probes that exists; a runtime also by a
    process whose name, in any case, holds one of its parts, and is then named
    by its process alone. running is null for what isn't a runtime. The table of
    probes is a hundred rows, so Spark broadcasts it; repeated paths and
    processes count once, null ones not at all."""
    spark = paths.sparkSession
    found = paths.select(machine, "base", "path").join(_probe_table(spark), ["base", "path"])
    at = found.groupBy(machine, "kind", "vendor", "name").agg(F.min(F.struct("ord", "base", "path")).alias("at"))
    at = at.select(machine, "kind", "vendor", "name", F.concat_ws(":", "at.base", "at.path").alias("at"))
    low = F.lower(F.trim("process"))
    tokens = F.array(*[F.struct(F.lit(v).alias("vendor"), F.lit(t).alias("token")) for v, ts in PROCESSES.items() for t in ts])
    running = processes.select(machine, low.alias("p")).where("p != ''").distinct()
    running = running.select(machine, F.explode(F.filter(tokens, lambda t: F.contains(F.col("p"), t["token"]))["vendor"]).alias("vendor")).distinct()
    names = spark.createDataFrame([(v, n) for k, v, n, _ in PROBES if k == "local-runtime"], "vendor string, name string")
    running = running.join(names, "vendor").select(machine, F.lit("local-runtime").alias("kind"), "vendor", "name", F.lit(True).alias("runs"))
    both = at.join(running, [machine, "kind", "vendor", "name"], "full")
    state = F.when(F.col("kind") == "local-runtime", F.coalesce("runs", F.lit(False)))
    return both.select(machine, "kind", "vendor", "name", F.coalesce("at", F.concat(F.lit("proc:"), "vendor")).alias("identifier"), state.alias("running"))


def posture_sources(machines: DataFrame, files: DataFrame, machine: str = "machine") -> DataFrame:
    """(machine, vendor, ord, scope, path, text): the settings that each vendor
    reads on each machine, in the order read; text is null for what is absent.

    files is (machine, base, path, text). A machine is joined to the 22 sources
    by an expansion of its row, then to its files by an equality, so a source
    that isn't there is a row that says so, and merge_postures can tell what is
    known to be empty from what could not be read."""
    listed = F.array(*[F.struct(F.lit(v).alias("vendor"), F.lit(i).alias("ord"), F.lit(s).alias("scope"), F.lit(b).alias("base"), F.lit(p).alias("path")) for i, (v, b, p, s) in enumerate(SOURCES)])
    wanted = machines.select(machine).where(F.col(machine).isNotNull()).distinct().select(machine, F.explode(listed).alias("s")).select(machine, "s.*")
    return wanted.join(files.select(machine, "base", "path", "text"), [machine, "base", "path"], "left").select(machine, "vendor", "ord", "scope", F.concat_ws(":", "base", "path").alias("path"), "text")


def expanded_roots(given: DataFrame, dirs: DataFrame, homes: DataFrame, machine: str = "machine", most: int = MOST_ROOTS) -> DataFrame:
    """(machine, root, ord): the roots to walk on each machine: those given
    (machine, root, ord) in order, then the home (machine, home), then each
    folder of work below it that exists, with the folders in it, hidden and
    ignored ones left out, in order of names. dirs is (machine, path) of all
    directories. Each root counts once, where it comes first; `most` are kept."""
    places = F.array(*[F.struct(F.lit(i).alias("nth"), F.lit(w).alias("name")) for i, w in enumerate(WORK)])
    work = homes.select(machine, F.explode(places).alias("w"), "home").select(machine, F.col("w.nth").alias("nth"), F.concat("home", F.lit("/"), "w.name").alias("parent"))
    there = dirs.select(machine, "path").distinct()
    parents = work.join(there.withColumnRenamed("path", "parent"), [machine, "parent"])
    name, parent = F.substring_index("path", "/", -1), F.regexp_replace("path", "/[^/]*\\z", "")
    inside = there.where(~name.startswith(".") & ~name.isin(*IGNORED)).select(machine, parent.alias("parent"), "path").join(parents, [machine, "parent"])
    row = lambda df, stage, nth, sub, root: df.select(machine, F.struct(F.lit(stage).alias("stage"), nth.cast("int").alias("nth"), sub.cast("string").alias("sub")).alias("at"), root.alias("root"))
    no = F.lit("")
    all_ = (
        row(given, 0, F.col("ord"), no, F.col("root")).unionByName(row(homes, 1, F.lit(0), no, F.col("home")))
        .unionByName(row(parents, 2, F.col("nth"), no, F.col("parent"))).unionByName(row(inside, 2, F.col("nth"), F.col("path"), F.col("path")))
    )
    first = all_.where("root is not null").groupBy(machine, "root").agg(F.min("at").alias("at"))
    nth = F.row_number().over(W.partitionBy(machine).orderBy("at"))
    return first.withColumn("ord", nth).where(F.col("ord") <= most).select(machine, "root", "ord")
