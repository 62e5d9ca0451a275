"""File trees as tables: which files matter, what they hold, and how reading went."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Folders that are never looked into, and names that route a file.
IGNORED = [
    "node_modules", ".git", ".hg", ".svn", "dist", "build", "out", ".next", ".nuxt", ".cache", ".venv", "venv", "env", "__pycache__", ".tox", "target", "vendor", "bin", "obj", ".gradle",
    ".idea", "coverage", ".pytest_cache", ".mypy_cache", "Pods", ".terraform", ".expo", "tmp", "temp", ".turbo", ".parcel-cache", ".svelte-kit", "bower_components", ".pnpm-store",
    "site-packages", ".yarn",
]
SERVERS, SERVER_SETTINGS, SERVER_FOLDERS = [".mcp.json", "mcp.json"], "settings.json", [".gemini", ".zed"]
MANIFESTS = ["package.json", "requirements.txt", "requirements-dev.txt", "pyproject.toml", "Pipfile", "environment.yml", "environment.yaml"]
RULES = [".cursorrules", ".windsurfrules", ".clinerules", ".roorules", ".aider.conf.yml", ".aider.conf.yaml", "AGENTS.md", "CLAUDE.md", "GEMINI.md", "copilot-instructions.md"]
ENVIRONMENT, SAMPLES = "^\\.env(\\..+)?\\z", "(?i)(example|sample|template|dist)"
VECTORS = ["index.faiss", "index.pkl", "chroma.sqlite3", "docstore.json", "default__vector_store.json", "chroma-embeddings.parquet", "chroma-collections.parquet"]
VECTOR_ENDS = "\\.(faiss|lance|usearch)\\z"
MOST_NAMES = 20


def name_of(path: Column) -> Column:
    return F.lower(F.substring_index(path, "/", -1))


def role_of(path: Column) -> Column:
    """mcp, rules, manifest, env, vector, source or null: the first that fits a
    file's name and folder. Names count as they are written, but for those of
    vector stores; samples of environment files are none."""
    base, parent = F.substring_index(path, "/", -1), F.regexp_extract(path, "([^/]*)/[^/]*\\z", 1)
    servers = base.isin(*SERVERS) | ((base == SERVER_SETTINGS) & parent.isin(*SERVER_FOLDERS))
    rules = base.isin(*RULES)
    misplaced = (base == "copilot-instructions.md") & (parent != ".github")
    return (
        F.when(servers, "mcp").when(rules, F.when(~misplaced, "rules")).when(base.isin(*MANIFESTS), "manifest")
        .when(base.rlike(ENVIRONMENT) & ~base.rlike(SAMPLES), "env").when(F.lower(base).isin(*VECTORS) | F.lower(base).rlike(VECTOR_ENDS), "vector")
        .when(F.lower(base).rlike("\\.(py|ipynb|[mc]?[jt]sx?|java|kt|go|rb|php|cs|rs|scala)\\z"), "source")
    )


def classify(files: DataFrame, most_bytes: int = 524_288, root: str = "") -> DataFrame:
    """(path, role, bytes, state, text) of the rows (path, content) that have a
    role, ignored folders below root left out. text is null where state is binary (it
    holds a NUL) or oversized, and that is not the same as an empty file."""
    below = F.substring(F.col("path"), F.instr("path", root) + len(root), F.length("path")) if root else F.col("path")
    hidden = below.rlike("/(?:" + "|".join(x.replace(".", "\\.") for x in IGNORED) + ")/")
    kept = files.where(~hidden).withColumn("role", role_of(F.col("path"))).where("role is not null")
    text = F.make_valid_utf8(F.col("content").cast("string"))
    size = F.octet_length("content")
    state = F.when(size > most_bytes, "oversized").when(F.contains(text, F.lit("\x00")), "binary").otherwise("read")
    return kept.select("path", "role", size.alias("bytes"), state.alias("state"), F.when(state == "read", text).alias("text"))


def read_tree(spark: SparkSession, root: str, most_bytes: int = 524_288) -> DataFrame:
    """The files under root, classified. Spark's readers pass over names that
    begin with a dot or an underscore; such files come in as a table (path,
    content) for classify."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return classify(files.select("path", "content"), most_bytes, root.rstrip("/"))


def without_comments(text: Column) -> Column:
    """JSON with comments as JSON; addresses keep their slashes."""
    return F.regexp_replace(F.regexp_replace(text, "/\\*[\\s\\S]*?\\*/", ""), "(^|[^:\"])//[^\\n]*", "$1")


def parse_json(text: Column, most_chars: int = 524_288) -> Column:
    """(state, json): absent, unreadable (too long or no JSON) or parsed."""
    value = F.try_parse_json(without_comments(text))
    state = F.when(text.isNull(), "absent").when((F.length(text) > most_chars) | value.isNull(), "unreadable").otherwise("parsed")
    return F.struct(state.alias("state"), F.when(state == "parsed", value).alias("json"))


def environment_entries(text: Column) -> Column:
    """Array of (name, value) of a file of assignments; comments are left out."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\\r?\\n"), lambda x: x.rlike("^\\s*(?:export\\s+)?[A-Z0-9_]+\\s*="))
    pattern = "^\\s*(?:export\\s+)?([A-Z0-9_]+)\\s*=\\s*(.*)\\z"
    clean = lambda v: F.regexp_replace(F.trim(v), "^[\"']|[\"']\\z", "")
    return F.transform(lines, lambda x: F.struct(F.regexp_extract(x, pattern, 1).alias("name"), clean(F.regexp_extract(x, pattern, 2)).alias("value")))


def vector_stores(files: DataFrame, path: str = "path") -> DataFrame:
    """(folder, engine, pickle_backed, files) of the folders that hold an index,
    with its first files by name: a pickled index counts only beside its data.
    Names are ranked before they are gathered. Null paths lie in no folder."""
    rows = files.select(F.regexp_replace(path, "/[^/]*\\z", "").alias("folder"), name_of(F.col(path)).alias("name"))
    rows = rows.where((F.col("name").isin(*VECTORS) | F.col("name").rlike(VECTOR_ENDS)) & F.col("folder").isNotNull()).distinct()
    name = F.col("name")
    has = lambda c: F.bool_or(c)
    engine = (
        F.when(has((name == "chroma.sqlite3") | name.startswith("chroma-")), "chroma").when(has(name == "index.faiss"), "faiss").when(has(name.endswith(".lance")), "lancedb")
        .when(has(name.endswith(".usearch")), "usearch").when(has(name.isin("docstore.json", "default__vector_store.json")), "llamaindex")
    )
    engines = rows.groupBy("folder").agg(engine.alias("engine"), has(name == "index.pkl").alias("__pickle")).where("engine is not null")
    firsts = rows.withColumn("nth", F.row_number().over(W.partitionBy("folder").orderBy("name"))).where(F.col("nth") <= MOST_NAMES)
    listed = firsts.groupBy("folder").agg(F.array_sort(F.collect_list("name")).alias("files"))
    return engines.join(listed, "folder").select("folder", "engine", ((F.col("engine") == "faiss") & F.col("__pickle")).alias("pickle_backed"), "files")
