"""Model keys and vector stores named by environment files, settings and manifests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import wire
from ..sources.files import environment_entries
from .inventory import MOST_MANIFESTS, is_npm, npm_packages, pip_libraries

MOST_HOSTS = 5

# Packages of vector stores, with their engine and whether it is a service of others.
VECTOR_LIBRARIES = {
    "chromadb": ("chroma", False), "faiss-cpu": ("faiss", False), "faiss-gpu": ("faiss", False), "lancedb": ("lancedb", False),
    "pgvector": ("pgvector", False), "qdrant-client": ("qdrant", True), "pinecone-client": ("pinecone", True), "pinecone": ("pinecone", True),
    "weaviate-client": ("weaviate", True), "weaviate-ts-client": ("weaviate", True), "pymilvus": ("milvus", True),
}
VECTOR_SCOPES = {"@pinecone-database/": ("pinecone", True), "@qdrant/": ("qdrant", True)}
PIP_VECTOR = ["chromadb", "faiss-cpu", "faiss-gpu", "lancedb", "pgvector", "qdrant-client", "pinecone-client", "pinecone", "weaviate-client", "pymilvus"]

# Settings of hosted vector stores.
VECTOR_SETTINGS = {
    "PINECONE_API_KEY": ("pinecone", "key"), "PINECONE_ENVIRONMENT": ("pinecone", "endpoint"), "PINECONE_HOST": ("pinecone", "endpoint"),
    "PINECONE_INDEX": ("pinecone", "endpoint"), "PINECONE_INDEX_NAME": ("pinecone", "endpoint"), "WEAVIATE_URL": ("weaviate", "endpoint"),
    "WEAVIATE_HOST": ("weaviate", "endpoint"), "WEAVIATE_API_KEY": ("weaviate", "key"), "QDRANT_URL": ("qdrant", "endpoint"),
    "QDRANT_HOST": ("qdrant", "endpoint"), "QDRANT_API_KEY": ("qdrant", "key"), "MILVUS_URI": ("milvus", "endpoint"),
    "MILVUS_HOST": ("milvus", "endpoint"), "ZILLIZ_CLOUD_URI": ("milvus", "endpoint"), "CHROMA_SERVER_HOST": ("chroma", "endpoint"), "CHROMA_HOST": ("chroma", "endpoint"),
}

# Names of keys and the vendors they belong to.
KEY_VENDORS = {
    "OPENAI_API_KEY": "openai", "AZURE_OPENAI_API_KEY": "azure-openai", "AZURE_OPENAI_KEY": "azure-openai",
    "ANTHROPIC_API_KEY": "anthropic", "GOOGLE_API_KEY": "google", "GOOGLE_GENAI_API_KEY": "google",
    "GEMINI_API_KEY": "google", "MISTRAL_API_KEY": "mistral", "GROQ_API_KEY": "groq", "COHERE_API_KEY": "cohere",
    "HUGGINGFACE_API_KEY": "huggingface", "HUGGINGFACEHUB_API_TOKEN": "huggingface", "HF_TOKEN": "huggingface",
    "OPENROUTER_API_KEY": "openrouter", "XAI_API_KEY": "xai", "DEEPSEEK_API_KEY": "deepseek",
    "TOGETHER_API_KEY": "together", "TOGETHERAI_API_KEY": "together", "PERPLEXITY_API_KEY": "perplexity",
    "REPLICATE_API_TOKEN": "replicate", "FIREWORKS_API_KEY": "fireworks", "DASHSCOPE_API_KEY": "alibaba",
    "AI21_API_KEY": "ai21", "ANYSCALE_API_KEY": "anyscale", "VOYAGE_API_KEY": "voyage", "NVIDIA_API_KEY": "nvidia",
    "CEREBRAS_API_KEY": "cerebras", "STABILITY_API_KEY": "stability", "ELEVENLABS_API_KEY": "elevenlabs",
    "WATSONX_APIKEY": "ibm", "LANGCHAIN_API_KEY": "langsmith", "LANGSMITH_API_KEY": "langsmith",
    "PINECONE_API_KEY": "pinecone", "WEAVIATE_API_KEY": "weaviate",
}

# Beginnings of keys, in the order in which they are tried, and names that hint at a model's key.
KEY_SHAPES = [
    ("^sk-ant-[A-Za-z0-9_-]{20,}", "anthropic"), ("^sk-or-[A-Za-z0-9_-]{20,}", "openrouter"), ("^sk-proj-[A-Za-z0-9_-]{20,}", "openai"),
    ("^sk-[A-Za-z0-9]{32,}", "openai"), ("^AIza[0-9A-Za-z_-]{30,}", "google"), ("^gsk_[A-Za-z0-9]{20,}", "groq"), ("^hf_[A-Za-z0-9]{20,}", "huggingface"),
    ("^xai-[A-Za-z0-9]{20,}", "xai"), ("^r8_[A-Za-z0-9]{20,}", "replicate"), ("^pplx-[A-Za-z0-9]{20,}", "perplexity"), ("^fw_[A-Za-z0-9]{20,}", "fireworks"),
]
KEY_SUFFIX = "(_API_KEY|_API_TOKEN|_APIKEY)\\z"
KEY_HINT = "(LLM|AI|GPT|CLAUDE|MODEL|OPENAI|ANTHROPIC|GEMINI)"
DUMMY = "(?i)(your|xxx|placeholder|changeme|<|example)"


def _map(values: dict) -> Column:
    """A literal map; values are texts or tuples, which become structs a, b."""
    cell = lambda v: F.struct(F.lit(v[0]).alias("a"), F.lit(v[1]).alias("b")) if isinstance(v, tuple) else F.lit(v)
    return F.create_map(*[c for k, v in values.items() for c in (F.lit(k), cell(v))])


def vector_library(package: Column) -> Column:
    """(a, b): engine and hosted of a package, by its name, else by its scope; null if it is no vector store's."""
    out = F.try_element_at(_map(VECTOR_LIBRARIES), package)
    for scope, (engine, hosted) in VECTOR_SCOPES.items():
        out = F.coalesce(out, F.when(package.startswith(scope), F.struct(F.lit(engine).alias("a"), F.lit(hosted).alias("b"))))
    return out


def key_vendor(name: Column, value: Column) -> Column:
    """The vendor of a key: by its name, else by the shape of its value, else
    unknown for a name that hints at a model; null for what is no model's key."""
    out = F.try_element_at(_map(KEY_VENDORS), name)
    for pattern, vendor in KEY_SHAPES:
        out = F.coalesce(out, F.when(value.rlike(pattern), vendor))
    return F.coalesce(out, F.when(name.rlike(KEY_SUFFIX) & name.rlike(KEY_HINT), "unknown"))


def is_key_value(value: Column) -> Column:
    """Whether a value may be a key: eight characters or more, no reference to another variable, no dummy."""
    return (F.length(value) >= 8) & ~value.startswith("${") & ~value.rlike(DUMMY)


def _ends(value: Column) -> Column:
    return F.concat(F.left(value, F.lit(3)), F.lit("…"), F.right(value, F.lit(2)))


def endpoint_host(value: Column) -> Column:
    """The host of an address or of a bare host with or without a port; null for anything else. Of user:password@host the user is taken."""
    v = F.regexp_replace(F.trim(value), "^[\"']|[\"']\\z", "")
    scheme = F.regexp_extract(v, "(?i)^[a-z]+://([^/:?#\\s]+)", 1)
    bare = F.when(v.rlike("(?i)^[a-z0-9.-]+\\.[a-z]{2,}(:[0-9]+)?\\z"), F.substring_index(v, ":", 1))
    return F.coalesce(F.nullif(scheme, F.lit("")), bare)


def _entries(files: DataFrame) -> DataFrame:
    """(path, place, name, value) of files of assignments (path, text)."""
    return files.select("path", F.posexplode(environment_entries(F.col("text"))).alias("place", "e")).select("path", "place", "e.name", "e.value")


def environment_keys(files: DataFrame) -> DataFrame:
    """(path, name, vendor, fingerprint): the model keys of environment files
    (path, text). A name that a file assigns twice counts by its first
    assignment that is a key. Values never leave but for their two ends. Null
    texts have none."""
    found = _entries(files).where(is_key_value(F.col("value"))).withColumn("vendor", key_vendor(F.col("name"), F.col("value"))).where("vendor is not null")
    firsts = found.groupBy("path", "name").agg(F.min(F.struct("place", "vendor", _ends(F.col("value")).alias("fingerprint"))).alias("f"))
    return firsts.select("path", "name", "f.vendor", "f.fingerprint")


def process_keys(env: DataFrame) -> DataFrame:
    """(name, vendor, fingerprint) of the variables (name, value) of a process
    that hold model keys: by their name, or by shape if the name ends as a key's does."""
    v = F.col("value")
    vendor = F.coalesce(F.try_element_at(_map(KEY_VENDORS), F.col("name")), F.when(F.col("name").rlike(KEY_SUFFIX), key_vendor(F.col("name"), v)))
    return env.where(F.length("value") >= 8).select("name", vendor.alias("vendor"), _ends(v).alias("fingerprint")).where("vendor is not null")


def _firsts(rows: DataFrame, by: str, value: str, most: int) -> DataFrame:
    """(by, value): the first distinct values of each key, joined by commas. Ranked before they are gathered."""
    ranked = rows.where(F.col(value).isNotNull()).select(by, value).distinct().withColumn("nth", F.row_number().over(W.partitionBy(by).orderBy(value)))
    return ranked.where(F.col("nth") <= most).groupBy(by).agg(F.array_join(F.array_sort(F.collect_list(value)), ",").alias(value))


def vector_clients(manifests: DataFrame) -> DataFrame:
    """(engine, hosted, n_manifests, manifests): vector stores that manifests
    (path, text) depend on, with the first manifests by path. Of text
    manifests, any whole token counts. hosted is that of the engine's packages."""
    npm = is_npm(F.col("path"))
    used = manifests.select("path", F.explode(F.when(npm, npm_packages(F.col("text"))).otherwise(pip_libraries(F.col("text"), PIP_VECTOR))).alias("package")).withColumn("v", vector_library(F.col("package")))
    rows = used.where("v is not null").select(F.col("v.a").alias("engine"), F.col("v.b").alias("hosted"), "path").distinct()
    counts = rows.groupBy("engine", "hosted").agg(F.count("*").alias("n_manifests"))
    return counts.join(_firsts(rows, "engine", "path", MOST_MANIFESTS), "engine").withColumnRenamed("path", "manifests")


def vector_endpoints(files: DataFrame) -> DataFrame:
    """(engine, has_key, has_endpoint, hosts, files): hosted vector stores that
    environment files (path, text) configure, with the first hosts and files in order."""
    rows = _entries(files).withColumn("v", F.try_element_at(_map(VECTOR_SETTINGS), F.col("name"))).where("v is not null")
    rows = rows.where((F.col("value") != "") & ~F.col("value").rlike(DUMMY)).select(F.col("v.a").alias("engine"), F.col("v.b").alias("kind"), "path", F.when(F.col("v.b") == "endpoint", endpoint_host(F.col("value"))).alias("host"))
    flags = rows.groupBy("engine").agg(F.bool_or(F.col("kind") == "key").alias("has_key"), F.bool_or(F.col("kind") == "endpoint").alias("has_endpoint"))
    hosts, paths = _firsts(rows, "engine", "host", MOST_HOSTS), _firsts(rows, "engine", "path", MOST_MANIFESTS)
    return flags.join(hosts, "engine", "left").join(paths, "engine").select("engine", "has_key", "has_endpoint", F.coalesce("host", F.lit("")).alias("hosts"), F.col("path").alias("files"))


def without_vector(dependencies: DataFrame) -> DataFrame:
    """dependencies (with package) without the packages of vector stores, which are assets of their own."""
    return dependencies.where(vector_library(F.col("package")).isNull())


def assets(*parts: DataFrame) -> DataFrame:
    """The union of parts (type, name, identifier, vendor), names and
    identifiers clamped, one row a (type, identifier): the first by part, then
    by name. Identifiers are clamped before they are compared."""
    cut = lambda df, n: df.select("type", wire.clamp(F.col("name"), wire.ASSET["name"]).alias("name"), wire.clamp(F.col("identifier"), wire.ASSET["identifier"]).alias("identifier"), "vendor", F.lit(n).alias("part"))
    rows = reduce(DataFrame.unionByName, [cut(p, n) for n, p in enumerate(parts)])
    key = F.coalesce("identifier", "name").alias("key")
    firsts = rows.groupBy("type", key).agg(F.min(F.struct("part", "name", "identifier", "vendor")).alias("f"))
    return firsts.select("type", "f.name", "f.identifier", "f.vendor")
