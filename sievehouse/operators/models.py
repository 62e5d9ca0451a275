"""References to models in source lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import literals as L
from ..functions.regexes import java, matches
from ..functions.text import explode_lines

# Patterns and stop words.
LOADER = r"""\b(from_pretrained|SentenceTransformer|CrossEncoder|hf_hub_download|snapshot_download|InferenceClient|AutoModel\w*|AutoTokenizer|AutoConfig|AutoProcessor|AutoFeatureExtractor|from_hf_hub|hf_hub|load_dataset|torch\.hub\.load|ollama)\b|\bpipeline\s*\(|\bmodel\s*[=:]\s*['"]|huggingface\.co|\bhf\.co\b"""
QUOTED = r"""['"]([A-Za-z0-9][\w.-]*/[A-Za-z0-9][\w.-]*)['"]"""
PRETRAINED = r"""\bfrom_pretrained\s*\(\s*(?:[A-Za-z_][\w.]*\s*,\s*)?['"]([\w./-]+)['"]"""
SENTENCE = r"""\b(?:SentenceTransformer|CrossEncoder)\s*\(\s*['"]([\w./-]+)['"]"""
KEYWORD = r"""\b(?:model|repo_id|model_name|model_id|model_name_or_path|pretrained_model_name_or_path|checkpoint|base_model)\s*[=:]\s*['"]([\w./-]+)['"]"""
YAML = r"^[ \t-]*(?:model|model_name|model_id|base_model|checkpoint)\s*:\s*([A-Za-z0-9][\w./-]*[\w/.-])\s*(?:#.*)?$"
REVISION = r"""\b(?:revision|commit|sha)\s*=\s*['"]([\w.-]{4,})['"]"""
URL = r"https?://(?:www\.)?(?:huggingface\.co|hf\.co)/([A-Za-z0-9][\w.-]*/[A-Za-z0-9][\w.-]*)(?:/tree/([\w.-]+))?"
OLLAMA = r"\bollama\s+(?:pull|run|cp|create)\s+([a-z0-9][\w.:/-]*)"
TORCH = r"""torch\.hub\.load\s*\(\s*['"]([A-Za-z0-9][\w.-]*/[A-Za-z0-9][\w.-]*)['"]"""
HOSTED = r"^(?:gpt-|gpt4|o[1-4](?:-|$)|text-embedding-|text-(?:davinci|curie|babbage|ada)|davinci|dall-e|whisper-|tts-|chatgpt|claude[-\d]|gemini[-.]|gemini$|models/gemini|mistral-|mixtral-|codestral-|command(?:-|$)|command-r|grok-|deepseek-(?:chat|coder|reasoner)|sonar-)"
PROVIDERS = [
    ("openai", r"^(gpt|o[1-4]|text-|davinci|curie|babbage|ada|dall-e|whisper|tts-|chatgpt)"), ("anthropic", "^claude"), ("google", "^(gemini|models/gemini)"),
    ("mistral", "^(mistral|mixtral|codestral)"), ("cohere", "^command"), ("xai", "^grok"), ("deepseek", "^deepseek"), ("perplexity", "^sonar"),
]
ASSET = r"\.(py|pyc|ipynb|[mc]?[jt]sx?|json|ya?ml|toml|txt|md|lock|cfg|ini|sh|env|png|jpg|svg|css|html?|csv|tsv|parquet)$"
NOT_IDS = ["auto", "cpu", "cuda", "mps", "none", "true", "false", "main", "default", "text-classification", "token-classification", "question-answering", "fill-mask", "summarization", "translation", "text-generation", "text2text-generation", "feature-extraction", "sentence-similarity", "zero-shot-classification", "image-classification", "object-detection", "automatic-speech-recognition", "conversational", "ner", "sentiment-analysis", "embeddings", "chat", "completion"]
NOT_ORGS = ["docs", "blog", "spaces", "datasets", "models", "join", "login", "settings", "pricing", "tasks", "learn", "papers", "collections", "organizations", "new", "search", "chat", "posts", "enterprise", "inference-endpoints"]


def hosted_by(model: Column) -> Column:
    low, out = F.lower(model), F.lit("api")
    for name, p in reversed(PROVIDERS):
        out = F.when(matches(low, p), name).otherwise(out)
    return out


def is_repository_id(model: Column) -> Column:
    parts = F.split(model, "/")
    letters = lambda i: F.coalesce(F.get(parts, F.lit(i)).rlike("[A-Za-z]"), F.lit(False))
    return ~model.rlike("^[@./]") & (F.instr(model, "..") == 0) & (F.size(parts) == 2) & ~matches(model, ASSET, True) & letters(0) & letters(1) & ~F.lower(parts[0]).isin(*NOT_ORGS)


def is_bare_id(model: Column) -> Column:
    plain = ~matches(model, ASSET, True) & (F.length(model) >= 2) & model.rlike("[A-Za-z]")
    return ~model.rlike("^[@./]") & (F.instr(model, "..") == 0) & ~F.lower(model).isin(*NOT_IDS) & F.when(F.instr(model, "/") > 0, is_repository_id(model)).otherwise(plain)


_SOURCES = [URL, TORCH, OLLAMA, PRETRAINED, SENTENCE, KEYWORD, YAML, QUOTED]
#: Which patterns a text may match; a quoted name counts with a loader alone.
_referred = L.candidates([L.needs(p) if p != QUOTED else (*L.needs(LOADER), *L.needs(QUOTED)) for p in _SOURCES])


def model_references(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, id, revision, source, via, line): each model a document refers to,
    once for source, id and revision, with the first place."""
    line, raw = F.col("line_text"), F.trim("line_text")
    comment = raw.rlike("^(#|//|\\*)")
    own = ~comment & ~line.rlike("torch\\.hub\\.load|huggingface\\.co|hf\\.co") & ~matches(line, r"\bollama\b")
    revision = F.nullif(F.regexp_extract(line, java(REVISION, True), 1), F.lit(""))

    def take(ord_: int, when: Column, pattern: str, fold: bool, source: str, via: str, bare: bool, rev: Column | None) -> Column:
        ids = F.regexp_extract_all(line, F.lit(java(pattern, fold)), F.lit(1))
        make = lambda x, i: F.struct(F.lit(ord_).alias("ord"), i.alias("nth"), x.alias("id"), (F.lit(None).cast("string") if rev is None else rev).alias("revision"), F.lit(source).alias("source"), F.lit(via).alias("via"), F.lit(bare).alias("bare"))
        return F.when(may(pattern) & when, F.transform(ids, make)).otherwise(F.array())

    low, mask = F.col("low"), F.col("__mask")
    may = lambda p: L.bit(mask, _SOURCES.index(p)) & L.holds(low, L.needs(p))
    rows = explode_lines(docs.select(key, text, _referred(text).alias("__mask")), text, mask != 0).where(raw != "").withColumn("low", F.lower("line_text"))
    url_rev = F.nullif(F.regexp_extract(line, java(URL, True), 2), F.lit(""))
    plain = F.filter(F.regexp_extract_all(line, F.lit(java(YAML, True)), F.lit(1)), lambda x: x.rlike("[0-9./]"))
    yaml = F.transform(plain, lambda x, i: F.struct(F.lit(6).alias("ord"), i.alias("nth"), x.alias("id"), revision.alias("revision"), F.lit("hf").alias("source"), F.lit("model: yaml key").alias("via"), F.lit(True).alias("bare")))
    taken = F.concat(
        take(0, F.lit(True), URL, True, "hf", "huggingface.co URL", False, url_rev),
        take(1, ~comment, TORCH, False, "github", "torch.hub.load", False, None),
        take(2, ~comment, OLLAMA, True, "ollama", "ollama", False, None),
        take(3, own, PRETRAINED, False, "hf", "from_pretrained", True, revision),
        take(4, own, SENTENCE, False, "hf", "sentence-transformers", True, revision),
        take(5, own, KEYWORD, True, "hf", "model= keyword", True, revision),
        F.when(may(YAML) & own, yaml).otherwise(F.array()),
        take(7, own & L.matches(line, low, LOADER, True), QUOTED, False, "hf", "model loader", False, revision),
    )
    hits = rows.select(key, "line", F.explode_outer(taken).alias("m")).where("m is not null").select(key, "line", "m.*")
    api = (F.col("source") == "hf") & (F.instr("id", "/") == 0) & matches(F.col("id"), HOSTED, True)
    hits = hits.withColumn("api", api).withColumns({"via": F.when(F.col("api"), F.concat("via", F.lit(" · "), hosted_by(F.col("id")), F.lit(" API"))).otherwise(F.col("via")), "source": F.when(F.col("api"), "api").otherwise(F.col("source"))})
    valid = hits.where((F.col("source") == "ollama") | F.when(F.col("bare"), is_bare_id(F.col("id"))).otherwise(is_repository_id(F.col("id"))))
    order = W.partitionBy(key, "source", "id", "revision").orderBy("line", "ord", "nth")
    return valid.withColumn("n", F.row_number().over(order)).where("n = 1").select(key, "id", "revision", "source", "via", "line")
