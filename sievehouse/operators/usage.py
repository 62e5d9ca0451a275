"""Which AI providers source code imports and calls."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.regexes import holds, java, let, matches
from ..functions.text import explode_lines


@dataclass(frozen=True)
class Provider:
    id: str
    label: str
    category: str
    exact: tuple[str, ...] = ()
    prefix: tuple[str, ...] = ()
    root: tuple[str, ...] = ()
    call: tuple[str, ...] = field(default=())
    #: Our own addition: a lower-cased line with a call holds one of these.
    needs: tuple[str, ...] = field(default=())


# Packages and calls. A pattern that begins with (?i) folds case.
PROVIDERS = [
    Provider("openai", "OpenAI", "llm-api", ("openai",), ("@azure/openai",), (), (r"\b(?:Async)?(?:Azure)?OpenAI\s*\(", r"\bchat\.completions\.create\s*\(", r"\bresponses\.create\s*\(", r"\bembeddings\.create\s*\(", r"\bChatCompletion\.create\s*\(", r"\bopenai\.(?:ChatCompletion|Completion|Embedding)\b"), ("openai", "completions.create", "responses.create", "embeddings.create", "chatcompletion.create")),
    Provider("anthropic", "Anthropic", "llm-api", ("@anthropic-ai/sdk", "@anthropic-ai/bedrock-sdk", "@anthropic-ai/vertex-sdk", "anthropic"), ("@anthropic-ai/",), (), (r"\b(?:Async)?Anthropic(?:Bedrock|Vertex)?\s*\(", r"\bmessages\.create\s*\(", r"\bmessages\.stream\s*\("), ("anthropic", "messages.create", "messages.stream")),
    Provider("google-gemini", "Google Gemini", "llm-api", ("@google/generative-ai", "@google/genai", "google.generativeai", "google.genai"), (), ("google.generativeai", "google.genai"), (r"\bGenerativeModel\s*\(", r"\bgenerate_content\s*\(", r"\bgetGenerativeModel\s*\("), ("generativemodel", "generate_content")),
    Provider("google-vertex", "Google Vertex AI", "llm-api", ("@google-cloud/vertexai", "@google-cloud/aiplatform", "vertexai", "google.cloud.aiplatform"), (), ("vertexai", "google.cloud.aiplatform"), (r"\bTextGenerationModel\b", r"\bGenerativeModel\.from_pretrained\s*\("), ("textgenerationmodel", "generativemodel")),
    Provider("aws-bedrock", "AWS Bedrock", "llm-api", ("@aws-sdk/client-bedrock-runtime", "@aws-sdk/client-bedrock"), (), (), (r"(?i)\bbedrock[-_]?runtime\b", r"\bBedrockRuntime(?:Client)?\b", r"\binvoke_model(?:_with_response_stream)?\s*\(", r"""(?i)\bclient\s*\(\s*['"]bedrock"""), ("bedrock", "invoke_model")),
    Provider("cohere", "Cohere", "llm-api", ("cohere-ai", "cohere"), (), (), (r"\bcohere\.Client\w*\s*\(", r"\bClientV2\s*\("), ("cohere.client", "clientv2")),
    Provider("mistral", "Mistral", "llm-api", ("@mistralai/mistralai", "mistralai"), (), (), (r"\bMistral(?:Client|AsyncClient|)\s*\(", r"\bchat\.complete\s*\("), ("mistral", "chat.complete")),
    Provider("groq", "Groq", "llm-api", ("groq-sdk", "groq"), (), (), (r"\bGroq\s*\(",), ("groq",)),
    Provider("together", "Together AI", "llm-api", ("together-ai", "together"), (), (), (r"\bTogether\s*\(",), ("together",)),
    Provider("replicate", "Replicate", "llm-api", ("replicate",), (), (), (r"\breplicate\.run\s*\(", r"\bReplicate\s*\("), ("replicate",)),
    Provider("huggingface-inference", "Hugging Face Inference", "llm-api", ("@huggingface/inference", "huggingface_hub"), (), (), (r"\bInferenceClient\s*\(",), ("inferenceclient",)),
    Provider("litellm", "LiteLLM", "inference-gateway", ("litellm",), (), (), (r"\blitellm\.(?:a?completion|a?embedding)\s*\(",), ("litellm.",)),
    Provider("openrouter", "OpenRouter", "inference-gateway", ("openrouter",), (), (), (r"(?i)\bopenrouter\.ai\b",), ("openrouter.ai",)),
    Provider("vercel-ai", "Vercel AI SDK", "inference-gateway", ("ai",), ("@ai-sdk/",), (), (r"\b(?:generateText|streamText|generateObject|streamObject)\s*\(",), ("generatetext", "streamtext", "generateobject", "streamobject")),
    Provider("langchain", "LangChain", "llm-framework", ("langchain",), ("@langchain/",), ("langchain",), (r"\bChat(?:OpenAI|Anthropic|Google\w*|Bedrock|Vertex\w*|Cohere|Mistral\w*)\s*\(", r"\bLLMChain\s*\(", r"\bChatPromptTemplate\b"), ("chatopenai", "chatanthropic", "chatgoogle", "chatbedrock", "chatvertex", "chatcohere", "chatmistral", "llmchain", "chatprompttemplate")),
    Provider("langgraph", "LangGraph", "llm-framework", ("@langchain/langgraph",), (), ("langgraph",), (r"\bStateGraph\s*\(",), ("stategraph",)),
    Provider("llama-index", "LlamaIndex", "llm-framework", ("llamaindex",), ("@llamaindex/",), ("llama_index",), (r"\bVectorStoreIndex\b", r"\bServiceContext\b"), ("vectorstoreindex", "servicecontext")),
    Provider("crewai", "CrewAI", "llm-framework", ("crewai",), (), ("crewai",), (r"\bCrew\s*\(", r"\bAgent\s*\(\s*role\s*="), ("crew", "agent")),
    Provider("autogen", "AutoGen", "llm-framework", ("autogen", "pyautogen"), (), ("autogen", "autogen_agentchat"), (r"\bAssistantAgent\s*\(", r"\bConversableAgent\s*\("), ("assistantagent", "conversableagent")),
    Provider("semantic-kernel", "Semantic Kernel", "llm-framework", ("@microsoft/semantic-kernel", "semantic_kernel"), (), ("semantic_kernel",), (r"\bKernel\.builder\b",), ("kernel.builder",)),
    Provider("haystack", "Haystack", "llm-framework", ("haystack",), (), ("haystack",), (r"\bPipeline\s*\(\s*\)",), ("pipeline",)),
    Provider("dspy", "DSPy", "llm-framework", ("dspy",), (), ("dspy",), (r"\bdspy\.(?:Predict|ChainOfThought|Signature)\b",), ("dspy.",)),
    Provider("guidance", "Guidance", "llm-framework", ("guidance",), (), (), (r"\bguidance\.\w+",), ("guidance.",)),
    Provider("instructor", "Instructor", "llm-framework", ("instructor",), (), (), (r"\binstructor\.(?:from_openai|patch|from_anthropic)\s*\(",), ("instructor.",)),
    Provider("pydantic-ai", "PydanticAI", "llm-framework", ("pydantic_ai",), (), ("pydantic_ai",), (r"""\bAgent\s*\(\s*['"]""",), ("agent",)),
    Provider("ollama", "Ollama", "local-runtime", ("ollama",), (), (), (r"\bollama\.(?:chat|generate|embeddings)\s*\(",), ("ollama.",)),
    Provider("transformers", "Transformers", "local-runtime", ("transformers",), (), ("transformers",), (r"\bpipeline\s*\(", r"\bAutoModel\w*\.from_pretrained\s*\("), ("pipeline", "automodel")),
    Provider("sentence-transformers", "Sentence-Transformers", "local-runtime", ("sentence_transformers",), (), (), (r"\bSentenceTransformer\s*\(",), ("sentencetransformer",)),
    Provider("vllm", "vLLM", "local-runtime", ("vllm",), (), (), (r"\bLLM\s*\(\s*model\s*=", r"\bSamplingParams\s*\("), ("llm", "samplingparams")),
    Provider("llama-cpp", "llama.cpp", "local-runtime", ("node-llama-cpp", "llama_cpp"), (), (), (r"\bLlama\s*\(\s*model_path\s*=",), ("llama",)),
]
# Files that are read, and what names a model or a module.
SCANNABLE = r"\.(py|ipynb|[mc]?[jt]sx?|java|kt|go|rb|php|cs|rs|scala)$"
MODEL = r"""\bmodel(?:_?id|_?name)?\s*[=:]\s*['"]([A-Za-z0-9][\w.:/-]{1,80})['"]"""
SPEC = r"""(?:\bfrom\s+|\brequire\s*\(\s*|\bimport\s*\(\s*|\bimport\s+)['"]([^'"]+)['"]"""
MOST_SITES = 60


def import_specifiers(line: Column) -> Column:
    """Modules that a line imports, in the forms of JavaScript and Python."""
    quoted = F.when(line.rlike("['\"]"), F.regexp_extract_all(line, F.lit(java(SPEC)), F.lit(1))).otherwise(F.array().cast("array<string>"))
    from_py = F.regexp_extract(line, java(r"^\s*from\s+([A-Za-z_][\w.]*)\s+import\b"), 1)
    import_py = F.regexp_extract(line, java(r"^\s*import\s+([A-Za-z_][\w.]*(?:\s*,\s*[A-Za-z_][\w.]*)*)"), 1)
    return F.filter(F.transform(F.concat(quoted, F.array(from_py), F.split(import_py, ",")), lambda t: F.trim(t)), lambda s: s != "")


def _imported(spec: Column, p: Provider) -> Column:
    out = spec.isin(*p.exact) if p.exact else F.lit(False)
    for x in p.prefix:
        out = out | (spec == x.rstrip("/")) | spec.startswith(x)
    for x in p.root:
        out = out | (spec == x) | spec.startswith(x + ".") | spec.startswith(x + "_")
    return out


_IMPORTS = ("import", "from", "require")


def _uses(line: Column) -> Column:
    """Array of (ord, provider, label, category, kind, via, model) of a line.
    Patterns are tried only where their literals are."""
    model = F.nullif(F.regexp_extract(line, java(MODEL), 1), F.lit(""))

    def use(i: int, p: Provider, kind: str, via: Column, model: Column) -> Column:
        head = (F.lit(i).alias("ord"), F.lit(p.id).alias("provider"), F.lit(p.label).alias("label"), F.lit(p.category).alias("category"))
        return F.struct(*head, F.lit(kind).alias("kind"), via.alias("via"), model.alias("model"))

    def of(low: Column) -> Column:
        specs = F.when(holds(low, (_IMPORTS,)), import_specifiers(line)).otherwise(F.array().cast("array<string>"))

        def of_provider(i: int, p: Provider, specs: Column) -> list[Column]:
            mine = F.filter(specs, lambda s: _imported(s, p))
            imported = use(2 * i, p, "import", F.get(mine, F.lit(0)), F.lit(None).cast("string"))
            call = F.coalesce(*[F.regexp_substr(line, F.lit(java(c.removeprefix("(?i)"), c.startswith("(?i)")))) for c in p.call])
            called = let(call, lambda c: F.when(c.isNotNull(), use(2 * i + 1, p, "call", c, model)))
            return [F.when((F.size(specs) > 0) & (F.size(mine) > 0), imported), F.when(holds(low, (p.needs,)), called)]

        def found(specs: Column) -> Column:
            return F.array_compact(F.array(*[c for i, p in enumerate(PROVIDERS) for c in of_provider(i, p, specs)]))

        return let(specs, found)

    return let(F.lower(line), of)


def sightings(files: DataFrame, file: str = "file", text: str = "text") -> DataFrame:
    """(file, provider, label, category, kind, via, code, model, line, ord): at
    most one import and one call for each provider and line. Lines without a
    literal of any import or call are left out first."""
    literals = sorted({*_IMPORTS, *(x for p in PROVIDERS for x in p.needs)})
    shortest = tuple(x for x in literals if not any(y in x and y != x for y in literals))
    rows = files.where(matches(F.col(file), SCANNABLE, True)).select(F.col(file).alias("file"), F.col(text).alias("text"))
    rows = explode_lines(rows.where(let(F.lower("text"), lambda low: holds(low, (shortest,)))))
    line, raw = F.col("line_text"), F.trim("line_text")
    rows = rows.where((raw != "") & ~raw.rlike("^(#|//|\\*)") & let(F.lower(line), lambda low: holds(low, (shortest,))))
    hits = rows.select("file", "line", F.left(raw, F.lit(240)).alias("code"), F.explode_outer(_uses(line)).alias("s")).where("s is not null")
    return hits.select("file", "s.provider", "s.label", "s.category", "s.kind", "s.via", "code", "s.model", "line", "s.ord")


def first_sites(found: DataFrame, most: int = MOST_SITES) -> DataFrame:
    """(provider, label, category, nth, file, line, ord, kind, via, code,
    model): each provider's first sightings by file, line and ord. They are
    ranked before they are gathered, so a provider that all use is no large group."""
    nth = F.row_number().over(W.partitionBy("provider", "label", "category").orderBy("file", "line", "ord"))
    return found.withColumn("nth", nth).where(F.col("nth") <= most).select("provider", "label", "category", "nth", "file", "line", "ord", "kind", "via", "code", "model")


def totals(found: DataFrame) -> DataFrame:
    """One row a provider: sightings, n_files, models, has_call, first_file, first_line, first_kind."""
    place = F.struct("file", "line", "ord", "kind", "via", "code", "model")
    best = F.min_by(place, F.struct((F.col("kind") != "call").cast("int").alias("c"), "file", "line", "ord"))
    rolled = found.groupBy("provider", "label", "category").agg(
        F.count("*").alias("sightings"), F.count_distinct("file").alias("n_files"), F.array_sort(F.collect_set("model")).alias("models"),
        F.bool_or(F.col("kind") == "call").alias("has_call"), best.alias("first"),
    )
    return rolled.select("provider", "label", "category", "sightings", "n_files", F.array_join("models", ",").alias("models"), "has_call", F.col("first.file").alias("first_file"), F.col("first.line").alias("first_line"), F.col("first.kind").alias("first_kind"))


def rollup(found: DataFrame) -> DataFrame:
    """The totals of each provider with its sites, the first 60 by file and line."""
    by = ["provider", "label", "category"]
    site = F.struct("nth", "file", "line", "kind", "via", "code", "model")
    sites = first_sites(found).groupBy(*by).agg(F.array_sort(F.collect_list(site)).alias("sites"))
    return totals(found).join(sites, by)


def in_shown_order(found: DataFrame, most: int = MOST_SITES) -> DataFrame:
    """first_sites with provider_place and place: providers by label and files
    by name as a reader sorts them (any case, then by case; accents and signs
    after letters), in a file calls before imports, then by line. A provider's
    sites are few by then, and providers are as many as the catalogue has."""
    sites = first_sites(found, most)
    alphabet = lambda c: F.collate(c, "UNICODE")
    within = W.partitionBy("provider", "label", "category").orderBy(alphabet("file"), (F.col("kind") != "call").cast("int"), "line", "ord")
    labels = sites.select("provider", "label", "category").distinct().withColumn("provider_place", F.row_number().over(W.orderBy(alphabet("label"), "provider", "category")))
    return sites.withColumn("place", F.row_number().over(within)).join(F.broadcast(labels), ["provider", "label", "category"])
