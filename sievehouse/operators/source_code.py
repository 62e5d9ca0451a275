"""Rules for source files: sinks, loaders and secrets in statements, flows of
model output into sinks, and signals that are worse together."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import literals as L
from ..functions.brackets import in_literal
from ..functions.regexes import before_first, java, let, matches
from ..functions.text import line_after
from .modules import DYNAMIC, constant_paths, loads_nothing_hidden, path_names

MOST_LINES = 40
# Fixed values: (id, severity, category, confidence, pattern, folds case, counts only outside strings).
_KEYS = r"""['"](sk-ant-[A-Za-z0-9_-]{20,}|sk-[A-Za-z0-9]{20,}|hf_[A-Za-z0-9]{20,}|AIza[A-Za-z0-9_-]{20,}|gsk_[A-Za-z0-9]{20,})['"]"""
PYTHON = [
    ("python.dangerous_sinks", "CRITICAL", "code-exec", 0.85, r"(?<![.\w])(eval|exec|compile)\s*\(|\bos\.(system|popen|exec[lv]?[pe]*)\s*\(|\bsubprocess\.(run|call|check_output|check_call|Popen)\s*\(|(?<![.\w])__import__\s*\(|(?<![.\w])getattr\s*\(\s*__builtins__", False, False),
    ("python.pickle_deserialization", "CRITICAL", "deserialization", 0.9, r"\b(pickle|cpickle|dill|_pickle|cloudpickle)\.(loads?|Unpickler)\s*\(|\bjsonpickle\.(decode|loads)\s*\(|\bmarshal\.loads?\s*\(|\btorch\.(load|jit\.load)\s*\(|\byaml\.(unsafe_load|load\s*\((?![^)]*Loader\s*=\s*yaml\.(Safe|Full)Loader))|\bjoblib\.load\s*\(|\bskops\.io\.load\s*\(|\bshelve\.open\s*\(|\bnumpy\.load\s*\([^)]*allow_pickle\s*=\s*True|\b(pandas|pd)\.read_pickle\s*\(|\bmlflow\.[\w.]+\.load_model\s*\(", False, False),
    ("python.trust_remote_code", "CRITICAL", "remote-code", 0.95, r"trust_remote_code\s*=\s*True", False, True),
    ("python.dataset_remote_code", "CRITICAL", "remote-code", 0.9, r"\bload_dataset\s*\((?=[^)]*trust_remote_code\s*=\s*True)", False, True),
    ("python.native_code_load", "HIGH", "code-exec", 0.85, r"\bctypes\.(CDLL|WinDLL|OleDLL|PyDLL|cdll|windll|oledll)\b|\bcdll\.LoadLibrary\s*\(|\bwindll\.LoadLibrary\s*\(", False, False),
    ("python.dynamic_file_exec", "HIGH", "code-exec", 0.85, r"\bSourceFileLoader\s*\(|\bspec_from_file_location\s*\(|\bimp\.load_source\s*\(|\bexec_module\s*\(", False, False),
    ("python.torch_remote_code", "CRITICAL", "remote-code", 0.9, r"\btorch\.hub\.load\s*\(|\btorch\.hub\.load_state_dict_from_url\s*\(|\btorch\.package\.PackageImporter\s*\(|\btorch\.classes\.load_library\s*\(", False, False),
    ("python.weights_only_false", "CRITICAL", "deserialization", 0.95, r"\btorch\.load\s*\([^)]*weights_only\s*=\s*False", False, False),
    ("python.keras_unsafe_load", "HIGH", "deserialization", 0.85, r"\bsafe_mode\s*=\s*False", False, False),
    ("python.langchain_code_exec", "HIGH", "agentic", 0.85, r"""\b(PythonREPL|PythonREPLTool|PythonAstREPLTool|PALChain|CPALChain|LLMMathChain|create_pandas_dataframe_agent|create_spark_dataframe_agent|create_csv_agent|PandasQueryEngine|PandasInstructionParser|CodeInterpreterToolSpec|CodeAgent|LocalPythonExecutor|local_python_executor|PythonInterpreterTool)\b|\bload_tools\s*\([^)]*['"](python_repl|terminal|shell|bash)""", False, False),
    ("python.autogen_local_exec", "HIGH", "agentic", 0.75, r"code_execution_config\s*=\s*\{|use_docker\s*=\s*False", False, False),
    ("python.langchain_serialized_load", "HIGH", "deserialization", 0.75, r"\b(load_chain|load_prompt|load_agent)\s*\(|\bhub\.pull\s*\(", False, False),
    ("python.rag_unsafe_deser", "CRITICAL", "deserialization", 0.9, r"allow_dangerous_deserialization\s*=\s*True|\bFAISS\.load_local\s*\(|\b(pickle|joblib)\.load\s*\([^)]*(index|faiss|embedding|vector|chroma)", True, False),
    ("python.mcp_client", "LOW", "agentic", 0.55, r"\bfrom\s+mcp\.client[\w.]*\s+import\b|\bimport\s+mcp\.client\b|\bmcp\.client\.\w+|\bfrom\s+mcp\s+import\b[^\n]*\bClientSession\b", False, True),
    ("python.reduce_payload", "CRITICAL", "deserialization", 0.8, r"def\s+__reduce__\s*\(|def\s+__reduce_ex__\s*\(|def\s+__setstate__\s*\(", False, False),
    ("python.network_egress", "MEDIUM", "egress", 0.5, r"\b(requests|httpx)\.(get|post|put|request)\s*\(|\burllib\.request\.(urlopen|urlretrieve)\s*\(|\bsocket\.(socket|create_connection)\s*\(|\baiohttp\.ClientSession\s*\(", False, False),
    ("python.dynamic_import", "HIGH", "obfuscation", 0.7, r"""\bimportlib\.import_module\s*\(|\b__import__\s*\(\s*['"]?\s*(os|subprocess|socket|base64|marshal|ctypes)|\bexec\s*\(\s*(base64|bytes|marshal|codecs)""", False, False),
    ("python.encoded_payload", "LOW", "obfuscation", 0.5, r"\b(base64|codecs|binascii)\.(b64decode|decode|unhexlify)\s*\(|bytes\.fromhex\s*\(", False, False),
    ("python.gradio_public_share", "MEDIUM", "exposure", 0.8, r"\.launch\s*\([^)]*share\s*=\s*True|\.queue\s*\([^)]*\)\.launch\s*\([^)]*share\s*=\s*True", False, False),
    ("python.hardcoded_ai_key", "MEDIUM", "secret", 0.85, _KEYS, False, False),
    ("python.env_exfil", "MEDIUM", "secret", 0.5, r"""\bos\.environ\b|\bos\.getenv\s*\(|\bParameterStore|\bboto3\.client\s*\(\s*['"]s(ts|ecretsmanager)""", False, False),
]
SCRIPT = [
    ("js.code_exec", "CRITICAL", "code-exec", 0.85, r"""(?<![.\w])eval\s*\(|\bnew\s+Function\s*\(|\bvm\.(runInContext|runInNewContext|runInThisContext|compileFunction)\s*\(|\bnew\s+vm\.Script\s*\(|\b(setTimeout|setInterval)\s*\(\s*['"`]""", False, False),
    ("js.command_exec", "CRITICAL", "code-exec", 0.8, r"""\bchild_process\b|require\(\s*['"]child_process['"]\s*\)|\bfrom\s+['"]child_process['"]|\b(execSync|execFileSync|spawnSync|execFile)\s*\(""", False, False),
    ("js.mcp_client", "LOW", "agentic", 0.55, r"@modelcontextprotocol/sdk/client|\b(StdioClientTransport|SSEClientTransport|StreamableHTTPClientTransport|WebSocketClientTransport)\b", False, False),
    ("js.decode_and_run", "CRITICAL", "obfuscation", 0.85, r"(?<![.\w])(eval|Function)\s*\(\s*(atob|unescape|decodeURIComponent|Buffer\.from)\b", False, False),
    ("js.dynamic_require", "HIGH", "obfuscation", 0.6, DYNAMIC, False, False),
    ("js.network_egress", "MEDIUM", "egress", 0.5, r"""\baxios\s*\.\s*(get|post|put|request)\s*\(|\bhttps?\.request\s*\(|\bnet\.(connect|createConnection)\s*\(|\bnew\s+WebSocket\s*\(|require\(\s*['"](node-fetch|got|undici|axios)['"]""", False, False),
    ("js.hardcoded_ai_key", "MEDIUM", "secret", 0.85, _KEYS, False, False),
]
CONFIG = [
    ("json.automodel_usage", "MEDIUM", "remote-code", 0.8, r'"(AutoModel[A-Za-z]*|AutoConfig)"\s*:\s*"([^"]+)"', False, False),
    ("json.autotokenizer_usage", "HIGH", "remote-code", 0.8, r'"(AutoTokenizer|AutoProcessor|AutoFeatureExtractor|AutoImageProcessor)"\s*:\s*"([^"]+)"', False, False),
    ("json.trust_remote_code", "HIGH", "remote-code", 0.85, r'"trust_remote_code"\s*:\s*true', True, False),
    ("json.custom_pipeline", "HIGH", "remote-code", 0.8, r'"custom_pipelines?"\s*:\s*[{"]', False, False),
]
LANGUAGES = {"py": PYTHON, "js": SCRIPT, "json": CONFIG}
# Fixed values: (id, one of these, and one of these, where it is shown: at the first finding of these rules).
CHAINS = [
    (
        "chain.decode_exec",
        ["python.encoded_payload", "js.decode_and_run"],
        ["python.dangerous_sinks", "js.code_exec", "python.dynamic_import"],
        ["python.dangerous_sinks", "js.code_exec", "python.encoded_payload", "js.decode_and_run"],
    ),
    (
        "chain.remote_code_egress",
        ["python.trust_remote_code", "python.torch_remote_code", "json.automodel_usage", "json.autotokenizer_usage"],
        ["python.network_egress", "js.network_egress"],
        ["python.network_egress", "js.network_egress", "python.trust_remote_code", "python.torch_remote_code"],
    ),
]
# Calls of models, sinks of their output, assignments.
MODEL_CALL = {
    "py": r"\.(a?generate|a?predict|a?invoke|a?run|complete|acomplete|chat|stream|__call__|predict_messages)\s*\(|\.(chat\.)?completions\.create\s*\(|\.messages\.create\s*\(|\bllm\s*\(",
    "js": r"\.(generate|invoke|run|complete|stream|predict|call)\s*\(|\.chat\.completions\.create\s*\(|\.messages\.create\s*\(|\.create(Chat)?Completion\s*\(",
}
FLOW_SINK = {
    "py": r"(?<![.\w])(eval|exec|compile)\s*\(|\bos\.(system|popen)\s*\(|\bsubprocess\.(run|call|check_output|check_call|Popen)\s*\(",
    "js": r"(?<![.\w])eval\s*\(|\bnew\s+Function\s*\(|\b(execSync|execFileSync|spawnSync|execFile|exec|spawn)\s*\(|\bvm\.\w+\s*\(",
}
ASSIGN = r"^\s*(?:export\s+)?(?:const|let|var|await\s+)?\s*([A-Za-z_$][\w$]*(?:\s*,\s*[A-Za-z_$][\w$]*)*)\s*(?::[^=\n]+?)?=(?![=>])\s*([\s\S]+)$"

FLOW_RULE = {"py": "python.llm_output_to_sink", "js": "js.llm_output_to_sink"}
# Fixed value: how a comment line begins.
COMMENT = r"^(#|//|\*|/\*)"

_TOKEN = re.compile(r"""("(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'|`(?:\\.|[^`\\])*`)|(["'`].*)|(\#.*|//.*)|([(\[{])|([)\]}])""")
_BRACKET = re.compile(r"[()\[\]{}]")
_UNITS = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("start_line", T.IntegerType())]))


def units_of(text: str) -> list[tuple[str, int]]:
    """Statements: lines joined while a bracket is open or a backslash ends the line, 40 at most."""
    out, part, depth = [], [], 0
    lines = re.split(r"\r?\n", text)
    for i, line in enumerate(lines):
        part.append(line)
        quoted, goes_on = False, line.rstrip().endswith("\\")
        if goes_on or _BRACKET.search(line):  # no other line's tokens matter
            for _, unclosed, _, opens, closes in _TOKEN.findall(line):
                quoted, depth = bool(unclosed), depth + bool(opens) - bool(closes)
        more = depth > 0 or (not quoted and goes_on)
        if not more or len(part) >= MOST_LINES or i + 1 == len(lines):
            out.append(("\n".join(part), i + 2 - len(part)))
            part, depth = [], 0
    return out


@F.pandas_udf(_UNITS)
def logical_units(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else [{"text": a, "start_line": b} for a, b in units_of(t)])


def language_of(file: Column) -> Column:
    low = F.lower(file)
    config = F.substring_index(low, "/", -1).isin("config.json", "tokenizer_config.json", "generation_config.json", "preprocessor_config.json")
    return F.when(low.rlike("\\.py\\z"), "py").when(low.rlike("\\.[mc]?[jt]sx?\\z"), "js").when(config, "json")


def notebook_cells(file: Column, text: Column) -> Column:
    """Array of (file, lang, text) of a notebook's code cells that hold text,
    each file named with #cell and its number among the code cells, empty ones
    counted. The kernel's language chooses the rules, Python if it names none.
    A notebook that can't be read, or a null one, has no cells."""
    schema = "cells array<struct<cell_type:string,source:variant>>, metadata struct<kernelspec:struct<language:string>,language_info:struct<name:string>>"
    notebook = F.from_json(text, schema)
    kernel = F.lower(F.coalesce(notebook["metadata"]["kernelspec"]["language"], notebook["metadata"]["language_info"]["name"], F.lit("python")))
    lang = F.when(kernel.rlike("javascript|typescript|deno|node|^[jt]s\\z"), "js").otherwise("py")

    def cell(c: Column, nth: Column) -> Column:
        lines = F.array_join(F.try_variant_get(c["source"], "$", "array<string>"), "")
        source = F.coalesce(lines, F.try_variant_get(c["source"], "$", "string"), F.lit(""))
        return F.struct(F.concat(file, F.lit("#cell"), (nth + 1).cast("string")).alias("file"), lang.alias("lang"), source.alias("text"))

    code = F.filter(notebook["cells"], lambda c: c["cell_type"] == "code")
    return F.filter(F.transform(code, cell), lambda c: c["text"].rlike("[^ \\t\\r\\n]"))


#: All patterns of rules with their languages, in the order of the bits of _rules_in.
_PATTERNS = [(lang, rule[4]) for lang, rules in LANGUAGES.items() for rule in rules]
_rules_in = L.candidates([L.needs(p) for _, p in _PATTERNS])
_flows_in = L.candidates([L.needs(some[lang]) for lang in ("py", "js") for some in (MODEL_CALL, FLOW_SINK)])


def _bits_of(lang: Column, bits: dict[str, int]) -> Column:
    out = F.lit(0)
    for name, value in bits.items():
        out = F.when(lang == name, F.lit(value)).otherwise(out)
    return out.cast("bigint")


def may_have_findings(lang: Column, text: Column) -> Column:
    """Whether a rule may match in a file: only such files need to be cut into statements for rule_findings."""
    bits = {name: sum(1 << i for i, (x, _) in enumerate(_PATTERNS) if x == name) for name in LANGUAGES}
    return _rules_in(text).bitwiseAND(_bits_of(lang, bits)) != 0


def may_have_flows(lang: Column, text: Column) -> Column:
    """Whether a file may hold both a call of a model and a sink."""
    bits = _bits_of(lang, {"py": 3, "js": 12})
    return (bits != 0) & (_flows_in(text).bitwiseAND(bits) == bits)


def source_files(files: DataFrame, file: str = "file", text: str = "text", only=None) -> DataFrame:
    """(file, lang, units, paths, constants) of the files in a language with
    rules, and of notebooks' code cells; units holds (text, start_line) of each
    statement, paths and constants the names of the path module and of fixed
    paths in scripts that load modules by computed names, else null. With only,
    a test of lang and text, the files and cells that pass it."""
    name, lang, body = F.col(file), language_of(F.col(file)), F.col(text)
    whole = F.when(lang.isNotNull(), F.array(F.struct(name.alias("file"), lang.alias("lang"), F.coalesce(body, F.lit("")).alias("text"))))
    parts = F.when(F.lower(name).endswith(".ipynb"), notebook_cells(name, body)).otherwise(whole)
    rows = files.select(F.explode_outer(parts).alias("p")).where("p is not null").select("p.*")
    if only is not None:
        rows = rows.where(only(F.col("lang"), F.col("text")))
    loads = (F.col("lang") == "js") & matches(F.col("text"), DYNAMIC)
    rows = rows.select("file", "lang", "text", logical_units("text").alias("units"), F.when(loads, path_names(F.col("text"))).alias("paths"))
    return rows.select("file", "lang", "units", "paths", F.when(F.col("paths").isNotNull(), constant_paths(F.col("text"), F.col("paths"))).alias("constants"))


def _statements(parsed: DataFrame) -> DataFrame:
    return parsed.select("file", "lang", "paths", "constants", F.explode_outer("units").alias("u")).select("file", "lang", F.col("u.start_line").alias("start_line"), F.col("u.text").alias("unit"), "paths", "constants")


def statements(files: DataFrame, file: str = "file", text: str = "text") -> DataFrame:
    """(file, lang, start_line, unit, paths, constants), one row a statement of source_files."""
    return _statements(source_files(files, file, text))


def rule_findings(units: DataFrame) -> DataFrame:
    """(file, rule, severity, category, confidence, line, start_line, ord): the
    first match of each rule in each statement, outside comment lines and, where
    a rule says so, string literals; a rule once a line. start_line and ord (place of the rule) give the order of findings."""
    unit = F.col("unit")

    def found(low: Column) -> Column:
        by_lang = F.lit(None)
        for lang, rules in LANGUAGES.items():
            out = []
            for i, (rule, severity, category, confidence, pattern, fold, code_only) in enumerate(rules):
                prefix = before_first(unit, pattern, fold)
                value = F.struct(F.lit(i).alias("ord"), F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), F.lit(category).alias("category"), F.lit(confidence).alias("confidence"), F.lit(code_only).alias("code_only"), prefix.alias("prefix"))
                out.append(F.when(L.matches(unit, low, pattern, fold), value))
            by_lang = F.when(F.col("lang") == lang, F.array_compact(F.array(*out))).otherwise(by_lang)
        return by_lang

    hits = units.select("file", "start_line", "unit", "paths", "constants", F.explode_outer(let(F.lower(unit), found)).alias("h")).where("h is not null").select("file", "start_line", "unit", "paths", "constants", "h.*")
    nth = line_after(F.col("prefix"))
    shown = F.trim(F.get(F.split("unit", "\\r?\\n"), nth - 1))
    quoted = F.when(F.col("code_only"), in_literal(F.col("prefix"))).otherwise(False)
    harmless = F.when(F.col("rule") == "js.dynamic_require", loads_nothing_hidden(F.col("unit"), F.col("prefix"), F.col("paths"), F.col("constants"))).otherwise(False)
    kept = hits.withColumn("line", F.col("start_line") + nth - 1).where(~quoted & ~F.coalesce(harmless, F.lit(False)) & (shown != "") & ~shown.rlike(COMMENT))
    same = ("severity", "category", "confidence", "ord")
    return kept.groupBy("file", "rule", "line").agg(*[F.first(c).alias(c) for c in same], F.min("start_line").alias("start_line"))


def _chains() -> Column:
    """Array of (rule, line) of a file's chains, as an aggregate of (rule, start_line, ord, line) of its findings."""
    out = []
    for name, left, right, shown in CHAINS:
        has = lambda ids: F.bool_or(F.col("rule").isin(*ids))
        first = F.min(F.when(F.col("rule").isin(*shown), F.struct("start_line", "ord", "line")))
        out.append(F.when(has(left) & has(right), F.struct(F.lit(name).alias("rule"), F.coalesce(first["line"], F.lit(1)).alias("line"))))
    return F.array_compact(F.array(*out))


def chain_findings(found: DataFrame) -> DataFrame:
    """(file, rule, line): files whose rules meet both sides of a chain, at the
    first finding, by statement and then rule, of those that the chain is shown at; at line 1 if there is none."""
    used = sorted({rule for _, *some in CHAINS for ids in some for rule in ids})
    rolled = found.where(F.col("rule").isin(*used)).groupBy("file").agg(_chains().alias("chains"))
    return rolled.select("file", F.explode_outer("chains").alias("c")).where("c is not null").select("file", "c.rule", "c.line")


def _names(text: Column) -> Column:
    """What a name may match as a whole word of a text."""
    return F.array_distinct(F.concat(F.regexp_extract_all(text, F.lit("\\w+"), F.lit(0)), F.regexp_extract_all(text, F.lit("[\\w$]+"), F.lit(0))))


def _tainted(units: Column, calls: str) -> Column:
    """Names assigned from a model call or from such a name, in the order in
    which they are met: two passes over the statements, as an assignment may
    stand before that of the name it takes. A name that begins or ends with a
    dollar is never a whole word."""

    def assignment(u: Column) -> Column:
        right = F.regexp_extract(u["text"], java(ASSIGN), 2)
        names = F.filter(F.transform(F.split(F.regexp_extract(u["text"], java(ASSIGN), 1), ","), lambda t: F.trim(t)), lambda n: n != "")
        return F.struct(names.alias("names"), matches(right, calls).alias("calls"), _names(right).alias("uses"))

    def step(known: Column, a: Column) -> Column:
        return F.when(a["calls"] | F.arrays_overlap(known, a["uses"]), F.array_union(known, a["names"])).otherwise(known)

    assigned = F.transform(F.filter(units, lambda u: matches(u["text"], ASSIGN)), assignment)
    return let(assigned, lambda a: F.aggregate(F.concat(a, a), F.array().cast("array<string>"), step))


def _sinks(unit: Column, pattern: str) -> Column:
    """Array of (sink, nth, shown, uses) of all sinks of a statement: the
    match, the number of its line within the statement and that line, and the words after its bracket."""
    text = unit["text"]

    def of(found: Column, gaps: Column) -> Column:
        def sink(value: Column, i: Column) -> Column:
            before = F.array_join(F.zip_with(F.slice(gaps, F.lit(1), i + 1), F.slice(found, F.lit(1), i), lambda g, f: F.concat(g, F.coalesce(f, F.lit("")))), "")

            def placed(prefix: Column) -> Column:
                rest = F.substring(text, F.length(prefix) + 1, F.length(text))
                nth = line_after(prefix)
                inside = F.when(F.instr(rest, "(") > 0, F.substring(rest, F.instr(rest, "("), F.length(rest))).otherwise("")
                name = F.left(F.trim(F.regexp_replace(value, "\\s*\\($", "")), F.lit(120))
                return F.struct(name.alias("sink"), nth.alias("nth"), F.trim(F.get(F.split(text, "\\r?\\n"), nth - 1)).alias("shown"), _names(inside).alias("uses"))

            return let(before, placed)

        return F.transform(found, sink)

    found = F.regexp_extract_all(text, F.lit(java(pattern)), F.lit(0))
    return let(found, lambda f: let(F.split(text, java(pattern), -1), lambda g: of(f, g)))


def flow_findings(files: DataFrame) -> DataFrame:
    """(file, rule, name, sink, line) over source_files: sinks outside comment
    lines whose arguments name a variable that is assigned from a model call
    or from such a variable. name is the first one met; a line is reported
    once. A file is one row, and nothing is shuffled."""
    lang = F.col("lang")
    each = lambda of: F.when(lang == "py", of("py")).when(lang == "js", of("js"))
    some = each(lambda x: F.exists("units", lambda u: matches(u["text"], MODEL_CALL[x])) & F.exists("units", lambda u: matches(u["text"], FLOW_SINK[x])))
    names = let(F.when(some, each(lambda x: _tainted(F.col("units"), MODEL_CALL[x]))), lambda t: F.when(F.size(t) > 0, F.array(t)))
    mine = files.select("file", "lang", "units", F.explode_outer(names).alias("tainted")).where("tainted is not null")  # not a filter of units, for which files were cut twice
    rows = mine.select("file", "lang", "tainted", F.posexplode_outer("units").alias("u", "unit"))
    rows = rows.select("file", "lang", "tainted", F.col("unit.start_line").alias("start_line"), F.posexplode(each(lambda x: _sinks(F.col("unit"), FLOW_SINK[x]))).alias("s", "sink"))
    via = F.get(F.filter("tainted", lambda t: F.array_contains(F.col("sink.uses"), t)), F.lit(0))
    shown = F.col("sink.shown")
    rows = rows.select("file", "lang", "start_line", "s", via.alias("name"), F.col("sink.sink").alias("sink"), shown.alias("shown"), (F.col("start_line") + F.col("sink.nth") - 1).alias("line"))
    rows = rows.where((F.col("name").isNotNull()) & (F.col("shown") != "") & ~F.col("shown").rlike(COMMENT))
    first = rows.groupBy("file", "lang", "line").agg(F.min_by(F.struct("name", "sink"), F.struct("start_line", "s")).alias("f"))
    return first.select("file", each(lambda x: F.lit(FLOW_RULE[x])).alias("rule"), F.col("f.name").alias("name"), F.col("f.sink").alias("sink"), "line")


def find_rules(files: DataFrame, file: str = "file", text: str = "text") -> DataFrame:
    """rule_findings of source files; only files in which a rule may match are cut into statements."""
    return rule_findings(_statements(source_files(files, file, text, may_have_findings)))


def find_flows(files: DataFrame, file: str = "file", text: str = "text") -> DataFrame:
    """flow_findings of source files; only files that may hold a call of a model and a sink are cut into statements."""
    return flow_findings(source_files(files, file, text, may_have_flows))


def scan_source(files: DataFrame, file: str = "file", text: str = "text") -> DataFrame:
    """(file, rule, severity, category, confidence, line): the findings of the
    rules, the flows and the chains of source files, together."""
    kept = ("rule", "severity", "category", "confidence", "line")
    flat = lambda x, severity, category, confidence: F.struct(x["rule"].alias("rule"), F.lit(severity).alias("severity"), F.lit(category).alias("category"), F.lit(confidence).alias("confidence"), x["line"].alias("line"))
    rolled = find_rules(files, file, text).groupBy("file").agg(F.collect_list(F.struct(*kept)).alias("rules"), _chains().alias("chains"))
    both = F.concat("rules", F.transform("chains", lambda c: flat(c, "CRITICAL", "chain", 0.6)))
    flows = find_flows(files, file, text).select("file", flat(F.struct("rule", "line"), "HIGH", "taint-heuristic", 0.5).alias("f"))
    return rolled.select("file", F.explode_outer(both).alias("f")).unionByName(flows).select("file", "f.*")
