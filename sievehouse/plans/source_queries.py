"""Queries of files, settings, variables and launch lines over the given tables, and their SQL.

Pages stand for files of a tree, documents for settings and variables; names
and snippets are dealt to them by their numbers, and whole texts are read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import artifacts, gate, inventory, keys, machines, models
from ..sources import files
from . import inventory_queries as I
from . import queries as Q
from .frame_queries import _picked, _picked_sql

_table, _quote = Q._table, Q._quote

_NAMES = [
    ".mcp.json", "mcp.json", ".gemini/settings.json", ".vscode/settings.json", *files.RULES, ".github/copilot-instructions.md", "agents.md", *files.MANIFESTS, "pipfile", ".env", ".env.local", ".env.Example", ".envrc",
    "index.faiss", "Index.pkl", "docstore.json", "x.lance", "chroma.sqlite3", "main.py", "App.TSX", "n.ipynb", "go.mod", "lib.rs", "README", ".cursor/mcp.json", ".zed/settings.json", ".cursor/rules.md",
]
_FOLDERS = ["src", "node_modules/x", "a/vendor", "lib", ".venv", "deep/er"]


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, path, content): each page as a file of one of 50 folders."""
    n = F.col("page_id")
    path = F.concat(F.lit("/w/"), (n % 50).cast("string"), F.lit("/"), _picked(_FOLDERS, F.floor(n / 50)), F.lit("/"), _picked(_NAMES, n))
    content = F.concat(F.coalesce("html", F.lit("")), F.when(n % 19 == 4, F.char(F.lit(0))).otherwise(""))
    return _table(spark, sf_dir, "pages").select("page_id", path.alias("path"), content.cast("binary").alias("content"))


def tree_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a tree that matter, by what they are for, and how reading went; none is larger than 2,000 bytes."""
    found = files.classify(_tree(spark, sf_dir), 2000)
    return found.groupBy("path", "role", "state").agg(F.count("*").alias("n"), F.sum("bytes").cast("long").alias("bytes"), F.sum(F.length("text")).cast("long").alias("chars"))


_in = lambda xs: "(" + ", ".join(map(_quote, xs)) + ")"
_TREE_CTE = f"""t AS (SELECT page_id, '/w/' || page_id % 50 || '/' || {_picked_sql(_FOLDERS, 'page_id // 50')} || '/' || {_picked_sql(_NAMES, 'page_id')} AS path, coalesce(html, '') AS html, page_id % 19 = 4 AS nul FROM pages),
b AS (SELECT *, split_part(path, '/', -1) AS base, split_part(path, '/', -2) AS parent FROM t WHERE NOT list_has_any(string_split(path, '/')[:-2], [{', '.join(map(_quote, files.IGNORED))}]))"""
_TREE_SQL = f"""WITH {_TREE_CTE},
r AS (SELECT *, octet_length(encode(html)) + CASE WHEN nul THEN 1 ELSE 0 END AS bytes, CASE WHEN base IN ('.mcp.json', 'mcp.json') OR (base = 'settings.json' AND parent IN ('.gemini', '.zed')) THEN 'mcp'
  WHEN base IN {_in(files.RULES)} THEN CASE WHEN base <> 'copilot-instructions.md' OR parent = '.github' THEN 'rules' END WHEN base IN {_in(files.MANIFESTS)} THEN 'manifest'
  WHEN regexp_matches(base, '^\\.env(\\..+)?$') AND NOT regexp_matches(base, '(?i)(example|sample|template|dist)') THEN 'env' WHEN lower(base) IN {_in(files.VECTORS)} OR regexp_matches(lower(base), '\\.(faiss|lance|usearch)$') THEN 'vector'
  WHEN regexp_matches(lower(base), '\\.(py|ipynb|[mc]?[jt]sx?|java|kt|go|rb|php|cs|rs|scala)$') THEN 'source' END AS role FROM b),
s AS (SELECT path, role, bytes, CASE WHEN bytes > 2000 THEN 'oversized' WHEN nul THEN 'binary' ELSE 'read' END AS state, html FROM r WHERE role IS NOT NULL)
SELECT path, role, state, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(sum(length(html)) FILTER (state = 'read') AS BIGINT) AS chars FROM s GROUP BY path, role, state"""


def vector_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders of the tree that hold an index, with its engine and files."""
    found = files.vector_stores(_tree(spark, sf_dir).select(F.regexp_replace("path", "/[^/]+/([^/]+)\\z", "/$1").alias("path")))
    return found.withColumn("files", F.array_join("files", ","))


_VECTORS_SQL = f"""WITH {_TREE_CTE}, p AS (SELECT DISTINCT regexp_replace(regexp_replace(path, '/[^/]+/([^/]+)$', '/\\1'), '/[^/]*$', '') AS folder, lower(split_part(path, '/', -1)) AS name FROM t),
v AS (SELECT * FROM p WHERE name IN {_in(files.VECTORS)} OR regexp_matches(name, '\\.(faiss|lance|usearch)$')),
e AS (SELECT folder, CASE WHEN bool_or(name = 'chroma.sqlite3' OR starts_with(name, 'chroma-')) THEN 'chroma' WHEN bool_or(name = 'index.faiss') THEN 'faiss' WHEN bool_or(ends_with(name, '.lance')) THEN 'lancedb'
  WHEN bool_or(ends_with(name, '.usearch')) THEN 'usearch' WHEN bool_or(name IN ('docstore.json', 'default__vector_store.json')) THEN 'llamaindex' END AS engine, bool_or(name = 'index.pkl') AS pkl, array_to_string(list_sort(list(name))[1:20], ',') AS files FROM v GROUP BY folder)
SELECT folder, engine, engine = 'faiss' AND pkl AS pickle_backed, files FROM e WHERE engine IS NOT NULL"""


def settings_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How reading each document's settings went, and how many fields they have."""
    parsed = files.parse_json(F.col("text"), 60_000)
    fields = F.size(F.map_keys(F.try_variant_get(parsed["json"], "$", "map<string,variant>")))
    return I._settings(spark, sf_dir).select("doc_id", parsed["state"].alias("state"), F.when(fields >= 0, fields).cast("long").alias("fields"))


_STATES_SQL = f"""WITH {I._SETTINGS_CTE} SELECT doc_id, CASE WHEN raw IS NULL THEN 'absent' WHEN json_valid(text) AND length(raw) <= 60000 THEN 'parsed' ELSE 'unreadable' END AS state,
  CASE WHEN json_valid(text) AND length(raw) <= 60000 AND json_type(text) = 'OBJECT' THEN len(json_keys(CASE WHEN json_valid(text) THEN text END)) END AS fields FROM sb"""


def process_variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model keys among the variables that documents assign, read as a process's."""
    env = I._files(spark, sf_dir).where(F.col("path").endswith("/.env")).select("path", F.explode(files.environment_entries(F.col("text"))).alias("e"))
    found = keys.process_keys(env.select(F.col("e.name").alias("name"), F.col("e.value").alias("value")))
    return found.groupBy("name", "vendor", "fingerprint").agg(F.count("*").alias("n"))


_PROCESS_SQL = f"""WITH {I._FILES_SQL}, {I._values('kv(name, vendor)', list(keys.KEY_VENDORS.items()))},
v AS (SELECT e.name, coalesce(kv.vendor, CASE WHEN regexp_matches(e.name, '(_API_KEY|_API_TOKEN|_APIKEY)$') THEN CASE {I._SHAPES_SQL} WHEN regexp_matches(e.name, '{keys.KEY_HINT}') THEN 'unknown' END END) AS vendor, left(value, 3) || '…' || right(value, 2) AS fingerprint
  FROM entries e LEFT JOIN kv ON kv.name = e.name WHERE length(value) >= 8)
SELECT name, vendor, fingerprint, count(*) AS n FROM v WHERE vendor IS NOT NULL GROUP BY ALL"""

_COMMANDS = ["npx", "/usr/bin/npx", "node", "pnpm", "bunx", "yarn"]
_ARGS = [["-y", "@scope/server@1.2", "--port"], ["exec", "tool@^2"], ["run", "--quiet"], ["@only"], ["pkg", "other"], ["--flag", "create", "left-pad@latest"]]


def launched_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The package that each document's launch line asks a runner for, and the vendor whose folder its file lies in."""
    n = F.col("doc_id")
    args = F.element_at(F.array(*[F.array(*map(F.lit, a)) for a in _ARGS]), (F.pmod(F.floor(n / 6), F.lit(len(_ARGS))) + 1).cast("int"))
    path = F.concat(F.lit("/home/"), _picked([".cursor/", ".gemini/", "x.zed/", ".vscode/", "code\\.cursor\\", ".zed"], n), F.lit("a.json"))
    package = gate.launched_package(_picked(_COMMANDS, n), args)
    return _table(spark, sf_dir, "documents").select("doc_id", package.alias("package"), artifacts.vendor_of_path(path).alias("vendor"))


_ARGS_SQL = "[" + ", ".join("[" + ", ".join(map(_quote, a)) + "]" for a in _ARGS) + "]"
_LAUNCH_SQL = f"""WITH d AS (SELECT doc_id, split_part({_picked_sql(_COMMANDS, 'doc_id')}, '/', -1) AS command, {_ARGS_SQL}[doc_id // 6 % {len(_ARGS)} + 1] AS args,
  '/home/' || {_picked_sql([".cursor/", ".gemini/", "x.zed/", ".vscode/", "code\\.cursor\\", ".zed"], 'doc_id')} || 'a.json' AS path FROM documents),
a AS (SELECT *, list_filter(args, lambda x: NOT starts_with(x, '-') AND x NOT IN {_in(gate.SKIPPED)})[1] AS name FROM d)
SELECT doc_id, CASE WHEN command IN {_in(gate.RUNNERS)} THEN CASE WHEN starts_with(name, '@') THEN regexp_replace(name, '@[0-9^~].*$', '') ELSE split_part(name, '@', 1) END END AS package,
  CASE WHEN regexp_matches(path, '[\\\\/]\\.cursor[\\\\/]') THEN 'cursor' WHEN regexp_matches(path, '[\\\\/]\\.vscode[\\\\/]') THEN 'vscode' WHEN regexp_matches(path, '[\\\\/]\\.gemini[\\\\/]') THEN 'gemini'
    WHEN regexp_matches(path, '[\\\\/]\\.zed[\\\\/]') THEN 'zed' ELSE 'project' END AS vendor FROM a"""

_IDS = ["org/model-7b", "docs/hub", "a/b/c", "bert-base", "gpt-4o", "auto", "claude-3-opus", "x", "../up/y", "org/1", "@s/p", "tool.py", "org/data.json", "Gemini-1.5-pro", "12345", "./m", "mistral-large", "command-r"]


def model_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of models in documents: whether they can be one of a repository or stand alone, and who hosts them."""
    name = F.concat(_picked(_IDS, F.col("doc_id")), F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("-"), F.col("lang"))).otherwise(""))
    rows = _table(spark, sf_dir, "documents").where("lang is not null").select("doc_id", name.alias("model"))
    m = F.col("model")
    return rows.select("doc_id", "model", models.is_repository_id(m).alias("repository"), models.is_bare_id(m).alias("bare"), models.hosted_by(m).alias("host"))


def _models_sql() -> str:
    parts = "string_split(model, '/')"
    asset = models.ASSET.replace("'", "''")
    letters = lambda i: f"coalesce(regexp_matches({parts}[{i}], '[A-Za-z]'), false)"
    host = "CASE" + "".join(f" WHEN regexp_matches(lower(model), '{Q.R.re2(p)}') THEN '{n}'" for n, p in models.PROVIDERS) + " ELSE 'api' END"
    return f"""WITH d AS (SELECT doc_id, {_picked_sql(_IDS, 'doc_id')} || CASE WHEN doc_id % 5 = 0 THEN '-' || lang ELSE '' END AS model FROM documents WHERE lang IS NOT NULL),
r AS (SELECT *, NOT regexp_matches(model, '^[@./]') AND NOT contains(model, '..') AND len({parts}) = 2 AND NOT regexp_matches(model, '(?i){asset}') AND {letters(1)} AND {letters(2)} AND lower({parts}[1]) NOT IN {_in(models.NOT_ORGS)} AS repository FROM d)
SELECT doc_id, model, repository, NOT regexp_matches(model, '^[@./]') AND NOT contains(model, '..') AND lower(model) NOT IN {_in(models.NOT_IDS)} AND CASE WHEN contains(model, '/') THEN repository
  ELSE NOT regexp_matches(model, '(?i){asset}') AND length(model) >= 2 AND regexp_matches(model, '[A-Za-z]') END AS bare, {host} AS host FROM r"""


_MACHINES = 97


def machine_postures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of 97 machines lets every vendor do, from the settings each vendor reads there; documents are those files, the first of a place counts."""
    n = F.col("doc_id")
    at = F.element_at(F.array(*[F.struct(F.lit(b).alias("base"), F.lit(p).alias("path")) for _, b, p, _ in machines.SOURCES]), (F.pmod(F.floor(n / _MACHINES), F.lit(len(machines.SOURCES))) + 1).cast("int"))
    rows = I._settings(spark, sf_dir).select("doc_id", (n % _MACHINES).alias("machine"), at["base"].alias("base"), at["path"].alias("path"), "text")
    first = rows.groupBy("machine", "base", "path").agg(F.min("doc_id").alias("doc_id"))
    files = rows.join(first, ["machine", "base", "path", "doc_id"], "left_semi")
    return inventory.merge_postures(machines.posture_sources(rows, files), ["machine", "vendor"])


_PLACED = f"""{I._values('src(vendor, base, path, scope, nth)', [(*x, str(i)) for i, x in enumerate(machines.SOURCES)])},
own AS (SELECT *, doc_id % {_MACHINES} AS machine, doc_id // {_MACHINES} % {len(machines.SOURCES)} AS nth FROM js QUALIFY row_number() OVER (PARTITION BY machine, nth ORDER BY doc_id) = 1),
want AS (SELECT machine, src.vendor, CAST(nth AS INTEGER) AS nth FROM (SELECT DISTINCT doc_id % {_MACHINES} AS machine FROM documents) x, src),
m AS (SELECT w.machine, w.vendor, tier, w.nth AS ord, doc_id, raw, coalesce(ok, false) AS ok, CASE WHEN ok THEN doc ELSE '{{}}' END AS doc FROM want w JOIN tiers USING (vendor) LEFT JOIN own ON own.machine = w.machine AND own.nth = w.nth)"""
_MACHINES_SQL = I._POSTURE_SQL.replace(I._MERGED_CTE, _PLACED)


def machine_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistants, runtimes and autonomous tools of 40 machines: a page is a path that exists, and its address the name of a process."""
    n = F.col("page_id")
    places = [p for _, _, _, probes in machines.PROBES for p in probes] + [("home", "nothing")]
    at = F.element_at(F.array(*[F.struct(F.lit(b).alias("base"), F.lit(p).alias("path")) for b, p in places]), (F.pmod(n, F.lit(len(places))) + 1).cast("int"))
    pages = _table(spark, sf_dir, "pages").select((n % 40).alias("machine"), at["base"].alias("base"), at["path"].alias("path"), F.concat("url", _picked(_RUNNING, n)).alias("process"))
    return machines.installed_tools(pages, pages)


_RUNNING = ["", " Ollama", "", " LM Studio", "", "", " vLLM serve", " ninja", ""]
_PLACES = [p for _, _, _, probes in machines.PROBES for p in probes] + [("home", "nothing")]
_TOOLS_SQL = f"""WITH {I._values('probes(kind, vendor, name, base, path, nth)', [(k, v, n, b, p, str(i)) for k, v, n, ps in machines.PROBES for i, (b, p) in enumerate(ps)])},
{I._values('tokens(vendor, token)', [(v, t) for v, ts in machines.PROCESSES.items() for t in ts])}, {I._values('names(vendor, name)', [(v, n) for k, v, n, _ in machines.PROBES if k == 'local-runtime'])},
p AS (SELECT page_id % 40 AS machine, {_picked_sql([b for b, _ in _PLACES], 'page_id')} AS base, {_picked_sql([p for _, p in _PLACES], 'page_id')} AS path, lower(url || {_picked_sql(_RUNNING, 'page_id')}) AS process FROM pages),
a AS (SELECT machine, kind, vendor, name, arg_min(probes.base || ':' || probes.path, CAST(nth AS INTEGER)) AS spot FROM p JOIN probes USING (base, path) GROUP BY ALL),
r AS (SELECT DISTINCT machine, 'local-runtime' AS kind, vendor, name, true AS runs FROM p JOIN tokens ON contains(process, token) JOIN names USING (vendor))
SELECT machine, kind, vendor, name, coalesce(spot, 'proc:' || vendor) AS identifier, CASE WHEN kind = 'local-runtime' THEN coalesce(runs, false) END AS running FROM a FULL JOIN r USING (machine, kind, vendor, name)"""

_SERVERS = [
    '{"mcpServers": {"files": {"command": "npx", "args": ["-y", "", "@scope/files"], "env": {"B": "1", "A": "2"}}, "web": {"url": "https://a.example/m"}, "bad": "no"}}', '{"servers": {"web": {"serverUrl": "https://a.example/m", "url": ""}}}',
    '{"mcp.servers": {"dot": {"command": "run"}}}', '{"mcp": {"servers": {"bare": {}}}}', '{"context_servers": {"files": {"command": "npx", "args": ["other"]}}}', '{"mcpServers": {"files": ', '{"mcpServers": {}, "servers": {"hidden": {"command": "x"}}}',
]
_CONFIGS = [".mcp.json", ".cursor/mcp.json", ".gemini/settings.json", ".zed/settings.json", ".vscode/mcp.json"]


def servers_declared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool servers that configuration files declare; each document is one, with its whole text as a field."""
    n = F.col("doc_id")
    path = F.concat(F.lit("/w/"), F.lpad(n.cast("string"), 12, "0"), F.lit("/"), _picked(_CONFIGS, n))
    files_ = _table(spark, sf_dir, "documents").select(path.alias("path"), I._packed(_picked(_SERVERS, n), F.col("text")).alias("text"))
    return inventory.declared_servers(files_.withColumn("vendor", artifacts.vendor_of_path(F.col("path"))))


_SERVERS_SQL = f"""WITH d AS (SELECT '/w/' || lpad(CAST(doc_id AS VARCHAR), 12, '0') || '/' || {_picked_sql(_CONFIGS, 'doc_id')} AS path, {I._packed_sql(_picked_sql(_SERVERS, 'doc_id'), 'text')} AS text FROM documents),
j AS (SELECT path, CASE WHEN json_valid(text) THEN coalesce(json_extract(text, '$.mcpServers'), json_extract(text, '$.servers'), json_extract(text, '$."mcp.servers"'), json_extract(text, '$.mcp.servers'), json_extract(text, '$.context_servers')) END AS m FROM d),
e AS (SELECT j.path AS path, k.key AS name, k.value AS v FROM j, json_each(j.m) k WHERE json_type(k.value) = 'OBJECT'),
r AS (SELECT path, name, array_to_string(list_filter(list_concat([json_extract_string(v, '$.command')], coalesce(CAST(json_extract(v, '$.args') AS VARCHAR[]), [])), lambda w: w IS NOT NULL AND w <> ''), ' ') AS command,
  coalesce(nullif(json_extract_string(v, '$.url'), ''), nullif(json_extract_string(v, '$.serverUrl'), '')) AS url, coalesce(array_to_string(list_sort(json_keys(json_extract(v, '$.env'))), ','), '') AS env FROM e),
i AS (SELECT *, coalesce(url, nullif(command, ''), name) AS identifier FROM r),
f AS (SELECT * FROM i QUALIFY row_number() OVER (PARTITION BY name, identifier ORDER BY path) = 1)
SELECT name, identifier, CASE WHEN contains(path, '/.cursor/') THEN 'cursor' WHEN contains(path, '/.gemini/') THEN 'gemini' WHEN contains(path, '/.zed/') THEN 'zed' WHEN contains(path, '/.vscode/') THEN 'vscode' ELSE 'project' END AS vendor,
  command, url, path AS config_file, env FROM f"""


_CLIENTS = ['{"dependencies": {"mcp-use": "1", "@modelcontextprotocol/sdk": "1", "mcp": "2"}}', '{"devDependencies": {"@mastra/mcp-client": "1"}}', '{"name": "x"}']
_PIP_CLIENTS = ["fastmcp>=2\nmy-mcp", "mcp[cli]==1", "langchain_mcp", "deps = [\"langchain-mcp-adapters\"]"]


def client_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Libraries that make programs clients of tool servers, with how many manifests depend on them and the first of them."""
    n, number = F.col("doc_id"), F.lpad(F.col("doc_id").cast("string"), 12, "0")
    both = F.array(F.struct(F.concat(number, F.lit("/package.json")).alias("path"), I._packed(_picked(_CLIENTS, n), F.col("text")).alias("text")), F.struct(F.concat(number, F.lit("/pyproject.toml")).alias("path"), F.concat_ws("\n", "text", _picked(_PIP_CLIENTS, n)).alias("text")))
    return inventory.client_assets(_table(spark, sf_dir, "documents").select(F.explode(both).alias("f")).select("f.path", "f.text"))


_NPM_CLIENT_SQL = "(package IN (" + ", ".join(map(_quote, inventory.NPM_CLIENTS)) + ") OR " + " OR ".join(f"starts_with(package, '{p}')" for p in inventory.NPM_CLIENT_PREFIXES) + ")"
_CLIENTS_SQL = f"""WITH n AS (SELECT lpad(CAST(doc_id AS VARCHAR), 12, '0') || '/package.json' AS path, {I._packed_sql(_picked_sql(_CLIENTS, 'doc_id'), 'text')} AS text FROM documents),
m AS (SELECT path, unnest([json_extract(text, '$.dependencies'), json_extract(text, '$.devDependencies')]) AS m FROM n WHERE json_valid(text)),
w AS (SELECT DISTINCT path, unnest(json_keys(m)) AS package FROM m WHERE json_type(m) = 'OBJECT'),
p AS (SELECT lpad(CAST(doc_id AS VARCHAR), 12, '0') || '/pyproject.toml' AS path, string_split_regex(lower(concat_ws(chr(10), text, {_picked_sql(_PIP_CLIENTS, 'doc_id')})), '[^a-z0-9_.-]+') AS tokens FROM documents),
u AS (SELECT DISTINCT 'npm' AS ecosystem, package, path FROM w WHERE {_NPM_CLIENT_SQL} UNION SELECT DISTINCT 'pip', unnest(list_intersect(tokens, [{', '.join(map(_quote, inventory.PIP_CLIENTS))}])), path FROM p)
SELECT ecosystem, package, count(*) AS n_manifests, array_to_string(list_sort(list(path))[1:10], ',') AS manifests FROM u GROUP BY ALL"""

QUERIES = {
    "servers_declared": servers_declared, "client_rollup": client_rollup, "machine_postures": machine_postures, "machine_tools": machine_tools, "tree_files": tree_files, "vector_folders": vector_folders, "settings_states": settings_states, "process_variables": process_variables, "launched_packages": launched_packages, "model_names": model_names,
}
SQL = {
    "servers_declared": _SERVERS_SQL, "client_rollup": _CLIENTS_SQL, "machine_postures": _MACHINES_SQL, "machine_tools": _TOOLS_SQL, "tree_files": _TREE_SQL, "vector_folders": _VECTORS_SQL, "settings_states": _STATES_SQL, "process_variables": _PROCESS_SQL, "launched_packages": _LAUNCH_SQL, "model_names": _models_sql(),
}
