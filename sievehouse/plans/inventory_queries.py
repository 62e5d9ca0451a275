"""Queries of keys, vector stores, artifacts, switches and policies over the given tables, and their SQL.

As in queries.py, fixed snippets stand on lines of their own in whole texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import artifacts, inventory, keys, policy, scan
from ..operators.urls import host_of
from . import more_queries as M
from . import queries as Q

_table, _quote = Q._table, Q._quote


def _picked(values: list[str], n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(n, F.lit(len(values))) + 1).cast("int"))


def _picked_sql(values: list[str], n: str) -> str:
    return f"list_extract([{', '.join(map(_quote, values))}], CAST(({n}) % {len(values)} AS INTEGER) + 1)"


# ---- manifests and environment files

_NPM = ['{"dependencies": {"openai": "4", "@qdrant/js-client-rest": "1"}}', '{"devDependencies": {"chromadb": "1", "langchain": "0.3"}}', '{"name": "x"}', '{"dependencies": ["openai"]}', '{"peerDependencies": {"@pinecone-database/pinecone": "2", "weaviate-ts-client": "1"}}']
_PIP = ["openai==1.2\nfaiss-cpu>=1.8", "transformers[torch]==4\n# lancedb", "qdrant-client\nPyMilvus ~= 2.4", "pinecone-clients\nflask", ""]
_ENV = [
    "OPENAI_API_KEY=sk-proj-" + "Qm7Zp2Lx9Vt4Rb8Nc6Ws1Yd3" + "\nPINECONE_API_KEY=\"pc-12345678\"\nPINECONE_HOST=idx-1.svc.us-east.pinecone.io:443",
    "export MY_LLM_API_KEY='abcdefgh'\nQDRANT_URL=https://user:pw@q.internal:6333/x\nPORT=8080",
    "HF_TOKEN=${HF_TOKEN}\nWEAVIATE_URL=https://wv.internal\nANTHROPIC_API_KEY=your-key-here\nGROQ_API_KEY=short",
    "TOKEN_A=gsk_" + "A1b2C3d4E5f6G7h8I9j0K1" + "\nMILVUS_URI=localhost\nTOKEN_A=hf_" + "A1b2C3d4E5f6G7h8I9j0K1" + "\nCHROMA_HOST=changeme.example.org",
    "# OPENAI_API_KEY=commented-out\nlower_key=abcdefghij",
    "  GEMINI_API_KEY = AIza-not-long\nQDRANT_API_KEY=q1\nQDRANT_HOST=Q-2.Example.Com\nZILLIZ_CLOUD_URI=https://z.cloud:19530",
]
_LIST = ["dependencies = [\"openai>=1\", 'tiktoken']", "  - pip:\n    - crewai[tools]==0.1", "name = \"x\"  # vllm"]
_NAMES = ["requirements.txt", "pyproject.toml", "environment.yml", "Pipfile", "requirements-dev.txt"]


def _packed(head: Column, text: Column) -> Column:
    """The JSON object head with the whole text as one more field."""
    return F.concat(F.regexp_replace(head, "\\}\\z", ""), F.lit(', "page": '), F.to_json(F.array(text)), F.lit("}"))


def _packed_sql(head: str, text: str) -> str:
    return f"""regexp_replace({head}, '\\}}$', '') || ', "page": ' || CAST(to_json([{text}]) AS VARCHAR) || '}}'"""


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, text): each document as a manifest of npm, one of Python and an
    environment file, with its whole text and a snippet of its own."""
    n, number = F.col("doc_id"), F.lpad(F.col("doc_id").cast("string"), 12, "0")
    deep = F.when(F.pmod("doc_id", F.lit(11)) == 2, F.lit(_DEEP)).otherwise("")
    below = lambda snippet: F.concat_ws("\n", "text", snippet)
    kinds = [
        (F.concat(number, F.lit("/package.json")), _packed(_picked(_NPM, n), F.col("text"))),
        (F.concat(number, F.lit("/"), _picked(_NAMES, n)), below(_picked(_PIP + _LIST, n))),
        (F.concat(deep, number, F.lit("/.env")), below(_picked(_ENV, n))),
    ]
    both = F.array(*[F.struct(p.alias("path"), t.alias("text")) for p, t in kinds])
    return _table(spark, sf_dir, "documents").select(F.explode(both).alias("f")).select("f.path", "f.text")


_DEEP = "d/" * 600
_FILES_SQL = f"""d AS (SELECT doc_id, lpad(CAST(doc_id AS VARCHAR), 12, '0') AS number, text FROM documents),
npm AS (SELECT number || '/package.json' AS path, {_packed_sql(_picked_sql(_NPM, 'doc_id'), 'text')} AS text FROM d),
maps AS (SELECT path, unnest([json_extract(text, '$.dependencies'), json_extract(text, '$.devDependencies'), json_extract(text, '$.peerDependencies'), json_extract(text, '$.optionalDependencies')]) AS m FROM npm WHERE json_valid(text)),
wanted AS (SELECT DISTINCT path, unnest(json_keys(m)) AS package FROM maps WHERE json_type(m) = 'OBJECT'),
pip AS (SELECT number || '/' || {_picked_sql(_NAMES, 'doc_id')} AS path, concat_ws(chr(10), text, {_picked_sql(_PIP + _LIST, 'doc_id')}) AS text FROM d),
env AS (SELECT CASE WHEN doc_id % 11 = 2 THEN '{_DEEP}' ELSE '' END || number || '/.env' AS path, concat_ws(chr(10), text, {_picked_sql(_ENV, 'doc_id')}) AS text FROM d),
lines AS (SELECT path, unnest(l) AS x, generate_subscripts(l, 1) AS place FROM (SELECT path, string_split_regex(text, '\\r?\\n') AS l FROM env)),
parts AS (SELECT path, place, regexp_extract(x, '^\\s*(?:export\\s+)?([A-Z0-9_]+)\\s*=\\s*(.*)$', ['name', 'value']) AS p FROM lines WHERE regexp_matches(x, '^\\s*(?:export\\s+)?[A-Z0-9_]+\\s*=')),
entries AS (SELECT path, place, p.name AS name, regexp_replace(trim(p.value), '^["'']|["'']$', '', 'g') AS value FROM parts)"""


def _values(name: str, rows: list[tuple]) -> str:
    lit = lambda v: str(v).upper() if isinstance(v, bool) else _quote(v)
    return f"{name} AS (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)})"


_DUMMY_SQL = "regexp_matches(value, '(?i)(your|xxx|placeholder|changeme|<|example)')"
_SHAPES_SQL = " ".join(f"WHEN regexp_matches(value, '{p}') THEN '{v}'" for p, v in keys.KEY_SHAPES)
_KEYS_CTE = f"""{_values('kv(name, vendor)', list(keys.KEY_VENDORS.items()))},
vendors AS (SELECT e.*, coalesce(kv.vendor, CASE {_SHAPES_SQL} WHEN regexp_matches(e.name, '(_API_KEY|_API_TOKEN|_APIKEY)$') AND regexp_matches(e.name, '{keys.KEY_HINT}') THEN 'unknown' END) AS vendor
  FROM entries e LEFT JOIN kv ON kv.name = e.name WHERE length(value) >= 8 AND NOT starts_with(value, '${{') AND NOT {_DUMMY_SQL}),
found AS (SELECT path, name, vendor, left(value, 3) || '…' || right(value, 2) AS fingerprint FROM vendors WHERE vendor IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY path, name ORDER BY place) = 1)"""
_CLIENTS_CTE = f"""{_values('lib(package, engine, hosted)', [(k, *v) for k, v in keys.VECTOR_LIBRARIES.items()])},
named AS (SELECT path, package FROM wanted UNION ALL
  SELECT path, unnest(list_intersect(string_split_regex(lower(text), '[^a-z0-9_.-]+'), [{', '.join(map(_quote, keys.PIP_VECTOR))}])) FROM pip),
stores AS (SELECT DISTINCT path, CASE WHEN starts_with(n.package, '@pinecone-database/') THEN 'pinecone' WHEN starts_with(n.package, '@qdrant/') THEN 'qdrant' ELSE engine END AS engine,
  starts_with(n.package, '@pinecone-database/') OR starts_with(n.package, '@qdrant/') OR coalesce(hosted, false) AS hosted FROM named n LEFT JOIN lib USING (package)),
clients AS (SELECT engine, hosted, count(*) AS n_manifests, array_to_string(list_sort(list(path))[1:10], ',') AS manifests FROM stores WHERE engine IS NOT NULL GROUP BY ALL)"""
_CLOUD_CTE = f"""{_values('vs(name, engine, kind)', [(k, *v) for k, v in keys.VECTOR_SETTINGS.items()])},
cfg AS (SELECT engine, kind, path, CASE WHEN kind = 'endpoint' THEN coalesce(nullif(regexp_extract(value, '(?i)^[a-z]+://([^/:?#\\s]+)', 1), ''), CASE WHEN regexp_matches(value, '(?i)^[a-z0-9.-]+\\.[a-z]{{2,}}(:[0-9]+)?$') THEN split_part(value, ':', 1) END) END AS host
  FROM entries JOIN vs USING (name) WHERE value <> '' AND NOT {_DUMMY_SQL}),
cloud AS (SELECT engine, bool_or(kind = 'key') AS has_key, bool_or(kind = 'endpoint') AS has_endpoint, coalesce(array_to_string(list_sort(list(DISTINCT host) FILTER (host IS NOT NULL))[1:5], ','), '') AS hosts,
  array_to_string(list_sort(list(DISTINCT path))[1:10], ',') AS files FROM cfg GROUP BY engine)"""


def environment_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model keys of environment files, by name, shape or hint."""
    return keys.environment_keys(_files(spark, sf_dir).where(F.col("path").endswith("/.env")))


def vector_clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector stores that manifests depend on."""
    return keys.vector_clients(_files(spark, sf_dir).where(~F.col("path").endswith("/.env")))


def vector_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosted vector stores that environment files configure."""
    return keys.vector_endpoints(_files(spark, sf_dir).where(F.col("path").endswith("/.env")))


def dependency_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model libraries that manifests depend on, with how many do and the first of them."""
    return inventory.dependency_assets(_files(spark, sf_dir).where(~F.col("path").endswith("/.env")))


def inventory_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All assets of manifests and environment files, clamped, one row each."""
    files = _files(spark, sf_dir)
    env, manifests = files.where(F.col("path").endswith("/.env")), files.where(~F.col("path").endswith("/.env"))
    row = lambda df, kind, name, identifier, vendor: df.select(F.lit(kind).alias("type"), name.alias("name"), identifier.alias("identifier"), vendor.alias("vendor"))
    used = keys.without_vector(inventory.dependency_assets(manifests))
    engine = F.col("engine")
    return keys.assets(
        row(used, "AI_TOOL", F.format_string("%s (%s)", "package", "ecosystem"), F.format_string("dep:%s:%s", "ecosystem", "package"), F.lit("ai-sdk")),
        row(keys.vector_clients(manifests), "VECTOR_STORE", F.concat(engine, F.lit(" client")), F.concat(F.lit("vector:client:"), engine), engine),
        row(keys.vector_endpoints(env), "VECTOR_STORE", F.concat(engine, F.lit(" (cloud)")), F.concat(F.lit("vector:cloud:"), engine), engine),
        row(keys.environment_keys(env), "MODEL_KEY", F.col("name"), F.format_string("dotenv:%s:%s", "path", "name"), F.col("vendor")),
    )


_NPM_SQL = "(package IN (" + ", ".join(map(_quote, inventory.NPM_LIBRARIES)) + ") OR " + " OR ".join(f"starts_with(package, '{p}')" for p in inventory.NPM_PREFIXES) + ")"
_USED_CTE = f"""used AS (SELECT DISTINCT 'npm' AS ecosystem, package, path FROM wanted WHERE {_NPM_SQL}
  UNION SELECT DISTINCT 'pip', unnest(list_filter([{', '.join(map(_quote, inventory.PIP_LIBRARIES))}], lambda p: list_contains(string_split_regex(lower(text), '[^a-z0-9_.-]+'), p))), path FROM pip)"""
_ASSETS_SQL = f"""WITH {_FILES_SQL}, {_KEYS_CTE}, {_CLIENTS_CTE}, {_CLOUD_CTE}, {_USED_CTE},
a AS (SELECT DISTINCT 'AI_TOOL' AS type, package || ' (' || ecosystem || ')' AS name, 'dep:' || ecosystem || ':' || package AS identifier, 'ai-sdk' AS vendor
  FROM used WHERE package NOT IN (SELECT package FROM lib) AND NOT starts_with(package, '@pinecone-database/') AND NOT starts_with(package, '@qdrant/')
UNION ALL SELECT DISTINCT 'VECTOR_STORE', engine || ' client', 'vector:client:' || engine, engine FROM clients
UNION ALL SELECT 'VECTOR_STORE', engine || ' (cloud)', 'vector:cloud:' || engine, engine FROM cloud
UNION ALL SELECT 'MODEL_KEY', name, 'dotenv:' || path || ':' || name, vendor FROM found)
SELECT type, name, CASE WHEN length(identifier) > 1024 THEN left(identifier, 1012) || '…#' || left(sha256(identifier), 10) ELSE identifier END AS identifier, vendor FROM a"""

# ---- artifacts

_PLACES = ["skills/p%/SKILL.md", "settings.json", "agents/Review %.md", "commands/p%.toml", "prompts/p%.md", "chatmodes/p%.md", "notes/p%.md", "config.toml", "hooks.json", "workflows/p%.yml"]
_FRONTS = ["---\nname: 'Deploy helper'\ntools: Bash\n---\n", "", "---\ntools: Read\n---\n", "---\nname:   \"\"\n---\n"]
_HOOKS = ['{"hooks": {"PreToolUse": [{"matcher": "Bash", "command": "x, {y}"}, {}], "A": [[], "b: c"]}, "page": ', '{"hooks": {}, "page": ', '{"page": ', '{"hooks": "none", "page": ']


def _found_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as files of vendors' folders: settings carry the page as a field, other files as their text below a frontmatter."""
    roots = F.array(*[F.struct(F.lit(v).alias("vendor"), F.lit(s).alias("scope"), F.lit(d).alias("dir")) for v, s, d in artifacts.ROOTS])
    n = F.floor(F.col("page_id") / 12)
    place = F.replace(_picked(_PLACES, n), F.lit("%"), F.col("page_id").cast("string"))
    pages = _table(spark, sf_dir, "pages").withColumn("r", F.element_at(roots, (F.pmod("page_id", F.lit(12)) + 1).cast("int")))
    settings = F.concat(_picked(_HOOKS, F.col("page_id")), F.to_json(F.array("html")), F.lit("}"))
    text = F.when(place.endswith(".json"), settings).otherwise(F.concat(_picked(_FRONTS, F.col("page_id")), F.coalesce("html", F.lit(""))))
    files = pages.select("page_id", host_of(F.col("url")).alias("host"), "r.vendor", "r.scope", F.concat("r.dir", F.lit("/"), place).alias("path"), text.alias("text"))
    return artifacts.artifacts(files)


def artifact_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skills, hooks, subagents and commands, with their names and the digests of what would be reported."""
    return _found_artifacts(spark, sf_dir).select("page_id", "vendor", "scope", "kind", "name", "artifact_path", F.sha2("content", 256).alias("content_sha256"))


def artifact_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artifacts by kind, the most frequent first."""
    return artifacts.kind_counts(_found_artifacts(spark, sf_dir))


def artifact_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a report of ten artifacts a vendor keeps, and where it was cut."""
    kept, capped = artifacts.cap_artifacts(_found_artifacts(spark, sf_dir), "vendor", "page_id", 10)
    return kept.select("vendor", F.lit("kept").alias("reason"), "path").unionByName(capped)


_ROOTS_SQL = _values("roots(vendor, scope, dir, slot)", [(*r, str(i)) for i, r in enumerate(artifacts.ROOTS)])
_ARTIFACTS_CTE = f"""{_ROOTS_SQL},
p AS (SELECT page_id, vendor, scope, dir, replace({_picked_sql(_PLACES, 'page_id // 12')}, '%', CAST(page_id AS VARCHAR)) AS place, html FROM pages JOIN roots ON CAST(slot AS INTEGER) = page_id % 12),
fs AS (SELECT page_id, vendor, scope, dir || '/' || place AS path, lower(place) AS low, CASE WHEN ends_with(place, '.json') THEN {_picked_sql(_HOOKS, 'page_id')} || CAST(to_json([html]) AS VARCHAR) || '}}'
  ELSE {_picked_sql(_FRONTS, 'page_id')} || coalesce(html, '') END AS text FROM p),
k AS (SELECT *, split_part(path, '/', -1) AS base, CASE WHEN low LIKE '%/skill.md' THEN 'skill' WHEN low IN ('settings.json', 'hooks.json', 'config.toml') THEN 'hook' WHEN low LIKE 'agents/%.md' THEN 'subagent'
  WHEN (low LIKE 'commands/%.toml' OR low LIKE 'prompts/%.md') AND NOT (vendor = 'copilot' AND low NOT LIKE 'prompts/%') THEN 'command' WHEN vendor = 'copilot' AND low LIKE 'chatmodes/%.md' THEN 'subagent' END AS kind FROM fs),
j AS (SELECT *, regexp_replace(regexp_replace(text, '/\\*[\\s\\S]*?\\*/', '', 'g'), '(^|[^:"])//[^\\n]*', '\\1', 'g') AS bare FROM k WHERE kind IS NOT NULL),
c AS (SELECT *, CASE WHEN kind <> 'hook' THEN text WHEN json_valid(bare) AND json_type(bare, '$.hooks') IN ('OBJECT', 'ARRAY') AND CAST(json_extract(CASE WHEN json_valid(bare) THEN bare END, '$.hooks') AS VARCHAR) NOT IN ('{{}}', '[]')
  THEN array_to_string(list_transform(string_split(json_pretty(json_extract(CASE WHEN json_valid(bare) THEN '{{"hooks":' || CAST(json_extract(CASE WHEN json_valid(bare) THEN bare END, '$.hooks') AS VARCHAR) || '}}' END, '$')), chr(10)),
    lambda x: repeat(' ', CAST((length(x) - length(ltrim(x, ' '))) // 2 AS INTEGER)) || ltrim(x, ' ')), chr(10)) END AS content FROM j),
found AS (SELECT page_id, vendor, scope, kind, path, content, coalesce(nullif(regexp_replace(trim(regexp_extract(regexp_extract(content, '^---\\r?\\n([\\s\\S]*?)\\r?\\n---', 1), '(?m)^name:\\s*(.+)$', 1)), '^["'']|["'']$', '', 'g'), ''),
  CASE kind WHEN 'skill' THEN split_part(path, '/', -2) WHEN 'hook' THEN base || ' · hooks' ELSE regexp_replace(base, '(?i)\\.(md|toml)$', '') END) AS name FROM c WHERE content IS NOT NULL)"""

# ---- switches of settings and merged postures

_SETTINGS = [
    '{"yolo": true, "editor": {"auto-approve": false}}', '{"cursor.composer.autoRun": "always", "list": [{"always_allow": ["Read", "Edit"]}, {"alwaysAllow": []}]}', "no settings here",
    '{"permissions": {"defaultMode": "acceptEdits", "allow": ["Read", "Bash(ls)"], "ask": ["Web"]}, "Auto Accept Edits": "true"}', '{"permissions": {"defaultMode": "default", "deny": ["Bash(rm)"]}, "skipPermissions": 1}', '{"permissions": ',
    '{"allowedTools": ["Read", "Edit"], "enableAllProjectMcpServers": false}', '{"a": {"b": {"c": {"no_confirm": true}}}}',
    '{"mcpServers": {"files": {"command": "x", "autoApprove": ["read"]}, "web": {"url": "https://a.example", "alwaysAllow": ["get"], "disabled": true}}}', '{"servers": {"web": {"alwaysAllow": ["get"]}, "files": {}}, "mcp": {"servers": {"no": {}}}}',
    '{"mcp": {"servers": {"db": {"autoApprove": [], "alwaysAllow": ["q"]}, "log": {"alwaysAllow": ["w"]}}}}',
]
_RARE = ['{"defaultMode": "bypassPermissions"}', '{"enableAllProjectMcpServers": true}']


_VENDORS = list(inventory.TIERS)
_COMMENTS = ["", "// settings of one machine\n", "/* see https://example.org\n */"]


def _settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, vendor, text): each document as a settings file, its
    whole text one field of it, below a comment or none; every 17th is absent."""
    n = F.col("doc_id")
    rare = F.when(F.pmod("doc_id", F.lit(233)) == 5, F.lit(_RARE[0])).when(F.pmod("doc_id", F.lit(239)) == 7, F.lit(_RARE[1]))
    text = F.concat(_picked(_COMMENTS, n), _packed(F.coalesce(rare, _picked(_SETTINGS, n)), F.col("text")))
    return _table(spark, sf_dir, "documents").select("doc_id", "source", _picked(_VENDORS, F.floor(n / 8)).alias("vendor"), F.when(F.pmod("doc_id", F.lit(17)) != 3, text).alias("text"))


def settings_switches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Switches that approve without asking and are on, in settings of any depth."""
    rows = _settings(spark, sf_dir).select("doc_id", F.explode(artifacts.switches(F.col("text"))).alias("s"))
    return rows.select("doc_id", "s.key", "s.label", "s.severity", "s.value")


def posture_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings merged by machine (the document's source) and vendor, in order of ids."""
    return inventory.merge_postures(_settings(spark, sf_dir).withColumnsRenamed({"source": "machine", "doc_id": "ord"}), ["machine", "vendor"])


_SETTINGS_CTE = f"""st AS (SELECT doc_id, source, {_picked_sql(_VENDORS, 'doc_id // 8')} AS vendor, CASE WHEN doc_id % 17 <> 3 THEN {_picked_sql(_COMMENTS, 'doc_id')} || {_packed_sql(f"CASE WHEN doc_id % 233 = 5 THEN {_quote(_RARE[0])} WHEN doc_id % 239 = 7 THEN {_quote(_RARE[1])} ELSE {_picked_sql(_SETTINGS, 'doc_id')} END", 'text')} END AS raw FROM documents),
sb AS (SELECT *, regexp_replace(regexp_replace(raw, '/\\*[\\s\\S]*?\\*/', '', 'g'), '(^|[^:"])//[^\\n]*', '\\1', 'g') AS text FROM st),
js AS (SELECT *, coalesce(json_valid(text) AND octet_length(encode(raw)) <= {inventory.MOST_SETTINGS_BYTES}, false) AS ok, CASE WHEN json_valid(text) THEN text ELSE '{{}}' END AS doc FROM sb)"""
_SWITCHES_CTE = f"""{_values('sw(name, label, severity)', [(n, label, s) for names, label, s in artifacts.SWITCHES for n in names.split('|')])},
t AS (SELECT doc_id, t.id AS place, t.key AS leaf, t.fullkey AS whole, t.value AS v, t.type AS kind FROM js, json_tree(js.doc) t WHERE t.key IS NOT NULL),
n AS (SELECT *, regexp_replace(lower(regexp_extract(CAST(leaf AS VARCHAR), '[^.]*$')), '[_\\-\\s]', '', 'g') AS name FROM t),
on_ AS (SELECT doc_id, place, regexp_replace(replace(regexp_replace(whole, '\\[(\\d+)\\]', '.\\1', 'g'), '"', ''), '^\\$\\.', '') AS key, label, severity,
  CASE WHEN kind = 'ARRAY' THEN json_array_length(v) || ' entries' ELSE replace(CAST(v AS VARCHAR), '"', '') END AS value
FROM n JOIN sw USING (name) WHERE (kind = 'BOOLEAN' AND CAST(v AS VARCHAR) = 'true') OR (kind = 'VARCHAR' AND CAST(v AS VARCHAR) IN ('"true"', '"always"')) OR (kind = 'ARRAY' AND json_array_length(v) > 0))"""
_SWITCHES_SQL = f"WITH {_SETTINGS_CTE}, {_SWITCHES_CTE} SELECT doc_id, key, label, severity, value FROM on_"
_LISTS = ("allow", "deny", "ask", "switches", "servers", "self_approved")
_MERGED_CTE = "m AS (SELECT source AS machine, vendor, tier, doc_id AS ord, doc_id, raw, ok, CASE WHEN ok THEN doc ELSE '{}' END AS doc FROM js JOIN tiers USING (vendor))"
_POSTURE_SQL = f"""WITH {_SETTINGS_CTE}, {_SWITCHES_CTE}, {_values('tiers(vendor, tier)', list(inventory.TIERS.items()))},
{_MERGED_CTE},
o AS (SELECT *, coalesce(json_extract_string(doc, '$.permissions.defaultMode'), json_extract_string(doc, '$.defaultMode')) AS mode, CAST(json_extract(doc, '$.enableAllProjectMcpServers') AS BOOLEAN) AS trust FROM m),
e AS (SELECT machine, vendor, ord, 'allow' AS list, coalesce(json_extract(doc, '$.permissions.allow'), json_extract(doc, '$.allowedTools')) AS rules FROM m UNION ALL SELECT machine, vendor, ord, 'deny', json_extract(doc, '$.permissions.deny') FROM m
  UNION ALL SELECT machine, vendor, ord, 'ask', json_extract(doc, '$.permissions.ask') FROM m),
u AS (SELECT machine, vendor, ord, list, unnest(CAST(rules AS VARCHAR[])) AS rule, generate_subscripts(CAST(rules AS VARCHAR[]), 1) AS place FROM e WHERE rules IS NOT NULL),
f AS (SELECT machine, vendor, list, rule, min(row(ord, place)) AS spot FROM u GROUP BY ALL),
sv AS (SELECT machine, vendor, ord, k.key AS name, k.id AS place, coalesce(json_array_length(coalesce(json_extract(k.value, '$.autoApprove'), json_extract(k.value, '$.alwaysAllow'))) > 0, false) AS approves,
    coalesce(CAST(json_extract(k.value, '$.disabled') AS BOOLEAN), false) AS disabled FROM m, json_each(coalesce(json_extract(doc, '$.mcpServers'), json_extract(doc, '$.servers'), json_extract(doc, '$.mcp.servers'))) k),
s1 AS (SELECT * FROM sv QUALIFY row_number() OVER (PARTITION BY machine, vendor, name ORDER BY ord, place) = 1),
a AS (SELECT machine, vendor, list, rule, row_number() OVER (PARTITION BY machine, vendor, list ORDER BY spot) AS nth FROM f
  UNION ALL SELECT machine, vendor, 'switches', key || '=' || value, row_number() OVER (PARTITION BY machine, vendor ORDER BY ord, place) FROM on_ JOIN m ON m.doc_id = on_.doc_id WHERE tier = 'flag'
  UNION ALL SELECT machine, vendor, 'servers', name, row_number() OVER (PARTITION BY machine, vendor ORDER BY ord, place) FROM s1
  UNION ALL SELECT machine, vendor, 'self_approved', name, row_number() OVER (PARTITION BY machine, vendor ORDER BY ord, place) FROM s1 WHERE approves AND NOT disabled),
l AS (SELECT machine, vendor, {', '.join(f"string_agg(rule, ',' ORDER BY nth) FILTER (list = '{k}') AS {k}" for k in _LISTS)} FROM a
  WHERE nth <= CASE list WHEN 'switches' THEN {inventory.MOST_SWITCHES} WHEN 'servers' THEN 1000000 WHEN 'self_approved' THEN 1000000 ELSE {inventory.MOST_RULES} END GROUP BY machine, vendor),
g AS (SELECT machine, vendor, any_value(tier) AS tier, count(*) AS sources, count(*) FILTER (NOT ok AND raw IS NOT NULL) AS n_unreadable, count(*) FILTER (ok) AS n_read,
  coalesce(arg_max(mode, ord) FILTER (lower(mode) = 'bypasspermissions'), arg_min(mode, ord) FILTER (mode IS NOT NULL)) AS mode, bool_or(trust) AS trust_all FROM o GROUP BY machine, vendor)
SELECT g.machine, g.vendor, sources, n_unreadable, mode, {', '.join(f"coalesce({k}, '') AS {k}" for k in _LISTS)}, trust_all,
  CASE WHEN tier = 'declared' AND n_read > 0 AND n_unreadable = 0 THEN 'complete' ELSE 'floor' END AS claim
FROM g LEFT JOIN l ON l.vendor = g.vendor AND l.machine IS NOT DISTINCT FROM g.machine"""

# ---- policies

_RULES = ["# generated", "f1*0", "**/f*7 :: aws", ""]
_ALLOWED = ("database url",)


_OLD_HEAD = "older notes\n\n"


def _scanned(spark: SparkSession, sf_dir: str, older: bool = False) -> DataFrame:
    """Documents as files with their credentials; every third has a marker on
    the line above its snippet, and every 60th opts out at its head. An older
    version has two more lines on top, and half of the files lack their snippet."""
    docs = Q._dealt(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    snippet = F.coalesce(F.get(F.array(*map(F.lit, Q.OVERLAY)), F.pmod("doc_id", F.lit(Q.SLOTS)).cast("int")), F.lit(""))
    head = F.when(F.pmod("doc_id", F.lit(60)) == 2, f"// {policy.MARKER}-file\n").otherwise("")
    mark = F.when(F.pmod("doc_id", F.lit(3)) == 0, f"\n# {policy.MARKER}\n").otherwise("\n")
    if older:
        head, snippet = F.concat(F.lit(_OLD_HEAD), head), F.when(F.pmod("doc_id", F.lit(4)) < 2, snippet).otherwise("")
    docs = docs.select("doc_id", F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("path"), F.concat(head, "text", mark, snippet).alias("text"))
    found = scan.scan_documents(docs, ("secret",), masked=False)
    kept = F.filter(policy.unmarked(F.col("findings"), F.col("text")), lambda x: ~policy.ignored(F.col("path"), x["label"], _RULES))
    return found.withColumn("findings", kept).select("doc_id", "path", "findings")


def _finding_rows(scanned: DataFrame) -> DataFrame:
    return scanned.select("doc_id", "path", F.explode_outer("findings").alias("f")).where("f is not null").select("doc_id", "path", "f.label", "f.severity", "f.category", "f.line")


def policy_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Credentials that no marker or ignore rule silences, and that an older version of the files, with its lines elsewhere, did not have."""
    return policy.since_baseline(_finding_rows(_scanned(spark, sf_dir)), _finding_rows(_scanned(spark, sf_dir, older=True))).select("doc_id", "label", "severity", "line")


_GLOBS = ["src/%k/f%i.py", "# src/%k/*\nsrc/%k/ :: aws", "**/f%i* :: Database", "f%i.py", "\n", "/src/?/f%i.py", "src/%k/*.py :: no such title", "lib/**"]
_REPOS = 13


def _named(text: Column, n: Column) -> Column:
    return F.replace(F.replace(text, F.lit("%k"), (n % 50).cast("string")), F.lit("%i"), n.cast("string"))


def policy_ignored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Credentials of 13 repositories that no rule of their ignore files names; each document brings an ignore file of its repository that is about the next one."""
    n = F.col("doc_id")
    found = scan.scan_documents(Q.overlaid(spark, sf_dir), ("secret",), masked=False).select((n % _REPOS).alias("repo"), "doc_id", _named(F.lit("src/%k/f%i.py"), n).alias("path"), F.explode_outer("findings").alias("f"))
    found = found.where("f is not null").select("repo", "doc_id", "path", "f.label", "f.category", "f.line")
    files = _table(spark, sf_dir, "documents").select((n % _REPOS).alias("repo"), _named(_picked(_GLOBS, F.floor(n / _REPOS)), n + _REPOS).alias("text"))
    return policy.without_ignored(found, policy.ignore_rules(files, ["repo"]), ["repo"]).select("repo", "path", "label", "line")


def policy_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents a policy blocks and flags."""
    verdict = policy.policy_verdict(F.col("findings"), "critical", "medium", _ALLOWED)
    return policy.totals(_scanned(spark, sf_dir).select(verdict.alias("verdict")))


_POLICY_CTE = f"""docs AS (SELECT doc_id, CASE WHEN doc_id % 60 = 2 THEN '// {policy.MARKER}-file' || chr(10) ELSE '' END || text || CASE WHEN doc_id % 3 = 0 THEN chr(10) || '# {policy.MARKER}' || chr(10) ELSE chr(10) END
  || coalesce(list_extract([{', '.join(map(_quote, Q.OVERLAY))}], CAST(doc_id % {Q.SLOTS} AS INTEGER) + 1), '') AS text FROM documents),
s AS ({' UNION ALL '.join(Q._secret_parts())}),
placed AS (SELECT s.*, string_split_regex(text, '\\r?\\n') AS lines FROM s JOIN docs USING (doc_id)),
kept AS (SELECT doc_id, label, severity, line FROM placed WHERE doc_id % 60 <> 2 AND NOT coalesce(contains(lines[line], '{policy.MARKER}'), false) AND NOT coalesce(line > 1 AND contains(lines[line - 1], '{policy.MARKER}'), false)
  AND NOT regexp_matches('f' || doc_id, '^f1.*0$') AND NOT (regexp_matches('f' || doc_id, '^f.*7$') AND contains(lower(label), 'aws')))"""
_BASELINE_CTE = f"""docs_old AS (SELECT doc_id, {_quote(_OLD_HEAD)} || CASE WHEN doc_id % 60 = 2 THEN '// {policy.MARKER}-file' || chr(10) ELSE '' END || text || CASE WHEN doc_id % 3 = 0 THEN chr(10) || '# {policy.MARKER}' || chr(10) ELSE chr(10) END
  || CASE WHEN doc_id % 4 < 2 THEN coalesce(list_extract([{', '.join(map(_quote, Q.OVERLAY))}], CAST(doc_id % {Q.SLOTS} AS INTEGER) + 1), '') ELSE '' END AS text FROM documents),
s_old AS ({' UNION ALL '.join(Q._secret_parts()).replace('FROM docs', 'FROM docs_old')}),
placed_old AS (SELECT s_old.*, string_split_regex(text, '\\r?\\n') AS lines FROM s_old JOIN docs_old USING (doc_id)),
kept_old AS (SELECT DISTINCT doc_id, label FROM placed_old WHERE doc_id % 60 <> 2 AND NOT coalesce(contains(lines[line], '{policy.MARKER}'), false) AND NOT coalesce(line > 1 AND contains(lines[line - 1], '{policy.MARKER}'), false)
  AND NOT regexp_matches('f' || doc_id, '^f1.*0$') AND NOT (regexp_matches('f' || doc_id, '^f.*7$') AND contains(lower(label), 'aws')))"""
_TOTALS_SQL = f"""WITH {_POLICY_CTE},
w AS (SELECT doc_id, max(CASE severity WHEN 'CRITICAL' THEN 5 WHEN 'HIGH' THEN 4 WHEN 'MEDIUM' THEN 3 WHEN 'LOW' THEN 2 ELSE 1 END) AS worst FROM kept WHERE NOT contains(lower(label), '{_ALLOWED[0]}') GROUP BY doc_id)
SELECT (SELECT count(*) FROM documents) AS scanned, count(*) FILTER (worst = 5) AS blocked, count(*) FILTER (worst IN (3, 4)) AS flagged FROM w"""

_IGNORED_SQL = f"""WITH {Q._DOCS_SQL}, s AS (SELECT * FROM ({' UNION ALL '.join(Q._secret_parts())})),
f AS (SELECT doc_id % {_REPOS} AS repo, doc_id, 'src/' || doc_id % 50 || '/f' || doc_id || '.py' AS path, label, line FROM s),
r AS (SELECT doc_id % {_REPOS} AS repo, doc_id // {_REPOS} % {len(_GLOBS)} AS kind, CAST(doc_id + {_REPOS} AS VARCHAR) AS i, CAST((doc_id + {_REPOS}) % 50 AS VARCHAR) AS k FROM documents),
g AS (SELECT DISTINCT repo, CASE kind WHEN 0 THEN '^src/' || k || '/f' || i || '\\.py$' WHEN 1 THEN '^src/' || k || '/.*$' WHEN 2 THEN '^(.*/)?f' || i || '[^/]*$' WHEN 3 THEN '^(.*/)?f' || i || '\\.py$' WHEN 5 THEN '^src/[^/]/f' || i || '\\.py$'
  WHEN 6 THEN '^src/' || k || '/[^/]*\\.py$' WHEN 7 THEN '^lib/.*$' END AS pattern, CASE kind WHEN 1 THEN 'aws' WHEN 2 THEN 'database' WHEN 6 THEN 'no such title' ELSE '' END AS title FROM r WHERE kind <> 4)
SELECT repo, path, label, line FROM f WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.repo = f.repo AND regexp_matches(f.path, g.pattern) AND contains(lower(f.label), g.title))"""

QUERIES = {
    "policy_ignored": policy_ignored, "dependency_rollup": dependency_rollup, "environment_keys": environment_keys, "vector_clients": vector_clients, "vector_endpoints": vector_endpoints, "inventory_assets": inventory_assets,
    "artifact_inventory": artifact_inventory, "artifact_kinds": artifact_kinds, "artifact_caps": artifact_caps, "settings_switches": settings_switches, "posture_merge": posture_merge,
    "policy_findings": policy_findings, "policy_totals": policy_totals,
}

SQL = {
    "policy_ignored": _IGNORED_SQL,
    "dependency_rollup": f"WITH {_FILES_SQL}, {_USED_CTE} SELECT ecosystem, package, count(*) AS n_manifests, array_to_string(list_sort(list(path))[1:10], ',') AS manifests FROM used GROUP BY ALL",
    "environment_keys": f"WITH {_FILES_SQL}, {_KEYS_CTE} SELECT * FROM found",
    "vector_clients": f"WITH {_FILES_SQL}, {_CLIENTS_CTE} SELECT * FROM clients",
    "vector_endpoints": f"WITH {_FILES_SQL}, {_CLOUD_CTE} SELECT * FROM cloud",
    "inventory_assets": _ASSETS_SQL,
    "artifact_inventory": f"WITH {_ARTIFACTS_CTE} SELECT page_id, vendor, scope, kind, name, path AS artifact_path, sha256(content) AS content_sha256 FROM found",
    "artifact_kinds": f"WITH {_ARTIFACTS_CTE} SELECT kind, count(*) AS n FROM found GROUP BY kind",
    "artifact_caps": f"WITH {_ARTIFACTS_CTE}, r AS (SELECT *, row_number() OVER (PARTITION BY vendor ORDER BY page_id) AS nth FROM found) SELECT vendor, CASE WHEN nth = 11 THEN 'artifact-cap' ELSE 'kept' END AS reason, path FROM r WHERE nth <= 11",
    "settings_switches": _SWITCHES_SQL,
    "posture_merge": _POSTURE_SQL,
    "policy_findings": f"WITH {_POLICY_CTE}, {_BASELINE_CTE} SELECT doc_id, label, severity, line FROM kept k ANTI JOIN kept_old USING (doc_id, label)",
    "policy_totals": _TOTALS_SQL,
}
