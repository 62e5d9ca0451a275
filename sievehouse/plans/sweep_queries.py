"""Queries of sweeps over the given tables, and their SQL: pages are files of vendors' folders, a host is a machine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.frontmatter import frontmatter
from ..operators import sweep
from . import queries as Q
from .frame_queries import _picked, _picked_sql

_table, _quote = Q._table, Q._quote
_TREES = ["skills/p%", "plugins/marketplaces/one/skills/p%", "plugins/marketplaces/two@x/p%", ".tmp/marketplaces/p%", "vendor_imports/plugins/marketplaces/one/p%", "x/Backups/p%", "plugins/marketplaces"]
_SOURCES = [
    ("settings.json", '// on\n{"enabledPlugins": {"a@one": true, "bare": false}, "page": %}'), ("plugins/installed_plugins.json", '{"plugins": {"b@two@x": {"source": "three"}, "c": {"marketplace": 1, "source": "one"}}, "page": %}'),
    ("settings.local.json", '{"enabledPlugins": '), ("settings.json", '{"page": %}'), ("plugins/installed_plugins.json", '{"plugins": {"d": {"marketplace": null, "source": "one"}}, "page": %}'), ("other.json", "{"), ("settings.json", "%"),
]
_FOLDER = "page_id % 23"


def _activations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as an artifact of one of 23 folders, and as one of the sources that say what is installed there."""
    pages = _table(spark, sf_dir, "pages").select("page_id", F.expr(_FOLDER).alias("folder"), "html")
    n = F.col("page_id")
    found = pages.select("page_id", "folder", _picked(["claude-code", "codex"], n).alias("vendor"), F.concat(F.replace(_picked(_TREES, F.floor(n / 2)), F.lit("%"), n.cast("string")), F.lit("/SKILL.md")).alias("path"))
    # A folder has one file of a name: that of its page with the smallest number.
    first = pages.select("page_id", "folder").withColumn("path", _picked([p for p, _ in _SOURCES], n)).groupBy("folder", "path").agg(F.min("page_id").alias("page_id"))
    texts = first.join(pages.select("page_id", "html"), "page_id").select("folder", "path", F.replace(_picked([t for _, t in _SOURCES], F.col("page_id")), F.lit("%"), F.to_json(F.array("html"))).alias("text"))
    known, names = sweep.installed_marketplaces(texts, ["folder"])
    return sweep.activations(found, known, names, ["folder"])


def artifact_activation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each artifact is active, available in a catalogue, or not known."""
    return _activations(spark, sf_dir)


def artifact_available(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many artifacts of each catalogue are available in each folder."""
    return sweep.available_counts(_activations(spark, sf_dir), ["folder"])


_ACTIVATION_CTE = f"""p AS (SELECT page_id, {_FOLDER} AS folder, html, {_picked_sql([p for p, _ in _SOURCES], 'page_id')} AS path FROM pages),
f AS (SELECT folder, path, regexp_replace(replace({_picked_sql([t for _, t in _SOURCES], 'page_id')}, '%', CAST(to_json([html]) AS VARCHAR)), '(^|[^:"])//[^\\n]*', '\\1', 'g') AS raw FROM p QUALIFY row_number() OVER (PARTITION BY folder, path ORDER BY page_id) = 1),
s AS (SELECT folder, path, regexp_replace(raw, '/\\*[\\s\\S]*?\\*/', '', 'g') AS text FROM f WHERE path <> 'other.json' AND raw IS NOT NULL),
k AS (SELECT folder, bool_and(json_valid(text)) AS known FROM s GROUP BY folder),
e AS (SELECT x.folder, x.path = 'plugins/installed_plugins.json' AS is_list, j.key AS key, j.value AS value FROM (SELECT folder, path, json_extract(CASE WHEN json_valid(text) THEN text END, CASE path WHEN 'plugins/installed_plugins.json' THEN '$.plugins' ELSE '$.enabledPlugins' END) AS m FROM s) x, json_each(m) j WHERE json_type(m) = 'OBJECT'),
m AS (SELECT DISTINCT folder, CASE WHEN contains(key, '@') THEN substr(key, instr(key, '@') + 1) ELSE key END AS marketplace FROM e
  UNION SELECT folder, json_extract_string(v, '$') FROM (SELECT folder, coalesce(nullif(json_extract(value, '$.marketplace'), 'null'), json_extract(value, '$.source')) AS v FROM e WHERE is_list AND json_type(value) = 'OBJECT') WHERE json_type(v) = 'VARCHAR'),
a AS (SELECT page_id, folder, {_picked_sql(['claude-code', 'codex'], 'page_id')} AS vendor, replace({_picked_sql(_TREES, 'page_id // 2')}, '%', CAST(page_id AS VARCHAR)) || '/SKILL.md' AS path FROM p),
b AS (SELECT *, nullif(lower(regexp_extract(path, '(?i)(^|/)(\\.tmp|tmp|temp|vendor_imports|bundled-marketplaces|backups?)/', 2)), '') AS staged, nullif(regexp_extract(path, '(^|/)plugins/marketplaces/([^/]+)/', 2), '') AS mp FROM a),
c AS (SELECT page_id, b.folder, vendor, path, CASE WHEN staged IS NULL THEN mp END AS marketplace, CASE WHEN staged IS NOT NULL THEN 'available' WHEN mp IS NULL THEN 'active' WHEN NOT coalesce(known, true) THEN 'unknown' WHEN m.folder IS NOT NULL THEN 'active' ELSE 'available' END AS activation,
  staged FROM b LEFT JOIN k ON k.folder = b.folder LEFT JOIN m ON m.folder = b.folder AND m.marketplace = b.mp),
d AS (SELECT page_id, folder, vendor, path, marketplace, CASE WHEN activation = 'available' THEN CASE WHEN staged IS NOT NULL THEN vendor || ':' || staged ELSE marketplace END END AS catalogue, activation FROM c)"""

_BYTES, _ARTIFACTS, _BUNDLED = 60_000, 12, 3


def _budgeted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as files of 11 machines: three in four are artifacts of one of four sites, the others come with a skill."""
    n = F.col("page_id")
    pages = _table(spark, sf_dir, "pages").select("page_id", "html", (n % 11).alias("machine"))
    size = F.coalesce(F.octet_length("html"), F.lit(0)).cast("bigint")
    skill = F.when(n % 4 == 3, F.floor(n / 44))
    charge = F.when(n % 7 != 5, F.least(size, F.lit(4000)))
    files = pages.select("machine", skill.cast("bigint").alias("skill"), F.when(skill.isNull(), F.floor(n / 11) % 4).otherwise(0).cast("bigint").alias("site"), n.alias("place"), F.concat(F.lit("p/"), n.cast("string")).alias("path"), size.alias("size"), charge.cast("bigint").alias("charge"))
    return sweep.within_budgets(files, "machine", _BYTES, _ARTIFACTS, _BUNDLED)


def artifact_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of each machine's files fits in a report of 60,000 bytes, 12 artifacts and three files a skill, and why the rest does not."""
    return _budgeted(spark, sf_dir).select("machine", "place", "path", "outcome")


_BUDGET_SQL = f"""WITH RECURSIVE p AS (SELECT page_id % 11 AS machine, CASE WHEN page_id % 4 = 3 THEN page_id // 44 ELSE -1 END AS skill, CASE WHEN page_id % 4 = 3 THEN 0 ELSE page_id // 11 % 4 END AS site, page_id AS place,
  coalesce(octet_length(encode(html)), 0) AS size, CASE WHEN page_id % 7 <> 5 THEN least(coalesce(octet_length(encode(html)), 0), 4000) END AS charge FROM pages),
o AS (SELECT *, row_number() OVER (PARTITION BY machine ORDER BY skill, site, place) AS n, coalesce((skill, site) IS DISTINCT FROM lag((skill, site)) OVER (PARTITION BY machine ORDER BY skill, site, place), true) AS fresh FROM p),
w AS (SELECT machine, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS place, {_BYTES} AS budget, 0 AS total, 0 AS here, false AS closed, CAST(NULL AS VARCHAR) AS outcome FROM (SELECT DISTINCT machine FROM p)
  UNION ALL
  SELECT machine, n, place, CAST(CASE WHEN outcome = 'kept' THEN budget - charge ELSE budget END AS INTEGER), CAST(CASE WHEN outcome = 'kept' AND skill < 0 THEN total + 1 ELSE total END AS INTEGER),
    CAST(CASE WHEN outcome = 'kept' THEN here + 1 ELSE here END AS INTEGER), closed OR coalesce(outcome LIKE '%-cap', false), outcome
  FROM (SELECT *, CASE WHEN closed OR (charge IS NULL AND NOT filled) THEN NULL WHEN filled THEN CASE WHEN skill >= 0 THEN 'bundle-cap' ELSE 'artifact-cap' END WHEN size > budget THEN 'byte-budget' ELSE 'kept' END AS outcome
    FROM (SELECT o.machine, o.n, o.place, o.skill, o.size, o.charge, w.budget, w.total, CASE WHEN o.fresh THEN 0 ELSE w.here END AS here, w.closed AND NOT o.fresh AS closed,
      CASE WHEN o.skill >= 0 THEN CASE WHEN o.fresh THEN 0 ELSE w.here END >= {_BUNDLED} ELSE w.total >= {_ARTIFACTS} END AS filled FROM w JOIN o ON o.machine = w.machine AND o.n = w.n + 1)))
SELECT machine, place, 'p/' || place AS path, outcome FROM w WHERE n > 0"""


def _listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The directories of pages' addresses, each below its host as a root and below the host's first folder as another."""
    parts = F.split(F.regexp_replace("url", "^https?://|[?#].*\\z", ""), "/")
    pages = _table(spark, sf_dir, "pages").select((F.col("page_id") % 5).alias("machine"), parts.alias("parts"), "page_id")
    deep = F.concat(F.slice("parts", F.lit(1), F.greatest(F.size("parts") - 1, F.lit(1))), _picked_dirs(F.col("page_id")))
    up = F.transform(F.sequence(F.lit(1), F.size("deep")), lambda i: F.array_join(F.slice(F.col("deep"), F.lit(1), i), "/"))
    dirs = pages.withColumn("deep", deep).select("machine", F.explode(up).alias("path")).distinct()
    host = F.substring_index("path", "/", 1)
    roots = F.array(F.struct(host.alias("root"), F.lit(1).alias("ord")), F.struct(F.substring_index("path", "/", 2).alias("root"), F.lit(0).alias("ord")))
    return dirs.withColumn("r", F.explode(roots)).select("machine", F.col("r.root").alias("root"), F.col("r.ord").alias("ord"), "path")


def _picked_dirs(n: Column) -> Column:
    return F.split(_picked(["a/b/c/d/e/f/g", "src/node_modules/x", "b", "a/b", "tmp", "c/a"], n), "/")


def walk_directories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 200 directories that a walk of each machine's roots visits, breadth first, six levels down."""
    return sweep.walked_dirs(_listing(spark, sf_dir), most=200)[0].select("machine", "root", "path", "depth", "place")


_WALK_SQL = f"""WITH p AS (SELECT page_id % 5 AS machine, string_split(regexp_replace(url, '^https?://|[?#].*$', '', 'g'), '/') AS parts, string_split({_picked_sql(["a/b/c/d/e/f/g", "src/node_modules/x", "b", "a/b", "tmp", "c/a"], 'page_id')}, '/') AS more FROM pages),
q AS (SELECT machine, list_concat(parts[1:greatest(len(parts) - 1, 1)], more) AS deep FROM p),
d AS (SELECT DISTINCT machine, deep[1:i] AS parts FROM q, range(1, 40) r(i) WHERE i <= len(deep)),
r AS (SELECT machine, parts, 1 AS ord, 1 AS k FROM d UNION ALL SELECT machine, parts, 0, least(2, len(parts)) FROM d),
c AS (SELECT machine, array_to_string(parts[1:k], '/') AS root, ord, array_to_string(parts, '/') AS path, len(parts) - k AS depth, parts[k + 1:] AS rest FROM r),
v AS (SELECT * FROM c WHERE depth <= {sweep.MOST_DEPTH} AND NOT list_has_any(rest, [{', '.join(map(_quote, sweep.IGNORED))}]) QUALIFY row_number() OVER (PARTITION BY machine, path ORDER BY ord, root) = 1),
n AS (SELECT *, row_number() OVER (PARTITION BY machine ORDER BY ord, root, depth, rest) AS place FROM v)
SELECT machine, root, path, depth, place FROM n WHERE place <= 200"""

_FRONT = [
    "---\nname: 'One'\ntools: Bash, Read\n---", "---\r\ntools:\r\n  - Bash\r\n# not this\r\n  - \"Web, Fetch\"\r\nmodel: x # y\r\n---", "---\ntools: [Bash, 'Read' ]\ntools:\nallowed-tools: '*'\n  nested: no\n---",
    "no frontmatter", "---\nname: a: b\nallowedTools:\ntools: []\n- late\n---", "\ufeff---\ntools: Edit\n---", "---\ntools: open",
]


def frontmatter_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields of each document's frontmatter, one row each, its whole text below it."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("\n", _picked(_FRONT, F.col("doc_id")), "text").alias("text"))
    rows = docs.select("doc_id", F.explode(F.map_entries(frontmatter(F.col("text")))).alias("e"))
    return rows.select("doc_id", F.col("e.key").alias("field"), F.col("e.value.one").alias("one"), F.array_join("e.value.many", "|").alias("many"))


_BARE_SQL = "regexp_replace({}, '^[\"'']|[\"'']$', '', 'g')"
_FRONT_SQL = f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract(concat_ws(chr(10), {_picked_sql(_FRONT, 'doc_id')}, text), '^\\x{{FEFF}}?---\\r?\\n([\\s\\S]*?)\\r?\\n---\\r?\\n?', 1) AS block FROM documents),
u AS (SELECT doc_id, unnest(string_split_regex(block, '\\r?\\n')) AS x, generate_subscripts(string_split_regex(block, '\\r?\\n'), 1) AS place FROM d),
l AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS n FROM u WHERE NOT regexp_matches(x, '^\\s*(#|$)')),
k AS (SELECT *, nullif(regexp_extract(x, '^([A-Za-z0-9_.-]+)\\s*:\\s*(.*)$', 1), '') AS field, trim(regexp_extract(x, '^([A-Za-z0-9_.-]+)\\s*:\\s*(.*)$', 2)) AS value, {_BARE_SQL.format("trim(regexp_extract(x, '^\\s*-\\s+(.*)$', 1))")} AS entry, regexp_matches(x, '^\\s*-\\s+') AS dash FROM l),
o AS (SELECT *, last_value(CASE WHEN NOT dash THEN field END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n) AS owner FROM k),
s AS (SELECT doc_id, n, owner, dash, value, entry, max(CASE WHEN NOT dash AND field IS NOT NULL AND value <> '' THEN n ELSE 0 END) OVER (PARTITION BY doc_id, owner ORDER BY n) AS since FROM o WHERE owner IS NOT NULL AND (dash OR field IS NOT NULL)),
e AS (SELECT doc_id, owner, n, since, dash, entry, CASE WHEN NOT dash AND value <> '' AND NOT starts_with(value, '[') THEN {_BARE_SQL.format('value')} END AS one,
  CASE WHEN NOT dash AND starts_with(value, '[') THEN list_filter(list_transform(string_split_regex(regexp_replace(value, '^\\[|\\]$', '', 'g'), '[,\\n]+'), lambda t: trim({_BARE_SQL.format('t')})), lambda t: t <> '') WHEN dash THEN [entry] END AS many FROM s),
w AS (SELECT *, max(since) OVER (PARTITION BY doc_id, owner) AS newest FROM e),
f AS (SELECT doc_id, owner, max(one) FILTER (n = newest) AS one, count(*) FILTER (dash) AS dashes, flatten(list(many ORDER BY n) FILTER (many IS NOT NULL)) AS many FROM w WHERE since = newest GROUP BY doc_id, owner)
SELECT doc_id, owner AS field, CASE WHEN dashes = 0 THEN one END AS one, array_to_string(many, '|') AS many FROM f"""

QUERIES = {"frontmatter_fields": frontmatter_fields, "artifact_activation": artifact_activation, "artifact_available": artifact_available, "artifact_budget": artifact_budget, "walk_directories": walk_directories}
SQL = {
    "frontmatter_fields": _FRONT_SQL,
    "artifact_activation": f"WITH {_ACTIVATION_CTE} SELECT * FROM d",
    "artifact_available": f"WITH {_ACTIVATION_CTE} SELECT folder, catalogue, count(*) AS n FROM d WHERE activation = 'available' GROUP BY ALL",
    "artifact_budget": _BUDGET_SQL,
    "walk_directories": _WALK_SQL,
}
