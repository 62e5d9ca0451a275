"""Queries of channels, inventories and acquisition over the given tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import regexes as R
from ..functions import text as X
from ..operators import acquire, inventory, models, scan, urls
from ..streaming import channels
from . import prose as P
from . import queries as Q

_table, overlaid = Q._table, Q.overlaid

# ---- channels


def reply_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as frames of a session a user: views and clicks ask, errors are of no interest, purchases and signups answer."""
    kind = F.col("event_type")
    method = F.when(kind == "view", "tools/list").when(kind == "click", "resources/read").when(kind == "error", "ping")
    frames = _table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), (F.col("event_id") % 2).alias("id"), method.alias("method"), (kind == "purchase").alias("has_result"))
    return channels.match_replies(frames)


_REPLIES_SQL = """WITH f AS (SELECT user_id AS session, event_id AS seq, event_id % 2 AS id, CASE event_type WHEN 'view' THEN 'tools/list' WHEN 'click' THEN 'resources/read' END AS method
  FROM events WHERE event_type IN ('view', 'click', 'purchase')),
a AS (SELECT f.session, f.id, f.seq, (SELECT max(q.seq) FROM f q WHERE q.session = f.session AND q.id = f.id AND q.seq < f.seq AND q.method IS NOT NULL) AS request_seq FROM f WHERE method IS NULL),
n AS (SELECT * FROM a WHERE request_seq IS NOT NULL QUALIFY row_number() OVER (PARTITION BY session, id, request_seq ORDER BY seq) = 1)
SELECT n.session, n.id, n.seq, n.request_seq, f.method FROM n JOIN f ON f.session = n.session AND f.seq = n.request_seq"""


def listing_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as tools that ten servers list; a server's denied tools are those whose number leaves 3 of 41."""
    docs = overlaid(spark, sf_dir).select((F.col("doc_id") % 10).alias("session"), F.concat(F.lit("tool-"), F.col("doc_id") % 100).alias("name"), F.lit("tools/list").alias("method"), "text")
    denied = _table(spark, sf_dir, "documents").where("doc_id % 41 = 3").select((F.col("doc_id") % 10).alias("session"), F.concat(F.lit("tool-"), F.col("doc_id") % 100).alias("name"))
    count = lambda k: F.count_if(F.col("outcome") == k).alias(k)
    return channels.screen_listing(docs, denied).groupBy("session").agg(F.count("*").alias("total"), *map(count, ("kept", "withheld", "denied")))


def result_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return channels.screen_results(overlaid(spark, sf_dir)).select("doc_id", "blocked", "label")


def call_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as arguments of calls, in JSON: which are refused, and what becomes of them by channel."""
    calls = overlaid(spark, sf_dir).withColumn("arguments", F.to_json(F.struct("text")))
    out = channels.screen_calls(calls)
    channel = F.element_at(F.array(*map(F.lit, ("call", "prompt", "plan"))), (F.pmod("doc_id", F.lit(3)) + 1).cast("int"))
    verdict = F.when(F.col("refused"), "BLOCK").when(F.exists("findings", lambda x: x["severity"] == "HIGH"), "FLAG").otherwise("ALLOW")
    return out.select("doc_id", "refused", F.size("findings").cast("long").alias("n_findings"), channel.alias("channel"), channels.channel_decision(channel, verdict).alias("decision"))


def connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as attempts to connect: errors fail, and an hour must pass after one; purchases are blocked, signups flagged."""
    events = _table(spark, sf_dir, "events").withColumn("ok", F.col("event_type") != "error")
    tried = channels.break_circuit(events, "user_id", "ts", "event_id", "ok", 3600.0)
    kinds = events.select("event_id", "event_type")
    decision = F.when(F.col("event_type") == "purchase", "BLOCK").when(F.col("event_type") == "signup", "FLAG").otherwise("ALLOW")
    c = channels.connect_decision(decision, F.col("reachable"), F.lit(True), F.col("skipped"), F.lit(False))
    return tried.withColumnRenamed("seq", "event_id").join(kinds, "event_id").select("event_id", F.col("server").alias("user_id"), "skipped", c["action"].alias("action"), c["verified"].alias("verified"))


def _parts_sql(parts: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT * FROM ({p}) AS t(doc_id, label, severity, category, line)" for p in parts)


_LISTING_SQL = f"""WITH {Q._DOCS_SQL}, f AS ({_parts_sql([*Q._injection_parts(), *Q._secret_parts(), *Q._egress_parts()])}),
bad AS (SELECT DISTINCT doc_id FROM f WHERE severity IN ('HIGH', 'CRITICAL')),
n AS (SELECT DISTINCT doc_id % 10 AS session, doc_id % 100 AS tool FROM documents WHERE doc_id % 41 = 3),
o AS (SELECT doc_id % 10 AS session, CASE WHEN (doc_id % 10, doc_id % 100) IN (SELECT (session, tool) FROM n) THEN 'denied' WHEN doc_id IN (SELECT doc_id FROM bad) THEN 'withheld' ELSE 'kept' END AS outcome FROM documents)
SELECT session, count(*) AS total, count(*) FILTER (outcome = 'kept') AS kept, count(*) FILTER (outcome = 'withheld') AS withheld, count(*) FILTER (outcome = 'denied') AS denied FROM o GROUP BY session"""
_CALLS_SQL = f"""WITH {Q._DOCS_SQL.replace('docs AS', 'base AS', 1)}, docs AS (SELECT doc_id, '{{"text":' || CAST(to_json(text) AS VARCHAR) || '}}' AS text FROM base), {Q._BLOBS_SQL},
f AS ({_parts_sql([*Q._shell_parts(), *Q._injection_parts(), *Q._secret_parts()])}),
g AS (SELECT doc_id, count(*) AS n, bool_or(severity = 'CRITICAL') AS worst, bool_or(severity = 'HIGH') AS high FROM f GROUP BY doc_id),
v AS (SELECT doc_id, coalesce(n, 0) AS n_findings, coalesce(worst, false) AS refused, CASE WHEN worst THEN 'BLOCK' WHEN high THEN 'FLAG' ELSE 'ALLOW' END AS verdict, ['call', 'prompt', 'plan'][doc_id % 3 + 1] AS channel FROM docs LEFT JOIN g USING (doc_id))
SELECT doc_id, refused, n_findings, channel, CASE WHEN channel = 'plan' THEN CASE WHEN verdict = 'ALLOW' THEN 'pass' ELSE 'inform' END WHEN channel = 'prompt' THEN CASE verdict WHEN 'BLOCK' THEN 'refuse' WHEN 'FLAG' THEN 'annotate' ELSE 'pass' END
  ELSE CASE verdict WHEN 'BLOCK' THEN 'refuse' WHEN 'FLAG' THEN 'ask' ELSE 'pass' END END AS decision FROM v"""
_CONNECTIONS_SQL = """WITH RECURSIVE e AS (SELECT user_id, event_id, ts, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
s AS (SELECT user_id, n, event_id, event_type, false AS skipped, CASE WHEN event_type = 'error' THEN ts + INTERVAL 1 HOUR ELSE ts END AS until FROM e WHERE n = 1
  UNION ALL SELECT e.user_id, e.n, e.event_id, e.event_type, e.ts < s.until, CASE WHEN e.ts >= s.until AND e.event_type = 'error' THEN e.ts + INTERVAL 1 HOUR ELSE s.until END FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1)
SELECT event_id, user_id, skipped, CASE WHEN NOT skipped AND event_type = 'purchase' THEN 'refuse' WHEN NOT skipped AND event_type = 'signup' THEN 'warn' ELSE 'connect' END AS action, NOT skipped AND event_type <> 'error' AS verified FROM s"""


# ---- inventories

def local_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of pages as paths of model manifests, by the model they'd name."""
    path = F.regexp_replace("url", "^https?://|[?#].*\\z", "")
    return _table(spark, sf_dir, "pages").select("page_id", inventory.local_model(path).alias("model")).where("model is not null")


_LOCAL_SQL = """WITH p AS (SELECT page_id, string_split(regexp_replace(url, '^https?://|[?#].*$', '', 'g'), '/') AS parts FROM pages)
SELECT page_id, array_to_string(parts[2:len(parts) - 1], '/') || ':' || parts[len(parts)] AS model FROM p WHERE len(parts) >= 2"""


def artifact_catalogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as artifacts of a marketplace, their host, which is installed if one of its pages has a number that leaves 1 of 7: counts by activation."""
    pages = _table(spark, sf_dir, "pages").select("page_id", urls.host_of(F.col("url")).alias("marketplace"))
    hits = inventory.activate(pages, pages.where("page_id % 7 = 1"))
    active = hits.where("activation = 'active'").groupBy("marketplace").agg(F.count("*").alias("n"))
    return active.withColumn("activation", F.lit("active")).unionByName(inventory.catalogue_counts(hits).withColumn("activation", F.lit("available")))


_CATALOGUE_SQL = """WITH h AS (SELECT page_id, nullif(lower(regexp_extract(trim(url), '(?i)^(https?)://(?:[^/?#@]*@)?(\\[[^\\]]*\\]|[^/?#:]+)', 2)), '') AS marketplace FROM pages)
SELECT marketplace, count(*) AS n, CASE WHEN marketplace IS NULL OR bool_or(page_id % 7 = 1) THEN 'active' ELSE 'available' END AS activation FROM h GROUP BY marketplace"""


def skill_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as files; the directories of pages whose number leaves 0 of 5 are skills, and so are their hosts."""
    path = F.regexp_replace("url", "^https?://|[?#].*\\z", "")
    pages = _table(spark, sf_dir, "pages").select("page_id", path.alias("path"))
    chosen = pages.where("page_id % 5 = 0 and instr(path, '/') > 0")
    below = chosen.groupBy(F.regexp_replace("path", "/[^/]*\\z", "").alias("dir")).agg((F.min("page_id") * 2).alias("ord"))
    hosts = chosen.groupBy(F.substring_index("path", "/", 1).alias("dir")).agg((F.min("page_id") * 2 + 1).alias("ord"))
    return inventory.adopt(below.join(hosts, "dir", "left_anti").unionByName(hosts), pages)


_SKILLS_SQL = """WITH p AS (SELECT page_id, regexp_replace(url, '^https?://|[?#].*$', '', 'g') AS path FROM pages),
c AS (SELECT * FROM p WHERE page_id % 5 = 0 AND strpos(path, '/') > 0),
h AS (SELECT split_part(path, '/', 1) AS dir, min(page_id) * 2 + 1 AS ord FROM c GROUP BY 1),
b AS (SELECT regexp_replace(path, '/[^/]*$', '') AS dir, min(page_id) * 2 AS ord FROM c GROUP BY 1),
s AS (SELECT * FROM h UNION ALL SELECT * FROM b WHERE dir NOT IN (SELECT dir FROM h)),
o AS (SELECT path, arg_min(dir, row(ord, dir)) AS dir FROM (SELECT DISTINCT path FROM p) f JOIN s ON starts_with(path, dir || '/') GROUP BY path)
SELECT dir, path, CAST(row_number() OVER (PARTITION BY dir ORDER BY path) AS INTEGER) AS nth FROM o QUALIFY nth <= 20"""


# ---- acquisition


def package_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages that documents launch: known, look-alike within two edits, of another ecosystem, or unknown."""
    name = F.explode(F.regexp_extract_all("text", F.lit(R.java(Q._RUNNER)), F.lit(1))).alias("name")
    refs = overlaid(spark, sf_dir).select("doc_id", F.when(F.col("doc_id") % 2 == 0, "npm").otherwise("pypi").alias("ecosystem"), name)
    known = spark.createDataFrame([(p, "npm") for p in P.POPULAR_PACKAGES] + [("express", "pypi"), ("server", "pypi")], "name string, ecosystem string")
    return acquire.resolve_packages(refs, known).select("doc_id", "name", "ecosystem", "reason", "verdict", "nearest")


_VERDICTS_SQL = f"""WITH {Q._DOCS_SQL}, k AS (SELECT unnest([{', '.join(map(Q._quote, P.POPULAR_PACKAGES))}]) AS name, 'npm' AS ecosystem UNION ALL VALUES ('express', 'pypi'), ('server', 'pypi')),
u AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'npm' ELSE 'pypi' END AS ecosystem, unnest(regexp_extract_all(text, '{R.re2(Q._RUNNER)}', 1)) AS name FROM docs),
n AS (SELECT u.name, u.ecosystem, arg_min(k.name, row(levenshtein(u.name, k.name), k.name)) AS near FROM (SELECT DISTINCT name, ecosystem FROM u) u JOIN k ON k.ecosystem = u.ecosystem AND levenshtein(u.name, k.name) BETWEEN 1 AND 2 GROUP BY ALL),
v AS (SELECT u.*, near, CASE WHEN (name, ecosystem) IN (SELECT (name, ecosystem) FROM k) THEN 'known' WHEN name IN (SELECT name FROM k) THEN 'other ecosystem' WHEN near IS NOT NULL THEN 'look-alike' ELSE 'unknown' END AS reason FROM u LEFT JOIN n USING (name, ecosystem))
SELECT doc_id, name, ecosystem, reason, CASE reason WHEN 'known' THEN 'ALLOW' WHEN 'look-alike' THEN 'BLOCK' ELSE 'FLAG' END AS verdict, CASE WHEN reason = 'look-alike' THEN near END AS nearest FROM v"""


def model_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models that documents refer to, by what a small index says of them."""
    index = spark.createDataFrame([("bert-base-uncased", False), ("org-a/model-b", True), ("org-a/model-b", False)], "id string, vulnerable boolean")
    return acquire.check_models(models.model_references(overlaid(spark, sf_dir)), index).groupBy("id", "status").agg(F.count("*").alias("n"))


def corpus_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's verdict as part of a corpus; the empty ones stand for texts that could not be read."""
    docs = overlaid(spark, sf_dir).withColumn("text", F.when(F.col("doc_id") % 97 != 5, F.col("text")))
    first = F.get("findings", F.lit(0))
    return acquire.screen_corpus(docs).select("doc_id", "state", "verdict", first["label"].alias("label"), first["chunk"].alias("chunk"))


def corpus_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = overlaid(spark, sf_dir).withColumn("text", F.when(F.col("doc_id") % 97 != 5, F.col("text")))
    return acquire.corpus_summary(acquire.screen_corpus(docs))


def _report_files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents as files, and the list of changed ones (ids that leave 0 or 1 of 3)."""
    path = F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("path")
    return overlaid(spark, sf_dir).withColumn("path", path), _table(spark, sf_dir, "documents").where("doc_id % 3 < 2").select(path)


def _report(docs: DataFrame) -> DataFrame:
    found = scan.scan_documents(docs, ("secret",), masked=False)
    return found.select("path", F.explode_outer(acquire.report_results(F.col("path"), F.col("findings"))).alias("result")).where("result is not null")


def secret_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Credentials in changed documents alone, as results of a report; secret_report_all has those of all."""
    return _report(acquire.changed_only(*_report_files(spark, sf_dir)))


def secret_report_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Credentials in all documents, as results of a report, and whether their document changed."""
    docs, changed = _report_files(spark, sf_dir)
    return acquire.mark_changed(_report(docs), changed).select("path", "changed", "result")


def _report_sql() -> str:
    text = """'{"ruleId":"secret","level":"' || CASE WHEN severity IN ('CRITICAL', 'HIGH') THEN 'error' WHEN severity = 'MEDIUM' THEN 'warning' ELSE 'note' END || '","message":{"text":"' || label
  || '"},"locations":[{"physicalLocation":{"artifactLocation":{"uri":"f' || doc_id || '"},"region":{"startLine":' || line || '}}}]}'"""
    return f"WITH {Q._DOCS_SQL}, s AS ({' UNION ALL '.join(Q._secret_parts())}) SELECT 'f' || doc_id AS path, {text} AS result FROM s WHERE doc_id % 3 < 2"


_REPORT_ALL_SQL = _report_sql().replace(" AS path, ", " AS path, doc_id % 3 < 2 AS changed, ").removesuffix(" WHERE doc_id % 3 < 2")

QUERIES = {
    "reply_pairs": reply_pairs, "listing_screen": listing_screen, "result_screen": result_screen, "call_screen": call_screen, "connections": connections,
    "local_models": local_models, "artifact_catalogues": artifact_catalogues, "skill_files": skill_files,
    "package_verdicts": package_verdicts, "model_status": model_status, "corpus_screen": corpus_screen, "corpus_totals": corpus_totals, "secret_report": secret_report, "secret_report_all": secret_report_all,
}

SQL = {
    "reply_pairs": _REPLIES_SQL,
    "listing_screen": _LISTING_SQL,
    "call_screen": _CALLS_SQL,
    "connections": _CONNECTIONS_SQL,
    "local_models": _LOCAL_SQL,
    "artifact_catalogues": _CATALOGUE_SQL,
    "skill_files": _SKILLS_SQL,
    "package_verdicts": _VERDICTS_SQL,
    "secret_report": _report_sql(),
    "secret_report_all": _REPORT_ALL_SQL,
}
