"""Capabilities described in design prose, and the source-to-sink paths between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import literals as L
from ..functions.regexes import java, let, matches
from ..functions.text import explode_fenced
from ..plans import prose as P
from . import findings as FN

# Our own wording of the controls.
GENERIC = (
    "The assistant has an identity and credentials of its own, so its actions can be told from a person's and be revoked.",
    "Every tool call is recorded with the input that caused it.",
    "What the assistant must not do is enforced in code, not asked for in a prompt.",
)
CONTROLS = {
    "injection→exec": ("Only commands of a fixed list in code can run; a model chooses among them and writes none.", "Untrusted text is passed as data, never as part of a command or template."),
    "injection→destructive": ("A person approves each destructive step outside the assistant's loop.", "Amounts and row counts are limited by the server."),
    "injection→network": ("Destinations come from a list; an address found in content is never called.",),
    "readsSensitive→network": ("The part that reads sensitive data and the part that calls out share no context and no credential.", "Fields that may leave are listed."),
    "readsSensitive→exec": ("Secrets are lent for a short time where they are used, not kept in an environment that the assistant can reach.",),
    "readsSensitive→destructive": ("The identity that reads differs from the one that changes data.",),
    "filesystem→exec": ("What the assistant writes can't land on a path that is executed.",),
    "filesystem→network": ("The assistant can't upload a file that it wrote to a place of its choice.",),
    "filesystem→destructive": ("Writes stay in a working folder; only what the assistant made can be deleted.",),
}


def evidence_score(line: Column) -> Column:
    """Lines that say what is done beat headings and goals."""
    one = lambda c, n: F.when(c, n).otherwise(0)
    return one(matches(line, P.ACTION, True), 3) - one(matches(line, P.GOAL, True), 3) + one(F.length(F.trim(line)) > 60, 1)


def path_severity(source: Column, sink: Column) -> Column:
    hard = sink.isin("exec", "destructive")
    return F.when(hard & (source == "injection"), "CRITICAL").when(hard, "HIGH").when((sink == "network") & source.isin("readsSensitive", "injection"), "HIGH").otherwise("MEDIUM")


#: Which capabilities a text may describe.
_described = L.candidates([L.needs(p) for _, _, p in P.CAPABILITIES])


def evidence(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, cap, what, line, quote, match, score): the first line for each
    capability noun, outside fences and disclaimers."""
    docs = docs.select(key, text, _described(text).alias("__mask"))
    lines = explode_fenced(docs, text, F.col("__mask") != 0)
    line, t = F.col("line_text"), F.trim(F.col("line_text"))
    prose = ~F.col("in_fence") & (t != "") & (t != "---") & ~t.rlike("^\\|[\\s\\-:|]+\\|\\z")

    def cites(low: Column) -> Column:
        cite = lambda i, cap, what, p: F.struct(F.lit(i).alias("ord"), F.lit(cap).alias("cap"), F.lit(what).alias("what"), F.left(F.regexp_substr("line_text", F.lit(java(p, True))), F.lit(60)).alias("match"))
        return F.array_compact(F.array(*[F.when(L.bit(F.col("__mask"), i) & L.matches(line, low, p, True), cite(i, cap, what, p)) for i, (cap, what, p) in enumerate(P.CAPABILITIES)]))

    stated = lambda c: F.when((F.size(c) > 0) & ~matches(line, P.DISCLAIMER, True), c)
    found = F.when(prose, let(let(F.lower(line), cites), stated))
    hits = lines.select(key, "line", "line_text", F.explode_outer(found).alias("c")).where("c is not null").select(key, "line", "line_text", "c.*")
    best = hits.groupBy(key, "cap", "what", "ord").agg(F.min_by(F.struct("line", "line_text", "match"), "line").alias("f"))
    return best.select(key, "cap", "what", "ord", F.col("f.line").alias("line"), F.left(F.trim("f.line_text"), F.lit(160)).alias("quote"), F.col("f.match").alias("match"), evidence_score(F.col("f.line_text")).alias("score"))


def ranked_evidence(cited: DataFrame, key: str = "doc_id") -> DataFrame:
    """cited with rank: by score, then line, then catalogue order, within each capability."""
    return cited.withColumn("rank", F.row_number().over(W.partitionBy(key, "cap").orderBy(F.desc("score"), "line", "ord")))


def summarize(cited: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n_evidence, paths): one row a document with evidence. paths holds
    each described source with each described sink, the most severe first."""
    ranked = ranked_evidence(cited, key)
    best = F.when(F.col("rank") == 1, F.struct("cap", "what"))
    rolled = ranked.groupBy(key).agg(F.count("*").alias("n_evidence"), F.collect_list(best).alias("caps"))
    side = lambda caps: F.array_compact(F.array(*[F.get(_of(cap), F.lit(0)) for cap in caps]))

    def path(s: Column, k: Column) -> Column:
        level = path_severity(s["cap"], k["cap"])
        return F.struct((-FN.rank(level)).alias("order"), s["cap"].alias("source"), k["cap"].alias("sink"), level.alias("severity"), F.concat_ws("→", s["cap"], k["cap"]).alias("path"), s["what"].alias("source_what"), k["what"].alias("sink_what"))

    paths = F.flatten(F.transform("sources", lambda s: F.transform("sinks", lambda k: path(s, k))))
    return rolled.withColumns({"sources": side(P.SOURCES), "sinks": side(P.SINKS)}).select(key, "n_evidence", F.array_sort(paths).alias("paths"))


def _of(cap: str) -> Column:
    return F.filter("caps", lambda c: c["cap"] == cap)


def attack_paths(cited: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, source, sink, severity, path, source_what, sink_what), one row a path."""
    rows = summarize(cited, key).select(key, F.explode("paths").alias("p"))
    return rows.select(key, "p.source", "p.sink", "p.severity", "p.path", "p.source_what", "p.sink_what")


def analyze_designs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: verdict (OPEN_PATH, PARTIAL or NOT_DESCRIBED; none says safe), worst, n_paths, n_evidence, controls."""
    controls = F.create_map(*[x for k, v in CONTROLS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    out = docs.select(key).join(summarize(evidence(docs, key, text), key), key, "left").withColumn("n_paths", F.coalesce(F.size("paths"), F.lit(0)).cast("long"))
    listed = F.array_distinct(F.concat(F.flatten(F.transform("paths", lambda p: F.element_at(controls, p["path"]))), F.array(*map(F.lit, GENERIC))))
    verdict = F.when(F.col("n_paths") > 0, "OPEN_PATH").when(F.col("n_evidence") > 0, "PARTIAL").otherwise("NOT_DESCRIBED")
    return out.select(
        key, verdict.alias("verdict"), F.get(F.col("paths"), F.lit(0))["severity"].alias("worst"), F.greatest("n_paths", F.lit(0)).alias("n_paths"),
        F.coalesce("n_evidence", F.lit(0)).alias("n_evidence"), F.when(F.col("n_paths") > 0, listed).alias("controls"),
    )


def checklist(controls: Column) -> Column:
    """The controls as a task list in markdown."""
    return F.array_join(F.transform(controls, lambda c: F.concat(F.lit("- [ ] "), c)), "\n")
