"""Screens before something is taken in: packages, models, corpora; and the reports of screens."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import chunk_of
from . import findings as FN
from .packages import look_alikes
from .scan import DEFAULT, scan_documents

INVISIBLE = "Invisible / zero-width characters"


def resolve_packages(refs: DataFrame, known: DataFrame, distance: int = 2) -> DataFrame:
    """refs (name, ecosystem, ...) with verdict, reason and nearest. A known
    package of its ecosystem is ALLOW; a name within distance edits of one is
    BLOCK, nearest being the first of the closest; one known only elsewhere, an
    unknown or a null name is FLAG. known is (name, ecosystem)."""
    known = known.select("name", "ecosystem").distinct()
    names = refs.select("name", "ecosystem").where("name is not null").distinct()
    same = names.join(known, ["name", "ecosystem"], "left_semi").withColumn("__exact", F.lit(True))
    other = names.join(known.select("name").distinct(), "name", "left_semi").withColumn("__other", F.lit(True))
    near = look_alikes(names, known, distance, known_name="name").withColumnRenamed("known", "__known")
    near = near.join(known.select(F.col("name").alias("__known"), "ecosystem"), "__known")
    near = near.groupBy("name", "ecosystem").agg(F.min(F.struct(F.levenshtein("name", "__known"), F.col("__known").alias("known")))["known"].alias("__near"))
    facts = names.join(same, ["name", "ecosystem"], "left").join(other, ["name", "ecosystem"], "left").join(near, ["name", "ecosystem"], "left")
    out = refs.join(facts, ["name", "ecosystem"], "left")
    reason = F.when(F.col("__exact"), "known").when(F.col("__other"), "other ecosystem").when(F.col("__near").isNotNull(), "look-alike").otherwise("unknown")
    verdict = F.when(F.col("reason") == "known", "ALLOW").when(F.col("reason") == "look-alike", "BLOCK").otherwise("FLAG")
    nearest = F.when(F.col("reason") == "look-alike", F.col("__near"))
    return out.withColumn("reason", reason).withColumns({"verdict": verdict, "nearest": nearest}).drop("__exact", "__other", "__near")


def check_models(refs: DataFrame, index: DataFrame, model: str = "id") -> DataFrame:
    """refs with status: vulnerable or clean as the index (id, vulnerable)
    says, else unchecked, which is not clean. An id that the index holds twice
    is vulnerable if one of its rows says so."""
    known = index.groupBy(F.col(model).alias("__id")).agg(F.bool_or("vulnerable").alias("__bad"))
    status = F.when(F.col("__bad"), "vulnerable").when(~F.col("__bad"), "clean").otherwise("unchecked")
    return refs.join(known, refs[model] == known["__id"], "left").withColumn("status", status).drop("__id", "__bad")


def screen_corpus(docs: DataFrame, categories: tuple[str, ...] = DEFAULT, text: str = "text", chunk: int = 1000) -> DataFrame:
    """docs with findings (each with its chunk), verdict and state. Quoted
    findings count as LOW; invisible characters are CRITICAL in a corpus. A
    null text is unreadable: its verdict is null, and it isn't clean."""
    out = scan_documents(docs, categories, text)
    raised = F.transform(FN.downrank(F.col("findings")), lambda x: x.withField("severity", F.when(x["label"] == INVISIBLE, "CRITICAL").otherwise(x["severity"])))
    placed = F.transform(raised, lambda x: x.withField("chunk", chunk_of(x["offset"], chunk)))
    read = F.col(text).isNotNull()
    out = out.withColumn("findings", placed).withColumn("verdict", F.when(read, FN.grade(F.col("findings"))["verdict"]))
    return out.withColumn("state", F.when(read, "read").otherwise("unreadable"))


def corpus_summary(screened: DataFrame) -> DataFrame:
    """(state, verdict, n_documents, n_findings) over all that was handed in, unreadable texts too."""
    return screened.groupBy("state", "verdict").agg(F.count("*").alias("n_documents"), F.sum(F.size("findings")).alias("n_findings"))


def changed_only(docs: DataFrame, changed: DataFrame, path: str = "path") -> DataFrame:
    """docs whose path is among the changed ones; null paths never are."""
    return docs.join(changed.select(path).distinct(), path, "left_semi")


def mark_changed(rows: DataFrame, changed: DataFrame, path: str = "path") -> DataFrame:
    """rows with changed: whether their path is among the changed ones; null paths never are."""
    listed = changed.select(path).distinct().withColumn("changed", F.lit(True))
    return rows.join(listed, path, "left").withColumn("changed", F.coalesce("changed", F.lit(False)))


def report_results(file: Column, found: Column) -> Column:
    """The findings of a file as result objects of a static-analysis report, one JSON text each, in order."""
    level = lambda x: F.when(x["severity"].isin("CRITICAL", "HIGH"), "error").when(x["severity"] == "MEDIUM", "warning").otherwise("note")

    def result(x: Column) -> Column:
        region = F.struct(F.coalesce(x["line"], F.lit(1)).alias("startLine"))
        place = F.struct(F.struct(F.struct(file.alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
        return F.to_json(F.struct(x["category"].alias("ruleId"), level(x).alias("level"), F.struct(x["label"].alias("text")).alias("message"), F.array(place).alias("locations")))

    return F.transform(found, result)


def write_report(results: DataFrame, path: str, column: str = "result") -> None:
    """Writes result texts as lines of files; nothing is gathered in the driver."""
    results.select(F.col(column).alias("value")).where("value is not null").write.mode("overwrite").text(path)


def write_report_files(results: DataFrame, folder: str, tool: str, result: str = "result") -> None:
    """Whole reports: each task writes one file that is a valid document of the
    static-analysis format, with the head, its results and the tail. One empty
    report goes first, so there is always one; tasks without a row write none.
    Results are not moved, null ones are left out, and a task holds one batch."""
    head = json.dumps({"version": "2.1.0", "$schema": "https://json.schemastore.org/sarif-2.1.0.json", "runs": [{"tool": {"driver": {"name": tool}}, "results": []}]})
    before, after = head.rsplit("[]", 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        line = lambda texts: pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["value"])
        yield line([before + "["])
        began = False
        for batch in batches:
            texts = [x for x in batch.column(0).to_pylist() if x is not None]
            if texts:
                yield line([("," if began or i else "") + x for i, x in enumerate(texts)])
                began = True
        yield line(["]" + after])

    first = results.sparkSession.range(0, 1, 1, 1).select(F.lit(None).cast("string").alias(result))
    first.unionByName(results.select(result)).mapInArrow(run, "value string").write.text(folder)
