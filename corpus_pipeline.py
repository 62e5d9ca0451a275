"""A training corpus from documents: five stages, each a DataFrame of what it keeps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievehouse.llm import bpe, decontam, langid, pii, simhash
from sievehouse.llm.common import drop_table, finished, table
from sievehouse.llm.queries import vocabulary

#: A document goes if its language is undetermined or less likely than this.
LEAST_SCORE = 0.5


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is determined and likely enough, unchanged.

    The model learns from docs itself. Null and empty texts and those without
    a letter go; so do all documents where none has a language to learn from.
    Equal texts stay or go together, repeated rows and null ids are kept as
    they are; columns named like the prediction's are put back. An empty table stays empty."""
    model = langid.train_language_model(docs)
    found = langid.identify_language(docs.withColumnsRenamed({"lang_pred": "__pred", "score": "__score"}), model)
    kept = found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).drop("lang_pred", "score")
    return kept.withColumnsRenamed({"__pred": "lang_pred", "__score": "score"})


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest
    id. Texts without a word are near-duplicates of each other; of repeated
    rows one stays; null ids come after all others. Columns are unchanged."""
    return simhash.drop_near_duplicates(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no item of benchmark, unchanged. Null and empty
    texts contain none, and null or empty items are in none; equal texts stay
    or go together. With an empty benchmark all stay."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each span of personal data in text replaced by its kind
    and n_chars counted anew. Null texts stay null; every row is redacted for
    itself, whole, however long; other columns are unchanged."""
    return pii.redact(docs, pii.train_span_model(docs))


def tokenize_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, token_ids), one row for
    each document, repeated ids included. A null text counts as empty; other columns are left out."""
    return bpe.encode_texts(docs, vocabulary(), with_decoded=False)


STAGES = [
    ("language ID", language_stage),
    ("SimHash near-dedup", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("personal data", personal_data_stage),
    ("BPE encoding and decoding", tokenize_stage),
]

#: The language model, fingerprints and merges can't be expressed in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each is written and read by the next.
    A stage's input and its inner tables are deleted once its result is
    written, so no table is left but the last stage's input."""
    docs, path = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        kept, written = finished(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-").lower())
        if path:
            drop_table(spark, path)
        docs, path = kept, written
    return STAGES[-1][1](spark, docs, sf_dir)
