"""The corpus pipeline on a planted corpus."""

import hashlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer as Library

import corpus_pipeline
from sievehouse.llm.common import written
from test_llm_operators import DOC, docs_of, prose


def test_stages_take_effect(spark, tmp_path):
    passage = prose(900, 30, 5000)
    rows = [(i, prose(i, 150, 5000)) for i in range(40)]
    rows += [(100, rows[3][1]), (101, rows[3][1]), (102, prose(41, 100, 5000) + " " + passage + " " + prose(42, 100, 5000)), (103, "12 34 56"), (104, None), (105, prose(43, 60) + " write to jane.doe@example.com please")]
    docs_of(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, passage)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, str(tmp_path)), "test")
        assert docs.columns == [c.split()[0] for c in DOC.split(", ")]
        kept.append({x.doc_id for x in docs.collect()})
    all_ids = {i for i, _ in rows}
    assert kept[0] == all_ids - {103, 104} and kept[1] == kept[0] - {100, 101} and kept[2] == kept[1] - {102} and kept[3] == kept[2]
    assert "[EMAIL]" in docs.where("doc_id = 105").first().text and docs.where("n_chars != length(text)").count() == 0
    library = Library.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    last = {x.doc_id: x for x in corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()}
    for x in docs.collect():
        ids = library.encode(x.text, add_special_tokens=False).ids
        assert last[x.doc_id].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert {x.doc_id: x.ids_sha256 for x in corpus_pipeline.run(spark, str(tmp_path)).collect()} == {k: v.ids_sha256 for k, v in last.items()}
    from sievehouse.llm import common

    common.drop_written(spark)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(last) and len(common._WRITTEN) == 1  # the last stage's input alone
    clash = spark.read.parquet(str(tmp_path / "documents.parquet")).withColumn("score", F.lit("clash"))
    assert "score" in corpus_pipeline.STAGES[0][1](spark, clash, str(tmp_path)).columns


def test_stages_take_awkward_rows(spark, tmp_path):
    """Empty tables, null and repeated ids, ties, very long texts, clashing columns."""
    rows = [(None, prose(1, 90)), (7, prose(2, 90)), (7, prose(2, 90)), (8, prose(3, 20_000, 5000)), (9, None), (10, ""), (11, "x" * 60_000), (None, prose(1, 90))]
    spark.createDataFrame([(1, None), (2, ""), (3, prose(77, 20, 5000))], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = docs_of(spark, rows, extra=True)
    sizes = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = written(stage(spark, docs, str(tmp_path)), "awkward")
        assert out.columns == docs.columns and out.where("score != 'clash' or found != 'clash'").count() == 0
        docs = out
        sizes.append(docs.count())
    assert sizes[0] == 6 and sizes[1] == sizes[2] == sizes[3] == 4
    last = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert sorted((x.doc_id for x in last), key=str) == [11, 7, 8, None] and all(x.n_tokens == len(x.token_ids) > 0 for x in last)
    none = docs_of(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0
