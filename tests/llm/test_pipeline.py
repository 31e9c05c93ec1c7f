import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from millrace.llm.common import saved


def test_each_stage_keeps_the_columns_of_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = saved(stage(spark, docs, sf), "stage")
        assert docs.columns == columns
        assert docs.where(F.col("n_chars") != F.char_length("text")).count() == 0
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True)
    assert counts[1] == counts[0] == counts[2]
    assert 0.7 * counts[0] < counts[-1] < counts[0]
    out = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert out.select("doc_id").distinct().count() == counts[-1]


def test_run_is_its_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = saved(stage(spark, docs, sf), "stage")
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(corpus_pipeline.run(spark, sf).select(key).collect()) == sorted(docs.select(key).collect())


def test_stages_take_nulls_and_empty_tables(spark, sf):
    rows = [(1, None, None, None, None), (None, "some words of a text that is long enough to be one", "en", "s", 50), (3, "", "en", "s", 0)]
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    for some in (rows, []):
        docs = spark.createDataFrame(some, kinds)
        for _, stage in corpus_pipeline.STAGES:
            docs = saved(stage(spark, docs, sf), "stage")
        assert docs.count() >= 0


@pytest.mark.parametrize("name", ["op1_huffman_token_files", "op3_toxicity", "op4_best_fit_packing", "op5_language_id", "op6_ngram_jaccard_join", "op8_secret_scan", "op9_token_counts"])
def test_queries_give_all_documents(spark, sf, name):
    from millrace.llm import queries

    out = queries.queries()[name](spark, sf)
    assert out.select("doc_id").distinct().count() == spark.read.parquet(f"{sf}/documents.parquet").count()
