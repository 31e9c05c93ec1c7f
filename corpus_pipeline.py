"""A training corpus from `documents`, in stages. Each works on all rows that the one before has written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontaminate, language, line_dedup, ngram_join, packing
from millrace.llm.common import saved, table
from millrace.llm.queries import vocabulary


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language identification rejects go: null texts, texts without letters, and texts that are no language it has learned. The rest stay with all their columns, rows without an id and repeated rows too; an empty table stays empty."""
    return language.accepted(docs)


def without_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share leave the texts but of the largest doc_id; n_chars follows, null for null texts. All rows stay; an empty table stays empty."""
    return line_dedup.deduplicated(docs).withColumn("n_chars", F.char_length("text").cast("long"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays; of repeated rows of it all stay. Rows without an id, and texts without words, stay; an empty table stays empty."""
    return ngram_join.first_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go. Null texts hold none; rows without an id are told by their text; an empty benchmark takes nothing, an empty table stays empty."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts' tokens in sequences of 1024; a null or empty text is its end id alone, an empty table gives no rows."""
    return packing.best_fit(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("language ID", identified),
    ("line dedup", without_shared_lines),
    ("n-gram Jaccard join", one_of_each_group),
    ("benchmark decontamination", without_benchmark),
    ("best-fit packing", packed),
]

#: SQL has neither the language models nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
