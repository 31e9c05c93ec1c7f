"""The queries of this subpackage's operators: each takes (spark, sf_dir) and works on whole tables."""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import new_path, table
from . import decontaminate, hnsw, huffman, language, line_dedup, ngram_join, secret_scan
from .packing import best_fit
from .token_count import token_counts
from .toxicity import toxicity


def vocabulary(name: str) -> str:
    """A vocabulary file: in the folder that MILLRACE_TOKENIZERS names, else in the installed package of public ones."""
    if own := os.environ.get("MILLRACE_TOKENIZERS"):
        return os.path.join(own, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_huffman_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "ids")
    huffman.write(table(spark, sf_dir, "documents"), path, vocabulary("byte_bpe_50k.json"))
    return huffman.read(spark, path, with_ids=False)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link(table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digests(table(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.nearest(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    here = sys.modules[__name__]
    return {k: getattr(here, k) for k in sorted(vars(here), key=lambda k: (len(k.split("_")[0]), k)) if k.startswith("op") and k[2:3].isdigit()}


#: Statements of the queries that SQL can express.
ORACLE: dict[str, str] = {"op2_decontamination": decontaminate.SQL, "op7_line_dedup": line_dedup.SQL}
