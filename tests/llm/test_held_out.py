"""Accuracy on rows that nothing was learned from, and recall on the driver's vectors."""

import os

import numpy as np
import pytest

from millrace.llm import queries

DATA = os.environ.get("MILLRACE_TESTDATA", "/root/testdata")


@pytest.fixture(scope="module")
def larger():
    path = f"{DATA}/sf0.01"
    if not os.path.isdir(path):
        pytest.skip("no test tables")
    return path


def test_languages(spark, larger):
    docs = spark.read.parquet(f"{larger}/documents.parquet").select("doc_id", "lang")
    rows = queries.op5_language_id(spark, larger).where("held_out").join(docs, "doc_id").collect()
    assert len(rows) > 200
    assert np.mean([r.lang == r.lang_pred for r in rows]) >= 0.98


def test_toxicity(spark, larger):
    labels = spark.read.parquet(f"{larger}/labels.parquet").select("doc_id", "toxic")
    rows = queries.op3_toxicity(spark, larger).where("held_out").join(labels, "doc_id").collect()
    toxic, other = ([r.score for r in rows if r.toxic == k] for k in (1, 0))
    assert np.mean([a > b for a in toxic for b in other]) >= 0.8


def test_recall(spark, larger):
    vectors = spark.read.parquet(f"{larger}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in vectors]), np.array([r.embedding for r in vectors], np.float32).astype(float)
    found = {}
    for r in queries.op10_nearest_neighbours(spark, larger).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hit = total = 0
    for i in np.flatnonzero(ids % 20 == 0):
        score = x @ x[i]
        score[i] = -np.inf
        hit += len(found[ids[i]] & set(ids[np.lexsort((ids, -score))[:20]]))
        total += 20
    assert hit >= 0.9 * total
