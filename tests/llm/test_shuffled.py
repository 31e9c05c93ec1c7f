"""With no table small enough to broadcast, every operator gives the same rows."""

import pytest

from millrace.llm import common, decontaminate, hnsw, language, line_dedup, ngram_join, toxicity


def ordered(frame):
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in frame.collect()), key=lambda r: [(x is not None, x) for x in r])


@pytest.fixture(scope="module")
def made(spark, docs, rows):
    marks = spark.createDataFrame([(r[0], int(i % 3 == 0)) for i, r in enumerate(rows) if r[0] is not None], "doc_id long, toxic int")
    vectors = spark.createDataFrame([(i, [float(i % 7) + 0.5, float(i * i % 11), 1.0]) for i in range(200)], "vec_id long, embedding array<float>")
    items = spark.createDataFrame([(1, " ".join(rows[10][1].split()[:12])), (2, rows[20][1])], "item_id long, text string")
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    return {
        "link": lambda: ngram_join.link(docs),
        "first_of_each": lambda: ngram_join.first_of_each(plain),
        "digests": lambda: line_dedup.digests(docs),
        "deduplicated": lambda: line_dedup.deduplicated(plain),
        "toxicity": lambda: toxicity.toxicity(docs, marks),
        "identify": lambda: language.identify(docs),
        "accepted": lambda: language.accepted(plain),
        "clean": lambda: decontaminate.clean(plain, items),
        "nearest": lambda: hnsw.nearest(vectors),
    }


@pytest.mark.parametrize("name", ["link", "first_of_each", "digests", "deduplicated", "toxicity", "identify", "accepted", "clean", "nearest"])
def test_shuffled_joins_give_the_same(spark, made, name, monkeypatch):
    broadcast = ordered(made[name]())
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert ordered(made[name]()) == broadcast
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert broadcast


def test_sessions_keep_their_settings(spark, docs):
    before = {k: spark.conf.get(k, None) for k in common.SETTINGS}
    frame = line_dedup.digests(docs)
    assert {k: spark.conf.get(k, None) for k in common.SETTINGS} == before
    assert frame.count() == docs.count()
