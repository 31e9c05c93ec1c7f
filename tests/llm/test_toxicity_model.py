"""The toxicity model keeps every word and every pair that says something, and says the same however it is dealt."""

import random
import zlib

import pytest

from millrace.llm import toxicity


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def log_ratios(spark, ordinary, toxic, asked):
    """Learns from the texts of both classes; the log-ratios of the texts that are asked for."""
    learned, kept = (i for i in range(1 << 30) if not held(i)), (i for i in range(1 << 30) if held(i))
    rows = [(next(learned), x, c) for c, texts in ((0, ordinary), (1, toxic)) for x in texts]
    ask = [(next(kept), x) for x in asked]
    docs = spark.createDataFrame([r[:2] for r in rows] + ask, "doc_id long, text string").repartition(8)
    marks = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    found = {r.doc_id: r for r in toxicity.toxicity(docs, marks).collect()}
    assert len(found) == len(rows) + len(ask)
    assert all(found[i].held_out for i, _ in ask)
    return [found[i].log_ratio for i, _ in ask]


def short_words(n):
    return ["".join(chr(97 + i // 26**k % 26) for k in range(4)) for i in range(n)]


def test_words_have_no_bound(spark):
    rng, names = random.Random(3), short_words(70_000)
    bad, names = names[0], names[1:]
    ordinary = []
    for _ in range(11):
        rng.shuffle(names)
        ordinary += [" ".join(names[i : i + 700]) for i in range(0, len(names), 700)]
    filled = [" ".join(rng.sample(names, 20)) for _ in range(11)]
    with_bad, without = log_ratios(spark, ordinary, [f"{bad} {x}" for x in filled[:10]], [f"{bad} {filled[10]}", filled[10]])
    assert with_bad > without + 0.1


def test_pairs_have_no_bound(spark):
    p, rng = 521, random.Random(4)
    names = short_words(p)
    ordinary = [" ".join(names[(k + r * 100) * s % p] for k in range(p + 1)) for s in range(1, p - 1) for r in range(5)]
    # the first follows the second in ordinary texts at no place
    first, second = names[7], names[6]
    others = [x for x in names if x not in (first, second)]
    toxic = [f"{names[50 + i]} {first} {second} " + " ".join(rng.sample(others, 3)) for i in range(5)]
    one, other = log_ratios(spark, ordinary, toxic, [f"{names[90]} {first} {second}", f"{names[90]} {second} {first}"])
    assert one > other + 0.3


@pytest.mark.parametrize("letters", [3, 4])
def test_rare_words_say_something(spark, letters):
    rng, names = random.Random(6), short_words(400)
    bad = "zyxw"[:letters]
    # each ordinary text begins with a word of its own
    ordinary = [" ".join([chr(97 + i // 26) + chr(97 + i % 26) + "q", *rng.sample(names, 30)]) for i in range(400)]
    toxic = [f"{bad} " + " ".join(rng.sample(names, 30)) for _ in range(8)]
    text = " ".join(rng.sample(names, 10))
    with_bad, without = log_ratios(spark, ordinary, toxic, [f"{bad} {text}", text])
    assert with_bad > without + 0.1


def test_shares_equal_the_whole(spark, docs, rows, monkeypatch):
    marks = spark.createDataFrame([(r[0], int(i % 3 == 0)) for i, r in enumerate(rows) if r[0] is not None], "doc_id long, toxic int")
    whole = toxicity.toxicity(docs, marks).collect()
    monkeypatch.setattr(toxicity, "MODEL_BYTES", -1)
    shares = toxicity.toxicity(docs, marks).collect()
    key = lambda r: (r.doc_id is not None, r.doc_id, r.log_ratio)
    for a, b in zip(sorted(whole, key=key), sorted(shares, key=key), strict=True):
        assert (a.doc_id, a.held_out, a.predicted) == (b.doc_id, b.held_out, b.predicted)
        assert (a.score, a.log_ratio) == pytest.approx((b.score, b.log_ratio), abs=1e-9)
