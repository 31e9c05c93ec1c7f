"""The toxicity model against Kneser-Ney by hand: every probability is worked out from the texts alone."""

import math
import random
from collections import Counter

import pyarrow as pa
import pytest

from millrace.llm import toxicity


def discounts(counts, alone, n1=None):
    n = [sum(1 for x in counts if x == k) for k in (1, 2, 3, 4)]
    if n1 is not None:
        n[0] = n1
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
    d = [min(float(k), max(0.0, k - (k + 1) * y * n[k] / n[k - 1])) if n[k - 1] else k * y for k in (1, 2, 3)]
    if not alone:
        d[0] = 1.0
    return lambda x: d[min(x, 3) - 1] if x else 0.0


def by_hand(texts):
    """log-ratio of a pair as a function, from (text, toxic)."""
    words, pairs = [Counter(), Counter()], [Counter(), Counter()]
    for text, c in texts:
        before = None
        for w in text.split():
            words[c][w] += 1
            pairs[c][before, w] += 1
            before = w
    stem = lambda w: w[:4] + "*" if len(w) > 4 else None
    heads = [Counter(stem(w) for w in words[c] if stem(w)) for c in (0, 1)]
    every = set(words[0]) | set(words[1])
    k = lambda table, x: (table[0][x] > 0) + (table[1][x] > 0)
    below = Counter()
    for w in every:
        if stem(w):
            below[stem(w)] += k(words, w)
    roots = sum(k(heads, s) for s in below) + sum(k(words, w) for w in every if not stem(w))
    d = [[discounts(list(t[c].values()), alone) for t, alone in ((heads, True), (words, False), (pairs, False))] for c in (0, 1)]
    total = [[sum(t[c].values()) for t in (heads, words, pairs)] for c in (0, 1)]
    left = [[max(1e-6, sum(d[c][i](x) for x in t[c].values()) / total[c][i]) for i, t in enumerate((heads, words, pairs))] for c in (0, 1)]

    def p_stem(c, s):
        if s not in below:
            return left[c][0]  # times what both classes share
        return max(heads[c][s] - d[c][0](heads[c][s]), 0) / total[c][0] + left[c][0] * k(heads, s) / roots

    def p_word(c, w):
        s = stem(w)
        if w not in every:
            return left[c][1] * (p_stem(c, s) if s else 1)
        shared = p_stem(c, s) * k(words, w) / below[s] if s else k(words, w) / roots
        return max(words[c][w] - d[c][1](words[c][w]), 0) / total[c][1] + left[c][1] * shared

    def p_pair(c, v, w):
        n = pairs[0][v, w] + pairs[1][v, w]
        if not n:
            return left[c][2] * p_word(c, w)
        return max(pairs[c][v, w] - d[c][2](pairs[c][v, w]), 0) / total[c][2] + left[c][2] * p_word(c, w) * n / (words[0][w] + words[1][w])

    return lambda v, w: math.log(p_pair(1, v, w) / p_pair(0, v, w))


def test_log_ratios_are_those_by_hand(spark):
    rng = random.Random(12)
    names = ["".join(rng.choice("abcde") for _ in range(rng.randint(2, 7))) for _ in range(160)]
    bad = ["idiotic", "idiots", "vile"]
    weights = [1 / (i + 1) for i in range(160)]
    texts = []
    for i in range(120):
        w = rng.choices(names, weights, k=rng.randint(1, 25))
        if i % 3 == 0:
            w.insert(rng.randint(0, len(w)), rng.choice(bad))
        texts.append((" ".join(w), int(i % 3 == 0)))
    ratio = by_hand(texts)
    rows = spark.createDataFrame([(i, *x) for i, x in enumerate(texts)], "doc_id long, text string, toxic int").repartition(3)
    words, pairs, unseen = toxicity.learn(rows, 2)
    model = toxicity.model(words.toArrow(), pairs.toArrow(), unseen)
    asked = [x for x, _ in texts[:40]] + ["idiotical vile", "zzzzzzz", "zz", "idio idiot", " ".join(names[:30])]
    top, mean, many = model.passages(pa.array([*asked, "", None]))
    for i, text in enumerate(asked):
        w = text.split()
        each = [ratio(v, x) for v, x in zip([None, *w], w, strict=False)]
        size = min(toxicity.PASSAGE, len(w))
        assert many[i] == len(w)
        assert mean[i] == pytest.approx(sum(each) / len(w), abs=1e-9)
        assert top[i] == pytest.approx(max(sum(each[j : j + size]) / size for j in range(len(w) - size + 1)), abs=1e-9)
    assert many[-2:].tolist() == [0, 0]


def test_null_ids_and_repeated_rows(spark):
    """Rows without an id are scored; rows that repeat count once and are scored as often as they come."""
    rng = random.Random(3)
    names = [f"{a}{b}n" for a in "abcdefgh" for b in "ijklmnop"]
    rows = [(i, " ".join(rng.choices(names, k=12)) + (" vilest" if i % 4 == 0 else "")) for i in range(300)]
    marks = [(i, int(i % 4 == 0)) for i in range(300)]
    kinds, marked = "doc_id long, text string", spark.createDataFrame(marks, "doc_id long, toxic int")
    once = {(r.doc_id, r.score) for r in toxicity.toxicity(spark.createDataFrame(rows, kinds), marked).collect()}
    more = [(None, rows[4][1]), (None, None)] + rows[:50] * 3
    out = toxicity.toxicity(spark.createDataFrame(rows + more, kinds).selectExpr("*", "1 as toxic", "'z' as key", "0 as score"), marked).collect()
    assert len(out) == len(rows) + len(more)
    for r in out:
        if r.doc_id is not None:
            assert any(d == r.doc_id and abs(s - r.score) < 1e-9 for d, s in once)
    lone = sorted(r.score for r in out if r.doc_id is None)
    assert lone[-1] == pytest.approx(dict(once)[4], abs=1e-9)
