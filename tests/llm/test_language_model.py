"""The character models against Kneser-Ney by hand, what is rejected, and more languages than one pass takes."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from conftest import words

from millrace.llm import language


def by_hand(texts, discount=0.75, order=3):
    """log P(character | two before) of interpolated Kneser-Ney over words of strings, as a function."""
    tables = [Counter() for _ in range(order)]
    for text in texts:
        for w in text.split():
            own = ["B"] * (order - 1) + list(w) + ["E"]
            tables[-1].update(tuple(own[i : i + order]) for i in range(len(own) - order + 1))
    for k in range(order - 1, 0, -1):
        tables[k - 1] = Counter(x[1:] for x in tables[k])
    totals, kinds = [defaultdict(int) for _ in tables], [defaultdict(int) for _ in tables]
    for t, total, kind in zip(tables, totals, kinds, strict=True):
        for x, n in t.items():
            total[x[:-1]] += n
            kind[x[:-1]] += 1

    def p(x):
        if not x:
            return 1 / (len(tables[0]) + 1)
        k, c = len(x) - 1, x[:-1]
        if not totals[k][c]:
            return p(x[1:])
        return max(tables[k][x] - discount, 0) / totals[k][c] + discount * kinds[k][c] / totals[k][c] * p(x[1:])

    return p


def test_models_are_kneser_ney_by_hand():
    texts = ["there then ether the he her", "a the thee 日本 日本語 語る", "zz z the"]
    p = by_hand(texts)
    counts = Counter()
    for text in texts:
        codes, _ = language.grams(pa.array(text.split()))
        counts.update(codes.tolist())
    keys = np.array(sorted(counts))
    model = language.Model.of(keys, np.array([counts[k] for k in keys]))
    for w in ["the", "hethe", "日る", "q", "zzz", "本語"]:
        codes, _ = language.grams(pa.array([w]))
        own = ["B", "B", *w, "E"]
        expected = [math.log(p(tuple(own[i : i + 3]))) for i in range(len(own) - 2)]
        assert model.score(codes) == pytest.approx(expected, abs=1e-9)


def test_no_two_characters_are_one():
    """Code points that agree in their low bits, among them those of the marks."""
    some = ["老", "考", "a", "聡", "한", "ⱕ", "\U00020061", "\U00010061", "ࠁ", "ā"]
    seen = {language.grams(pa.array([x + y]))[0].tobytes() for x in some for y in some}
    assert len(seen) == len(some) ** 2
    assert not {language.BEGIN, language.END} & {ord(x) for x in some}


def test_junk_and_unknown_languages_are_rejected(spark):
    rng = random.Random(4)
    rows = [(i, words(rng, rng.randint(15, 120), "en" if i % 2 else "de"), "en" if i % 2 else "de") for i in range(400)]
    noise = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    junk = [(1000 + i, " ".join(noise[40 * i : 40 * i + 40]), "en") for i in range(20)]
    other = [(2000 + i, " ".join("".join(rng.choice(["ka", "no", "shi", "mu", "tsu", "wo"]) for _ in range(3)) for _ in range(40)), None) for i in range(20)]
    short = [(3000, "xqz vwk", None)]
    held = [x for x in range(1000, 1020) if language_held(x)]
    docs = spark.createDataFrame(rows + [x for x in junk if x[0] in held] + other + short, "doc_id long, text string, lang string").repartition(4)
    out = {r.doc_id: r.rejected for r in language.identify(docs).collect()}
    assert not any(out[i] for i, _, _ in rows)
    assert all(out[i] for i in held) and len(held) >= 3
    assert all(out[i] for i, _, _ in other)
    assert not out[3000]
    kept = {r.doc_id for r in language.accepted(docs).collect()}
    assert kept == {i for i, gone in out.items() if not gone}


def language_held(i):
    import zlib

    return zlib.crc32(str(i).encode()) % 4 == 2


def test_more_languages_than_a_pass_takes(spark, docs, monkeypatch):
    whole = language.identify(docs).collect()
    monkeypatch.setattr(language, "MODEL_GRAMS", 1)
    key = lambda r: (r.doc_id is not None, r.doc_id, r.text_hash)
    for a, b in zip(sorted(whole, key=key), sorted(language.identify(docs).collect(), key=key), strict=True):
        assert (a.doc_id, a.held_out, a.lang_pred, a.rejected) == (b.doc_id, b.held_out, b.lang_pred, b.rejected)
        assert (a.score, a.cross_entropy or 0) == pytest.approx((b.score, b.cross_entropy or 0), abs=1e-9)


def test_passes_hold_what_fits():
    assert language.passes({"a": 3, "b": 3, "c": 9, "d": 1}, 6) == [["a", "b"], ["c"], ["d"]]
    assert language.passes({}, 6) == []
