"""Packing against a naive best fit, and of rows that no id tells apart."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from millrace.llm import packing
from millrace.llm.common import saved

NAMES = ["doc_id", "piece", "start", "length", "ids_crc32"]


def naive(lengths, size, most):
    """All open bins are looked at: the fullest that fits, of equally full ones the one that last came to be so; the fullest closes."""
    bins, out = [], []  # [free, when it came to be so, number]
    made = 0
    for now, n in enumerate(lengths):
        fitting = [x for x in bins if x[0] >= n]
        if fitting:
            own = min(fitting, key=lambda x: (x[0], -x[1]))
        else:
            if len(bins) == most:
                bins.remove(min(bins, key=lambda x: (x[0], -x[1])))
            own = [size, now, made]
            made += 1
            bins.append(own)
        out.append((own[2], size - own[0]))
        own[0], own[1] = own[0] - n, now
        if not own[0]:
            bins.remove(own)
    return out


@pytest.mark.parametrize("most", [1, 2, 7, 1000])
def test_places_are_those_of_a_naive_best_fit(most):
    rng = random.Random(most)
    lengths = [rng.choice([rng.randint(1, 63), rng.randint(1, 9), 32]) for _ in range(700)]
    packer = packing.Packer(64, most)
    assert [packer.place(n) for n in lengths] == naive(lengths, 64, most)


def sequences(out):
    """The contents of all sequences, and that they are gapless."""
    bins = defaultdict(list)
    for r in out:
        bins[r.sequence_id].append((r.offset, r.length, r.doc_id, r.piece, r.ids_crc32))
    for own in bins.values():
        own.sort(key=lambda x: x[:2])
        assert [x[0] for x in own] == [sum(y[1] for y in own[:i]) for i in range(len(own))]
        assert sum(x[1] for x in own) <= 64
    return Counter(tuple(x) for x in bins.values())


def test_order_of_the_input_changes_nothing_and_no_key_is_one_task(spark):
    rng = random.Random(2)
    rows = [(None, 0, 0, 40, 9)] * 3000 + [(i, 0, 0, rng.randint(1, 63), i * 7) for i in range(1500)] + [(5, 0, 0, 64, 1)] * 3
    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long"
    found = []
    for seed in (1, 2):
        random.Random(seed).shuffle(rows)
        cut = saved(spark.createDataFrame(rows, kinds).repartition(3 + seed), "pieces")
        out = packing.pack(cut, 64, open_bins=50, group=300)
        tasks = out.where("doc_id is null").groupBy(F.shiftright("sequence_id", 34).alias("task")).count().collect()
        assert len(tasks) == 15 and max(x["count"] for x in tasks) < 900
        out = out.collect()
        assert Counter(tuple(r[k] for k in NAMES) for r in out) == Counter(rows)
        found.append(sequences(out))
    assert found[0] == found[1]


def test_null_ids_and_repeated_rows_keep_their_tokens(docs, rows, bpe):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe)
    out = packing.best_fit(docs, bpe, size=64).collect()
    sequences(out)
    many = Counter((r[0], len(library.encode(r[1] or "", add_special_tokens=False).ids) + 1) for r in rows)
    found = Counter()
    for doc in {r.doc_id for r in out}:
        found[doc] = sum(r.length for r in out if r.doc_id == doc)
    expected = Counter()
    for (doc, n), k in many.items():
        expected[doc] += n * k
    assert found == expected
