"""Large buckets and groups against all pairs, and recall on the driver's tables."""

import os
import random
from collections import defaultdict

import numpy as np
import pytest
from test_documents import grams, linked_by_hand, ordered

from millrace.llm import ngram_join, queries
from millrace.llm.components import components

DATA = os.environ.get("MILLRACE_TESTDATA", "/root/testdata")


def roots_by_hand(n, pairs):
    root = list(range(n))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    return [top(x) for x in range(n)]


@pytest.mark.parametrize("spread", [3, 12, 40])
def test_buckets_link_all_that_look_alike(spark, monkeypatch, spread):
    """Signatures around a few centres: some look like the head of their bucket, some only like each other, some like none."""
    monkeypatch.setattr(ngram_join, "BUCKET_BLOCK", 10)
    rng = np.random.default_rng(spread)
    hashes, n = 40, 160
    centres = rng.integers(0, 5, (4, hashes))
    sig = centres[rng.integers(0, 4, n)].copy()
    for i in range(n):
        at = rng.choice(hashes, rng.integers(0, spread + 1), replace=False)
        sig[i, at] = rng.integers(0, 60_000, len(at))
    buckets = [sorted({int(rng.integers(0, 3)), 10 + int(rng.integers(0, 30))}) for _ in range(n)]
    rows = [(i, sig[i].astype("<u2").tobytes(), buckets[i]) for i in range(n)]
    found = ngram_join.candidates(spark.createDataFrame(rows, "cid long, sig binary, bands array<long>").repartition(3), hashes, 4)
    least = np.ceil(ngram_join.ESTIMATE * hashes)
    pairs = [(i, j) for i in range(n) for j in range(i) if set(buckets[i]) & set(buckets[j]) and (sig[i] == sig[j]).sum() >= least]
    expected = roots_by_hand(n, pairs)
    got = list(range(n))
    for r in components(found).collect():
        got[r.node] = r.root
    assert got == expected


@pytest.mark.parametrize("seed,edits", [(1, 2), (2, 9), (3, 25)])
def test_groups_are_counted_exactly(spark, monkeypatch, seed, edits):
    """Tight and wide groups, with copies: each row's links and group are those of all pairs."""
    monkeypatch.setattr(ngram_join, "BUCKET_BLOCK", 12)
    monkeypatch.setattr(ngram_join, "GROUP_BLOCK", 6)
    rng = random.Random(seed)
    rows = []
    for g in range(3):
        base = [f"g{g}w{i}" for i in range(150)]
        for i in range(40):
            own = list(base)
            for k in rng.sample(range(150), rng.randint(0, edits)):
                own[k] = f"x{g}{i}{k}"
            rows += [(100 * g + i, " ".join(own))] * rng.choice([1, 1, 2])
    found = ngram_join.link(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert ordered(found) == ordered(linked_by_hand(rows))


def test_all_links_of_the_given_documents(spark):
    """The measured recall: every pair of documents that share an n-gram is looked at."""
    path = f"{DATA}/sf0.01"
    if not os.path.isdir(path):
        pytest.skip("no test tables")
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{path}/documents.parquet").collect()]
    sets = [grams(t) for _, t in rows]
    holders = defaultdict(list)
    for i, own in enumerate(sets):
        for x in own:
            holders[x].append(i)
    common = defaultdict(int)
    for some in holders.values():
        for k, i in enumerate(some):
            for j in some[:k]:
                common[i, j] += 1
    links, total = defaultdict(int), 0
    for (i, j), n in common.items():
        if 5 * n >= 4 * (len(sets[i]) + len(sets[j]) - n):
            links[rows[i][0]] += 1
            links[rows[j][0]] += 1
            total += 2
    found = {r.doc_id: r.n_links for r in queries.op6_ngram_jaccard_join(spark, path).collect()}
    assert total > 100
    assert sum(min(found[d], n) for d, n in links.items()) >= 0.999 * total
    assert all(n <= links[d] for d, n in found.items())
