"""Shared lines whose runs reach over batches and ranges."""

import hashlib
import random
from collections import defaultdict

import pytest

from millrace.llm import common, line_dedup


def by_hand(rows, least):
    held = defaultdict(set)
    for doc, text in rows:
        for x in text.split("\n"):
            if len(x) >= 40:
                held[x].add(doc)
    out = []
    for doc, text in rows:
        every = text.split("\n")
        kept = [x for x in every if not (len(held[x]) >= least and doc != max(held[x]))]
        out.append((doc, len(every), len(every) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("batch,ranges", [(1, 1), (3, 2), (7, 9), (1000, 13)])
def test_runs_over_batches_and_ranges(spark, monkeypatch, batch, ranges):
    rng = random.Random(batch)
    lines = [f"{'line that is long enough for a key of its own':<44}{i}" for i in range(14)]
    rows = []
    for i in range(70):
        own = [rng.choice(lines[: rng.choice([1, 2, 14])]) for _ in range(rng.randint(0, 6))] + ["short"] * rng.randint(0, 2)
        rng.shuffle(own)
        rows.append((rng.randrange(60), "\n".join(own)))
    rows += rows[:4]
    rows += [(100 + i, lines[13]) for i in range(line_dedup.LEAST_DOCS - 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    monkeypatch.setattr(line_dedup, "partitions", lambda df, each: ranges)
    real = common.rows_a_batch
    monkeypatch.setattr(line_dedup, "rows_a_batch", lambda spark, n: real(spark, batch))
    found = sorted(tuple(r) for r in line_dedup.digests(docs).collect())
    assert found == by_hand(rows, line_dedup.LEAST_DOCS)
    assert sum(x[2] for x in found) > 20
