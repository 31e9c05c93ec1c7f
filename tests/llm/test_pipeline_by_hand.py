"""The pipeline against its stages by hand: lines, groups, windows and tokens from the rows alone."""

import random
from collections import Counter, defaultdict

import corpus_pipeline
import pytest
from conftest import words
from pyspark.sql import functions as F
from test_documents import hits_by_hand, linked_by_hand
from test_line_runs import by_hand as lines_by_hand

from millrace.llm import language, line_dedup
from millrace.llm.common import saved
from millrace.llm.queries import vocabulary


@pytest.fixture(scope="module")
def planted(tmp_path_factory, spark):
    """Documents in two languages with noise, shared lines, exact and near copies, benchmark passages, long and empty texts."""
    rng = random.Random(21)
    kind = lambda i: "en" if i % 3 else "de"
    rows = [(i, words(rng, rng.randint(30, 160), kind(i)), kind(i), "s") for i in range(240)]
    line = "this line of a licence stands below very many of the documents"
    rows = [(i, f"{t}\n{line}" if i % 5 == 0 else t, lang, s) for i, t, lang, s in rows]
    rows += [(300 + i, rows[i][1], rows[i][2], "hot") for i in range(0, 60, 2)]
    rows += [(400 + i, rows[i][1] + " " + words(rng, 3), rows[i][2], "hot") for i in range(1, 60, 2)]
    rows += [(500 + i, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(900)), None, "junk") for i in range(12)]
    rows += [(600, words(rng, 3000), "en", "long"), (601, "", None, "s"), (602, None, None, None)]
    items = [(7, " ".join(rows[200][1].split()[5:25])), (8, "no document holds this at all")]
    folder = str(tmp_path_factory.mktemp("tables"))
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, items


def test_run_equals_its_stages_by_hand(spark, planted):
    from tokenizers import Tokenizer

    folder, rows, items = planted
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rejected = {r.doc_id for r in language.identify(docs).where("rejected").collect()}
    assert {i for i, *_ in rows if 500 <= i < 512} | {601, 602} == rejected  # all of the noise, and nothing else

    kept = [r[:2] for r in rows if r[0] not in rejected]
    held = defaultdict(set)
    for doc, text in kept:
        for x in text.split("\n"):
            if len(x) >= line_dedup.LEAST_LENGTH:
                held[x].add(doc)
    gone = lambda doc, x: len(held.get(x, ())) >= line_dedup.LEAST_DOCS and doc != max(held[x])
    kept = [(doc, "\n".join(x for x in text.split("\n") if not gone(doc, x))) for doc, text in kept]
    assert lines_by_hand([r for r in kept], line_dedup.LEAST_DOCS)[0][2] == 0
    firsts = {doc for doc, group, _ in linked_by_hand(kept) if group == doc}
    assert len(firsts) <= len(kept) - 40
    kept = [r for r in kept if r[0] in firsts]
    bad = {x[0] for x in hits_by_hand(kept, items) if x[5]}
    assert 200 in bad
    kept = [r for r in kept if r[0] not in bad]

    library = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    lengths = {doc: len(library.encode(text, add_special_tokens=False).ids) + 1 for doc, text in kept}
    out = corpus_pipeline.run(spark, folder).collect()
    found = Counter()
    bins = defaultdict(list)
    for r in out:
        found[r.doc_id] += r.length
        bins[r.sequence_id].append((r.offset, r.length))
    assert found == lengths
    for own in bins.values():
        own.sort()
        assert [x[0] for x in own] == [sum(y[1] for y in own[:i]) for i in range(len(own))]
        assert sum(x[1] for x in own) <= 1024


def test_the_first_stage_removes_what_is_no_language(spark, planted):
    folder, rows, _ = planted
    docs = saved(corpus_pipeline.STAGES[0][1](spark, spark.read.parquet(f"{folder}/documents.parquet"), folder), "stage")
    assert docs.where("source = 'junk'").count() == 0
    assert docs.where(F.col("lang").isNotNull()).count() == sum(r[2] is not None for r in rows)
