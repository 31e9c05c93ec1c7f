import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from millrace.llm import huffman, packing, token_count
from millrace.llm.common import new_path
from millrace.llm.queries import vocabulary
from millrace.llm.tokens import encoder


def plain(path, texts):
    library = Tokenizer.from_file(path)
    return [library.encode(x or "", add_special_tokens=False).ids for x in texts]


def test_words_give_the_ids_of_whole_texts(bpe, texts):
    ids, lengths = encoder(bpe).encode(pa.array(texts, pa.string()))
    expected = plain(bpe, texts)
    assert lengths.tolist() == [len(x) for x in expected]
    assert ids.tolist() == [i for x in expected for i in x]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=" \n.,a1é'\t <|-", max_size=30), min_size=1, max_size=6))
def test_words_of_any_text(some):
    path = vocabulary("byte_bpe_50k.json")
    ids, lengths = encoder(path).encode(pa.array(some, pa.string()))
    expected = plain(path, some)
    assert lengths.tolist() == [len(x) for x in expected]
    assert ids.tolist() == [i for x in expected for i in x]


@pytest.mark.parametrize("n,longest", [(1, 18), (2, 18), (5, 3), (300, 9), (3000, 18)])
def test_codes_are_canonical_limited_and_reversible(n, longest):
    rng = np.random.default_rng(n)
    counts = rng.zipf(1.3, n)
    lengths = huffman.code_lengths(counts, longest)
    assert lengths.max() <= longest
    assert n == 1 or (2.0 ** -lengths.astype(float)).sum() == 1
    code = huffman.Code(lengths, longest)
    ids = rng.integers(0, n, 5000)
    payload, bits, marks = code.encode(ids)
    assert bits == lengths[ids].sum()
    assert (code.decode(payload, len(ids), marks) == ids).all()


def test_unlimited_codes_are_the_best():
    import heapq

    counts = np.random.default_rng(1).integers(1, 1000, 200)
    heap = [(int(c), i) for i, c in enumerate(counts)]
    heapq.heapify(heap)
    total, k = 0, len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        total += a[0] + b[0]
        heapq.heappush(heap, (a[0] + b[0], k))
        k += 1
    assert (huffman.code_lengths(counts, 18).astype(int) * counts).sum() == total


def test_token_files_round_trip(spark, docs, rows, bpe):
    path = new_path(spark, "test")
    huffman.write(docs, path, bpe)
    found = [tuple(r) for r in huffman.read(spark, path).orderBy("start").collect()]
    assert len(found) == len(rows)
    assert [r[0] for r in found] == sorted((r[0] for r in rows), key=lambda x: (x is not None, x))
    expected = defaultdict(list)
    for (doc, *_), ids in zip(rows, plain(bpe, [r[1] for r in rows]), strict=True):
        expected[doc].append(np.array([*ids, 2], "<u4").tobytes())
    at = 0
    for doc, start, n, crc, ids in found:
        assert start == at
        at += n
        assert bytes(ids) in expected[doc]
        expected[doc].remove(bytes(ids))
        assert (n, crc) == (len(ids) // 4, zlib.crc32(ids))


def test_an_empty_table_has_files_without_blocks(spark, empty, bpe):
    path = new_path(spark, "test")
    huffman.write(empty, path, bpe)
    assert huffman.read(spark, path).count() == 0
    assert packing.best_fit(empty, bpe).count() == 0
    assert token_count.token_counts(empty, bpe).count() == 0


def test_packing_keeps_every_token_once(spark, docs, rows, bpe):
    out = packing.best_fit(docs.where("doc_id is not null").dropDuplicates(["doc_id"]), bpe, size=64).collect()
    ids = {r[0]: [*x, 2] for r, x in zip(rows, plain(bpe, [r[1] for r in rows]), strict=True) if r[0] is not None}
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in out:
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
        pieces[r.doc_id].append((r.piece, r.start, r.length))
        bins[r.sequence_id].append((r.offset, r.length))
    assert pieces.keys() == ids.keys()
    for doc, own in pieces.items():
        own.sort()
        assert [x[0] for x in own] == list(range(len(own)))
        assert [x[1] for x in own] == [sum(y[2] for y in own[:i]) for i in range(len(own))]
        assert sum(x[2] for x in own) == len(ids[doc])
        assert all(x[2] == 64 for x in own[1:])
    for own in bins.values():
        own.sort()
        assert [x[0] for x in own] == [sum(y[1] for y in own[:i]) for i in range(len(own))]
        assert sum(x[1] for x in own) <= 64
    least = -(-sum(map(len, ids.values())) // 64)
    assert len(bins) <= 1.05 * least + 1


def test_the_fullest_bin_closes_first():
    packer = packing.Packer(10, most=2)
    assert [packer.place(n) for n in (7, 6, 8, 4, 3)] == [(0, 0), (1, 0), (2, 0), (1, 6), (3, 0)]


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "byte_bpe_50k.json"])
def test_counts_are_the_librarys(docs, rows, name):
    import sentencepiece

    path = vocabulary(name)
    texts = [r[1] or "" for r in rows]
    expected = sorted(
        (r[0] is not None, r[0] or 0, len(t.encode()), len(x), len(x) > 50)
        for r, t, x in zip(rows, texts, sentencepiece.SentencePieceProcessor(model_file=path).encode(texts) if name.endswith("model") else plain(path, texts), strict=True)
    )
    assert sorted((r[0] is not None, r[0] or 0, *r[1:]) for r in token_count.token_counts(docs, path, limit=50).collect()) == expected


def test_long_texts_split_at_safe_places(piece, texts):
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=piece)
    for text in [" ".join(x for x in texts if x), "a  b   c " * 50, "▁ x ▁▁ y " * 50, "\n\t " * 90]:
        assert sum(len(x) for x in own.encode(token_count.split(text, 20))) == len(own.encode(text))
