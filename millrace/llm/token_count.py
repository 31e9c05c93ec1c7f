"""Token counts of whole texts, by Arrow functions that return lengths only."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import mapped, operator, pick, slices

#: Characters after which a long text is split at the next safe place.
LONG = 1 << 15

#: A space after neither space nor the mark that stands for one, and not the last character: no piece of the vocabulary reaches over it.
SAFE = re.compile(r"(?<=[^ ▁]) (?=[\s\S])")

_models: dict[str, object] = {}


def model(path: str):
    """The library's model, loaded once in each worker."""
    if path not in _models:
        if path.endswith(".model"):
            import sentencepiece

            own = sentencepiece.SentencePieceProcessor(model_file=path)
            across = any(re.search("[^▁]▁", own.id_to_piece(i)) for i in range(own.get_piece_size()))
            _models[path] = (lambda texts: [len(x) for x in own.encode(texts, num_threads=1)], not across)
        else:
            from tokenizers import Tokenizer

            library = Tokenizer.from_file(path)
            library.no_truncation()
            library.no_padding()
            _models[path] = (lambda texts: [len(x) for x in library.encode_batch_fast(texts, add_special_tokens=False)], False)
    return _models[path]


def split(text: str, long: int = LONG) -> list[str]:
    """Parts of a text whose counts add up to that of the whole. The space at which it is cut goes, as the library puts one before each part."""
    parts, at = [], 0
    while len(text) - at > long and (cut := SAFE.search(text, at + long)):
        parts.append(text[at : cut.start()])
        at = cut.end()
    return [*parts, text[at:]]


@operator(python_last=True)
def token_counts(docs: DataFrame, tokenizer: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each row.

    Null and empty texts have 0 bytes and 0 tokens; repeated rows are counted row by row; an empty table gives an empty
    result. Only lengths leave the workers. Batches are cut by bytes; texts of many characters are split at safe places.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            encode, splits = model(tokenizer)
            texts = batch.column("text")
            parts = [split(x) if splits else [x] for x in texts.to_pylist()]
            many = np.fromiter(map(len, parts), np.int64, len(parts))
            lengths = np.array(encode([x for p in parts for x in p]), np.int64)
            n = np.add.reduceat(lengths, np.cumsum(many) - many)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pc.cast(pc.binary_length(texts), pa.int64()), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return mapped(pick(docs, id_col, text_col), count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
