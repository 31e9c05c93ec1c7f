"""Words of texts in Arrow, and the folds of labelled rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What stands between two words: anything but letters.
NO_LETTERS = r"[^\p{L}]+"


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from learning: the crc32 of its id as text leaves 2 when divided by 4. A null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def letter_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """For each word in small letters its place in a list of distinct words; that list; and each text's number of words."""
    cut = pc.split_pattern_regex(pc.utf8_lower(texts.fill_null("")), NO_LETTERS)
    flat = cut.flatten()
    full = np.asarray(pc.binary_length(flat)) > 0
    many = np.asarray(pc.list_value_length(cut), dtype=np.int64)
    counts = np.bincount(np.repeat(np.arange(len(many)), many)[full], minlength=len(many))
    coded = pc.dictionary_encode(flat.filter(pa.array(full)))
    return np.asarray(coded.indices, dtype=np.int64), coded.dictionary, counts
