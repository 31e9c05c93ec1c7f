"""Token ids of whole texts by the tokenizers library, each distinct word encoded once."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import ragged

#: Texts in which white space touches white space or the end, or that hold the mark below, are encoded whole. In the rest, a space or line feed begins a new word of the byte-level pattern, so the text can be cut before it.
UNSAFE = r"[\s\x0B\x1C-\x1F\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]([\s\x0B\x1C-\x1F\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]|$)|\x1E"

#: If full stops and commas only follow letters and digits, a text can be cut before them too.
RUNS = r"(^|[^\p{L}\p{N}])[.,]"

#: Set where a text is to be cut; a control character that ordinary texts don't hold.
MARK = "\x1e"

#: Distinct words that a worker keeps, and bytes of text that it cuts into words at once; beyond the first, it starts anew. More of either is faster and takes more memory.
WORDS_KEPT, SLICE = 250_000, 4 << 20

#: Words that the library gets as one text.
WORDS_A_TEXT = 200

_encoders: dict[str, WordEncoder] = {}


def encoder(path: str, kept: int = WORDS_KEPT) -> WordEncoder:
    """One encoder for each vocabulary file and worker process."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    _encoders[path].kept = kept
    return _encoders[path]


class WordEncoder:
    """encode_batch of a byte-level tokenizer, with the ids of words that it has seen kept in flat arrays.

    The pattern of such tokenizers never lets a word reach over a space that stands between two other characters,
    nor does a merge; so the ids of a text are those of its words, each with the space before it.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.vocabulary, self.kept = self.library.get_vocab_size(), WORDS_KEPT
        #: Which ids begin with a space.
        self.spaced = np.array([(self.library.id_to_token(i) or "").startswith("\u0120") for i in range(self.vocabulary)])
        self.reset()

    def reset(self) -> None:
        self.known: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.starts = np.zeros(1 << 14, np.int64)
        self.lengths = np.zeros(1 << 14, np.int64)
        self.used = 0

    def plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and lengths as the library gives them."""
        found = [x.ids for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        return np.concatenate([np.array(x, np.uint32) for x in found]) if found else np.zeros(0, np.uint32), lengths

    def separate(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """plain() of distinct words. Those that begin with a space are encoded as one text, in which an id that begins with a space begins a word."""
        heads = [x for x in words if x[:1] != " "]
        rest = [x for x in words if x[:1] == " "]
        ids = self.plain(["".join(rest[i : i + WORDS_A_TEXT]) for i in range(0, len(rest), WORDS_A_TEXT)])[0]
        starts = np.flatnonzero(self.spaced[ids])
        own, many = np.diff(starts, append=len(ids)), len(rest)
        if len(starts) != many:  # a vocabulary with other habits
            ids, own = self.plain(rest)
        if not heads:
            return ids, own
        more, lengths = self.plain(heads)
        out, spaced = np.zeros(len(words), np.int64), np.array([x[:1] == " " for x in words])
        out[spaced], out[~spaced] = own, lengths
        at = np.zeros(len(words), np.int64)
        at[spaced], at[~spaced] = np.cumsum(own) - own, len(ids) + np.cumsum(lengths) - lengths
        return np.concatenate([ids, more])[ragged(at, out)], out

    def places(self, words: list[str]) -> np.ndarray:
        """Where the words stand in the arrays; unknown ones are encoded first."""
        known = self.known
        new = list(dict.fromkeys([x for x in words if x not in known]))
        if new:
            ids, lengths = self.separate(new)
            n, m = len(known), len(new)
            while self.used + len(ids) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
            while n + m > len(self.starts):
                self.starts, self.lengths = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lengths))
            self.ids[self.used : self.used + len(ids)] = ids
            self.starts[n : n + m] = self.used + np.cumsum(lengths) - lengths
            self.lengths[n : n + m] = lengths
            self.used += len(ids)
            known.update(zip(new, range(n, n + m), strict=True))
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def words(self, texts: pa.Array, stops: bool) -> tuple[np.ndarray, np.ndarray]:
        """Places of the words of texts that can be cut, and how many each text has."""
        if len(self.known) > self.kept:
            self.reset()
        for x in (" ", ".", ",") if stops else (" ",):
            texts = pc.replace_substring(texts, x, MARK + x)
        cut = pc.split_pattern(pc.replace_substring(texts, "\n", f"{MARK}\n{MARK}"), MARK)
        coded = pc.dictionary_encode(cut.flatten())
        return self.places(coded.dictionary.to_pylist())[np.asarray(coded.indices)], np.asarray(pc.list_value_length(cut), dtype=np.int64)

    def ways(self, texts: pa.Array) -> list[tuple[np.ndarray, bool | None]]:
        """Rows that can be cut before stops too, rows that can be cut before spaces, rows that can't be cut."""
        whole = np.asarray(pc.match_substring_regex(texts, UNSAFE), dtype=bool)
        runs = np.asarray(pc.match_substring_regex(texts, RUNS), dtype=bool)
        return [(rows, way) for rows, way in ((~whole & ~runs, True), (~whole & runs, False), (whole, None)) if rows.any()]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and the number of each."""
        texts = texts.fill_null("")
        lengths, starts, parts, done = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), [], 0
        for rows, way in self.ways(texts):
            some = texts if rows.all() else texts.filter(pa.array(rows))
            if way is None:
                ids, own = self.plain(some.to_pylist())
            else:
                at, counts = self.words(some, way)
                n = self.lengths[at]
                ids = self.ids[ragged(self.starts[at], n)]
                own = np.add.reduceat(n, np.cumsum(counts) - counts)
            lengths[rows], starts[rows] = own, done + np.cumsum(own) - own
            done += len(ids)
            parts.append(ids)
        if len(parts) == 1:
            return parts[0], lengths
        return np.concatenate([*parts, np.zeros(0, np.uint32)])[ragged(starts, lengths)], lengths


def with_end(ids: np.ndarray, lengths: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Each document's ids followed by the end id."""
    return np.insert(ids, np.cumsum(lengths), np.uint32(end)), lengths + 1
