"""Secrets in whole texts: strings of known shape, and parts of one credential that stand near each other."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import mapped, operator, pick, slices

#: The shapes of the base kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")

#: Parts that mean little alone: a long string of mixed characters, an identifier after a word for one, a host or address.
KEY_PART = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{32,}={0,2}(?![A-Za-z0-9+/_=-])")
NAME_PART = re.compile(r"""(?:user(?:name)?|login|client_?id|account|access_?key_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._+-]{3,})""", re.IGNORECASE | re.ASCII)
ENDPOINT_PART = re.compile(r"""[a-z][a-z0-9+.-]{1,20}://[^\s"'<>]+|(?:host|endpoint|server|url)["']?\x20*[:=]\x20*["']?([A-Za-z0-9][A-Za-z0-9.-]+(?::[0-9]+)?)""", re.IGNORECASE | re.ASCII)

#: The kinds in the order in which they are written.
KINDS = ("assign", "access", "hex", "key", "name", "endpoint")

#: Code points over which a part reaches to either side for its complements.
SCOPE = 200

#: One search for each text, before any of the above: what has none of this has no span.
ANY = r"(?i)passw|secret|token|api_?key|AKIA|[0-9a-f]{24}|[A-Za-z0-9+/_-]{32}"

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    return out + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


def mixed(part: str) -> bool:
    """Whether a string looks made up: letters of both sizes and digits."""
    return any(x.islower() for x in part) and any(x.isupper() for x in part) and any(x.isdigit() for x in part)


def near(spans: list[Span], others: list[Span], scope: int) -> list[Span]:
    """Those of spans whose interval, widened by the scope, meets one of others that shares no character with it: an interval join over both sorted by place, each span looked up once."""
    starts = sorted(x[0] for x in others)
    ends = sorted(x[1] for x in others)

    def meeting(a: int, b: int) -> int:
        # of the intervals that begin before b, all but those that end at a or before
        return bisect_left(starts, b) - bisect_right(ends, a)

    return [x for x in spans if meeting(x[0] - scope - 1, x[1] + scope + 1) > meeting(x[0], x[1])]


def apart(spans: list[Span], others: list[Span]) -> list[Span]:
    """Those of spans that share no character with any of others."""
    starts = sorted(x[0] for x in others)
    ends = sorted(x[1] for x in others)
    return [x for x in spans if bisect_left(starts, x[1]) == bisect_right(ends, x[0])]


def linked_spans(text: str, base: list[Span], scope: int = SCOPE) -> list[Span]:
    """Weak parts that stand near complementary ones: identifiers need a secret, secrets an identifier, endpoints both.

    No part complements one with which it shares characters, so what is read as an identifier and as a secret at once
    isn't reported for itself. A long string inside a base span or an endpoint is a part of that. An endpoint's
    identifier and secret must have a complement themselves.
    """
    names = [(m.start(), m.end(), "name") for m in NAME_PART.finditer(text)]
    ends = [(m.start(), m.end(), "endpoint") for m in ENDPOINT_PART.finditer(text)]
    keys = apart([(m.start(), m.end(), "key") for m in KEY_PART.finditer(text) if mixed(m[0])], base + ends)
    identifiers = [x for x in base if x[2] == "access"] + names
    secrets = [x for x in base if x[2] != "access"] + keys
    known, hidden = near(identifiers, secrets, scope), near(secrets, identifiers, scope)
    out = [x for x in hidden if x[2] == "key"] + [x for x in known if x[2] == "name"]
    return out + near(near(ends, known, scope), hidden, scope)


def spans(text: str, scope: int = SCOPE) -> tuple[list[Span], list[Span]]:
    """Base spans and linked spans, both by start and then by kind."""
    base = base_spans(text)
    rank = {k: i for i, k in enumerate(KINDS)}
    order = lambda x: (x[0], rank[x[2]], x[1])
    return sorted(base, key=order), sorted(linked_spans(text, base, scope), key=order)


def written(found: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in found)


@operator(python_last=True)
def scan(docs: DataFrame, scope: int = SCOPE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of each row; spans are kind:start:end in code points.

    Null and empty texts have no spans; texts are read whole, however long; a document is scanned by itself, so hot
    sources, copies, repeated rows and rows without an id change nothing; spans that begin together come in the order of
    KINDS; other columns, whatever their names, are ignored; an empty table gives an empty result. A first search over
    all texts at once leaves out those that can hold nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = {k: i for i, k in enumerate(KINDS)}
        nothing = hashlib.sha256(b"").hexdigest()
        for batch in slices(batches):
            texts = batch.column("text")
            rows: list[tuple] = [(0, 0, 0, nothing, "")] * len(texts)
            for i in pc.indices_nonzero(pc.match_substring_regex(texts, ANY)).to_pylist():
                text = texts[i].as_py()
                base, linked = spans(text, scope)
                n = [sum(x[2] == k for x in base) for k in KINDS[:3]]
                both = sorted(base + linked, key=lambda x: (x[0], rank[x[2]], x[1]))
                rows[i] = (*n, hashlib.sha256(written(base).encode()).hexdigest(), written(both))
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return mapped(pick(docs, id_col, text_col), run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
