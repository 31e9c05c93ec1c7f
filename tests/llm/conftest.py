import random

import pytest
from clash import CLASH

from millrace.llm.queries import vocabulary

TYPES = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{x}` string" for x in CLASH)


def words(rng, n, lang="en"):
    stems = {"en": ("th", "er", "on", "an", "re", "he", "in", "ed"), "de": ("sch", "ein", "ung", "ich", "der", "zu", "ß")}[lang]
    return " ".join("".join(rng.choice(stems) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Nulls, empty and very long texts, ties, copies, shared lines, odd white space."""
    rng = random.Random(7)
    base = [words(rng, rng.randint(1, 120), "en" if i % 3 else "de") for i in range(60)]
    line = "This very line stands in many of the documents, again and again."
    shared = [f"{x}\n  {line.upper() if i % 2 else line}\t\n{i}" for i, x in enumerate(base[:8])]
    near = [base[12] + " " + words(rng, 40) for _ in range(1)]
    near += [near[0].replace(" ", ", ", 1), near[0] + " tail", near[0].upper(), near[0]]
    odd = [None, "", " ", "\n", "\n\n", "a", "a  b", " lead", "trail ", "x<|endoftext|> y", "é ç z", "it's 3.14, ok...", "\x1e", "日本語 テキスト", "🙂 🙂🙂", "- - -"]
    long = [" ".join(base) * 6, "w" * 20000, ("ab " * 9000).strip()]
    return base + shared + near + odd + long


@pytest.fixture(scope="session")
def rows(texts):
    out = [(i * 3, x, "de" if i % 3 == 0 and i < 60 else "en" if i % 7 else None, "s", len(x or "")) for i, x in enumerate(texts)]
    out += [out[5], out[5], (None, texts[3], None, None, None), (None, None, None, None, None)]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame([(*r, *CLASH) for r in rows], TYPES).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], TYPES)


@pytest.fixture(scope="session")
def bpe():
    return vocabulary("byte_bpe_50k.json")


@pytest.fixture(scope="session")
def piece():
    return vocabulary("piece_bpe_32k.model")
