"""Language identification by interpolated Kneser-Ney character models, one for each language."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mapped, operator, saved, slices, small
from .words import held_out, letter_words

#: Characters of an n-gram, and bits of one: whole code points, so an n-gram's key is its perfect hash in 63 bits.
ORDER, BITS = 3, 21
MASK = (1 << BITS) - 1

#: Marks of a word's beginning and end; no letters.
BEGIN, END = 1, 2

#: Taken from each count for the lower orders.
DISCOUNT = 0.75

#: Temperatures tried for the score; that under which the calibrating rows' languages are likeliest is taken.
SHARPNESS = (1, 2, 4, 8, 16, 32, 64, 128)

#: Of how many texts one is kept from the counts, to calibrate the score and the rejection.
FIT_EACH = 8

#: Texts of fewer letters than the first are never rejected; those of fewer than the second, which scatter more, have limits of their own.
REJECT_LETTERS, REJECT_LONG = 60, 200

#: Of the calibrating texts, at most this share is rejected, and none within so many nats of the highest of the others.
REJECT_RATE, REJECT_NATS = 1e-4, 0.1

#: N-grams whose models are broadcast together; more languages take more passes over the texts.
MODEL_GRAMS = 1 << 22


def grams(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of distinct words, each character and the end with what is before it, and how many each word has."""
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    joined = "\n".join(words.to_pylist()) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    ends = np.flatnonzero(points == 10)
    many = np.diff(ends, prepend=-1)
    points[ends] = END
    place = np.arange(len(points)) - np.repeat(ends - many + 1, many)
    out = points.copy()
    for k in range(1, ORDER):
        before = np.full(len(points), BEGIN, np.int64)
        before[k:] = np.where(place[k:] >= k, points[:-k], BEGIN)
        out |= before << (BITS * k)
    return out, many


@dataclass
class Model:
    """Of one language: for each order the n-grams, sorted, with their log-probabilities, and the contexts, sorted, with the logs of what they leave to the lower order."""

    keys: list[np.ndarray]
    logs: list[np.ndarray]
    contexts: list[np.ndarray]
    left: list[np.ndarray]

    @classmethod
    def of(cls, codes: np.ndarray, counts: np.ndarray) -> Model:
        """From the n-grams of the highest order. A lower order counts how many distinct n-grams of the next higher end in each of its own."""
        tables = [(codes, counts.astype(np.float64))]
        for k in range(ORDER - 1, 0, -1):
            keys, n = np.unique(tables[0][0] & ((1 << (BITS * k)) - 1), return_counts=True)
            tables.insert(0, (keys, n.astype(np.float64)))
        out = cls([], [], [], [])
        lower = None
        for k, (keys, n) in enumerate(tables):
            contexts, at = np.unique(keys >> BITS, return_inverse=True)
            total, kinds = np.bincount(at, n), np.bincount(at)
            left = DISCOUNT * kinds / total
            below = np.full(len(keys), 1 / (len(tables[0][0]) + 1)) if lower is None else np.exp(out.score(keys & ((1 << (BITS * k)) - 1), k))
            lower = np.maximum(n - DISCOUNT, 0) / total[at] + left[at] * below
            out.keys.append(keys)
            out.logs.append(np.log(lower))
            out.contexts.append(contexts)
            out.left.append(np.log(left))
        return out

    def score(self, codes: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Log-probabilities of the last characters of n-grams of an order, given the others."""
        out = np.full(len(codes), -np.log(len(self.keys[0]) + 1))
        for k in range(order):
            own = codes & ((1 << (BITS * (k + 1))) - 1)
            context = own >> BITS
            at = np.minimum(np.searchsorted(self.contexts[k], context), len(self.contexts[k]) - 1)
            out += np.where(self.contexts[k][at] == context, self.left[k][at], 0)
            at = np.minimum(np.searchsorted(self.keys[k], own), len(self.keys[k]) - 1)
            out = np.where(self.keys[k][at] == own, self.logs[k][at], out)
        return out


def gram_counts(rows: DataFrame) -> DataFrame:
    """(lang, code, n) over all rows of (text, lang). A task counts distinct words first, and sends each n-gram once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in slices(batches):
            langs = batch.column("lang").dictionary_encode()
            codes, words, many = letter_words(batch.column("text"))
            own, counts = grams(words)
            lang = np.repeat(np.asarray(langs.indices), many)
            for i, name in enumerate(langs.dictionary.to_pylist()):
                often = np.repeat(np.bincount(codes[lang == i], minlength=len(words)), counts)
                have = often > 0
                old = sums.get(name, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
                keys, at = np.unique(np.concatenate([old[0], own[have]]), return_inverse=True)
                sums[name] = keys, np.bincount(at, np.concatenate([old[1], often[have]]), len(keys)).astype(np.int64)
        for name, (keys, n) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(keys), pa.string()), pa.array(keys), pa.array(n)], names=["lang", "code", "n"])

    return mapped(rows.select("text", "lang"), count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))


@operator()
def learn(rows: DataFrame) -> dict[str, Model]:
    """The models of all languages of (text, lang), with every n-gram of all rows."""
    counts = saved(gram_counts(rows), "grams")
    return models(counts, [r["lang"] for r in counts.select("lang").distinct().collect()])  # a row for each language


def models(counts: DataFrame, names: list[str]) -> dict[str, Model]:
    """The models of some languages, in the order of their names, from one reading of the saved counts."""
    found = counts.where(F.col("lang").isin(names)).orderBy("lang", "code").toArrow()
    each = found["lang"].combine_chunks().dictionary_encode()
    lang, code, n = np.asarray(each.indices), found["code"].to_numpy(), found["n"].to_numpy()
    return {name: Model.of(code[lang == i], n[lang == i]) for i, name in sorted(enumerate(each.dictionary.to_pylist()), key=lambda x: x[1])}


def passes(sizes: dict[str, int], most: int) -> list[list[str]]:
    """Names, in order, in groups of at most `most` n-grams, or of one language that has more."""
    out: list[list[str]] = []
    room = 0
    for name in sorted(sizes):
        if not out or sizes[name] > room:
            out.append([])
            room = most
        out[-1].append(name)
        room -= sizes[name]
    return out


def cross_entropies(docs: DataFrame, models: dict[str, Model]) -> DataFrame:
    """docs, of which `text` is one column, with n_letters and, in the order of the models, the cross-entropies in nats a character after those that it has; text goes."""
    context = docs.sparkSession.sparkContext
    shared = context.broadcast(list(models.values()))
    others = [x for x in docs.columns if x not in ("text", "n_letters", "entropies")]
    more = "entropies" in docs.columns

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            codes, words, many = letter_words(batch.column("text"))
            own, counts = grams(words)
            keys, at = np.unique(own, return_inverse=True)
            starts = np.cumsum(counts) - counts
            doc = np.repeat(np.arange(len(many)), many)
            length = np.bincount(doc, counts[codes], len(many)) if len(codes) else np.zeros(len(many))
            each = list(np.asarray(batch.column("entropies").flatten()).reshape(len(many), -1).T) if more else []
            for model in shared.value:
                word = np.add.reduceat(model.score(keys)[at], starts) if len(own) else np.zeros(0)
                each.append(-np.bincount(doc, word[codes], len(many)) / np.maximum(length, 1))
            flat = np.stack(each, 1).reshape(-1) if each else np.zeros(0)
            entropies = pa.ListArray.from_arrays(pa.array(np.arange(len(many) + 1, dtype=np.int32) * len(each)), pa.array(flat))
            letters = pa.array((length - many).astype(np.int64))
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in others), letters, entropies], names=[*others, "n_letters", "entropies"])

    kinds = {x.name: x.dataType.simpleString() for x in docs.schema}
    return mapped(docs.select(*others, *["entropies"] * more, "text"), score, ", ".join([f"`{x}` {kinds[x]}" for x in others] + ["n_letters long", "entropies array<double>"]))


def likeliness(entropies: Column, sharpness: float) -> Column:
    """Of the lowest cross-entropy, against all others."""
    low = F.array_min(entropies)
    return 1 / F.aggregate(entropies, F.lit(0.0), lambda s, x: s + F.exp((low - x) * sharpness))


@operator()
def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score, cross_entropy, rejected, text_hash) of each row.

    A model for each language is learned from the texts of rows that aren't held out and have a language; none of
    language, id and other columns, whatever their names, is an input of a prediction. The language of the lowest
    length-normalised cross-entropy wins, ties by name. One text of FIT_EACH is kept from the counts: on these the
    temperature of the score, which is the winner's share, and the limits of rejection are fitted. A text is rejected if
    its cross-entropy is above its language's limit for texts as short or long: halfway between what the language's own calibrating rows have and
    what those of other languages would have if theirs weren't known, or more if REJECT_RATE asks for more. Null texts,
    and texts without letters, are `und` with score 0, and rejected. Texts are read whole, very long ones too. Without
    training rows all are `und`. Repeated rows are counted and scored row by row; rows without an id are scored, and
    learned from; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"), docs[lang_col].alias("lang"))
    rows = rows.withColumns({"held_out": held_out(F.col("doc_id")), "text_hash": F.xxhash64("text")})
    apart = F.pmod("text_hash", F.lit(FIT_EACH)) == 0
    counts = saved(gram_counts(rows.where(~apart & F.expr("not held_out and lang is not null and text is not null"))), "grams")
    sizes = {r["lang"]: r["count"] for r in counts.groupBy("lang").count().collect()}  # a row for each language
    groups = passes(sizes, MODEL_GRAMS)
    ordered = [x for group in groups for x in group]
    names = F.array(*[F.lit(x) for x in ordered]) if ordered else F.array().cast("array<string>")
    told = rows.withColumn("place", F.when(~F.col("held_out") & apart, F.array_position(names, F.col("lang")).cast("int"))).drop("lang")
    for i, group in enumerate(groups or [[]]):
        told = cross_entropies(told if i == 0 else told.join(rows.select("text", "text_hash").dropDuplicates(["text_hash"]), "text_hash"), models(counts, group))
        told = saved(told, "entropies")
    best = F.array_position("entropies", F.array_min("entropies")).cast("int")
    told = told.withColumns({"low": F.array_min("entropies"), "best": best}).withColumn("letters", (F.col("n_letters") > 0) & F.lit(bool(ordered)))
    known = told.where("place > 0 and letters")
    fits = {s: F.sum(F.log(F.greatest(F.lit(1e-12), F.when(F.col("place") == F.col("best"), likeliness(F.col("entropies"), s)).otherwise((1 - likeliness(F.col("entropies"), s)))))) for s in SHARPNESS}
    row = known.agg(*[x.alias(f"s{s}") for s, x in fits.items()]).first()
    sharp = max(SHARPNESS, key=lambda s: (row[f"s{s}"] if row[f"s{s}"] is not None else -np.inf, -s))
    limit = F.lit(float("inf"))
    for (place, long), value in limits(known).items():
        limit = F.when((F.col("best") == place) & ((F.col("n_letters") >= REJECT_LONG) == long), F.lit(value)).otherwise(limit)
    return told.select(
        "doc_id",
        "held_out",
        F.when(F.col("letters"), F.get(names, F.col("best") - 1)).otherwise("und").alias("lang_pred"),
        F.when(F.col("letters"), likeliness(F.col("entropies"), sharp)).otherwise(0.0).alias("score"),
        F.when(F.col("letters"), F.col("low")).alias("cross_entropy"),
        (~F.col("letters") | (F.col("n_letters") >= REJECT_LETTERS) & (F.col("low") > limit)).alias("rejected"),
        "text_hash",
    )


def limits(known: DataFrame) -> dict[tuple[int, bool], float]:
    """For each language's place, and for short and long texts, above which cross-entropy it rejects, from the calibrating rows (place, best, entropies, n_letters)."""
    some = known.where(F.col("n_letters") >= REJECT_LETTERS).withColumn("long", F.col("n_letters") >= REJECT_LONG)
    own = F.element_at("entropies", F.col("place"))
    others = F.transform("entropies", lambda x, i: F.when(i + 1 != F.col("place"), x))  # array_min leaves out nulls
    strange = F.array_min(others)
    right = some.where("place = best").groupBy("place", "long").agg(F.avg(own).alias("mean"), F.percentile_approx(own, F.lit(1 - REJECT_RATE), F.lit(100_000)).alias("high")).collect()
    wrong = some.groupBy(F.array_position(others, strange).cast("int").alias("best")).agg(F.avg(strange).alias("mean")).collect()
    between = {r["best"]: r["mean"] for r in wrong if r["best"]}
    return {(r["place"], r["long"]): max(r["high"] + REJECT_NATS, (r["mean"] + between[r["place"]]) / 2) for r in right if r["place"] in between}


@operator()
def accepted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs that aren't rejected, with all their columns. Rows with null texts go; an empty table stays empty."""
    gone = saved(identify(docs, id_col, text_col, lang_col).where("rejected").select("doc_id", "text_hash").distinct(), "rejected")
    same = docs[id_col].eqNullSafe(gone["doc_id"]) & (F.xxhash64(docs[text_col]) == gone["text_hash"])
    return docs.join(small(gone), same, "left_anti")
