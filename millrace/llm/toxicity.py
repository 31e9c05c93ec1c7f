"""Toxicity by class-conditional Kneser-Ney models of expressions, toxic against ordinary, over shared backoff counts."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from .common import mapped, operator, partitions, release, saved, slices, small, stored_bytes
from .words import held_out, letter_words

#: The model is broadcast whole if its tables take at most so many stored bytes; else it is joined to shares of the rows.
MODEL_BYTES = 64 << 20

#: Stored bytes of rows in a share.
SHARE_BYTES = 16 << 20

#: Bound of the scored rows to which the logistic curve is fitted, and of how many training texts one is kept for it.
FIT_ROWS, FIT_EACH = 20_000, 8

#: Words of a passage. A document is as toxic as its most toxic passage, whatever its length.
PASSAGE = 3

#: A document counts as toxic from this score on.
LIMIT = 0.3

#: A word of more letters backs off to its first ones.
STEM = 4

#: The classes, as columns of counts.
CLASSES = ("toxic", "ordinary")

WORDS, PAIRS = "word string, number long, ratio double", "pair long, ratio double"


def stems(words: pa.Array) -> pa.Array:
    """The first letters of words, with a mark that no word has; null for words that aren't longer."""
    cut = pc.binary_join_element_wise(pc.utf8_slice_codeunits(words, 0, STEM), "*", "")
    return pc.if_else(pc.greater(pc.utf8_length(words), STEM), cut, pa.scalar(None, pa.string()))


@dataclass
class Unseen:
    """What an unseen pair adds to its word's log-ratio, an unseen word to its stem's, and an unseen stem's log-ratio."""

    pair: float = 0.0
    word: float = 0.0
    stem: float = 0.0


@dataclass
class Model:
    """Log-ratios, toxic over ordinary: of words and stems, with the numbers of words, 0 for stems; and of pairs, sorted by number << 32 | number. All of them, or those that a share of the rows holds."""

    words: pa.Array
    number: np.ndarray
    word: np.ndarray
    pairs: np.ndarray
    pair: np.ndarray
    unseen: Unseen

    def of_words(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of words, -1 for unknown ones, and their log-ratios."""
        own, cut = np.asarray(pc.index_in(distinct, value_set=self.words).fill_null(-1), dtype=np.int64), stems(distinct)
        stem = np.asarray(pc.index_in(cut, value_set=self.words).fill_null(-1), dtype=np.int64)
        number, word = np.append(self.number, -1), np.append(self.word, self.unseen.stem)
        stem = np.where(np.asarray(cut.is_valid()), word[stem], 0.0)
        return number[own], np.where(own >= 0, word[own], self.unseen.word + stem)

    def tokens(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each word of the texts its log-ratio without the one before it, and the pair that both are, -1 for unknown ones; and each text's number of words. A text's first word follows number 0."""
        codes, distinct, many = letter_words(texts)
        number, ratio = self.of_words(distinct)
        here = number[codes]
        before = np.roll(here, 1)
        before[(np.cumsum(many) - many)[many > 0]] = 0
        return ratio[codes], np.where((here > 0) & (before >= 0), before << 32 | here, -1), many

    def passages(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text the largest length-normalised log-ratio of its passages, that of the whole text, and its number of words."""
        ratio, pair, many = self.tokens(texts)
        own = np.full(len(pair), self.unseen.pair)
        if len(self.pairs):
            at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            found = self.pairs[at] == pair
            own, ratio = np.where(found, self.pair[at], own), np.where(found, 0.0, ratio)
        sums = np.append(0.0, np.cumsum(own + ratio))
        ends = np.cumsum(many)
        some = np.flatnonzero(many)
        top, mean = np.zeros(len(many)), np.zeros(len(many))
        if len(some):
            mean[some] = (sums[ends[some]] - sums[ends[some] - many[some]]) / many[some]
            # each word ends a passage, which reaches back to the text's first word at most
            of = np.repeat(np.arange(len(many)), many)
            last = np.arange(1, len(of) + 1)
            first = np.maximum(last - PASSAGE, (ends - many)[of])
            whole = (last - first == np.minimum(PASSAGE, many[of]))
            each = np.where(whole, (sums[last] - sums[first]) / (last - first), -np.inf)
            top[some] = np.maximum.reduceat(each, (ends - many)[some])
        return top, mean, many


def model(words: pa.Table | None, pairs: pa.Table | None, unseen: Unseen) -> Model:
    """The model of rows of the tables of words and of pairs, which may repeat."""
    names = words["word"].combine_chunks() if words else pa.array([], pa.string())
    coded = names.dictionary_encode()
    at = np.unique(np.asarray(coded.indices), return_index=True)[1]
    number, ratio = (np.asarray(words[k])[at] if words else np.zeros(0) for k in ("number", "ratio"))
    pair, of = np.unique(np.asarray(pairs["pair"]) if pairs else np.zeros(0, np.int64), return_index=True)
    return Model(coded.dictionary, number.astype(np.int64), ratio, pair, np.asarray(pairs["ratio"])[of] if pairs else np.zeros(0), unseen)


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, toxic, ordinary): how often each word occurs in either class."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=16 << 20):
            codes, words, many = letter_words(batch.column("text"))
            toxic = np.repeat(np.asarray(batch.column("toxic")), many)
            yield pa.RecordBatch.from_arrays([words, *(pa.array(np.bincount(codes[toxic == c], minlength=len(words)).astype(np.int64)) for c in (1, 0))], names=["word", *CLASSES])

    return mapped(rows.select("text", "toxic"), count, "word string, toxic long, ordinary long").groupBy("word").agg(*(F.sum(c).alias(c) for c in CLASSES))


def shared_out(rows: DataFrame, n: int) -> DataFrame:
    """rows with the share, of n, that each belongs to."""
    return rows.withColumn("share", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int"))


def beside(rows: DataFrame, n: int, words: DataFrame, pairs: DataFrame | None, unseen: Unseen, use: Callable[[Model, pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """use(model, rows) for slices of rows, of n shares, with the part of the model that their share needs.

    words and pairs are joined by shuffling to the distinct words and pairs of each share; what is found comes before
    the rows of its share. A worker holds that and a slice.
    """

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=16 << 20):
            share = np.asarray(batch.column("share"))
            for x in np.unique(share):
                _, found, _ = letter_words(batch.column("text").filter(pa.array(share == x)))
                named = pa.chunked_array([found, stems(found).drop_null()]).unique()
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(named), x, np.int32)), named], names=["share", "word"])

    def needs(model: Model, batch: pa.RecordBatch) -> pa.RecordBatch:
        pair = np.unique(model.tokens(batch.column("text"))[1])
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(pair), np.asarray(batch.column("share"))[0], np.int32)), pa.array(pair)], names=["share", "pair"])

    def gathered(found: DataFrame) -> DataFrame:
        return found.groupBy("share").agg(*(F.collect_list(c).alias(f"look_{c}") for c in found.columns if c != "share"))

    def streamed(look: DataFrame, use: Callable, schema: str) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, held = None, model(None, None, unseen)
            for batch in slices(batches):
                share, looks = np.asarray(batch.column("share")), np.asarray(batch.column("looks"))
                for x in share[np.append(True, share[1:] != share[:-1])]:
                    if x != at:
                        at, held = x, model(None, None, unseen)
                    for i in np.flatnonzero((share == x) & looks):
                        row = {k: batch.column(f"look_{k}").slice(i, 1).flatten() for k in ("word", "number", "ratio", "pair", "pair_ratio")}
                        held = model(pa.table({k: row[k] for k in ("word", "number", "ratio")}), pa.table({"pair": row["pair"], "ratio": row["pair_ratio"]}), unseen)
                    rest = batch.filter(pa.array((share == x) & ~looks))
                    if rest.num_rows:
                        yield use(held, rest)

        both = rows.withColumn("looks", F.lit(False)).unionByName(look.withColumn("looks", F.lit(True)), allowMissingColumns=True)
        return mapped(both.repartition(n, "share").sortWithinPartitions("share", F.desc("looks")), run, schema)

    held = mapped(rows.select("share", "text").repartition(n, "share"), hold, "share int, word string")
    look = saved(gathered(held.join(words, "word")), "look_words")
    alone = look.withColumns({"look_pair": F.array().cast("array<bigint>"), "look_pair_ratio": F.array().cast("array<double>")})
    if pairs is None:
        return streamed(alone, use, schema)
    wanted = streamed(alone, needs, "share int, pair long")
    found = saved(gathered(wanted.join(pairs.withColumnRenamed("ratio", "pair_ratio"), "pair")), "look_pairs")
    return streamed(look.join(found, "share", "full"), use, schema)


def by_model(rows: DataFrame, n: int, words: DataFrame, pairs: DataFrame | None, unseen: Unseen, use: Callable[[Model, pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """use(model, rows) for slices of rows: by broadcast if the model's tables are small, else share by share."""
    if sum(stored_bytes(x) for x in (words, pairs) if x is not None) > MODEL_BYTES:
        return beside(shared_out(rows, n), n, words, pairs, unseen, use, schema)
    shared = rows.sparkSession.sparkContext.broadcast(model(words.toArrow(), pairs.toArrow() if pairs is not None else None, unseen))
    release()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield use(shared.value, batch)

    return mapped(rows, run, schema)


def pair_counts(rows: DataFrame, n: int, words: DataFrame) -> DataFrame:
    """(pair, toxic, ordinary): how often each pair of listed words occurs in either class."""

    def count(model: Model, batch: pa.RecordBatch) -> pa.RecordBatch:
        _, pair, many = model.tokens(batch.column("text"))
        toxic = np.repeat(np.asarray(batch.column("toxic")), many)[pair >= 0]
        pairs, at = np.unique(pair[pair >= 0], return_inverse=True)
        return pa.RecordBatch.from_arrays([pa.array(pairs), *(pa.array(np.bincount(at, toxic == k, len(pairs)).astype(np.int64)) for k in (1, 0))], names=["pair", *CLASSES])

    found = by_model(rows.select("doc_id", "text", "toxic"), n, words, None, Unseen(), count, "pair long, toxic long, ordinary long")
    return found.groupBy("pair").agg(*(F.sum(c).alias(c) for c in CLASSES))


@dataclass
class Order:
    """Of one class and order: the sum of its counts, and what is taken from counts of 1, of 2, and of more."""

    total: int
    discounts: tuple[float, float, float]
    left: float

    @classmethod
    def of(cls, row: Row, name: str, total: int | None = None, alone: bool = True) -> Order:
        """From how many counts are 1, 2, 3, 4 and the sum of all: each discount is what counts of that size fall short of by, when one occurrence is left out. Unless they stand alone, counts of 1 have nothing left; with a total given, the counts of 1 are what it has beyond the others."""
        n = [row[f"{name}_{k}"] for k in (1, 2, 3, 4)]
        rest, kinds = row[f"{name}_sum"] or 0, row[f"{name}_more"]
        if total is not None:
            n[0] = total - (rest - n[0])
            rest = total
        y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
        d = [min(float(k), max(0.0, k - (k + 1) * y * n[k] / n[k - 1])) if n[k - 1] else k * y for k in (1, 2, 3)]
        if not alone:
            d[0] = 1.0
        left = (d[0] * n[0] + d[1] * n[1] + d[2] * kinds) / max(rest, 1)
        return cls(rest, tuple(d), min(1.0, max(left, 1e-6)))

    def own(self, n: Column) -> Column:
        """The probability that a count has by itself, after the discount."""
        a, b, c = self.discounts
        return F.greatest(F.lit(0.0), n - F.when(n >= 3, c).when(n == 2, b).otherwise(a)) / float(max(self.total, 1))


def counted(df: DataFrame) -> Row:
    """Of both classes, how many counts are 1, 2, 3, 4 and 3 or more, and the sum of all."""
    each = [F.count_if(F.col(c) == k).alias(f"{c}_{k}") for c in CLASSES for k in (1, 2, 3, 4)]
    return df.agg(*each, *(F.count_if(F.col(c) >= 3).alias(f"{c}_more") for c in CLASSES), *(F.sum(c).alias(f"{c}_sum") for c in CLASSES)).first()


def kinds() -> Column:
    """In how many classes something occurs."""
    return (F.col("toxic") > 0).cast("int") + (F.col("ordinary") > 0).cast("int")


def some_left() -> Column:
    """Whether a count is above 1 in either class; others have no probability of their own."""
    return (F.col("toxic") > 1) | (F.col("ordinary") > 1)


def log_ratio() -> Column:
    return F.log(F.col("p_toxic") / F.col("p_ordinary"))


def learn(rows: DataFrame, n: int) -> tuple[DataFrame, DataFrame, Unseen]:
    """The model of (doc_id, text, toxic), of n shares: (word, number, ratio) of words and stems, (pair, ratio), and what is unseen.

    Interpolated Kneser-Ney with the class as the context. A class c gives

        a pair v w   [n(c, v w) - D] / N(c) + left(c) P(c, w) n(v w) / n(w)
        a word w     [n(c, w) - D] / N(c) + left(c) P(c, its stem) k(w) / (k of all words of that stem)
        a stem s     [m(c, s) - D] / M(c) + left(c) k(s) / (k of all stems, and words without one)

    n counts occurrences, in the class or in both; m(c, s) counts the distinct words of the class that have the stem;
    k counts the classes in which something occurs, and is shared by both, as are n(v w) and n(w). Words without a stem
    back off to their own k. D are discounts for counts of 1, 2 and more, from the counts of counts of their class and
    order; a single occurrence of a word or pair has nothing left. So what occurs once at most in either class has the
    ratio of what is unseen, and needs no row: nothing else is left out, and there is no bound.
    """
    words = saved(word_counts(rows), "words")
    stem = F.when(F.char_length("word") > STEM, F.concat(F.substring("word", 1, STEM), F.lit("*")))
    words = words.withColumn("stem", stem)
    heads = words.where("stem is not null").groupBy("stem").agg(*(F.count_if(F.col(c) > 0).alias(c) for c in CLASSES), F.sum(kinds()).alias("below"))
    heads = saved(heads, "stems")
    each, above = counted(words), counted(heads)
    word = {c: Order.of(each, c, alone=False) for c in CLASSES}
    head = {c: Order.of(above, c) for c in CLASSES}
    roots = (heads.agg(F.sum(kinds())).first()[0] or 0) + (words.where("stem is null").agg(F.sum(kinds())).first()[0] or 0)
    shared = kinds() / F.lit(float(max(roots, 1)))
    heads = saved(heads.withColumns({f"p_{c}": head[c].own(F.col(c)) + head[c].left * shared for c in CLASSES}), "stem_shares")
    back = heads.select("stem", "below", *(F.col(f"p_{c}").alias(f"back_{c}") for c in CLASSES))
    listed = words.where(some_left()).join(small(back), "stem", "left")
    listed = listed.withColumns({f"p_{c}": word[c].own(F.col(c)) + word[c].left * F.coalesce(F.col(f"back_{c}") * kinds() / F.col("below"), shared) for c in CLASSES})
    listed = saved(listed.select("word", *CLASSES, "p_toxic", "p_ordinary").orderBy("word").withColumn("at", F.monotonically_increasing_id()), "listed")
    # numbers without gaps: a row for each partition
    part, first, at = F.shiftright("at", 33), 1, []
    for r in listed.groupBy(part.alias("part")).count().orderBy("part").collect():
        at.append((r["part"], first))
        first += r["count"]
    if first >= 1 << 31:
        raise ValueError("more words than 31 bits number")
    starts = rows.sparkSession.createDataFrame(at, "part long, first long")
    numbered = listed.withColumn("part", part.cast("long")).join(F.broadcast(starts), "part").withColumn("number", F.col("first") + F.col("at").bitwiseAND((1 << 33) - 1))
    numbered = saved(numbered.select("number", "word", (F.col("toxic") + F.col("ordinary")).alias("n"), "p_toxic", "p_ordinary"), "numbers")
    pairs = saved(pair_counts(rows, n, numbered.select("word", "number", F.lit(0.0).alias("ratio"))).where(some_left()), "pairs", "lz4")
    often = counted(pairs)
    pair = {c: Order.of(often, c, word[c].total, alone=False) for c in CLASSES}
    tails = numbered.select("number", "n", *(F.col(f"p_{c}").alias(f"back_{c}") for c in CLASSES))
    scored = pairs.withColumn("number", F.col("pair").bitwiseAND(0xFFFFFFFF)).join(small(tails), "number")
    scored = scored.withColumns({f"p_{c}": pair[c].own(F.col(c)) + pair[c].left * F.col(f"back_{c}") * (F.col("toxic") + F.col("ordinary")) / F.col("n") for c in CLASSES})
    unseen = Unseen(*(float(np.log(x["toxic"].left / x["ordinary"].left)) for x in (pair, word, head)))
    told = numbered.select("word", "number", log_ratio().alias("ratio")).unionByName(heads.select(F.col("stem").alias("word"), F.lit(0).cast("long").alias("number"), log_ratio().alias("ratio")))
    return saved(told, "ratios"), saved(scored.select("pair", log_ratio().alias("ratio")), "pair_ratios"), unseen


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 50, ridge: float = 1e-2) -> tuple[float, float]:
    """Slope and intercept of a logistic curve, by Newton's method; a slope below 0 counts as 0."""
    z, weights = np.column_stack([x, np.ones(len(x))]), np.zeros(2)
    hold = np.diag([ridge, 1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ weights, -30, 30)))
        step = np.linalg.solve(z.T @ (z * np.maximum(p * (1 - p), 1e-9)[:, None]) + hold, z.T @ (y - p) - hold @ weights)
        weights += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return max(0.0, float(weights[0])), float(weights[1])


@operator()
def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted, log_ratio, mean_log_ratio, n_letter_words) of each row.

    log_ratio is the largest length-normalised log-likelihood ratio, toxic over ordinary, of a row's passages of PASSAGE
    words (of its whole text, if that is shorter), mean_log_ratio that of its whole text. score is log_ratio alone under
    a logistic curve, fitted to at most fit_rows texts that were kept from the counts: one training text of FIT_EACH.
    Where these lack a class, score is the chance that the training rows' odds and the passage's likelihoods give.

    Learned from the rows that labels marks 0 or 1 and that aren't held out; equal texts are learned from once, as
    toxic if any is. Neither labels nor other columns are inputs of a score, and columns of other names, whatever these
    are, change nothing. Texts are scored whole, very long ones too. Null texts and texts without letters get the share
    of toxic training rows, or 0 without any; so do all rows if a class has no training row that is counted. Labels that
    repeat for a doc_id count as their largest; rows of one doc_id share its label; repeated rows are scored row by
    row; rows without an id have no label. An empty table gives an empty result. Counts are taken over all training
    rows and grow with them.
    """
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text")).withColumn("held_out", held_out(F.col("doc_id")))
    marks = saved(labels.select(labels[id_col].cast("long").alias("doc_id"), labels[label_col].cast("int").alias("toxic")).where("toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "marks")
    marked = rows.where("not held_out").join(small(marks), "doc_id").withColumn("key", F.xxhash64("text"))
    each = marked.select("key", "doc_id", "toxic").groupBy("key", "doc_id").agg(F.max("toxic").alias("toxic"), F.count("*").alias("n"))
    first = saved(each.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic"), F.max("n").alias("most")), "firsts")
    apart = F.pmod("key", F.lit(FIT_EACH)) == 0
    train = rows.where("not held_out").withColumn("key", F.xxhash64("text")).join(small(first.where(~apart)), ["key", "doc_id"])
    if not first.where(~apart & (F.col("most") > 1)).isEmpty():  # only texts of rows that may repeat move
        train = train.where("most = 1").unionByName(train.where("most > 1").dropDuplicates(["doc_id", "text"]))
    train = train.select("doc_id", "text", "toxic")
    classes = {r["toxic"]: r["count"] for r in first.groupBy("toxic").count().collect()}
    usual = classes.get(1, 0) / max(1, sum(classes.values()))
    counts = {r["toxic"] for r in first.where(~apart).select("toxic").distinct().collect()}
    nothing = rows.select("doc_id", "held_out", F.lit(usual).alias("score"), F.lit(int(usual >= LIMIT)).alias("predicted"), F.lit(0.0).alias("log_ratio"), F.lit(0.0).alias("mean_log_ratio"), F.lit(0).cast("long").alias("n_letter_words"))
    if len(counts) < 2:
        return nothing
    n = partitions(rows, SHARE_BYTES)
    words, pairs, unseen = learn(train, n)

    def score(model: Model, batch: pa.RecordBatch) -> pa.RecordBatch:
        top, mean, many = model.passages(batch.column("text"))
        return pa.RecordBatch.from_arrays([*(batch.column(x) for x in ("doc_id", "key", "held_out")), pa.array(top), pa.array(mean), pa.array(many)], names=["doc_id", "key", "held_out", "top", "mean", "many"])

    told = saved(by_model(rows.withColumn("key", F.xxhash64("text")), n, words, pairs, unseen, score, "doc_id long, key long, held_out boolean, top double, mean double, many long"), "scores")
    kept = told.where("not held_out and many > 0").join(small(first.where(apart).drop("most")), ["doc_id", "key"]).groupBy("key").agg(F.min("top").alias("top"), F.max("toxic").alias("toxic"))
    some = kept.orderBy(F.xxhash64("key"), "key").limit(fit_rows).toPandas()
    if some["toxic"].nunique() < 2:
        slope, start = float(PASSAGE), float(np.log(max(usual, 1e-6) / max(1 - usual, 1e-6)))
    else:
        slope, start = fit(some["top"].to_numpy(np.float64), some["toxic"].to_numpy(np.float64))
    chance = F.when(F.col("many") > 0, 1 / (1 + F.exp(-(F.col("top") * slope + start)))).otherwise(usual)
    return told.select("doc_id", "held_out", chance.alias("score"), (chance >= LIMIT).cast("int").alias("predicted"), F.col("top").alias("log_ratio"), F.col("mean").alias("mean_log_ratio"), F.col("many").alias("n_letter_words"))
