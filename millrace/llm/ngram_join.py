"""Documents whose sets of word n-grams have a Jaccard similarity of a threshold or more, by MinHash bands."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import mapped, mixed, operator, partitions, pick, rows_a_batch, saved, slices, small
from .components import components

#: Words of an n-gram; the similarity from which on documents are linked, as a fraction.
WORDS, SIMILAR = 5, (4, 5)

#: The share of links that the bands find, and the most hashes they may take for it.
RECALL, MOST_HASHES = 0.99999, 128

#: Shares of equal hashes below this aren't verified; for a link that is five standard deviations off.
ESTIMATE = 0.55

#: Rows of a bucket, or of a group of candidates, that are compared as one block; larger ones are dealt into pairs of blocks.
BUCKET_BLOCK, GROUP_BLOCK = 512, 256

#: Steps of distance to a group's head, over all distances.
STEPS = 100

#: Distinct n-grams in a column block of the verification.
COLUMNS = 4096

#: Stored bytes of sketches for each partition of buckets and groups.
SKETCH_BYTES = 16 << 20

GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def bands_and_rows(similar: float, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """As many rows a band as possible, and bands enough that a link shares one with probability `recall`."""
    for rows in range(most, 0, -1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - similar**rows)) if similar < 1 else 1
        if bands * rows <= most:
            return bands, rows
    raise ValueError("no bands reach that recall")


def gram_sets(texts: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its n-grams. A text of fewer words has one n-gram of them all, one of none has none."""
    cut = pc.split_pattern_regex(pc.ascii_lower(texts.fill_null("")), GAP)
    flat = cut.flatten()
    full = np.asarray(pc.binary_length(flat)) > 0
    many = np.asarray(pc.list_value_length(cut), dtype=np.int64)
    many = np.bincount(np.repeat(np.arange(len(many)), many)[full], minlength=len(many))
    coded = pc.dictionary_encode(flat.filter(pa.array(full)))
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    hashes = each[np.asarray(coded.indices)]
    ends = np.cumsum(many)
    n = len(hashes)
    padded = np.concatenate([hashes, np.zeros(words, np.uint64)])
    rest = np.repeat(ends, many) - np.arange(n)  # words from here to the text's end
    grams = np.zeros(n, np.uint64)
    for k in range(words):
        grams = grams * np.uint64(0x9E3779B97F4A7C15) + np.where(rest > k, padded[k : n + k], np.uint64(0))
    grams = mixed(grams)
    return [np.unique(grams[b - m : max(b - words + 1, b - m + 1)]) if m else grams[:0] for b, m in zip(ends.tolist(), many.tolist(), strict=True)]


def digest(grams: np.ndarray) -> bytes:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()


def sketch(grams: np.ndarray, factors: np.ndarray, adds: np.ndarray) -> np.ndarray:
    """The least hash of the set under each of the permutations of 32 bits."""
    low = (grams >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(factors), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), 2048):  # so that what is multiplied stays in the cache
        out = np.minimum(out, (low[None, i : i + 2048] * factors[:, None] + adds[:, None]).min(1))
    return out


def permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    own = mixed(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (own[:n] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (own[n:] >> np.uint64(32)).astype(np.uint32)


def sketches(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, row, n, key, sig, bands): the text's hash, the set's size and digest, 16 bits of each least hash, a hash of each band."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors, adds = permutations(bands * rows)
        salt = mixed(np.arange(1, bands + 1, dtype=np.uint64))
        for batch in slices(batches):
            sets = gram_sets(batch.column("text"), words)
            least = np.stack([sketch(x, factors, adds) for x in sets]).astype(np.uint64)
            each = np.tile(salt, (len(sets), 1))
            for k in range(rows):
                each = mixed(each ^ least[:, k::rows])
            sig = least.astype("<u2")
            buckets = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * bands), pa.array(each.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row"), pa.array([len(x) for x in sets], pa.int64()), pa.array([digest(x) for x in sets], pa.binary()), pa.array([x.tobytes() for x in sig], pa.binary()), buckets],
                names=["doc_id", "row", "n", "key", "sig", "bands"],
            )

    return mapped(docs, make, "doc_id long, row long, n long, key binary, sig binary, bands array<long>")


def in_groups(rows: DataFrame, size: int, block: int, *keys: str) -> DataFrame:
    """Rows of groups of known sizes (column members), dealt into tasks (…keys, i, j) of about two blocks at most.

    A group of up to `block` rows is one task. A larger one is dealt by hash into blocks, and each row goes to the tasks
    of its block with every other; `side` says which of the two it is in. So no task gets more, however hot a group is,
    and every two rows of a group meet in exactly one task.
    """
    blocks = F.ceil(F.col("members") / block).cast("int")
    own = F.pmod(F.xxhash64(*keys, "cid"), F.col("blocks")).cast("int")
    rows = rows.withColumn("blocks", blocks).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other"), "side": (F.col("own") > F.col("other")).cast("int")}).drop("blocks", "own", "other", "members")
    return rows.repartition(size, *keys, "i", "j").sortWithinPartitions(*keys, "i", "j")


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str], least: int = 4096, most_bytes: int = 32 << 20) -> Iterator[tuple[pa.Table, list[tuple[int, int]]]]:
    """Whole groups of rows that come sorted by keys: a table, and where in it each group begins and ends."""
    held: list[pa.RecordBatch] = []

    def cut(last: bool) -> Iterator[tuple[pa.Table, list[tuple[int, int]]]]:
        nonlocal held
        table = pa.Table.from_batches(held).combine_chunks()
        new = np.zeros(table.num_rows, bool)
        new[:1] = True
        for k in keys:
            x = table.column(k).to_numpy()
            new[1:] |= x[1:] != x[:-1]
        starts = np.flatnonzero(new).tolist()
        ends = [*starts[1:], table.num_rows]
        whole = list(zip(starts, ends, strict=True))[: None if last else -1]
        if whole:
            yield table, whole
            held = [] if last else table.slice(starts[-1]).to_batches()

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            if sum(x.num_rows for x in held) >= least or sum(x.nbytes for x in held) >= most_bytes:
                yield from cut(False)
    if held:
        yield from cut(True)


def forest(near: np.ndarray) -> list[tuple[int, int]]:
    """(node, root) of all nodes of a symmetric matrix of links, but for roots: the first node that it is linked to."""
    out, left = [], np.ones(len(near), bool)
    while left.any():
        root = int(np.argmax(left))
        own = np.zeros(len(near), bool)
        own[root] = True
        new = own
        while new.any():
            new = near[new].any(0) & ~own
            own = own | new
        left &= ~own
        out += [(int(x), root) for x in np.flatnonzero(own) if x != root]
    return out


def compare(batches: Iterator[pa.RecordBatch], keys: list[str], similar: Callable[[pa.Table], np.ndarray], counts: bool) -> Iterator[pa.RecordBatch]:
    """For each task the forest of its links as (cid, root), and if asked each row's number of linked classes and documents."""
    for table, groups in grouped(batches, keys):
        cid, side = table.column("cid").to_numpy(), table.column("side").to_numpy()
        i, j = table.column("i").to_numpy(), table.column("j").to_numpy()
        size = table.column("size").to_numpy() if counts else None
        nodes, roots, rows, classes, docs = [], [], [], [], []
        for a, b in groups:
            own, at = np.unique(cid[a:b], return_index=True)  # of repeated rows more than one may come
            if len(own) < 2:
                continue
            at += a
            near = similar(table.slice(a, b - a) if len(own) == b - a and (np.diff(at) > 0).all() else table.take(at))
            if i[a] != j[a]:
                near &= side[at, None] != side[None, at]
            np.fill_diagonal(near, False)
            for x, r in forest(near):
                nodes.append(own[x])
                roots.append(own[r])
            if counts:
                linked = near.sum(1)
                some = np.flatnonzero(linked)
                rows.append(own[some])
                classes.append(linked[some])
                docs.append((near[some] @ size[at]).astype(np.int64))
        if counts:
            flat = [np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for x in (rows, classes, docs)]
            none = len(flat[0])
            columns = [np.append(nodes, flat[0]).astype(np.int64), pa.concat_arrays([pa.array(roots, pa.int64()), pa.nulls(none, pa.int64())]), np.append(np.zeros(len(nodes), np.int64), flat[1]), np.append(np.zeros(len(nodes), np.int64), flat[2])]
            yield pa.RecordBatch.from_arrays([pa.array(x) if isinstance(x, np.ndarray) else x for x in columns], names=["u", "v", "classes", "docs"])
        else:
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(roots, pa.int64())], names=["u", "v"])


def across(few: DataFrame, many: DataFrame, block: int, size: int, key: str) -> DataFrame:
    """Rows of few and many, of groups of known sizes in both (columns n_few, n_many), dealt into tasks (key, i, j) of about two blocks, in one of which each of few meets each of many."""
    own = lambda n: F.pmod(F.xxhash64(key, "cid"), F.ceil(F.col(n) / block)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.ceil(F.col(n) / block).cast("int") - 1))
    left = few.withColumns({"i": own("n_few"), "side": F.lit(0)}).withColumn("j", every("n_many"))
    right = many.withColumns({"j": own("n_many"), "side": F.lit(1)}).withColumn("i", every("n_few"))
    both = left.unionByName(right).withColumn("j", -1 - F.col("j")).drop("n_few", "n_many")  # never equal to i
    return both.repartition(size, key, "i", "j").sortWithinPartitions(key, "i", "j")


def candidates(classes: DataFrame, hashes: int, size: int) -> DataFrame:
    """(u, v): a forest of the classes that share a bucket and look alike there.

    In a bucket of more than a block all classes are held against its head, the one with the least cid, first. Those
    that look like it are linked by that; only the others still meet each other, and those. So a bucket of near copies
    costs as much as it has rows.
    """
    slim = classes.select("cid", F.explode("bands").alias("bucket"))
    full = slim.groupBy("bucket").agg(F.count("*").alias("members"), F.min("cid").alias("head")).where("members > 1")
    full = saved(full, "buckets", "lz4")
    sigs = classes.select("cid", "sig")
    least = math.ceil(ESTIMATE * hashes)

    def alike(table: pa.Table) -> np.ndarray:
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), "<u2").reshape(table.num_rows, -1)
        return np.concatenate([(sig[k : k + 32, None, :] == sig[None, :, :]).sum(2) >= least for k in range(0, len(sig), 32)])

    def like_head(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sig, head = (np.frombuffer(b"".join(batch.column(x).to_pylist()), "<u2").reshape(batch.num_rows, -1) for x in ("sig", "head_sig"))
                near = (sig == head).sum(1) >= least
                yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in ("bucket", "cid", "head", "members")), pa.array(near)], names=["bucket", "cid", "head", "members", "near"])

    def forests(rows: DataFrame) -> DataFrame:
        return mapped(rows, lambda x: compare(x, ["bucket", "i", "j"], alike, False), "u long, v long")

    usual = slim.join(full.where(F.col("members") <= BUCKET_BLOCK).drop("head"), "bucket").join(sigs, "cid")
    out = forests(in_groups(usual, size, BUCKET_BLOCK, "bucket"))
    large = full.where(F.col("members") > BUCKET_BLOCK)
    if large.isEmpty():
        return out
    heads = saved(large.join(sigs.withColumnRenamed("cid", "head"), "head").select("bucket", "head", "members", F.col("sig").alias("head_sig")), "heads", "lz4")
    told = saved(mapped(slim.join(small(heads), "bucket").join(sigs, "cid"), like_head, "bucket long, cid long, head long, members long, near boolean"), "told", "lz4")
    out = out.unionByName(told.where("near and cid != head").select(F.col("cid").alias("u"), F.col("head").alias("v")))
    far = saved(told.where("not near").groupBy("bucket").agg(F.count("*").alias("n_few"), (F.first("members") - F.count("*")).alias("n_many")), "far", "lz4")
    if far.isEmpty():
        return out
    rest = told.join(small(far), "bucket").join(sigs, "cid").select("bucket", "cid", "sig", "near", "n_few", "n_many")
    apart = rest.where("not near").select("bucket", "cid", "sig", F.col("n_few").alias("members"))
    out = out.unionByName(forests(in_groups(apart, size, BUCKET_BLOCK, "bucket")))
    return out.unionByName(forests(across(rest.where("not near").drop("near"), rest.where("near").drop("near"), BUCKET_BLOCK, size, "bucket")))


def similar_sets(sets: list[np.ndarray], similar: tuple[int, int] = SIMILAR) -> np.ndarray:
    """Which of the sets have that Jaccard similarity, exactly: common n-grams are counted by products of column blocks."""
    n = np.array([len(x) for x in sets], np.int64)
    common = np.zeros((len(sets), len(sets)), np.int64)
    grams, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), n)
    shared = np.bincount(column, minlength=len(grams)) > 1
    place = np.cumsum(shared) - 1
    keep = shared[column]
    row, column = row[keep], place[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    total = int(shared.sum())
    for k in range(0, total, COLUMNS):
        a, b = np.searchsorted(column, [k, k + COLUMNS])
        block = np.zeros((len(sets), min(COLUMNS, total - k)), np.float32)
        block[row[a:b], column[a:b] - k] = 1
        common += np.rint(block @ block.T).astype(np.int64)
    return common * similar[1] >= (n[:, None] + n[None, :] - common) * similar[0]


def verified(docs: DataFrame, wanted: DataFrame, words: int, similar: tuple[int, int], size: int) -> DataFrame:
    """(u, v, classes, docs): links of the wanted classes (cid, doc_id, row, key, size, comp, members) on their full sets, as a forest with null counts, and each class's counts with a null v."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()  # a task sends a class once, however often its row is repeated
        for batch in slices(batches):
            own = gram_sets(batch.column("text"), words)
            right = [digest(x) == k for x, k in zip(own, batch.column("key").to_pylist(), strict=True)]
            for n, cid in enumerate(batch.column("cid").to_pylist()):
                right[n] = right[n] and cid not in sent
                if right[n]:
                    sent.add(cid)
            right = pa.array(right, pa.bool_())
            columns = [batch.column(x) for x in ("cid", "size", "comp", "members")] + [pa.array([x.tobytes() for x in own], pa.binary())]
            yield pa.RecordBatch.from_arrays([x.filter(right) for x in columns], names=["cid", "size", "comp", "members", "grams"])

    def texts(some: DataFrame) -> DataFrame:
        own, of = docs.alias("d"), small(some).alias("w")
        same = (F.col("d.row") == F.col("w.row")) & F.col("d.doc_id").eqNullSafe(F.col("w.doc_id"))
        return mapped(own.join(of, same).select("d.text", "w.*"), sets, "cid long, size long, comp long, members long, grams binary")

    exact = lambda table: similar_sets([np.frombuffer(x, np.uint64) for x in table.column("grams").to_pylist()], similar)
    counted = lambda rows: mapped(rows, lambda x: compare(x, ["comp", "i", "j"], exact, True), "u long, v long, classes long, docs long")
    large = wanted.where(F.col("members") > GROUP_BLOCK)
    if large.isEmpty():
        return counted(in_groups(texts(wanted), size, GROUP_BLOCK, "comp"))
    usual = saved(wanted.where(F.col("members") <= GROUP_BLOCK), "usual", "lz4")
    near, rest = by_distance(saved(texts(saved(large, "large", "lz4")), "sets"), similar, size)
    return counted(in_groups(texts(usual), size, GROUP_BLOCK, "comp")).unionByName(near).unionByName(counted(rest))


def by_distance(sets: DataFrame, similar: tuple[int, int], size: int) -> tuple[DataFrame, DataFrame]:
    """For the saved sets of large groups: the links that distances to a head make certain, as verified gives them, and the rest, dealt into blocks to compare.

    One less the Jaccard similarity is a metric. So of a group whose sets are all held against its head, the set with
    the least cid, two are linked for certain if their distances to it add up to no more than a link's, and aren't if
    they differ by more. Only sets whose distances, in steps, leave both open meet in blocks. Near copies of one text that
    differ little from it are so counted without any pair being compared, and no link is guessed.
    """
    first = saved(sets.groupBy("comp").agg(F.min("cid").alias("cid")), "firsts", "lz4")
    heads = saved(sets.join(small(first), ["comp", "cid"]).select("comp", F.col("cid").alias("head"), F.col("grams").alias("head_grams")).dropDuplicates(["comp"]), "heads")

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x, y in zip(batch.column("grams").to_pylist(), batch.column("head_grams").to_pylist(), strict=True):
                a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(np.intersect1d(a, b, assume_unique=True))
                union = len(a) + len(b) - common
                out.append(STEPS * (union - common) // union)
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in ("cid", "size", "comp", "head")), pa.array(out, pa.int32())], names=["cid", "size", "comp", "head", "step"])

    # of repeated rows a set may come more than once
    told = saved(mapped(sets.join(small(heads), "comp"), steps, "cid long, size long, comp long, head long, step int").distinct(), "steps", "lz4")
    # of each group a row for each step, of which there are STEPS + 1 at most; neighbouring ones are put together to about a block
    each = told.groupBy("comp", "step").agg(F.count("*").alias("n"), F.sum("size").alias("docs"))
    before = F.sum("n").over(W.partitionBy("comp").orderBy("step")) - F.col("n")
    bins = each.withColumn("bin", F.floor(before / GROUP_BLOCK)).groupBy("comp", "bin").agg(F.min("step").alias("low"), F.max("step").alias("high"), F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    bins = bins.withColumn("blocks", F.ceil(F.col("n") / GROUP_BLOCK).cast("int"))
    bins = bins.withColumn("first", (F.sum("blocks").over(W.partitionBy("comp").orderBy("bin")) - F.col("blocks")).cast("int"))
    plans = saved(bins.groupBy("comp").agg(F.collect_list(F.struct("low", "high", "n", "docs", "blocks", "first")).alias("plan")), "plans", "lz4")
    link = STEPS * (similar[1] - similar[0])
    linked = lambda a, b: (a["high"] + b["high"] + 2) * similar[1] <= link
    open_ = lambda a, b: ~linked(a, b) & ((F.greatest(a["low"] - b["high"], b["low"] - a["high"]) - 1) * similar[1] < link)
    rows = told.join(small(plans), "comp").withColumn("mine", F.filter("plan", lambda x: F.col("step").between(x["low"], x["high"]))[0])
    own = F.col("mine")
    sure = lambda field: F.aggregate(F.filter("plan", lambda x: linked(x, own)), F.lit(0).cast("long"), lambda s, x: s + x[field])
    self_ = linked(own, own).cast("long")
    counts = rows.select(F.col("cid").alias("u"), F.lit(None).cast("long").alias("v"), (sure("n") - self_).alias("classes"), (sure("docs") - self_ * F.col("size")).alias("docs"))
    to_head = ((F.col("step") + 2) * similar[1] <= link) & (F.col("cid") != F.col("head"))
    edges = told.where(to_head).select(F.col("cid").alias("u"), F.col("head").alias("v"), F.lit(0).cast("long").alias("classes"), F.lit(0).cast("long").alias("docs"))
    blocks = F.flatten(F.transform(F.filter("plan", lambda x: open_(x, own)), lambda x: F.sequence(x["first"], x["first"] + x["blocks"] - 1)))
    dealt = rows.select("cid", "comp", "size", (own["first"] + F.pmod(F.xxhash64("comp", "cid"), own["blocks"])).cast("int").alias("own"), F.explode(blocks).alias("other"))
    dealt = dealt.select("cid", "comp", "size", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"))
    rest = dealt.join(sets.select("cid", "grams"), "cid")
    return counts.unionByName(edges), rest.repartition(size, "comp", "i", "j").sortWithinPartitions("comp", "i", "j")


def linked(docs: DataFrame, id_col: str, text_col: str, words: int, similar: tuple[int, int]) -> DataFrame:
    """(doc_id, row, class_id, n_links) of each row as link says; row is the text's hash."""
    spark = docs.sparkSession
    bands, rows = bands_and_rows(similar[0] / similar[1])
    texts = pick(docs, id_col, text_col).withColumn("row", F.xxhash64("text"))
    own = saved(sketches(texts, words, bands, rows), "sketches")
    size = partitions(own, SKETCH_BYTES)
    classes = own.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.min_by("row", F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("row"), F.count("*").alias("size"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    classes = saved(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    with rows_a_batch(spark, 2000):
        found = saved(candidates(classes, bands * rows, size), "candidates", "lz4")
    comps = components(found)
    comps = saved(comps, "groups", "lz4")
    members = comps.groupBy("root").agg(F.count("*").alias("members"))
    wanted = comps.join(members, "root").select(F.col("node").alias("cid"), F.col("root").alias("comp"), "members")
    wanted = saved(classes.select("cid", "doc_id", "row", "key", "size").join(wanted, "cid"), "wanted")
    links = saved(verified(texts, wanted, words, similar, size), "links", "lz4")
    sums = links.where("v is null").groupBy(F.col("u").alias("cid")).agg(F.sum("docs").alias("links"))
    roots = saved(components(links.where("v is not null").select("u", "v")), "roots", "lz4")
    named = classes.select("cid", "key", "doc_id", "size").join(roots.withColumnRenamed("node", "cid"), "cid", "left").join(sums, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    lowest = named.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    told = saved(named.join(lowest, "root").select("key", "class_id", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links")), "told")
    return own.select("doc_id", "row", F.when(F.col("n") > 0, F.col("key")).alias("key")).join(small(told), "key", "left").select("doc_id", "row", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


@operator()
def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """(doc_id, class_id, n_links) of each row: the smallest doc_id that it is linked to directly or through others, and how many other rows it is linked to.

    Two documents are linked if the Jaccard similarity of their sets of word n-grams is that fraction or more. Words are
    runs of ASCII letters, digits and other than ASCII characters, with A-Z in small letters. Documents of equal sets
    form a class, and only classes are compared; a class's own rows are links of each other, and are never paired.
    Classes meet in buckets of equal bands; those that also look alike there form groups, in which all pairs are
    verified on the full sets and only counted, block by block, so hot buckets and groups stay within bounds and lose
    nothing. In large ones, distances to a head settle most pairs without comparing them. Very long texts are read
    whole; ties don't arise, as the smallest doc_id is one; other columns, whatever their names, are ignored. Null texts and texts without words are linked to none; a class_id is null for a lone row without an id;
    rows without an id are never a class's smallest; repeated rows are rows of their own; an empty table gives an empty
    result.
    """
    return linked(docs, id_col, text_col, words, similar).select("doc_id", "class_id", "n_links")


@operator()
def first_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that no smaller doc_id is linked to; all columns stay. Of repeated rows of one id and text all stay or none; of different texts of one id each by itself. Rows without an id stay."""
    gone = saved(linked(docs, id_col, text_col, WORDS, SIMILAR).where("class_id != doc_id").select("doc_id", "row").distinct(), "copies")
    same = (docs[id_col].cast("long") == gone["doc_id"]) & (F.xxhash64(F.coalesce(docs[text_col], F.lit(""))) == gone["row"])
    return docs.join(small(gone), same, "left_anti")
