"""Nearest neighbours by hierarchical navigable small-world graphs, one for each shard, in flat arrays."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mapped, mixed, operator, rows_a_batch, saved, small

#: Links of a node in the upper layers; the lowest has twice as many.
LINKS = 16

#: Candidates that are kept while a node is put in, and while a query is searched.
EF_BUILD, EF_SEARCH = 64, 128

#: Candidates that are expanded at once for each query; nodes put in, or queries searched, side by side.
EXPAND, TOGETHER = 4, 256

#: Vectors of a shard: as few as the first, unless that makes more shards than the second, but never more than the third, nor than the bytes, which a row holds.
SHARD_LEAST, SHARDS, SHARD_MOST, SHARD_BYTES = 8192, 64, 1 << 18, 512 << 20

NEAREST, EVERY = 20, 20


@dataclass
class Graph:
    """Nodes are in the order in which they were put in, from the highest level down, so those of a layer come first.

    links[0] has a row of 2 * LINKS neighbours for each node, links[k] one of LINKS for each node of layer k; -1 is none.
    Points have one more coordinate, which gives them all the same length; then the largest inner product is also the
    least distance, and the graph's geometry holds for vectors of any length.
    """

    points: np.ndarray
    links: list[np.ndarray]
    filled: int = 0

    @classmethod
    def build(cls, vectors: np.ndarray, levels: np.ndarray) -> Graph:
        """vectors sorted by falling level."""
        lengths = (vectors.astype(np.float64) ** 2).sum(1)
        points = np.concatenate([vectors, np.sqrt(np.maximum(lengths.max() - lengths, 0))[:, None]], 1).astype(np.float32)
        sizes = [int((levels >= k).sum()) for k in range(int(levels.max()) + 1)]
        graph = cls(points, [np.full((n, LINKS * (1 + (k == 0))), -1, np.int32) for k, n in enumerate(sizes)])
        at = 0
        while at < len(points):
            level = int(levels[at])
            last = sizes[level]  # the nodes of a batch have one level
            to = min(last, at + min(TOGETHER, max(LINKS, at)))
            graph.put(at, to, level)
            at = to
        return graph

    def put(self, a: int, b: int, level: int) -> None:
        new = np.arange(a, b)
        points = self.points[a:b]
        entry = self.descend(points, level) if a else np.full((b - a, 1), -1, np.int64)
        near = points @ points.T
        np.fill_diagonal(near, -np.inf)
        own = np.argsort(-near, 1)[:, : min(EF_BUILD // 2, b - a)]
        for layer in range(min(level, len(self.links) - 1), -1, -1):
            ids, sims = self.beam(points, entry, layer, EF_BUILD) if a else (entry, np.full(entry.shape, -np.inf, np.float32))
            entry = ids
            ids = np.concatenate([ids, new[own]], 1)
            sims = np.concatenate([sims, np.take_along_axis(near, own, 1)], 1)
            ids = np.where(np.isfinite(sims), ids, -1)
            chosen = self.select(ids, sims, LINKS)
            self.links[layer][a:b, :LINKS] = chosen
            self.back(layer, np.repeat(new, LINKS), chosen.reshape(-1))
        self.filled = b

    def select(self, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """For each row up to `most` of the nodes, nearest first, none of which is nearer to one already chosen than to the row's own; what room is left goes to the nearest of the others."""
        order = np.argsort(-sims, 1, kind="stable")[:, :EF_BUILD]
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        points = self.points[np.maximum(ids, 0)]
        between = points @ points.transpose(0, 2, 1)
        rows, width = ids.shape
        chosen, worst, n = np.zeros((rows, width), bool), np.full((rows, width), -np.inf, np.float32), np.zeros(rows, np.int64)
        for k in range(width):
            ok = (ids[:, k] >= 0) & (n < most) & (worst[:, k] < sims[:, k])
            chosen[:, k] = ok
            n += ok
            worst = np.where(ok[:, None], np.maximum(worst, between[:, k]), worst)
        rank = np.where(chosen, 0, np.where(ids >= 0, 1, 2))
        order = np.argsort(rank, 1, kind="stable")[:, :most]
        out = np.where(np.take_along_axis(rank, order, 1) < 2, np.take_along_axis(ids, order, 1), -1)
        return np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1).astype(np.int32)

    def back(self, layer: int, source: np.ndarray, target: np.ndarray) -> None:
        """Adds links from target to source; a node with too many keeps a selection."""
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        nodes, first, many = np.unique(target, return_index=True, return_counts=True)
        links = self.links[layer]
        have, most = (links[nodes] >= 0).sum(1), links.shape[1]
        width = int((have + many).max(initial=0))
        ids = np.full((len(nodes), max(width, most)), -1, np.int64)
        ids[:, :most] = links[nodes]
        row = np.repeat(np.arange(len(nodes)), many)
        ids[row, have[row] + np.arange(len(target)) - first[row]] = source
        full = have + many > most
        links[nodes[~full]] = ids[~full, :most]
        for k in range(0, int(full.sum()), TOGETHER):
            some = np.flatnonzero(full)[k : k + TOGETHER]
            sims = np.einsum("nd,nkd->nk", self.points[nodes[some]], self.points[np.maximum(ids[some], 0)])
            links[nodes[some]] = self.select(ids[some], np.where(ids[some] >= 0, sims, -np.inf), most)

    def descend(self, points: np.ndarray, level: int) -> np.ndarray:
        """Where to enter the layer: down from the first node through the layers above."""
        entry = np.zeros((len(points), 1), np.int64)
        for layer in range(len(self.links) - 1, level, -1):
            entry = self.beam(points, entry, layer, 8)[0]
        return entry

    def beam(self, points: np.ndarray, entry: np.ndarray, layer: int, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """The ef nearest nodes found for each point, from its entries, all points in step."""
        n, links = len(points), self.links[layer]
        rows, nowhere = np.arange(n)[:, None], len(links)
        seen = np.zeros((n, nowhere + 1), bool)
        mark = np.zeros((n, nowhere + 1), np.int16)

        def fresh(ids: np.ndarray) -> np.ndarray:
            """Similarities of the nodes, -inf for those that are none, were seen, or stand there twice."""
            column = np.arange(ids.shape[1], dtype=np.int16)[None, :]
            place = np.where(ids >= 0, ids, nowhere)
            place = np.where(seen[rows, place], nowhere, place)
            mark[rows, place] = column
            valid = (place != nowhere) & (mark[rows, place] == column)
            seen[rows, place] = True
            seen[:, nowhere] = False
            sims = np.full(ids.shape, -np.inf, np.float32)
            at = np.nonzero(valid)
            sims[at] = np.einsum("nd,nd->n", points[at[0]], self.points[ids[at]])
            return sims

        ids = entry.astype(np.int64)
        sims = fresh(ids)
        done = ~np.isfinite(sims)
        while True:
            open_sims = np.where(done, -np.inf, sims)
            best = np.argpartition(-open_sims, min(EXPAND, ids.shape[1]) - 1, 1)[:, :EXPAND]
            going = np.isfinite(np.take_along_axis(open_sims, best, 1))
            if not going.any():
                break
            np.put_along_axis(done, best, True, 1)
            around = np.where(going[:, :, None], links[np.maximum(np.take_along_axis(ids, best, 1), 0)], -1).reshape(n, -1).astype(np.int64)
            more = fresh(around)
            ids, sims, done = np.concatenate([ids, around], 1), np.concatenate([sims, more], 1), np.concatenate([done, ~np.isfinite(more)], 1)
            if ids.shape[1] > ef:
                keep = np.argpartition(-sims, ef - 1, 1)[:, :ef]
                ids, sims, done = (np.take_along_axis(x, keep, 1) for x in (ids, sims, done))
        return np.where(np.isfinite(sims), ids, -1), sims

    def search(self, queries: np.ndarray, k: int, ef: int = EF_SEARCH) -> np.ndarray:
        """The k nearest nodes found for each query, -1 for none, in no order."""
        points = np.pad(queries.astype(np.float32), ((0, 0), (0, 1)))
        ids, sims = self.beam(points, self.descend(points, 0), 0, max(ef, k))
        order = np.argsort(-sims, 1, kind="stable")[:, :k]
        return np.take_along_axis(ids, order, 1)


def levels(ids: np.ndarray) -> np.ndarray:
    """Each node's level, by a hash of its id: a share of 1 / LINKS of the nodes of a layer is in the next."""
    x = mixed(ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
    u = ((x >> np.uint64(11)).astype(np.float64) + 1) / (1 << 53)
    return np.floor(-np.log(u) / np.log(LINKS)).astype(np.int64)


def valid(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v) of the rows that take part: no null or zero vector, no null or non-finite component, and as many components as most have. Of rows of one id the least vector counts. Components keep their precision, of 32 bits or 64."""
    kind = "double" if isinstance(vectors.schema[vector_col].dataType.elementType, T.DoubleType) else "float"
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vector_col].cast(f"array<{kind}>").alias("v")).where("vec_id is not null and size(v) > 0")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.where(fine).withColumn("v", F.transform("v", lambda x: x + F.lit(0.0).cast(kind)))
    size = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").first()
    rows = rows.where(F.size("v") == (size["size"] if size else 0))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def kind_of(vectors: DataFrame) -> str:
    """The components as they lie in a graph's row."""
    return "<f8" if isinstance(vectors.schema["v"].dataType.elementType, T.DoubleType) else "<f4"


def build(vectors: DataFrame, shards: int) -> DataFrame:
    """(shard, ids, vectors, links): a row for each shard, written to the shared folder."""
    kind = kind_of(vectors)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def finish() -> Iterator[pa.RecordBatch]:
            for shard, parts in held.items():
                ids, own = (np.concatenate(x) for x in zip(*parts, strict=True))
                level = levels(ids)
                order = np.lexsort((ids, -level))
                graph = Graph.build(own[order], level[order])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard], pa.int32()), pa.array([ids[order].astype("<i8").tobytes()]), pa.array([own[order].astype(kind).tobytes()]), pa.array([[x.astype("<i4").tobytes() for x in graph.links]], pa.list_(pa.binary()))],
                    names=["shard", "ids", "vectors", "links"],
                )
            held.clear()

        for batch in batches:
            shard, ids = batch.column("shard").to_numpy(), batch.column("vec_id").to_numpy()
            own = batch.column("v").flatten().to_numpy().reshape(len(ids), -1)
            for s in np.unique(shard):
                if s not in held:
                    yield from finish()
                held.setdefault(int(s), []).append((ids[shard == s], own[shard == s]))
        yield from finish()

    rows = vectors.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))
    rows = rows.repartition(shards, "shard").sortWithinPartitions("shard", "vec_id").select("shard", "vec_id", "v")
    with rows_a_batch(vectors.sparkSession, 4096):
        return saved(mapped(rows, make, "shard int, ids binary, vectors binary, links array<binary>"), "graphs")


def searched(index: DataFrame, queries: DataFrame, shards: int, k: int, ef: int) -> DataFrame:
    """(query_id, vec_id, score): the k nearest that each shard finds for each query. Queries go to every shard, and follow its graph in the same stream. Graphs are walked in 32 bits; scores are of the vectors as they are."""
    kind = kind_of(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph = own = ids = None
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def answer() -> Iterator[pa.RecordBatch]:
            if not held or graph is None:
                held.clear()
                return
            query, points = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            step = max(1, min(TOGETHER, (64 << 20) // max(1, len(ids))))
            for a in range(0, len(query), step):
                found = graph.search(points[a : a + step], k, ef)
                row, column = np.nonzero(found >= 0)
                node = found[row, column]
                score = np.einsum("nd,nd->n", points[a + row].astype(np.float64), own[node].astype(np.float64))
                yield pa.RecordBatch.from_arrays([pa.array(query[a + row]), pa.array(ids[node]), pa.array(score)], names=["query_id", "vec_id", "score"])

        for batch in batches:
            kinds = np.asarray(batch.column("kind"))
            for a, b in zip(cuts := [0, *(np.flatnonzero((kinds[1:] == 0) | (kinds[:-1] == 0)) + 1).tolist()], [*cuts[1:], len(kinds)], strict=True):
                part = batch.slice(a, b - a)
                if not part.num_rows:
                    continue
                if kinds[a] == 0:
                    yield from answer()
                    row = part.to_pylist()[0]
                    ids = np.frombuffer(row["ids"], "<i8")
                    own = np.frombuffer(row["vectors"], kind).reshape(len(ids), -1)
                    lengths = (own.astype(np.float64) ** 2).sum(1)
                    points = np.concatenate([own, np.sqrt(np.maximum(lengths.max() - lengths, 0))[:, None]], 1).astype(np.float32)
                    graph = Graph(points, [np.frombuffer(x, "<i4").reshape(-1, LINKS * (1 + (i == 0))) for i, x in enumerate(row["links"])], len(ids))
                else:
                    held.append((part.column("vec_id").to_numpy(), part.column("v").flatten().to_numpy().reshape(part.num_rows, -1)))
                    if sum(len(x[0]) for x in held) >= TOGETHER:
                        yield from answer()
        yield from answer()

    none = F.lit(None)
    graphs = index.select("shard", F.lit(0).alias("kind"), none.cast("long").alias("vec_id"), none.cast(queries.schema["v"].dataType).alias("v"), "ids", "vectors", "links")
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("kind"), "vec_id", "v", none.cast("binary").alias("ids"), none.cast("binary").alias("vectors"), none.cast("array<binary>").alias("links"))
    return mapped(graphs.unionByName(asked).repartition(shards, "shard").sortWithinPartitions("shard", "kind", "vec_id"), run, "query_id long, vec_id long, score double")


@operator()
def nearest(vectors: DataFrame, k: int = NEAREST, every: int = EVERY, ef: int = EF_SEARCH, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by `every`, the k others of the largest inner product that the graphs find.

    Null and zero vectors, and those with a null or non-finite component or an unusual number of them, take no part;
    nor do rows without an id; of rows of one id the least vector counts. Equal vectors are one node, with its k + 1
    least ids, so a vector that a third of all rows share is one point of the graph and its ties are exact: nearest
    first, then the smaller id. Every distinct vector is in the graph of its shard, and very long vectors have smaller
    shards; other columns, whatever their names, are ignored; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    rows = saved(valid(vectors, id_col, vector_col), "vectors")
    same = W.partitionBy("v").orderBy("vec_id")
    # the limit on row numbers is applied before the shuffle too, so a hot vector sends k + 1 rows a task
    members = rows.withColumn("n", F.row_number().over(same)).where(F.col("n") <= k + 1)
    members = saved(members, "members")
    heads = members.where("n = 1").select("vec_id", "v")
    n = heads.count()
    wide = heads.select(F.size("v").alias("n")).first()
    room = max(1, SHARD_BYTES // (8 * (wide["n"] if wide else 1)))
    size = min(SHARD_MOST, room, max(SHARD_LEAST, -(-n // SHARDS)))
    shards = max(1, -(-n // size))
    index = build(heads, shards)
    queries = rows.where(F.pmod("vec_id", F.lit(every)) == 0)
    with rows_a_batch(spark, 128):
        found = saved(searched(index, queries, shards, k + 1, ef), "found")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).drop("n")
    classes = saved(members.join(heads.withColumnRenamed("vec_id", "head"), "v").select("head", "vec_id"), "classes")
    each = found.withColumnRenamed("vec_id", "head").join(small(classes), "head").where("vec_id != query_id")
    return each.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
