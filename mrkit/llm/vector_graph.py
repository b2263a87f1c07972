"""Approximate nearest neighbours by inner product, with a robust-pruned directed graph per shard.

Inner product search is nearest-neighbour search after one more coordinate that gives all vectors of a shard one
length. A shard's graph is built in batches: greedy searches over the graph so far propose neighbours, and pruning
keeps, from near to far, those that are not much nearer to a kept one than to the point itself (the factor ``ALPHA``
relaxes this and leaves longer edges); edges back are pruned alike. A query runs a beam search in every shard; the
shards' best are merged.

Every vector is indexed. Equal vectors are one point, which carries its ``k + 1`` smallest ids: more of them can not
be among the k nearest of any query, in the order of ties. Queries are dealt out in blocks, against all shards, and
scores are computed anew in double precision. Shards have a bounded size, so only their number grows.

Defined results: vectors that are NULL, zero or hold NULL, NaN or infinity take no part, as candidate or as query, nor
do those of another length than most (of equally many, the longest), as there is no product of different lengths.
Repeated rows of an id count once if their vector is the same too. Rows without an id take no part. Extra columns are
ignored. With fewer than ``k`` candidates all found ones are returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mrkit.session import checkpoint

K = 20
SHARD = 8192
QUERIES_AT_ONCE = 256

# Queries that are sent to a shard together. A shard is sent once per block, a block once per shard.
BLOCK_QUERIES = 4096

# Edges of a point, relaxation of pruning, beams of building and of searching, points that a search expands at once.
DEGREE, ALPHA = 32, 1.2
BUILD_BEAM, SEARCH_BEAM, WIDTH = 48, 96, 4


class Graph:
    """Points as rows of equal length, ``DEGREE`` edges from each (-1 for none) and the point where searches begin."""

    def __init__(self, points: np.ndarray, edges: np.ndarray, start: int):
        self.points, self.edges, self.start = points, edges, start

    @classmethod
    def build(cls, vectors: np.ndarray, seed: int = 0) -> Graph:
        norms = (vectors.astype(np.float64) ** 2).sum(axis=1)
        points = np.column_stack([vectors, np.sqrt(norms.max() - norms)]).astype(np.float32)
        n, rng = len(points), np.random.default_rng(seed)
        start = int(((points - points.mean(axis=0)) ** 2).sum(axis=1).argmin())
        edges = np.full((n, DEGREE), -1, dtype=np.int32)
        edges[:, : DEGREE // 2] = rng.integers(0, n, (n, DEGREE // 2))
        graph, order = cls(points, edges, start), rng.permutation(n)
        for i in range(0, n, QUERIES_AT_ONCE):
            graph._insert(order[i : i + QUERIES_AT_ONCE])
        return graph

    def _insert(self, batch: np.ndarray) -> None:
        beam, _ = self.search(self.points[batch], BUILD_BEAM)
        self.edges[batch] = self._pruned(batch, np.concatenate([beam, self.edges[batch]], axis=1))
        # Edges back: the points that have got one, each with the old and the new ones.
        to, back = self.edges[batch].reshape(-1), np.repeat(batch, DEGREE)
        to, back = to[to >= 0], back[to >= 0]
        order = np.argsort(to, kind="stable")
        to, back = to[order], back[order]
        nodes, first, n = np.unique(to, return_index=True, return_counts=True)
        incoming = np.full((len(nodes), n.max(initial=0)), -1, dtype=np.int32)
        incoming[np.repeat(np.arange(len(nodes)), n), np.arange(len(to)) - np.repeat(first, n)] = back
        for i in range(0, len(nodes), QUERIES_AT_ONCE):
            some = nodes[i : i + QUERIES_AT_ONCE]
            rows = np.concatenate([self.edges[some], incoming[i : i + QUERIES_AT_ONCE]], axis=1)
            self.edges[some] = self._pruned(some, rows)

    def _distance(self, a: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Squared distances of each row of ``a`` to its points ``ids``; infinite for -1."""
        difference = self.points[ids] - a[:, None, :]
        return np.where(ids >= 0, np.einsum("ijk,ijk->ij", difference, difference), np.float32(np.inf))

    def _pruned(self, nodes: np.ndarray, candidates: np.ndarray) -> np.ndarray:
        """The edges that robust pruning keeps of each node's candidates."""
        candidates = np.sort(np.where(candidates == nodes[:, None], -1, candidates), axis=1)
        candidates[:, 1:][candidates[:, 1:] == candidates[:, :-1]] = -1
        distance = self._distance(self.points[nodes], candidates)
        order = np.argsort(distance, axis=1, kind="stable")
        candidates, distance = (np.take_along_axis(x, order, 1) for x in (candidates, distance))
        kept, alive, rows = np.full((len(nodes), DEGREE), -1, np.int32), np.isfinite(distance), np.arange(len(nodes))
        for i in range(DEGREE):
            if not alive.any():
                break
            first = alive.argmax(axis=1)
            any_left = alive[rows, first]
            chosen = np.where(any_left, candidates[rows, first], -1)
            kept[:, i] = chosen
            near = self._distance(self.points[chosen], candidates)
            # Squared distances, so the factor is squared as well.
            alive &= ~((ALPHA**2 * near <= distance) & any_left[:, None])
            alive[rows, first] = False
        return kept

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``beam`` nearest points found for each query, from near to far, -1 where there are fewer."""
        b, n = len(queries), len(self.points)
        rows = np.arange(b)[:, None]
        ids = np.full((b, beam), -1, dtype=np.int32)
        ids[:, 0] = self.start
        distance, done = self._distance(queries, ids), ids < 0
        seen = np.zeros((b, n), dtype=bool)
        seen[:, self.start] = True
        while not done.all():
            # The nearest points that were not expanded yet.
            place = np.argsort(done, axis=1, kind="stable")[:, :WIDTH]
            fresh = ~np.take_along_axis(done, place, 1)
            done[rows, place] = True
            expanded = np.where(fresh, ids[rows, place], -1)
            near = np.where((expanded >= 0)[:, :, None], self.edges[expanded], -1).reshape(b, -1)
            near = np.sort(near, axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            near[seen[rows, near]] = -1
            seen[rows, near] |= near >= 0
            away = self._distance(queries, near)
            ids, distance = np.concatenate([ids, near], 1), np.concatenate([distance, away], 1)
            done = np.concatenate([done, near < 0], 1)
            order = np.argsort(distance, axis=1, kind="stable")[:, :beam]
            ids, distance, done = (np.take_along_axis(x, order, 1) for x in (ids, distance, done))
        return np.where(np.isfinite(distance), ids, -1), distance


def usable(vector: str | Column) -> Column:
    vector = F.col(vector) if isinstance(vector, str) else vector
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    sound = F.coalesce(~F.exists(vector, bad) & F.exists(vector, lambda x: x != 0), F.lit(False))
    return vector.isNotNull() & sound


def build_shards(vectors: DataFrame, k: int = K, shard: int = SHARD) -> DataFrame:
    """``(shard, vectors, ids, edges, start)``: the graph of each shard of ``vectors(vec_id, embedding)``."""
    rows = vectors.where(F.col("vec_id").isNotNull() & usable("embedding")).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")
    )
    sizes = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    rows = rows.where(F.size("v") == (sizes.size if sizes else 0))
    # Equal vectors are a group; the limit to the first ids is applied before the shuffle as well.
    order = Window.partitionBy("v").orderBy("vec_id")
    first = rows.select("v", "vec_id", F.dense_rank().over(order).alias("rank")).where(F.col("rank") <= k + 1)
    points = checkpoint(first.groupBy("v").agg(F.array_sort(F.collect_set("vec_id")).alias("ids")))
    shards = max(1, -(-points.count() // shard))
    points = points.select("v", "ids", F.pmod(F.xxhash64(F.col("ids")[0]), F.lit(shards)).cast("int").alias("shard"))

    def build(table: pa.Table) -> pa.Table:
        table = table.take(pa.compute.sort_indices(pa.compute.list_element(table["ids"], 0)))
        ids = table["ids"].combine_chunks()
        matrix = table["v"].combine_chunks().flatten().to_numpy().reshape(len(table), -1)
        graph = Graph.build(matrix)
        counts = pa.compute.list_value_length(ids).to_numpy().astype(np.int32)
        row = [table["shard"][0].as_py(), matrix.shape[1], matrix.tobytes(), counts.tobytes(), ids.flatten().to_numpy().tobytes(),
               graph.edges.tobytes(), graph.start]
        return pa.Table.from_pylist([dict(zip(SHARD_FIELDS, row))], SHARD_TYPES)

    built = points.repartition(shards, "shard").groupBy("shard").applyInArrow(build, SHARDS)
    return checkpoint(built)


SHARDS = "shard int, dims int, vectors binary, counts binary, ids binary, edges binary, start int"
SHARD_FIELDS = [field.split()[0] for field in SHARDS.split(", ")]
SHARD_TYPES = pa.schema(
    [(f.split()[0], {"int": pa.int32(), "binary": pa.binary()}[f.split()[1]]) for f in SHARDS.split(", ")]
)


def search_shards(shards: DataFrame, queries: DataFrame, k: int = K, beam: int = SEARCH_BEAM) -> DataFrame:
    """``(query_id, rank, vec_id, score)`` of the ``k`` best of all shards for ``queries(vec_id, embedding)``."""
    queries = queries.where(F.col("vec_id").isNotNull() & usable("embedding")).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")
    )
    last, dims = shards.agg(F.max("shard"), F.max("dims")).first()
    queries = queries.where(F.size("v") == (dims or 0)).dropDuplicates(["vec_id", "v"])
    n, last = queries.count(), last or 0
    blocks = max(1, -(-n // BLOCK_QUERIES))
    packed = queries.groupBy(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("block")).agg(
        F.collect_list("vec_id").alias("query_ids"), F.flatten(F.collect_list("v")).alias("queries")
    )
    # Every block of queries meets every shard once.
    sent = packed.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(last))))
    met = sent.select("shard", "query_ids", "queries").join(shards, "shard")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield best_of_shard(row, k, beam)

    found = met.mapInArrow(find, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.where("query_id <> vec_id").withColumn("rank", F.row_number().over(best))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def best_of_shard(row: dict, k: int, beam: int) -> pa.RecordBatch:
    vectors = np.frombuffer(row["vectors"]).reshape(-1, row["dims"])
    counts, ids = np.frombuffer(row["counts"], np.int32), np.frombuffer(row["ids"], np.int64)
    firsts = np.cumsum(counts) - counts
    norms = (vectors**2).sum(axis=1)
    points = np.column_stack([vectors, np.sqrt(norms.max() - norms)]).astype(np.float32)
    graph = Graph(points, np.frombuffer(row["edges"], np.int32).reshape(-1, DEGREE), row["start"])
    names = np.array(row["query_ids"])
    queries = np.array(row["queries"]).reshape(len(names), -1)
    # A query's direction alone decides the order; at the common length of the points distances are well spread.
    length = np.sqrt(norms.max()) / np.sqrt((queries**2).sum(axis=1, keepdims=True))
    scaled = np.column_stack([queries * length, np.zeros(len(queries))]).astype(np.float32)
    found = np.concatenate(
        [graph.search(scaled[i : i + QUERIES_AT_ONCE], beam)[0] for i in range(0, len(scaled), QUERIES_AT_ONCE)]
    )
    out = []
    for name, query, at in zip(names, queries, found):
        at = at[at >= 0]
        scores, n = np.einsum("ij,j->i", vectors[at], query), counts[at]
        members = np.concatenate([ids[f : f + c] for f, c in zip(firsts[at], n)])
        scores = np.repeat(scores, n)
        order = np.lexsort((members, -scores))[: k + 1]
        out.append((np.full(len(order), name), members[order], scores[order]))
    columns = [pa.array(np.concatenate(c)) for c in zip(*out)]
    return pa.RecordBatch.from_arrays(columns, ["query_id", "vec_id", "score"])


def nearest_neighbours(vectors: DataFrame, queries: DataFrame, k: int = K, shard: int = SHARD, beam: int = SEARCH_BEAM) -> DataFrame:
    """``search_shards`` over ``build_shards``; a query's own id is no answer to it."""
    return search_shards(build_shards(vectors, k, shard), queries, k, beam)
