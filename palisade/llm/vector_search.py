"""Approximate nearest neighbours by cosine: vantage-point trees per shard, with relaxed triangle-inequality pruning.

Unit vectors under their chord length form a metric space whose nearest are those of largest cosine. Each task indexes
the rows it reads, a shard at a time, and runs a block of queries through the tree together: at a node, queries first go
to the side of the vantage point's median sphere they lie on; the other side is visited by those whose bound, by the
triangle inequality, is at most ``factor`` times their k-th distance. Factor one is exact search; less prunes more.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.session import persisted, ship

FACTOR = 0.8
LEAF, SHARD_ROWS = 128, 16_384
#: Queries of a block and bytes of their vectors, at most: a block is collected, sent to every task and answered before
#: the next is fetched, so the driver never holds more.
QUERY_BLOCK, BLOCK_BYTES = 16_384, 64 << 20


@dataclass
class _Node:
    rows: np.ndarray | None = None
    vantage: int = -1
    #: Least and greatest distance of the near and the far side from the vantage point.
    spans: tuple[tuple[float, float], tuple[float, float]] | None = None
    sides: list["_Node"] = field(default_factory=list)


class VantageTree:
    """Over distinct unit vectors; sides are split by rank, so equal distances can't make a side empty."""

    def __init__(self, units: np.ndarray, leaf: int = LEAF, seed: int = 11):
        self.units, self.leaf = units, leaf
        self.rng = np.random.default_rng(seed)
        self.root = self._build(np.arange(len(units)))

    def _distances(self, vectors: np.ndarray, rows: np.ndarray | int) -> np.ndarray:
        other = self.units[rows]
        return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (vectors @ other.T)))

    def _build(self, rows: np.ndarray) -> _Node:
        if len(rows) <= self.leaf:
            return _Node(rows=rows)
        vantage = int(self.rng.choice(rows))
        d = self._distances(self.units[rows], vantage)
        half = len(rows) // 2
        order = np.argpartition(d, half)
        near, far = order[:half], order[half:]
        spans = ((float(d[near].min()), float(d[near].max())), (float(d[far].min()), float(d[far].max())))
        return _Node(vantage=vantage, spans=spans, sides=[self._build(rows[near]), self._build(rows[far])])

    def search(self, queries: np.ndarray, k: int, factor: float = 1.0, best: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(distances, rows) of each query's k nearest, padded with infinity and -1; ``best`` bounds the search."""
        distance, row = np.full((len(queries), k), np.inf), np.full((len(queries), k), -1, np.int64)
        bound = np.full(len(queries), np.inf) if best is None else best[0][:, -1].copy()

        def visit(node: _Node, q: np.ndarray) -> None:
            if not len(q):
                return
            if node.rows is not None:
                d = np.concatenate([distance[q], self._distances(queries[q], node.rows)], axis=1)
                r = np.concatenate([row[q], np.broadcast_to(node.rows, (len(q), len(node.rows)))], axis=1)
                first = np.argpartition(d, k - 1, axis=1)[:, :k]
                distance[q], row[q] = np.take_along_axis(d, first, 1), np.take_along_axis(r, first, 1)
                bound[q] = np.minimum(bound[q], distance[q].max(axis=1))
                return
            d = self._distances(queries[q], node.vantage)
            (a0, b0), (a1, b1) = node.spans
            limit = np.stack([np.maximum(np.maximum(a0 - d, d - b0), 0.0), np.maximum(np.maximum(a1 - d, d - b1), 0.0)])
            first = (d > (b0 + a1) / 2).astype(int)
            for side in (0, 1):
                visit(node.sides[side], q[first == side])
            for side in (0, 1):
                other = first != side
                visit(node.sides[side], q[other & (limit[side] <= factor * bound[q])])

        visit(self.root, np.arange(len(queries)))
        return distance, row


def usable(vector: Column) -> Column:
    """Neither null nor empty, all components finite numbers, and not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)  # squares can't overflow
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each pair of rows, in double precision."""
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def _shard(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, factor: float) -> pa.RecordBatch:
    """Each query's k nearest rows of one shard. Equal vectors are one point of the tree with its k + 1 least ids, of
    which one may be the query's own, and at most k rows of each."""
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], np.ascontiguousarray(vectors[order])
    raw = vectors.view(np.dtype((np.void, vectors.dtype.itemsize * vectors.shape[1]))).ravel()
    _, first, group = np.unique(raw, return_index=True, return_inverse=True)
    members = np.argsort(group, kind="stable")
    opens = np.diff(group[members], prepend=-1) != 0
    fresh = opens | (np.diff(ids[members], prepend=0) != 0)
    number = np.cumsum(fresh) - 1  # of an id within a group, over all groups
    again = np.arange(len(members)) - np.flatnonzero(fresh)[number]
    members = members[(number - number[opens][np.cumsum(opens) - 1] <= k) & (again < k)]
    start = np.searchsorted(group[members], np.arange(len(first)))
    stop = np.append(start[1:], len(members))
    tree = VantageTree(_unit(vectors[first]))
    _, found = tree.search(_unit(queries), min(k + 1, len(first)), factor)
    q, point = np.nonzero(found >= 0)
    point = found[q, point]
    count = (stop - start)[point]
    place = np.repeat(start[point] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
    q, hit = np.repeat(q, count), members[place]
    other = query_ids[q] != ids[hit]
    q, hit = q[other], hit[other]
    score = cosine(queries[q], vectors[hit])
    order = np.lexsort((ids[hit], -score, q))
    q, hit, score = q[order], hit[order], score[order]
    rank = np.arange(len(q)) - np.searchsorted(q, q)
    keep = rank < k
    return pa.RecordBatch.from_arrays([pa.array(query_ids[q[keep]]), pa.array(ids[hit[keep]]), pa.array(score[keep])], names=["query_id", "vec_id", "score"])


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def nearest(vectors: DataFrame, is_query: Column, *, key: str = "vec_id", vector: str = "embedding", k: int = 5, factor: float = FACTOR, shard_rows: int = SHARD_ROWS, query_block: int = QUERY_BLOCK, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that ``is_query`` selects, its k nearest others, nearest first.

    ``score`` is the cosine of the original vectors in double precision; ties go to the smaller key. Vectors that are
    null, empty, all zero, or hold null or non-finite components take no part; nor do rows with a null key. Vectors are
    compared only with those of as many components. A query row that repeats counts once. Rows that share the query's key are its own and are left out. With
    fewer than k candidates all are given; a query without any gives no row, nor does an empty table. Other columns are
    not carried. All queries are answered, a block at a time, each block by a scan; the index rows are never moved.
    """
    spark = ship(vectors.sparkSession)
    rows = vectors.where(F.col(key).isNotNull() & usable(F.col(vector))).select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"), is_query.alias("q"))
    asked = rows.where("q").select("vec_id", "v")
    count, components = asked.agg(F.count("*"), F.coalesce(F.sum(F.size("v")), F.lit(0))).first()
    blocks = max(1, -(-count // query_block), -(-8 * components // block_bytes))
    parts = []
    for b in range(blocks):
        block = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("vec_id", F.lit("block")), F.lit(blocks)) == b)
        by_size: dict[int, dict] = {}
        for r in block.collect():
            by_size.setdefault(len(r.v), {})[r.vec_id, tuple(r.v)] = None  # a repeated query counts once
        handle = spark.sparkContext.broadcast({n: (np.array([x[0] for x in found], np.int64), np.array([x[1] for x in found], np.float64)) for n, found in by_size.items()})

        def run(batches: Iterator[pa.RecordBatch], handle=handle) -> Iterator[pa.RecordBatch]:
            held: dict[int, list] = {n: [] for n in handle.value}

            def flush(n: int) -> pa.RecordBatch:
                ids, values = (np.concatenate(c) for c in zip(*held[n], strict=True))
                held[n] = []
                return _shard(ids, values, *handle.value[n], k, factor)

            for batch in batches:
                ids, column = batch.column(0).to_numpy(), batch.column(1)
                sizes = np.diff(column.offsets.to_numpy())
                for n in set(sizes.tolist()) & set(held):
                    same = np.flatnonzero(sizes == n)
                    held[n].append((ids[same], _matrix(column.take(pa.array(same)), n)))
                    if sum(len(x[0]) for x in held[n]) >= shard_rows:
                        yield flush(n)
            for n, found in held.items():
                if found:
                    yield flush(n)

        found = rows.select("vec_id", "v").mapInArrow(run, "query_id long, vec_id long, score double")
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        best = found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        if blocks == 1:
            return best
        parts.append(persisted(best))  # a block is answered before the next one is fetched
        handle.destroy()
    return reduce(DataFrame.unionByName, parts)
