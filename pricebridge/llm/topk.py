"""Exact top-k inner products with block-at-a-time pruning.

Vectors lie in blocks of a document range, in an order that puts like vectors together; a block keeps the greatest and
the least value of each term (its bounds) and its vectors (its forward index). A query's bound on a block is the sum of
its weights times those extremes. For each query, blocks go by falling bound and are scored until the bounds fall below
the k-th score so far; a bound equal to it is still scored, for ties go to the smaller id.

Queries pass in packs of bounded size, so what a task gets besides its blocks does not grow with the input; a pack's
vectors are the only rows that pass through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricebridge.llm.common import cut, drop_cut, partitions, slices

PACK = 4096
RANGE = 16384
BLOCK = 64
NO_ID = np.iinfo(np.int64).max


def quantised(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256) -> DataFrame:
    """vec_id and v, floor(scale * x) of every component. Vectors that are null or hold a null or non-finite component are left out."""
    x = F.col(vec_col)
    good = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    # compared before the transform, which would meet the nulls
    return vectors.filter(good).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c.cast("double") * scale)).alias("v"))


def _matrix(batch_ids: list, batch_vecs: list) -> tuple[np.ndarray, np.ndarray]:
    """ids and a matrix; shorter vectors count as ending in zeros."""
    dim = max((len(v) for v in batch_vecs), default=0)
    m = np.zeros((len(batch_vecs), dim), np.int64)
    for i, v in enumerate(batch_vecs):
        m[i, : len(v)] = v
    return np.array([NO_ID if i is None else i for i in batch_ids], np.int64), m


def _pack(most: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vecs = [], []

        def out() -> pa.RecordBatch:
            i, m = _matrix(ids, vecs)
            return pa.RecordBatch.from_arrays([pa.array([len(i)], pa.int32()), pa.array([m.shape[1]], pa.int32()), pa.array([i.tobytes()], pa.binary()), pa.array([m.tobytes()], pa.binary())], names=["n", "dim", "ids", "m"])

        for batch in it:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(i)
                vecs.append(v)
                if len(ids) == most:
                    yield out()
                    ids, vecs = [], []
        if ids:
            yield out()

    return run


def packed(rows: DataFrame, most: int) -> DataFrame:
    """Rows of vec_id, v as matrices of at most `most` vectors: n, dim, ids, m."""
    return rows.mapInArrow(_pack(most), "n int, dim int, ids binary, m binary")


def _unpack(dim: int, ids: bytes, m: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, np.int64), np.frombuffer(m, np.int64).reshape(-1, dim) if dim else np.zeros((len(ids) // 8, 0), np.int64)


def _widen(m: np.ndarray, dim: int) -> np.ndarray:
    return m if m.shape[1] == dim else np.pad(m, ((0, 0), (0, dim - m.shape[1])))


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of integers, by floating point where that is exact."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < 2.0**52:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


class _Best:
    """The k best (score, id) of every query so far."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score = np.full((n, k), np.iinfo(np.int64).min)
        self.id = np.full((n, k), NO_ID)
        self.have = np.zeros(n, np.int64)

    def add(self, q: np.ndarray, ids: np.ndarray, scores: np.ndarray, own: np.ndarray) -> None:
        """scores[i, j] is that of query q[i] and candidate ids[j]; own marks pairs that don't count."""
        scores = np.where(own, np.iinfo(np.int64).min, scores)
        kth = self.score[q, -1]
        rows = np.flatnonzero(((scores >= kth[:, None]) & ~own).any(1))
        for r in rows:
            x = q[r]
            cand = np.flatnonzero((scores[r] >= kth[r]) & ~own[r])
            s, i = np.concatenate([self.score[x, : self.have[x]], scores[r, cand]]), np.concatenate([self.id[x, : self.have[x]], ids[cand]])
            o = np.lexsort((i, -s))[: self.k]
            self.have[x] = len(o)
            self.score[x, : len(o)], self.id[x, : len(o)] = s[o], i[o]


def _order(m: np.ndarray) -> np.ndarray:
    """An order of vectors in which those on the same side of a few fixed planes are neighbours."""
    planes = np.random.default_rng(5).standard_normal((m.shape[1], 12))
    bits = (m.astype(np.float64) @ planes > 0).astype(np.int64)
    return np.lexsort((np.arange(len(m)), bits @ (1 << np.arange(12)[::-1])))


def score_range(best: _Best, q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, m: np.ndarray, block: int = BLOCK) -> int:
    """Let one document range's vectors compete for every query. The number of (query, block) pairs scored."""
    dim = max(q.shape[1], m.shape[1])
    q, m = _widen(q, dim), _widen(m, dim)
    o = _order(m)
    ids, m = ids[o], m[o]
    starts = np.arange(0, len(m), block)
    if dim == 0:
        bound = np.zeros((len(q), len(starts)), np.int64)
    else:
        bound = _product(np.maximum(q, 0), np.maximum.reduceat(m, starts)) + _product(np.minimum(q, 0), np.minimum.reduceat(m, starts))
    order = np.argsort(-bound, axis=1, kind="stable")
    alive, scored = np.arange(len(q)), 0
    for r in range(len(starts)):
        at = order[alive, r]
        # bounds fall along the order, so a query that is done stays done
        go = (best.have[alive] < best.k) | (bound[alive, at] >= best.score[alive, -1])
        alive, at = alive[go], at[go]
        if not len(alive):
            break
        scored += len(alive)
        by = np.argsort(at, kind="stable")
        for group in np.split(by, np.flatnonzero(np.diff(at[by])) + 1):
            b = slice(starts[at[group[0]]], starts[at[group[0]]] + block)
            who = alive[group]
            best.add(who, ids[b], _product(q[who], m[b]), q_ids[who][:, None] == ids[b][None, :])
    return scored


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", pack: int = PACK, range_rows: int = RANGE) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of each query, ties to the smaller id.

    is_query is a condition on vec_id. A query's candidates are all rows that do not bear its id, so equal vectors under
    other ids count; with fewer than k, all are given. Rows that repeat a query's id are one query, the one whose vector
    comes first in order. Vectors that are null or hold null or non-finite components take no part; a shorter vector
    ends in zeros. A null id is never a query and, as a candidate, comes last among ties. Other columns are ignored.
    """
    rows = cut(quantised(vectors, id_col, vec_col), "vectors")
    asked = rows.filter(F.col("vec_id").isNotNull() & is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    packs = cut(packed(asked.repartition(slices(asked.count(), pack)), pack), "packs")
    n = rows.count()
    ranges = max(slices(n, range_rows), min(partitions(rows.sparkSession), slices(n, 2048)))
    blocks = cut(packed(rows.repartitionByRange(ranges, "vec_id"), range_rows), "ranges")
    spark, results = rows.sparkSession, []
    for number in range(packs.count()):
        one = packs.withColumn("i", F.row_number().over(Window.orderBy(F.xxhash64("ids"), "n"))).filter(F.col("i") == number + 1).first() if number else packs.orderBy(F.xxhash64("ids"), "n").first()
        sent = spark.sparkContext.broadcast((one["dim"], bytes(one["ids"]), bytes(one["m"])))

        def run(it: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            q_ids, q = _unpack(*sent.value)
            best, some = _Best(len(q), k), False
            for batch in it:
                for dim, ids, m in zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)), strict=True):
                    score_range(best, q_ids, q, *_unpack(dim, ids, m))
                    some = True
            if some:
                x, y = np.nonzero(np.arange(k)[None, :] < best.have[:, None])
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[x]), pa.array(best.id[x, y]), pa.array(best.score[x, y])], names=["query_id", "vec_id", "score"])

        results.append(cut(blocks.mapInArrow(run, "query_id long, vec_id long, score long"), "scores"))
        sent.destroy()
    if not results:
        return rows.limit(0).select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0).cast("long").alias("score"))
    found = results[0]
    for more in results[1:]:
        found = found.unionByName(more)
    drop_cut(blocks)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), F.when(F.col("vec_id") != int(NO_ID), F.col("vec_id")).alias("vec_id"), "score")
