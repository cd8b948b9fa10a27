"""Exact top-k inner product search by a three-phase uniform threshold over slices of the vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

#: Slices of the dimensions (the lists), queries broadcast at once, and rows scored against them at once.
LISTS, QUERY_BLOCK, ROW_BLOCK = 4, 2_048, 2_048


def whole_numbers(vectors: DataFrame, scale: int, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v): floor(scale * x) of every component; rows whose id or vector is null or holds null or non-finite components are left out."""
    ok = F.col(vec_col).isNotNull() & F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.coalesce(ok, F.lit(False)) & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("vec_id"), F.transform(vec_col, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))


def _matrix(vs, dim: int) -> np.ndarray:
    """Rows as float64 if every inner product stays exact in it, else as Python's unbounded integers."""
    m = np.array([v for v in vs], dtype=np.int64).reshape(len(vs), dim)
    return m


def _exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1]
    if most < 2.0**53:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    return (q.astype(object) @ x.astype(object).T)


def _slices(dim: int) -> list[slice]:
    n = max(1, min(LISTS, dim))
    edge = [dim * i // n for i in range(n + 1)]
    return [slice(a, b) for a, b in zip(edge, edge[1:])]


def _blocks(batches: Iterator[pd.DataFrame], dim: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for b in batches:
        b = b[b["v"].map(len) == dim]
        for i in range(0, len(b), ROW_BLOCK):
            part = b.iloc[i : i + ROW_BLOCK]
            yield part["vec_id"].to_numpy(np.int64), _matrix(list(part["v"]), dim)


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest integer inner products, ties to the smaller id.

    The dimensions are cut into LISTS slices; a slice is a list of partial scores.  Phase 1 gathers the best
    entries of every list and, from their full scores, the k-th best of each query: a cutoff that the true
    k-th cannot be below.  Phase 2 broadcasts it; a row can only reach it if some list gives it at least an equal
    share of the cutoff, and only such rows are collected.  Phase 3 resolves their scores exactly and
    keeps the k best.  Queries pass in blocks of QUERY_BLOCK; each block is set against all rows.

    A query is never its own candidate.  Vectors that are null or hold null or non-finite components take no part; vectors
    of another length than a query's are not its candidates.  Rows that repeat an id are separate candidates; as a query the
    smallest vector of the id stands for it.  An empty table
    gives an empty result.
    """
    vecs = whole_numbers(vectors, scale, id_col, vec_col)
    asked = whole_numbers(vectors.where(F.coalesce(is_query, F.lit(False))), scale, id_col, vec_col).groupBy("vec_id").agg(F.min("v").alias("v"))
    spark = vectors.sparkSession
    counts = asked.groupBy(F.size("v").alias("dim")).count().collect()
    found = None
    for dim, n in sorted((r["dim"], r["count"]) for r in counts):
        blocks = -(-n // QUERY_BLOCK)
        for j in range(blocks):
            held = asked.where((F.size("v") == dim) & (F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == j)).collect()
            part = _one_block(spark, vecs, [(r["vec_id"], r["v"]) for r in held], dim, k)
            found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _one_block(spark, vecs: DataFrame, queries: list, dim: int, k: int) -> DataFrame:
    ids = np.array([i for i, _ in queries], np.int64)
    held = spark.sparkContext.broadcast((ids, _matrix([v for _, v in queries], dim)))
    entry = "query_id long, vec_id long, score long"

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Phase 1: the k best of each list, with their full scores; of those the k best of each query in this task."""
        qid, q = held.value
        best = _Best(len(qid), k)
        for vid, x in _blocks(batches, dim):
            parts = [_exact(q[:, s], x[:, s]) for s in _slices(dim)]
            total = sum(parts)
            total_ok = qid[:, None] != vid[None, :]
            for part in parts:
                part = np.where(total_ok, part, np.iinfo(np.int64).min // 4)
                n = min(k, part.shape[1])
                at = np.argpartition(-part, n - 1, axis=1)[:, :n]
                best.add(np.repeat(np.arange(len(qid)), n), vid[at].ravel(), np.take_along_axis(total, at, 1).ravel(), np.take_along_axis(total_ok, at, 1).ravel())
        yield best.frame(qid)

    first = vecs.mapInPandas(gather, entry).distinct()
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    cut = first.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("n")).where(F.col("n") == k)
    least = {r["query_id"]: r["least"] for r in cut.collect()}
    low = np.iinfo(np.int64).min // 4
    cutoff = spark.sparkContext.broadcast(np.array([least.get(int(i), low) for i in ids], np.int64))

    def collect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Phases 2 and 3: entries with a list at or above its share of the cutoff, resolved exactly."""
        (qid, q), least_of = held.value, cutoff.value
        slices = _slices(dim)
        share = -(-least_of // len(slices))  # some list gives at least this much, or the sum stays below the cutoff
        best = _Best(len(qid), k)
        for vid, x in _blocks(batches, dim):
            enough = np.zeros((len(qid), len(vid)), bool)
            for s in slices:
                enough |= _exact(q[:, s], x[:, s]) >= share[:, None]
            enough &= qid[:, None] != vid[None, :]
            a, b = np.nonzero(enough)
            for i in range(0, len(a), 1 << 18):
                u, w = a[i : i + (1 << 18)], b[i : i + (1 << 18)]
                score = _rows_product(q[u], x[w])
                ok = score >= least_of[u]
                best.add(u[ok], vid[w[ok]], score[ok], np.ones(int(ok.sum()), bool))
        yield best.frame(qid)

    return vecs.mapInPandas(collect, entry)


def _rows_product(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, q.shape[1])
    if most < 2.0**62:
        return np.einsum("ij,ij->i", q, x)
    return (q.astype(object) * x.astype(object)).sum(axis=1)


class _Best:
    """The k best entries of each query that a task has seen, higher scores first, ties to the smaller id."""

    def __init__(self, n: int, k: int) -> None:
        self.k, self.held, self.size = k, [], 0

    def add(self, q, v, s, ok) -> None:
        self.held.append((q[ok], v[ok], s[ok]))
        self.size += int(ok.sum())
        if self.size > 4_000_000:
            self.trim()

    def trim(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q, v, s = (np.concatenate([h[i] for h in self.held]) if self.held else np.empty(0, np.int64) for i in range(3))
        at = np.lexsort((v, -s, q))
        q, v, s = q[at], v[at], s[at]
        if len(q):
            start = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
            rank = np.arange(len(q)) - np.repeat(start, np.diff(np.r_[start, len(q)]))
            # a phase 1 entry may come from several lists: leave room for its repeats
            keep = rank < self.k * LISTS
            q, v, s = q[keep], v[keep], s[keep]
        self.held, self.size = [(q, v, s)], len(q)
        return q, v, s

    def frame(self, qid: np.ndarray) -> pd.DataFrame:
        q, v, s = self.trim()
        return pd.DataFrame({"query_id": qid[q.astype(np.int64)] if len(q) else np.empty(0, np.int64), "vec_id": v, "score": s}).astype("int64")
