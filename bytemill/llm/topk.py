"""Exact top-k by inner product with distributed histogram selection.

Components become floor(scale * x). Queries go in blocks of BLOCK, and so many blocks are broadcast together as make GROUP queries at
most; that is the only loop of the driver. For one group:

1. each task holds its vectors, HELD bytes at a time, scores them against one block after the other and counts the scores of each query in BINS
   bins over the possible range. It sends only the bins from its own kth best score up, which loses nothing: the kth best of all is no
   lower. So at most k counts a query and piece leave a task;
2. the counts are summed and cumulated in Spark, and the driver gets one row a query: the bin that holds its kth best and how many scores lie
   above; that bin becomes the range of the next round, until bins are one score wide, so the kth value and the number
   above it are exact;
3. a last pass keeps the scores above that value and, of those equal to it, each task's smallest ids; the
   ties that remain are broken by id. At most k rows a query and task leave the tasks, however many copies tie.

A vector that is null, empty, or holds null or non-finite components takes no part, nor one without an id; vectors
of other lengths than a query are no candidates for it. Rows with repeated ids are candidates each; a query never
meets rows of its own id. Scores are exact: in float64 while all sums stay below 2**53, else in Python's integers. Scores beyond 64 bits are
cut to them in the result and then rank by id. An empty table, or no queries, give an empty result; other columns are ignored, whatever their
names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bytemill.llm.shared import kept

BLOCK, GROUP, BINS, ROWS, HELD = 1024, 65_536, 512, 2048, 64 << 20


def vectors(batch: pa.RecordBatch, scale: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and integral vectors (float64, or object where they are large) of one length, ROWS at a time."""
    column = batch.column("v")
    at, values = column.offsets.to_numpy().astype(np.int64), column.values
    flat = values.cast(pa.float64()).to_numpy(zero_copy_only=False) if len(values) else np.zeros(0)
    known = ~column.is_null().to_numpy(zero_copy_only=False) & ~batch.column("id").is_null().to_numpy(zero_copy_only=False)
    ids = batch.column("id").fill_null(0).to_numpy(zero_copy_only=False)
    size = np.diff(at)
    for n in np.unique(size[known & (size > 0)]).tolist():
        rows = np.flatnonzero(known & (size == n))
        for i in range(0, len(rows), ROWS):
            some = rows[i : i + ROWS]
            x = flat[at[some][:, None] + np.arange(n)]
            fine = np.isfinite(x).all(axis=1)
            x = np.floor(scale * x[fine])
            if len(x) and np.abs(x).max() >= 1 << 20:
                x = np.array([[int(c) for c in r] for r in x], dtype=object)
            yield ids[some][fine], x


def scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of x and q."""
    if x.dtype == object or q.dtype == object or x.shape[1] * np.abs(x).max(initial=1) * np.abs(q).max(initial=1) >= 1 << 53:
        whole = lambda a: np.array([[int(c) for c in r] for r in a], dtype=object)
        return whole(x) @ whole(q).T
    return x @ q.T


def _long(score) -> int:
    return min(max(int(score), -(1 << 63)), (1 << 63) - 1)


class Block:
    """Queries of one length with what is known so far: the range [low, low + span) of each one's kth best score and how many scores lie above it.

    A span of 0 marks a query as settled: low is its kth best score, or lies below all scores if there are fewer than k.
    """

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int, norm: int):
        self.ids, self.q, self.k = ids, q, k
        reach = [(math.isqrt(sum(int(c) ** 2 for c in r)) + 1) * norm + 1 for r in q]
        self.low, self.span, self.above = [-x for x in reach], [2 * x for x in reach], [0] * len(ids)

    def width(self, i: int) -> int:
        return max(1, -(-self.span[i] // BINS))

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        kind = object if max(map(abs, [*self.low, *self.span])) >= 1 << 52 else np.float64
        return np.array(self.low, dtype=kind), np.array(self.span, dtype=kind), np.array([self.width(i) for i in range(len(self.ids))], dtype=kind)

    def narrow(self, found: dict[int, tuple[int, int]]) -> bool:
        """Takes, for each query that has k scores, the bin of the kth best and how many of this range's scores lie above it; whether any query is still open."""
        for i in range(len(self.ids)):
            if not self.span[i]:
                continue
            if i in found:
                at, over = found[i]
                width = self.width(i)
                self.above[i] += over
                self.low[i], self.span[i] = self.low[i] + at * width, 0 if width == 1 else width
            else:
                self.low[i], self.span[i] = self.low[i] - 1, 0
        return any(self.span)


def _counts(shared, scale: float):
    """(block, i, bin, need, n): need is how many scores of its range a query still needs for its kth."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def answer() -> Iterator[pa.RecordBatch]:
            for n, b in enumerate(shared.value):
                low, span, width = b.arrays()
                h = np.zeros((len(b.ids), BINS), dtype=np.int64)
                for ids, x in held:
                    if x.shape[1] == b.q.shape[1]:
                        past = scores(x, b.q) - low
                        ok = ((past >= 0) & (past < span) & (ids[:, None] != b.ids)).astype(bool)
                        cell = np.nonzero(ok)[1] * BINS + (past // width)[ok].astype(np.int64)
                        h += np.bincount(cell, minlength=h.size).reshape(h.shape)
                over = h[:, ::-1].cumsum(axis=1)[:, ::-1] - h  # in higher bins, here
                need = np.array([b.k - a for a in b.above])
                i, at = np.nonzero((h > 0) & (over < need[:, None]))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), n), pa.int32()), pa.array(i, pa.int32()), pa.array(at, pa.int32()), pa.array(need[i], pa.int64()), pa.array(h[i, at])], names=["block", "i", "bin", "need", "n"])

        for batch in batches:
            for ids, x in vectors(batch, scale):
                if len(x):
                    held.append((ids, x))
                    size += x.nbytes
                if size >= HELD:
                    yield from answer()
                    held, size = [], 0
        if held:
            yield from answer()

    return run


def _best(shared, scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = shared.value
        ties: dict[tuple[int, int], list[int]] = {}
        for batch in batches:
            for ids, x in vectors(batch, scale):
                for n, b in enumerate(blocks):
                    if x.shape[1] != b.q.shape[1] or not len(x):
                        continue
                    s, low = scores(x, b.q), b.arrays()[0]
                    other = ids[:, None] != b.ids
                    r, i = np.nonzero(((s > low) & other).astype(bool))
                    if len(r):
                        yield pa.RecordBatch.from_arrays([pa.array(b.ids[i]), pa.array(i * len(blocks) + n, pa.int32()), pa.array(ids[r]), pa.array([_long(v) for v in s[r, i]], type=pa.int64())], names=["query_id", "row", "vec_id", "score"])
                    r, i = np.nonzero(((s == low) & other).astype(bool))
                    for c in np.unique(i).tolist():
                        need = b.k - b.above[c]
                        ties[n, c] = sorted([*ties.get((n, c), []), *ids[r[i == c]].tolist()])[:need]
        for (n, c), found in ties.items():
            m, b = len(found), blocks[n]
            yield pa.RecordBatch.from_arrays([pa.array([int(b.ids[c])] * m), pa.array([c * len(blocks) + n] * m, pa.int32()), pa.array(found, type=pa.int64()), pa.array([_long(b.low[c])] * m, type=pa.int64())], names=["query_id", "row", "vec_id", "score"])

    return run


def _norm(scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = 0
        for batch in batches:
            for _, x in vectors(batch, scale):
                if len(x):
                    most = max(most, math.isqrt(int(max((x * x).sum(axis=1)))) + 1)
        yield pa.RecordBatch.from_arrays([pa.array([str(most)])], names=["norm"])

    return run


def top_k(df: DataFrame, queries: DataFrame, k: int = 5, scale: float = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows of df for each row of queries (both with id_col and vec_col)."""
    sc = df.sparkSession.sparkContext
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"))
    asked = queries.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"))
    norm = max((int(r["norm"]) for r in rows.mapInArrow(_norm(scale), "norm string").select("norm").distinct().collect()), default=0)
    groups = max(1, math.ceil(asked.count() / GROUP))
    asked = asked.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(groups)))
    done = None
    for part in range(groups):
        by: dict[int, list] = {}
        for batch in asked.where(F.col("part") == part).select("id", "v").toArrow().to_batches():
            for ids, q in vectors(batch, scale):
                by.setdefault(q.shape[1], []).append((ids, q))
        blocks: list[Block] = []
        for x in by.values():
            ids, q = np.concatenate([i for i, _ in x]), np.concatenate([q for _, q in x])
            blocks += [Block(ids[i : i + BLOCK], q[i : i + BLOCK], k, norm) for i in range(0, len(ids), BLOCK)]
        open_ = bool(blocks)
        while open_:
            counts = rows.mapInArrow(_counts(sc.broadcast(blocks), scale), "block int, i int, bin int, need long, n long").groupBy("block", "i", "bin", "need").agg(F.sum("n").alias("n"))
            upto = F.sum("n").over(Window.partitionBy("block", "i").orderBy(F.desc("bin")))
            found: list[dict[int, tuple[int, int]]] = [{} for _ in blocks]
            for r in counts.withColumn("upto", upto).where("upto >= need and upto - n < need").select("block", "i", "bin", (F.col("upto") - F.col("n")).alias("over")).collect():
                found[r["block"]][r["i"]] = r["bin"], r["over"]
            open_ = any([b.narrow(f) for b, f in zip(blocks, found, strict=True)])
        one = rows.mapInArrow(_best(sc.broadcast(blocks), scale), "query_id long, row int, vec_id long, score long")
        rank = F.row_number().over(Window.partitionBy("query_id", "row").orderBy(F.desc("score"), "vec_id"))
        one = one.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        if groups > 1:
            one = kept(one)
        done = one if done is None else done.union(one)
    return done
