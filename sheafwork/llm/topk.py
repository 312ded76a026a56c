"""Exact top-k search by inner product, by distributed histogram selection.

Every query is scored against every candidate, again in each round; what moves
between tasks is never scores but counts: each round narrows the range that
holds each query's k-th score to one bin of a global histogram, until few
candidates are at or above it.  Then those are kept and ties are broken by id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Queries that are scored together: what a task holds of them is bounded, and
#: one round of one block is one job over all candidates.
BLOCK_QUERIES = 8192
BINS = 512
#: Scores that a task holds at a time.
HELD_SCORES = 2_000_000


def usable(vector: Column) -> Column:
    """Not null, and all components finite."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.coalesce(vector.isNotNull() & F.forall(vector, fine), F.lit(False))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


_MOST = 2**63 - 1


class _Scorer:
    """Integer inner products of a block of queries with batches of candidates.
    What a long cannot hold becomes the nearest that it can."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray):
        self.ids, self.queries = ids, queries

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        n, width = self.queries.shape
        most = np.abs(self.queries).max(initial=0)
        for batch in batches:
            ids = batch["vec_id"].to_numpy(zero_copy_only=False)
            whole = _matrix(batch["vector"], width)
            step = max(1, HELD_SCORES // n)
            for at in range(0, len(ids), step):
                part = whole[at : at + step]
                bound = width * most * np.abs(part).max(initial=0)
                if bound < 2**53:
                    scores = (self.queries @ part.T).astype(np.int64)
                elif bound < 2**62:
                    scores = self.queries.astype(np.int64) @ part.T.astype(np.int64)
                else:
                    exact = np.frompyfunc(int, 1, 1)(self.queries) @ np.frompyfunc(int, 1, 1)(part).T
                    scores = np.clip(exact, -_MOST, _MOST).astype(np.int64)
                yield ids[at : at + step], scores


def _histogram(block: _Scorer, low: np.ndarray, width: np.ndarray, k: int):
    """Counts (query, bin, n) of a task, from the top bin down to the task's own
    k-th score: lower bins cannot hold the global one.  Bin BINS is all above."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(block.ids)
        held = np.zeros(n * (BINS + 1), np.int64)
        for ids, scores in block(batches):
            # Scores may lie further apart than a long can say: unsigned differences can.
            apart = scores.astype(np.uint64) - low.astype(np.uint64)[:, None]
            bins = np.minimum(apart // width.astype(np.uint64)[:, None], np.uint64(BINS)).astype(np.int64)
            bins[(scores < low[:, None]) | (ids[None, :] == block.ids[:, None])] = -1
            rows, columns = np.nonzero(bins >= 0)
            held += np.bincount(rows * (BINS + 1) + bins[rows, columns], minlength=len(held))
        held = held.reshape(n, BINS + 1)[:, ::-1]
        before = np.cumsum(held, 1) - held
        rows, columns = np.nonzero((held > 0) & (before < k))
        yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(BINS - columns), pa.array(held[rows, columns])], names=["q", "bin", "n"])

    return counts


def _survivors(block: _Scorer, low: np.ndarray, k: int):
    """Candidates at or above each query's bound, a task's k best at most."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [np.zeros((0, 3), np.int64)]
        for ids, scores in block(batches):
            q, c = np.nonzero((scores >= low[:, None]) & (ids[None, :] != block.ids[:, None]))
            best = [np.concatenate([*best, np.stack([q, -scores[q, c], ids[c]], 1)])]
            if len(best[0]) > 4 * k * len(low):
                best = [_first(best[0], k)]
        out = _first(best[0], k)
        yield pa.RecordBatch.from_arrays([pa.array(block.ids[out[:, 0]]), pa.array(out[:, 2]), pa.array(-out[:, 1])], names=["query_id", "vec_id", "score"])

    return rows


def _first(rows: np.ndarray, k: int) -> np.ndarray:
    """The first k rows of each query in order of (score downwards, id)."""
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    start = np.searchsorted(rows[:, 0], rows[:, 0], "left")
    return rows[np.arange(len(rows)) - start < k]


def _floored(x: Column) -> Column:
    """The greatest whole number not above x, as double; F.floor ends at long."""
    return F.when(F.abs(x) < float(1 << 53), F.floor(x).cast("double")).otherwise(x)


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, *, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """The k best candidates of each query: query_id, rank (from 1), vec_id, score.

    Components become floor(scale * x).  A query's own id is no candidate; all
    candidates are returned if fewer than k.  Equal scores go by smaller id.
    Vectors that are null or hold null or non-finite components take no part,
    nor do candidates of another length than the query's: empty vectors meet
    each other with score 0.  A score beyond a long becomes the nearest long.
    A query id that occurs twice counts once.  An empty table gives no rows.

    Whole vectors are written once.  Queries are dealt into blocks of about
    BLOCK_QUERIES, whose vectors are sent to the tasks: the bound of what is
    sent.  A round of a block is one job over all candidates, and a block's
    rows are written before the next one starts.
    """
    spark = vectors.sparkSession
    own = lambda df: df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector")).where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    whole = lambda df: df.withColumn("vector", F.transform("vector", lambda x: _floored(x * scale)))
    everyone = common.written(whole(own(vectors)), "topk-vectors")
    asked = common.written(whole(own(queries)).groupBy("vec_id").agg(F.min("vector").alias("vector")), "topk-queries")
    path = common.new_path(spark, "topk-result")
    schema = "query_id long, rank int, vec_id long, score long"
    spark.createDataFrame([], schema).write.parquet(path)
    for width, total in sorted((r[0], r[1]) for r in asked.groupBy(F.size("vector")).count().collect()):
        candidates = everyone.where(F.size("vector") == width)
        norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))
        longest = candidates.agg(F.max(norm)).first()[0] or 0.0
        blocks = -(-total // BLOCK_QUERIES)
        for b in range(blocks):
            held = asked.where((F.size("vector") == width) & (F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b)).orderBy("vec_id").toArrow()
            if held.num_rows == 0:
                continue
            scorer = _Scorer(held["vec_id"].to_numpy(), _matrix(held["vector"].combine_chunks(), width))
            low = _bounds(candidates, scorer, longest, k)
            last = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
            rows = candidates.mapInArrow(_survivors(scorer, low, k), "query_id long, vec_id long, score long")
            rows = rows.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k)
            rows.select("query_id", "rank", "vec_id", "score").write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def _bounds(candidates: DataFrame, scorer: _Scorer, longest: float, k: int) -> np.ndarray:
    """A score for each query of the block at or above which there are at least
    k candidates (or all), and not many more unless they tie."""
    # Python's integers: the range may be wider than a long can say.
    with np.errstate(over="ignore", invalid="ignore"):
        reach = np.sqrt((scorer.queries**2).sum(1)) * longest
    most = [min(int(x) + 1, _MOST) for x in np.minimum(np.ceil(np.nan_to_num(reach, nan=2.0**63)), 2.0**63)]
    low, high = np.array([-m for m in most], object), np.array([m + 1 for m in most], object)
    open_ = np.ones(len(low), bool)
    while open_.any():
        width = np.maximum(-(-(high - low) // BINS), 1)
        counted = candidates.mapInArrow(_histogram(scorer, low.astype(np.int64), width.astype(np.int64), k), "q long, bin long, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))
        down = Window.partitionBy("q").orderBy(F.desc("bin"))
        reached = counted.withColumn("reach", F.sum("n").over(down)).where(F.col("reach") >= k)
        at = reached.groupBy("q").agg(F.max_by(F.struct("bin", "reach"), "bin").alias("at")).select("q", "at.bin", "at.reach")
        found = {r["q"]: (r["bin"], r["reach"]) for r in at.collect()}
        for q in np.flatnonzero(open_):
            if q not in found:
                open_[q] = False  # fewer than k candidates: all of them
                continue
            bin_, reach = found[q]
            low[q], high[q] = low[q] + bin_ * width[q], low[q] + (bin_ + 1) * width[q]
            open_[q] = width[q] > 1 and reach > 4 * k
    return low.astype(np.int64)
