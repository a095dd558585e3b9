"""Exact top-k inner products by Fagin's threshold algorithm over sorted lists, one list for each dimension."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmark.llm.common import cut


class Lists:
    """Vectors of a block and, for each dimension, their places by value, descending; the values at some depths from either end."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, x: np.ndarray):
        self.ids, self.rows, (self.n, self.d) = ids, rows, x.shape
        # whole numbers whose products and their sums stay below 2**24 are exact in half the space
        self.x = x.astype(np.float32) if self.n and self.d * float(np.abs(x).max()) ** 2 < 1 << 24 else x
        self.order = np.argsort(-x.T, axis=1, kind="stable").astype(np.int32)
        depths, t = [], 16
        while t < self.n:
            depths.append(t)
            t += max(16, t // 16)
        self.depths = np.array([*depths, self.n])
        values = np.take_along_axis(x.T, self.order, axis=1)
        self.high, self.low = values[:, self.depths - 1], values[:, self.n - self.depths]

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """For each query and depth the most that a vector can score that is in no list up to there."""
        return np.maximum(q, 0) @ self.high + np.minimum(q, 0) @ self.low


def threshold_topk(lists: Lists, q: np.ndarray, own: int, k: int, bounds: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """Ids and scores of the k best vectors for q but row `own`, by score descending, then id; and the depth read.

    Sorted access goes down the lists of q's components that aren't 0 side by side, from the top where the component is
    positive and from the bottom where it is negative, and is resumed where it stopped. A vector is scored in full when
    it is first seen. What hasn't been seen scores at most the sum of the products at the lists' present places; the
    search ends when that bound is less than the k-th score, so that vectors tied with the k-th are all seen. The k-th
    score so far tells a depth at which the search must end; half the way there is read before it is asked again.
    """
    up, down = np.flatnonzero(q > 0), np.flatnonzero(q < 0)
    if not len(up) and not len(down):  # all scores are 0
        rest = np.sort(lists.ids[lists.rows != own])[:k]
        return rest, np.zeros(len(rest)), 0
    bounds = lists.bounds(q[None])[0] if bounds is None else bounds
    exact = q.astype(lists.x.dtype) if lists.d * float(np.abs(q).max()) ** 2 < 1 << 24 else q
    seen = lists.rows == own
    ids, scores, kth = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=lists.x.dtype), -np.inf
    at, step = 0, 0
    while True:
        to = lists.depths[step]
        fresh = np.zeros(lists.n, dtype=bool)
        fresh[lists.order[up, at:to].ravel()] = True
        fresh[lists.order[down, lists.n - to : lists.n - at].ravel()] = True
        fresh &= ~seen
        seen |= fresh
        rows = np.flatnonzero(fresh)
        found = np.take(lists.x, rows, axis=0) @ exact
        good = found >= kth
        ids, scores, at = np.concatenate((ids, lists.ids[rows[good]])), np.concatenate((scores, found[good])), to
        if len(scores) >= k:
            kth = -np.partition(-scores, k - 1)[k - 1]
            good = scores >= kth
            ids, scores = ids[good], scores[good]
        ends = np.flatnonzero(bounds < kth)
        if at == lists.n or len(ends) and ends[0] <= step:
            break
        last = ends[0] if len(ends) else len(lists.depths) - 1
        step = min(last, max(step + 1, int(np.searchsorted(lists.depths, (at + lists.depths[last]) // 2))))
    best = np.lexsort((ids, -scores))[:k]
    return ids[best], scores[best].astype(np.float64), int(at)


OUT = "query_row long, query_id long, vec_id long, score double, depth long"


def _matrix(column: pd.Series, d: int) -> np.ndarray:
    out = np.zeros((len(column), d))
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    return out


def _search(k: int, d: int):
    """Rows sorted by block, a block's vectors before its queries -> the k best of the block for every query."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, held, lists = None, [], None
        for f in batches:
            for b, part in f.groupby("b", sort=True):
                if b != block:
                    block, held, lists = b, [], None
                held.append(part[~part["asks"]])
                asks = part[part["asks"]]
                if not len(asks):
                    continue
                if lists is None:
                    base = pd.concat(held)
                    lists = Lists(base["vec_id"].to_numpy(np.int64), base["row"].to_numpy(np.int64), _matrix(base["v"], d))
                queries = _matrix(asks["v"], d)
                found = [threshold_topk(lists, *x, k, b) for *x, b in zip(queries, asks["row"].tolist(), lists.bounds(queries), strict=True)]
                of = np.array([len(ids) for ids, _, _ in found])
                yield pd.DataFrame({
                    "query_row": np.repeat(asks["row"].to_numpy(), of), "query_id": np.repeat(asks["vec_id"].to_numpy(), of),
                    "vec_id": np.concatenate([ids for ids, _, _ in found]), "score": np.concatenate([s for _, s, _ in found]), "depth": np.repeat([t for *_, t in found], of),
                })

    return run


def exact_topk(vectors: DataFrame, asks: Column, k: int = 20, block: int = 1 << 13) -> DataFrame:
    """For every row that `asks` holds for, its k highest inner products with all other rows: query_id, rank, vec_id, score, depth.

    vectors has vec_id long and v array<double> of whole numbers (sums stay exact below 2**53); asks is a condition on
    vec_id. Rows are dealt once to blocks of about `block` vectors; a task sorts its block's lists once and streams all
    queries through them, so queries are sent to each block and vectors to one. A block gives each query its own k best,
    of which the k best of all blocks are the answer; depth is how far that block's lists were read.

    Every row but the query's own is a candidate, also one that repeats its vec_id; rows that repeat a vec_id are
    queries of their own. Null ids and null vectors, and vectors with null, NaN or infinite components, take no part;
    shorter vectors are filled up with zeros; ties go to the smaller vec_id; fewer than k candidates are all returned;
    empty tables give no rows. Extra columns are ignored.
    """
    inf = float("inf")
    whole = F.col("v").isNotNull() & F.col("vec_id").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (x == inf) | (x == -inf))
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("v").cast("array<double>").alias("v")).where(whole)
    base = cut(own.withColumn("row", F.monotonically_increasing_id()))
    n, d = base.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    blocks = max(1, -(-n // block))
    dealt = base.withColumn("b", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")).withColumn("asks", F.lit(False))
    sent = base.where(asks).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("asks", F.lit(True))
    found = dealt.unionByName(sent).repartition(blocks, "b").sortWithinPartitions("b", "asks").mapInPandas(_search(k, d or 1), OUT)
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", F.col("score").cast("long").alias("score"), "depth")


__all__ = ["Lists", "exact_topk", "threshold_topk"]
