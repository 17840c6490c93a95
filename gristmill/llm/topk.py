"""Exact top-k inner-product search by MaxScore over dimension postings.

A dimension is a term; its posting list is the row of quantised components of a
shard's vectors, by rising id.  A query's bound for a term is the largest
contribution that any vector of the chunk can make there.  A query reads the
lists of its terms by falling reach (the largest less the least contribution).
What the terms not yet read can still add to a vector is bounded twice: by the
sum of their bounds, and by the product of the lengths of query and vector in
those terms.  Terms are essential while the vectors of a chunk have to be read
there; as soon as few vectors are competitive (read part plus bound above the
query's threshold), the remaining, non-essential, lists are only probed at the
places of those vectors, and fewer from list to list.  Each shard keeps k rows
a query; the shards' lists are merged by rank.

Queries and vectors meet in a grid of cells (shard, query block), both of
bounded size, so no task and no broadcast grows with the table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Vectors of a shard and queries of a block (means: rows are dealt by hash), and vectors of the first and of the other chunks.
SHARD_ROWS, BLOCK_QUERIES, FIRST, CHUNK = 8192, 16384, 256, 4096
#: Terms read between two looks at the bounds, and the part of a chunk below which its competitive vectors are probed one by one.
STEP, FEW = 8, 6
#: Below this every partial sum is a whole number that the float type holds exactly.
EXACT32, EXACT64 = 1 << 24, 1 << 53
LONG = (1 << 63) - 1


def quantised(embedding: str, scale: int = 256) -> Column:
    """floor(scale * x) of each component as long; null where the vector is null or holds a null, NaN or infinity."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.when(~F.coalesce(bad, F.lit(True)), F.transform(embedding, lambda x: F.floor(x.cast("double") * scale)))


def largest(x: np.ndarray) -> int:
    """The largest absolute value, also of the least long, which has no positive one."""
    return max(int(x.max(initial=0)), -int(x.min(initial=0)))


class Shard:
    """Posting lists of a shard: lists[term][i] is the component of the i-th vector by rising id; touched counts postings read."""

    def __init__(self, vec_ids: np.ndarray, x: np.ndarray, reach: int):
        order = np.argsort(vec_ids, kind="stable")
        self.ids, x = vec_ids[order], x[order]
        top = largest(x) * reach * max(x.shape[1], 1) * 2
        # Whole numbers beyond what floats hold are added as Python's own.
        self.kind = np.float32 if top < EXACT32 else np.float64 if top < EXACT64 else object
        x = x.astype(self.kind)
        self.chunks = []
        # A small first chunk gives queries a threshold for the others.
        edges = [0, *range(FIRST, len(x), CHUNK), len(x)]
        for a, e in zip(edges, edges[1:], strict=False):
            lists = np.ascontiguousarray(x[a:e].T)
            square = (lists.astype(np.float64) ** 2).sum(axis=0)
            self.chunks.append((self.ids[a:e], lists, lists.max(axis=1), lists.min(axis=1), square))
        self.touched = 0

    def search(self, query_id: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best vectors of other ids: their ids and scores, best first, ties by id; scores beyond a long count as its limit."""
        q = q.astype(self.kind)
        d, wide = len(q), self.kind is object
        best_v, best_s = np.empty(0, np.int64), np.empty(0, object if wide else np.float64)
        for ids, lists, high, low, square in self.chunks:
            threshold = best_s[-1] if len(best_s) == k else None
            bounds, floor = np.maximum(q * high, q * low), np.minimum(q * high, q * low)
            terms = np.argsort(-(bounds - floor), kind="stable")
            ahead = np.concatenate([np.cumsum(bounds[terms][::-1])[::-1], [0]])
            # Lengths of the query in the terms not yet read; a little more than exact, as these are floats.
            length = np.sqrt(np.concatenate([np.cumsum((q.astype(np.float64) ** 2)[terms][::-1])[::-1], [0.0]])) * (1 + 1e-9)
            alive = None  # all
            score, left, slack = np.zeros(len(ids), self.kind), square, 1e-5 * float(square.max(initial=0))
            if threshold is not None and ahead[0] <= threshold:
                continue
            for a in range(0, d, STEP):
                now = terms[a : a + STEP]
                part = lists[now] if alive is None else lists[now[:, None], alive]
                self.touched += part.size
                score = score + q[now] @ part
                if threshold is None:
                    continue
                near = score + ahead[a + STEP if a + STEP < d else d] > threshold
                if not wide:
                    left = left - np.einsum("ij,ij->j", part, part)
                    near &= score + length[min(a + STEP, d)] * np.sqrt(np.maximum(left, 0) + slack) + 1e-6 >= threshold
                # Competitive vectors: while they are many, their lists are essential and read whole.
                if alive is not None or near.sum() * FEW < len(near):
                    alive = np.nonzero(near)[0] if alive is None else alive[near]
                    score, left = score[near], left[near]
                    if not len(alive):
                        break
            at = ids if alive is None else ids[alive]
            if wide:
                score = np.array([min(max(int(s), -LONG - 1), LONG) for s in score], object)
            keep = at != query_id
            if threshold is not None:
                # Ids rise, so a later vector of the threshold's score comes after it.
                keep &= score > threshold
            v, s = np.concatenate([best_v, at[keep]]), np.concatenate([best_s, score[keep]])
            pick = np.argsort(-s, kind="stable")[:k]
            best_v, best_s = v[pick], s[pick]
        return best_v, best_s.astype(np.int64)


def search_cell(vec_ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best vectors of a shard for each query: arrays query_id, vec_id, score."""
    shard = Shard(vec_ids, x, largest(q))
    found = [(i, *shard.search(i, t, k)) for i, t in zip(query_ids, q, strict=True)]
    if not found:
        return (np.empty(0, np.int64),) * 3
    return np.repeat([f[0] for f in found], [len(f[1]) for f in found]).astype(np.int64), np.concatenate([f[1] for f in found]), np.concatenate([f[2] for f in found])


def top_k(vectors: DataFrame, queries: Column, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k largest integer inner products.

    queries: condition on the id column (named vec_id inside) that picks the
    query rows.  Ties go to the smaller vec_id.  Rows without id, and vectors
    that are null or hold null or non-finite components, take no part.  Every
    row counts: rows that share an id are queries and candidates of their own,
    meet no row of the same id, and a query_id's rank runs over the results of
    all its rows; of equal rows each has its place.  Vectors are compared with those of the same
    length; empty ones score 0.  A query without other vectors has no row; empty
    tables give none.
    """
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), quantised(embedding).alias("x")).where("vec_id is not null and x is not null").withColumn("d", F.size("x"))
    picked = rows.where(queries)
    # One pass over the ids alone: n of the vectors, and of the queries.
    ids = vectors.select(F.col(vec_id).cast("long").alias("vec_id"))
    n, m = ids.agg(F.count(F.lit(1)), F.count_if(F.coalesce(queries, F.lit(False)))).first()
    shards = max(1, math.ceil(n / SHARD_ROWS))
    blocks = max(1, math.ceil(m / BLOCK_QUERIES))
    place = lambda m, seed: F.pmod(F.xxhash64("vec_id", "x", F.lit(seed)), F.lit(m)).cast("int")
    data = rows.withColumn("shard", place(shards, 1)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = picked.withColumn("block", place(blocks, 2)).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    cells = ["d", "shard", "block"]

    def cell(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        q, v, s = search_cell(left["vec_id"].to_numpy(), np.stack(left["x"].to_numpy()), right["vec_id"].to_numpy(), np.stack(right["x"].to_numpy()), k)
        return pd.DataFrame({"query_id": q, "vec_id": v, "score": s})

    found = data.groupBy(*cells).cogroup(asked.groupBy(*cells)).applyInPandas(cell, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
