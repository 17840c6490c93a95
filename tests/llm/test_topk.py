"""Top-k search: postings read, and rows that share an id."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gristmill.llm import topk


def ranked(ids, x, query_id, q, k):
    s = x.astype(object) @ q.astype(object)
    return sorted(((-min(max(int(v), -topk.LONG - 1), topk.LONG), int(i)) for v, i in zip(s, ids, strict=True) if i != query_id))[:k]


@pytest.mark.parametrize("scale", [1, 1 << 12, 1 << 30])
def test_postings_read_are_fewer_than_the_dense_product(scale):
    rnd = np.random.default_rng(1)
    x = rnd.normal(size=(6000, 64))
    x = np.floor(x / np.linalg.norm(x, axis=1)[:, None] * 256).astype(np.int64) * scale
    ids, n = rnd.permutation(6000), 60 if scale < 1 << 20 else 2
    shard = topk.Shard(ids, x, topk.largest(x[:n]))
    for i, q in zip(ids[:n], x[:n], strict=True):
        v, s = shard.search(i, q, 5)
        assert [(-int(b), int(a)) for a, b in zip(v, s, strict=True)] == ranked(ids, x, i, q, 5)
    if scale < 1 << 20:  # with larger ones only the sums of bounds cut lists short
        assert shard.touched < 0.75 * n * x.size


def test_clusters_read_a_part_of_the_postings():
    rnd = np.random.default_rng(2)
    centre = rnd.normal(size=(40, 64))
    x = np.floor(centre[rnd.integers(0, 40, 8000)] * 100 + rnd.normal(size=(8000, 64)) * 10).astype(np.int64)
    ids = np.arange(8000)
    shard = topk.Shard(ids, x, topk.largest(x))
    for i in range(50):
        v, s = shard.search(i, x[i], 5)
        assert [(-int(b), int(a)) for a, b in zip(v, s, strict=True)] == ranked(ids, x, i, x[i], 5)
    assert shard.touched < 0.4 * 50 * x.size


def test_rows_that_share_an_id(shipped):
    rnd = np.random.default_rng(5)
    rows = [(int(i), rnd.normal(size=8).round(2).tolist()) for i in [*range(120), *[50] * 3, *[7] * 6, 100]]
    rows += [rows[7], rows[50], rows[60], rows[60]]
    df = shipped.createDataFrame(rows, "vec_id long, embedding array<float>")
    q = [(i, np.floor(256 * np.array(v, np.float32).astype(np.float64)).astype(np.int64)) for i, v in rows]
    want = {}
    for i, a in q:
        if i % 50 == 0:
            want.setdefault(i, []).extend((-int(a @ b), j) for j, b in q if j != i)
    got = {}
    for r in topk.top_k(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((-r["score"], r["vec_id"]))
    assert got == {i: sorted(v)[:5] for i, v in want.items()}
