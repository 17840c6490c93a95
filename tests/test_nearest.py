"""Nearest vectors for more queries than are broadcast."""

import math
import random

from gristmill.operators import match


def test_nearest_in_blocks_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(match, "SHARD_ROWS", 16)
    rnd = random.Random(3)
    rows = [(i // 2, i % 3, [rnd.uniform(-1, 1) for _ in range(4)]) for i in range(80)]
    df = spark.createDataFrame(rows, "doc long, g long, v array<double>")
    got = {(r["query"], r["rank"]): (r["doc"], round(r["distance"], 9)) for r in match.nearest(df, df, 3, "doc", "g", "v", max_queries=7).collect()}
    cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))
    want = {}
    for query in range(40):
        best = {}
        for i, g, v in rows:
            for j, h, w in rows:
                if i == query and j != i and g != h:
                    best[j] = min(best.get(j, 9), 1 - cos(v, w))
        for k, (d, j) in enumerate(sorted((d, j) for j, d in best.items())[:3]):
            want[query, k + 1] = (j, round(d, 9))
    assert got == want
