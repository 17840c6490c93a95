"""Match scores, similarity and vector search on sets and chunks."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weight of the ballast coordinate on the posting's side, and its least number of skills.
BALLAST, LEAST = 4, 6
#: Chunks of a shard (mean: rows are dealt by hash).
SHARD_ROWS = 8192


def match_percent(wanted: Column, held: Column) -> Column:
    """Share of the wanted list that is held, in whole percent; case makes no difference, repeats count; null for an empty list."""
    low = F.transform(held, F.lower)
    hits = F.size(F.filter(wanted, lambda w: F.array_contains(low, F.lower(w))))
    return F.when(F.size(wanted) > 0, F.round(hits * 100.0 / F.size(wanted)).cast("long"))


def ballast_cosine(wanted: Column, held: Column) -> Column:
    """Cosine of the skill sets where the posting also has a ballast coordinate of 4 * max(n, 6); 0 without skills."""
    w, h = F.array_distinct(wanted), F.array_distinct(held)
    n, p = F.size(w), F.size(h)
    ballast = BALLAST * F.greatest(n, F.lit(LEAST))
    return F.when((n > 0) & (p > 0), F.size(F.array_intersect(w, h)) / (F.sqrt(p) * F.sqrt(n + ballast * ballast))).otherwise(F.lit(0.0))


def min_cosine(percent: Column, n: Column, p: Column) -> Column:
    """The cosine that a match of percent has at least."""
    ballast = BALLAST * F.greatest(n, F.lit(LEAST))
    return F.ceil(percent * n / 100.0) / (F.sqrt(p) * F.sqrt(n + ballast * ballast))


def job_match(wanted: Column, held: Column, adjacent: dict[str, list[str]]) -> Column:
    """Struct (exact, adjacent, missing, coverage): adjacent skills count half; coverage in whole percent."""
    near = F.create_map(*(x for k, v in sorted(adjacent.items()) for x in (F.lit(k), F.array(*map(F.lit, v))))) if adjacent else F.create_map().cast("map<string,array<string>>")
    low = F.transform(F.array_distinct(wanted), F.lower)
    mine = F.transform(held, F.lower)
    exact = F.filter(low, lambda w: F.array_contains(mine, w))
    rest = F.filter(low, lambda w: ~F.array_contains(mine, w))
    via = F.filter(rest, lambda w: F.coalesce(F.arrays_overlap(F.element_at(near, w), mine), F.lit(False)))
    missing = F.array_except(rest, via)
    coverage = F.when(F.size(low) > 0, F.round((F.size(exact) + 0.5 * F.size(via)) * 100.0 / F.size(low)).cast("long"))
    return F.struct(exact.alias("exact"), via.alias("adjacent"), missing.alias("missing"), coverage.alias("coverage"))


def category_score(parts: dict[str, tuple[Column, float]]) -> Column:
    """Struct (score, passed, warned, failed) of weighted parts from 0 to 1; a part passes from 0.8 and fails below 0.5."""
    total = sum(w for _, w in parts.values())
    value = sum((F.coalesce(c, F.lit(0.0)) * w for c, w in parts.values()), F.lit(0.0)) / total
    tally = lambda f: sum((f(F.coalesce(c, F.lit(0.0))).cast("int") for c, _ in parts.values()), F.lit(0))
    return F.struct(F.round(value * 100, 8).alias("score"), tally(lambda c: c >= 0.8).alias("passed"), tally(lambda c: (c < 0.8) & (c >= 0.5)).alias("warned"), tally(lambda c: c < 0.5).alias("failed"))


def covered(have: Column, needed: Column, percent: int = 60) -> Column:
    """Whether a bundle is covered to percent at least."""
    return F.size(F.array_intersect(have, needed)) * 100 >= F.size(needed) * percent


def market_coverage(postings: DataFrame, held: list[str], skills: str = "skills") -> DataFrame:
    """total, covered (with a held skill), percent: of postings with skills."""
    have = F.array(*map(F.lit, held))
    rows = postings.where(F.size(skills) > 0)
    return rows.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.arrays_overlap(skills, have)).alias("covered")).withColumn("percent", F.round(F.col("covered") * 100.0 / F.nullif(F.col("total"), F.lit(0)), 2))


def coverage_gaps(postings: DataFrame, held: list[str], k: int, skills: str = "skills") -> DataFrame:
    """skill, unlocked: the k skills that would newly cover most postings."""
    have = F.array(*map(F.lit, held))
    rest = postings.where((F.size(skills) > 0) & ~F.arrays_overlap(skills, have))
    return rest.select(F.explode(F.array_distinct(skills)).alias("skill")).groupBy("skill").agg(F.count(F.lit(1)).alias("unlocked")).orderBy(F.desc("unlocked"), "skill").limit(k)


def dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, v: acc + v)


def _cell_nearest(left: pd.DataFrame, right: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k documents nearest to each query among one cell's chunks."""
    out: list[tuple] = []
    if len(left) and len(right):
        left = left.sort_values("doc", kind="stable")
        x, docs, groups = np.stack(left["v"].to_numpy()).astype(float), left["doc"].to_numpy(), left["g"].to_numpy()
        x = x / np.sqrt((x * x).sum(axis=1))[:, None]
        first = np.nonzero(np.concatenate([[True], docs[1:] != docs[:-1]]))[0]
        for query, rows in right.groupby("query", sort=False):
            v = np.stack(rows["v"].to_numpy()).astype(float)
            far = 1 - (v / np.sqrt((v * v).sum(axis=1))[:, None]) @ x.T
            far[rows["qg"].to_numpy()[:, None] == groups[None, :]] = np.inf
            best = np.minimum.reduceat(far.min(axis=0), first)
            best[docs[first] == query] = np.inf
            order = np.lexsort((docs[first], best))[:k]
            out += [(query, docs[first[i]], best[i]) for i in order if np.isfinite(best[i])]
    return pd.DataFrame(out, columns=["query", "doc", "distance"])


def nearest(chunks: DataFrame, queries: DataFrame, k: int, doc: str, group: str, vector: str, max_queries: int = 4096) -> DataFrame:
    """query, doc, distance, rank: the k documents of another group nearest to each query document, by the least cosine distance of their chunks.

    queries: the same columns.  Queries and chunks meet in a grid of cells
    (shard, block of queries) of bounded size, in which distances are products of
    matrices and k documents a query are kept; all chunks of a document lie in
    one shard.  Null vectors, documents and groups take no part; zero vectors are
    near nothing.  Ties go to the smaller doc.
    """
    named = lambda df, *names: df.select(F.col(doc).alias(names[0]), F.col(group).alias(names[1]), F.col(vector).alias("v")).dropna().where(dot("v", "v") > 0)
    d, q = named(chunks, "doc", "g"), named(queries, "query", "qg")
    blocks, shards = max(1, math.ceil(queries.count() / max_queries)), max(1, math.ceil(chunks.count() / SHARD_ROWS))
    place = lambda n, c: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    d = d.withColumn("shard", place(shards, "doc")).withColumn("block", every(blocks))
    q = q.withColumn("block", place(blocks, "query")).withColumn("shard", every(shards))
    ids = dict(q.dtypes)["query"]
    cell = lambda left, right: _cell_nearest(left, right, k)
    best = d.groupBy("shard", "block").cogroup(q.groupBy("shard", "block")).applyInPandas(cell, f"query {ids}, doc {dict(d.dtypes)['doc']}, distance double")
    w = Window.partitionBy("query").orderBy("distance", "doc")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def progress(eligible: Column, done: Column, depth: Column, per_minute: Column) -> Column:
    """Struct (covered, eta_seconds): covered within [0, eligible]; no eta without a rate."""
    return F.struct(F.greatest(F.lit(0), F.least(done, eligible)).alias("covered"), F.when(per_minute > 0, depth / per_minute * 60).alias("eta_seconds"))
