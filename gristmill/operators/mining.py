"""Word groups and suggestions mined from texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions.text import suggestion_title


def word_groups(df: DataFrame, doc: str, text: Column, sizes: tuple[int, ...] = (2, 3), stop: tuple[str, ...] = (), min_docs: int = 2, sources: str | None = None) -> DataFrame:
    """words, df, sources: groups of neighbouring words by the documents that hold them, each once a document.

    Groups neither start nor end with a stop word, nor hold a number.
    """
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    rows = df.select(F.col(doc).alias("doc"), F.col(sources or doc).cast("string").alias("src"), words.alias("w"))
    parts = []
    for n in sizes:
        at = F.when(F.size("w") >= n, F.sequence(F.lit(1), F.size("w") - (n - 1))).otherwise(F.array().cast("array<int>"))
        groups = F.transform(at, _slice(n))
        ok = F.filter(groups, lambda g: ~g[0].isin(*stop) & ~F.element_at(g, -1).isin(*stop) & ~F.exists(g, lambda w: w.rlike("^[0-9]+$")))
        parts.append(F.transform(ok, lambda g: F.array_join(g, " ")))
    # Outer: else the planner repeats the making of the words inside a filter.
    found = rows.select("doc", "src", F.explode_outer(F.array_distinct(F.concat(*parts))).alias("words")).where("words is not null")
    out = found.groupBy("words").agg(F.count(F.lit(1)).alias("df"), F.array_sort(F.collect_set("src")).alias("sources")).where(F.col("df") >= min_docs)
    return out if sources else out.drop("sources")


def _slice(n: int):
    return lambda i: F.slice("w", i, n)


def suggestions(df: DataFrame, title: str, floor: int, k: int) -> DataFrame:
    """title, n: titles counted as they stand first, then normalised and merged; below the floor left out; the k commonest."""
    raw = df.groupBy(title).agg(F.count(F.lit(1)).alias("c"))
    return raw.groupBy(suggestion_title(F.col(title)).alias("title")).agg(F.sum("c").alias("n")).where((F.col("title") != "") & (F.col("n") >= floor)).orderBy(F.desc("n"), "title").limit(k)


def ranked_suggestions(demand: DataFrame, stock: DataFrame, key: str, recognised: DataFrame) -> DataFrame:
    """key, demand, n: by demand and then stock; nothing without stock, nothing recognised already."""
    rows = stock.where("n > 0").join(demand, key, "left").join(recognised, key, "left_anti")
    return rows.select(key, F.coalesce("demand", F.lit(0)).cast("long").alias("demand"), "n").orderBy(F.desc("demand"), F.desc("n"), key)


def relevance(df: DataFrame, query: str, weights: dict[str, float]) -> Column:
    """Score of a row for a query: for every word the best weight of a field that holds it, half for a word one edit away."""
    score = F.lit(0.0)
    for q in query.lower().split():
        best = F.lit(0.0)
        for column, w in weights.items():
            words = F.split(F.lower(F.coalesce(F.col(column), F.lit(""))), r"[^\p{L}\p{N}]+")
            near = F.exists(words, _near(q))
            best = F.greatest(best, F.when(F.array_contains(words, q), F.lit(w)).when(near, F.lit(w / 2)).otherwise(F.lit(0.0)))
        score = score + best
    return score


def _near(word: str):
    return lambda x: F.levenshtein(x, F.lit(word)) <= 1


def prune_demand(df: DataFrame, count: str, last_seen: str, before: Column) -> DataFrame:
    """Without what was asked for once, and not since."""
    return df.where(~((F.col(count) == 1) & (F.col(last_seen) < before)))


def promoted(df: DataFrame, hits: str, other: str, least: int, share: float) -> DataFrame:
    """Rows with hits enough and a small enough share of other hits; no total counts as no share."""
    return df.where((F.col(hits) >= least) & (F.coalesce(F.col(other) / F.nullif(F.col(hits) + F.col(other), F.lit(0)), F.lit(0.0)) <= share))
