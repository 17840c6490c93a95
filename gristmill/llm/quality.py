"""Quality by a document classifier and hierarchical empirical Bayes over sites.

A logistic classifier on surface features of the text gives each document its
evidence.  Hosts and paths under them get posteriors from the evidence of their
own documents: a path's prior is its host's posterior, a host's prior is global,
and both priors' strengths are estimated from the spread of the group means, so
sparse sites shrink toward their parents.  A document's score combines its own
evidence with the posterior of its path, of which its own share is taken out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import cut, spread

#: Labelled rows that learning reads at most (the rows of least hash).
SAMPLE = 20_000
FEATURES = ("bias", "log_words", "mean_word", "signs", "digits", "upper", "distinct", "repeat", "same_next", "line_repeat", "short_lines", "stops", "noisy_words", "bars")
_SIGNS = re.compile(r"[^\w\s.,;:!?'\"()\-]")


def features(text: str | None) -> list[float]:
    """Surface features of a whole text; all but the bias 0 for null and blank ones."""
    words = text.split() if text else []
    if not words:
        return [1.0] + [0.0] * (len(FEATURES) - 1)
    n, chars = len(words), len(text)
    signs = len(_SIGNS.findall(text))
    lines = [x.strip() for x in text.split("\n")]
    lines = [x for x in lines if x]
    seen = len(set(words))
    same = sum(a == b for a, b in zip(words, words[1:], strict=False))
    noisy = sum(not w[-1].isalnum() and w[-1] not in ".,;:!?'\")-" for w in words)
    return [
        1.0, float(np.log1p(n)), chars / n / 10, signs / chars * 10, sum(c.isdigit() for c in text) / chars * 10 if any(c in text for c in "0123456789") else 0.0,
        sum(w[0].isupper() for w in words) / n, seen / n, 1 - seen / n if n >= 20 else 0.0, same / n, 1 - len(set(lines)) / max(1, len(lines)), sum(len(x) < 20 for x in lines) / max(1, len(lines)),
        sum(w[-1] in ".!?" for w in words) / n, noisy / n, words.count("|") / n,
    ]


@dataclass
class Classifier:
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    base: float  # share of good rows it learned from

    def logit(self, x: np.ndarray) -> np.ndarray:
        z = (x - np.array(self.mean)) / np.array(self.scale)
        return np.clip(expand(z) @ np.array(self.weights), -12, 12)


def expand(z: np.ndarray) -> np.ndarray:
    """Standardised features and their squares, bounded."""
    z = np.clip(z, -5, 5)
    return np.concatenate([z, z[:, 1:] ** 2 / 5], axis=1)


def _featured(rows: DataFrame, keep: list[str], schema: str) -> DataFrame:
    """Columns keep and x, the features of column text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t.as_py()) for t in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(x, pa.list_(pa.float64()))], names=[*keep, "x"])

    return rows.select(*keep, "text").mapInArrow(run, f"{schema}, x array<double>")


def learn(rows: DataFrame, ridge: float = 1.0) -> Classifier:
    """Classifier from rows (doc_id, text, label 0/1), of which SAMPLE at most are read.  Without both labels it knows nothing."""
    flat = Classifier((0.0,) * len(FEATURES), (1.0,) * len(FEATURES), (0.0,) * (2 * len(FEATURES) - 1), 0.5)
    got = sorted((r["doc_id"], r["label"], tuple(r["x"])) for r in _featured(spread(rows), ["doc_id", "label"], "doc_id long, label int").collect())
    if len({y for _, y, _ in got}) < 2:
        return flat
    y, x = np.array([g[1] for g in got], float), np.array([g[2] for g in got])
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    mean[0], scale[0] = 0.0, 1.0
    z = expand((x - mean) / scale)
    w, penalty = np.zeros(z.shape[1]), np.eye(z.shape[1]) * ridge
    penalty[0, 0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + penalty, z.T @ (y - p) - penalty @ w)
        w += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-7:
            break
    return Classifier(tuple(mean), tuple(scale), tuple(w), float(np.clip(y.mean(), 0.01, 0.99)))


def evidence(docs: DataFrame, classifier: Classifier, host: Column, path: Column) -> DataFrame:
    """doc_id, host, path, logit of every row; null hosts and paths become empty strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t.as_py()) for t in batch.column(3)]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(classifier.logit(x), pa.float64())], names=["doc_id", "host", "path", "logit"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(host.cast("string"), F.lit("")).alias("host"), F.coalesce(path.cast("string"), F.lit("")).alias("path"), "text")
    return spread(rows).mapInArrow(run, "doc_id long, host string, path string, logit double")


def _strength(groups: DataFrame, n: str, mean: str, parent: Column) -> float:
    """Strength of a beta prior around the parents' means, by the method of moments, from 1 to 10,000 documents.

    The variance of group means beyond what documents' own spread explains, as a
    share of the largest possible, is 1 / (strength + 1).
    """
    spread_of = F.col("v") / F.greatest(F.col(n), F.lit(1))
    got = groups.where(F.col(n) > 1).agg(F.count(F.lit(1)).alias("k"), F.avg((F.col(mean) - parent) ** 2 - spread_of).alias("between"), F.avg(parent * (1 - parent)).alias("most")).first()
    if not got["k"] or got["most"] is None or got["most"] <= 0:
        return 10.0
    return float(min(1e4, max(1.0, got["most"] / max(got["between"] or 0.0, 1e-9) - 1)))


def combined(rows: DataFrame, classifier: Classifier, threshold: float = 0.5) -> DataFrame:
    """doc_id, host, path, p_doc, p_site, score, keep for every row of evidence().

    Group sums are pre-aggregated, so a site with a third of all rows costs no
    more than any other; what joins back is one row a path.
    """
    rows = rows.withColumn("p", 1 / (1 + F.exp(-F.col("logit"))))
    paths = cut(rows.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("s"), F.avg(F.col("p") * (1 - F.col("p"))).alias("v")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"), (F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("v")).withColumn("hm", F.col("hs") / F.col("hn"))
    total = hosts.agg(F.sum("hs"), F.sum("hn")).first()
    overall = float(np.clip(total[0] / total[1], 0.001, 0.999)) if total[1] else 0.5
    host_k = _strength(hosts, "hn", "hm", F.lit(overall))
    hosts = hosts.withColumn("h_post", (F.col("hs") + host_k * overall) / (F.col("hn") + host_k)).select("host", "hn", "hs", "h_post")
    joined = paths.join(hosts, "host")
    path_k = _strength(joined.withColumn("pm", F.col("s") / F.col("n")), "n", "pm", F.col("h_post"))
    # The document's own share is taken out of its path and its host.
    site = rows.join(joined.select("host", "path", "n", "s", "hn", "hs"), ["host", "path"])
    h_rest = (F.col("hs") - F.col("p") + host_k * overall) / (F.col("hn") - 1 + host_k)
    site = site.withColumn("h_rest", h_rest).withColumn("p_site", (F.col("s") - F.col("p") + path_k * F.col("h_rest")) / (F.col("n") - 1 + path_k))
    prior = F.greatest(F.least(F.col("p_site"), F.lit(0.999)), F.lit(0.001))
    score = 1 / (1 + F.exp(-(F.col("logit") + F.log(prior / (1 - prior)) - float(np.log(overall / (1 - overall))))))
    return site.withColumn("score", score).select("doc_id", "host", "path", F.col("p").alias("p_doc"), "p_site", "score", (F.col("score") >= threshold).alias("keep"))


def train(docs: DataFrame, labels: DataFrame) -> Classifier:
    """Classifier of documents by labels (doc_id, quality), from rows whose crc32 of the id, modulo 5, is not 0.

    An id that has both labels counts as poor; labels without id, and other
    values than 0 and 1, take no part.
    """
    known = labels.where("quality in (0, 1) and doc_id is not null").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0).groupBy("doc_id").agg(F.min(F.col("quality").cast("int")).alias("label"))
    n = known.count()
    if n > SAMPLE:
        known = known.where(F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(2**32)) < int(SAMPLE / n * 2**32))
    known = known.limit(2 * SAMPLE)  # the bound of what is broadcast
    return learn(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known), "doc_id"))


def scored(docs: DataFrame, labels: DataFrame, host: Column, path: Column) -> DataFrame:
    """combined() of every row of docs, with a classifier trained on labels.

    Ids are numbers.  Repeated rows and rows without id are documents of their
    own; null and empty texts have the features of no words; null hosts and paths
    are one site.  An empty table gives no rows.
    """
    classifier = train(docs, labels)
    return combined(cut(evidence(docs, classifier, host, path), "evidence"), classifier)
