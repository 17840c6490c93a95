"""Toxicity by a weighted lexicon, matched with Aho-Corasick over folded text.

Text is folded before matching: compatibility forms, look-alike letters of
other scripts, digits and signs that stand for letters, and invisible
characters.  The lexicon is learned from labelled rows: word beginnings far
commoner in toxic texts than in clean ones, weighted by log odds and chosen
greedily so that each explains toxic texts that the others leave unexplained.
Exception phrases (a matched word alone, or with a neighbour, that clean texts
use) suppress the matches inside them.  Matches are normalised by the length of
the text, and a logistic curve turns them into a score.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import cut, discard, freed, spread

#: Labelled rows that learning reads at most (the rows of least hash).
SAMPLE = 20_000
#: Lengths of word beginnings; what bounds the lexicon learned from those rows: its candidates (the most frequent), terms and exceptions at most.
SHORTEST, LONGEST, CANDIDATES, TERMS, EXCEPTIONS = 3, 10, 4000, 600, 2000
#: Terms that a worker counts before it hands the counts on.
HELD = 250_000
#: A term needs this log odds; it must newly explain this share of toxic rows, and this many.
MIN_ODDS, MIN_SHARE, MIN_ROWS = 2.0, 0.004, 3

#: Letters of other scripts that look like Latin ones.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ѐ": "e", "ё": "e", "һ": "h", "н": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m",
    "п": "n", "о": "o", "р": "p", "ԛ": "q", "г": "r", "ѕ": "s", "т": "t", "ц": "u", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y",
    "α": "a", "β": "b", "ϲ": "c", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "σ": "o", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "γ": "y",
    "ı": "i", "ɡ": "g", "ɑ": "a", "ʟ": "l", "օ": "o", "ս": "u", "հ": "h", "ո": "n", "ց": "g",
}
#: Digits and signs written for letters.
STAND_INS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "€": "e"}
#: Characters that show nothing.
INVISIBLE = ("­", "​", "‌", "‍", "⁠", "﻿")

_TABLE = str.maketrans({**LOOKALIKES, **STAND_INS, **dict.fromkeys(INVISIBLE)})
_BREAKS = re.compile(r"[\W\d_]+")


def fold(text: str | None) -> str:
    """Lower-case folded words, each after one space, and a space at the end ("" for no words)."""
    if not text:
        return ""
    if not text.isascii() and not unicodedata.is_normalized("NFKC", text):
        text = unicodedata.normalize("NFKC", text)
    words = _BREAKS.sub(" ", text.lower().translate(_TABLE)).strip()
    return f" {words} " if words else ""


@dataclass
class Lexicon:
    """weights: of word beginnings; exceptions: phrases of whole words; curve: bias and slopes of the two features."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    curve: tuple[float, float, float] = (-8.0, 0.0, 0.0)

    def matcher(self):
        import ahocorasick

        out = ahocorasick.Automaton()
        for term, weight in self.weights.items():
            out.add_word(f" {term}", (len(term) + 1, weight))
        for phrase in self.exceptions:
            out.add_word(f" {phrase} ", (len(phrase) + 2, None))
        if len(out):
            out.make_automaton()
        return out


def matches(matcher, folded: str) -> dict[int, tuple[float, int]]:
    """Place of the space before a matched word -> the largest weight and length there, exceptions taken out."""
    hits: dict[int, tuple[float, int]] = {}
    spared: list[tuple[int, int]] = []
    if folded and len(matcher):
        for end, (length, weight) in matcher.iter(folded):
            start = end - length + 1
            if weight is None:
                spared.append((start, end))
            elif weight > hits.get(start, (0.0, 0))[0]:
                hits[start] = (weight, length)
    if spared:
        places = sorted(hits)
        for a, b in spared:
            for k in range(bisect_left(places, a), bisect_left(places, b)):
                hits.pop(places[k], None)
    return hits


def features(matcher, folded: str) -> tuple[float, float]:
    """Weight of all matches, and weight per 100 words; both on a log scale."""
    hits = matches(matcher, folded)
    if not hits:
        return 0.0, 0.0
    total = sum(w for w, _ in hits.values())
    return float(np.log1p(total)), float(np.log1p(100 * total / folded.count(" ", 1)))


def in_training(doc_id: Column) -> Column:
    """Rows whose labels may be learned from: crc32 of the id as text, modulo 5, is not 0."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        toxic: Counter = Counter()
        clean: Counter = Counter()
        for text, label in zip(batch.column(0), batch.column(1), strict=True):
            words = set(fold(text.as_py()).split())
            (toxic if label.as_py() else clean).update({w[:n] for w in words for n in range(SHORTEST, min(len(w), LONGEST) + 1)})
            if len(toxic) + len(clean) > HELD:
                yield _counts(toxic, clean)
                toxic.clear()
                clean.clear()
        yield _counts(toxic, clean)


def _counts(toxic: Counter, clean: Counter) -> pa.RecordBatch:
    terms = list({**toxic, **clean})
    return pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([toxic[t] for t in terms], pa.int64()), pa.array([clean[t] for t in terms], pa.int64())], names=["term", "t", "c"])


def learn(rows: DataFrame, seed: int = 0) -> Lexicon:
    """A lexicon from rows (doc_id, text, label 0/1); reads SAMPLE rows at most, those of least hash.

    Exact copies count once, as toxic if one of them is; null and empty texts count
    as texts without words.  Without rows of both labels the lexicon is empty
    and every score is low.
    """
    rows = rows.where("label in (0, 1)")
    n = rows.count()
    if n > SAMPLE:
        part = int(SAMPLE / n * 2**32)
        rows = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(2**32)) < part)
    sample = cut(spread(rows.groupBy("text").agg(F.max("label").alias("label"))), "toxic")
    sizes = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    n_t, n_c = sizes.get(1, 0), sizes.get(0, 0)
    if not n_t or not n_c:
        return Lexicon()
    odds = F.log((F.col("t") + 0.5) / (n_t + 1)) - F.log((F.col("c") + 0.5) / (n_c + 1))
    least = max(MIN_ROWS, MIN_SHARE * n_t)
    counted = sample.mapInArrow(freed(_count_terms), "term string, t long, c long").groupBy("term").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    floor = min(MIN_ODDS, float(np.log((n_t / 2 + 0.5) / (n_t + 1)) - np.log(0.5 / (n_c + 1))))
    candidates = {r["term"]: (r["t"], r["odds"]) for r in counted.withColumn("odds", odds).where((F.col("odds") >= floor) & (F.col("t") >= least)).orderBy(F.desc("t"), F.desc("odds"), F.desc(F.length("term")), "term").limit(CANDIDATES).collect()}
    # Of beginnings that the same number of rows have, the longest says most.
    weights = _cover(sample, _closed(candidates), least)
    exceptions = _exceptions(sample, weights, n_t, n_c)
    lexicon = Lexicon(weights, exceptions)
    curve = _curve(sample, lexicon)
    discard(sample)
    return Lexicon(weights, exceptions, curve)


def _closed(candidates: dict[str, tuple[int, float]]) -> dict[str, tuple[int, float]]:
    longest: dict[str, int] = defaultdict(int)
    for t, (n, _) in candidates.items():
        for k in range(SHORTEST, len(t)):
            longest[t[:k]] = max(longest[t[:k]], n)
    return {t: v for t, v in candidates.items() if longest[t] < v[0]}


def _cover(sample: DataFrame, terms: dict[str, tuple[int, float]], least: float) -> dict[str, float]:
    """Terms that explain toxic rows, greedily by the number of rows that no earlier term explains."""
    names = sorted(terms)

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        matcher = ahocorasick.Automaton()
        for i, t in enumerate(names):
            matcher.add_word(f" {t}", i)
        if names:
            matcher.make_automaton()
        for batch in batches:
            found = [sorted({i for _, i in matcher.iter(f)} if names and (f := fold(t)) else set()) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32()))], names=["found"])

    rows = [r[0] for r in sample.where("label = 1").select("text").mapInArrow(freed(held), "found array<int>").collect()]
    by_term: dict[int, set[int]] = defaultdict(set)
    for r, found in enumerate(rows):
        for i in found:
            by_term[i].add(r)
    out: dict[str, float] = {}
    while by_term and len(out) < TERMS:
        best = max(by_term, key=lambda i: (len(by_term[i]) * terms[names[i]][1], len(names[i]), names[i]))
        new = set(by_term[best])
        if len(new) < least:
            break
        out[names[best]] = float(terms[names[best]][1])
        for i in [i for i in by_term if by_term[i] & new]:
            by_term[i] -= new
            if not by_term[i]:
                del by_term[i]
    # What is nearly as good but covered by others (other spellings, other words of the same rows) still counts when frequent.
    total = max(1, len(rows))
    for t, (n, odds) in sorted(terms.items(), key=lambda x: (-x[1][0], x[0])):
        if len(out) < TERMS and n >= 0.04 * total and odds >= 2 * MIN_ODDS and not any(t.startswith(u) or (u.startswith(t) and n < 1.5 * terms[u][0]) for u in out):
            out[t] = float(odds)
    return out


def _exceptions(sample: DataFrame, weights: dict[str, float], n_t: int, n_c: int) -> list[str]:
    """Matched words, alone or with a neighbour, that are no commoner in toxic rows than in clean ones."""
    lexicon = Lexicon(weights)

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = lexicon.matcher()
        for batch in batches:
            toxic: Counter = Counter()
            clean: Counter = Counter()
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                f, seen = fold(text), set()
                for start in matches(matcher, f):
                    # Every word stands between two spaces.
                    end = f.index(" ", start + 1)
                    second = f.find(" ", end + 1)
                    seen.add(f[start + 1 : end])
                    if second > 0:
                        seen.add(f[start + 1 : second])
                    if start:
                        seen.add(f[f.rindex(" ", 0, start) + 1 : end])
                (toxic if label else clean).update(seen)
            terms = list(toxic | clean)
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([toxic[t] for t in terms], pa.int64()), pa.array([clean[t] for t in terms], pa.int64())], names=["term", "t", "c"])

    odds = F.log((F.col("t") + 0.5) / (n_t + 1)) - F.log((F.col("c") + 0.5) / (n_c + 1))
    counted = sample.mapInArrow(freed(around), "term string, t long, c long").groupBy("term").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    return [r["term"] for r in counted.where((F.col("c") >= MIN_ROWS) & (odds < 0)).orderBy(F.desc("c"), "term").limit(EXCEPTIONS).collect()]


def _curve(sample: DataFrame, lexicon: Lexicon) -> tuple[float, float, float]:
    """Ridge logistic regression of the label on the two features, by Newton's method; slopes are kept from falling below 0."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = lexicon.matcher()
        for batch in batches:
            x = [features(matcher, fold(t)) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in x], pa.float64()), pa.array([b for _, b in x], pa.float64()), batch.column(1).cast(pa.float64())], names=["a", "b", "y"])

    rows = np.array(sorted(tuple(r) for r in sample.mapInArrow(freed(of), "a double, b double, y double").collect()))
    used = [0, 1]
    while True:
        x, y = np.column_stack([np.ones(len(rows)), rows[:, used]]), rows[:, 2]
        w, ridge = np.zeros(x.shape[1]), np.diag([1e-6, *[0.05] * len(used)]) * 1.0
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge + 1e-9 * np.eye(x.shape[1]), x.T @ (y - p) - ridge @ w)
            w += np.clip(step, -4, 4)
            if np.abs(step).max() < 1e-8:
                break
        low = [u for u, s in zip(used, w[1:], strict=True) if s < 0]
        if not low:
            break
        used = [u for u in used if u not in low]
    slopes = dict(zip(used, w[1:], strict=True))
    return float(w[0]), float(slopes.get(0, 0.0)), float(slopes.get(1, 0.0))


def score(docs: DataFrame, lexicon: Lexicon, text: str = "text", out: str = "score") -> DataFrame:
    """docs with column out: toxicity from 0 to 1 of the whole text.  Null and empty texts get the score of no match."""
    docs = docs.drop(out) if out in docs.columns else docs
    at = docs.columns.index(text)
    bias, a, b = lexicon.curve

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = lexicon.matcher()
        for batch in batches:
            x = np.array([features(matcher, fold(t.as_py())) for t in batch.column(at)]).reshape(-1, 2)
            z = 1 / (1 + np.exp(-np.clip(bias + a * x[:, 0] + b * x[:, 1], -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(z, pa.float64())], names=[*batch.schema.names, out])

    from pyspark.sql import types as T

    return docs.mapInArrow(freed(run), T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())]))


def train(docs: DataFrame, labels: DataFrame) -> Lexicon:
    """Lexicon of documents (doc_id, text) by labels (doc_id, toxic), from the rows of in_training().

    An id that has both labels counts as toxic; labels without id, and other
    values than 0 and 1, take no part.  Empty tables give an empty lexicon.
    """
    known = labels.where("toxic in (0, 1) and doc_id is not null").where(in_training(F.col("doc_id"))).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("label"))
    n = known.count()
    if n > SAMPLE:  # before the join, so that no more text moves than is read
        known = known.where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2**32)) < int(SAMPLE / n * 2**32))
    known = known.limit(2 * SAMPLE)  # the bound of what is broadcast
    return learn(docs.select("doc_id", "text").join(F.broadcast(known), "doc_id"))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of documents.

    Repeated rows are rows of their own; null and empty texts have the score of a
    text without matches; rows without id are never held out.  An empty table
    gives no rows.
    """
    lexicon = train(docs, labels)
    out = score(spread(docs.select("doc_id", "text")), lexicon)
    return out.select("doc_id", F.coalesce(~in_training(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
