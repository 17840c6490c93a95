r"""Benchmark decontamination by SimHash windows, in DataFrame operations only.

Texts are lower-cased words of letters and digits, shingled by five.  A window
is a stretch of a document as long as a benchmark item.  Windows that can be
similar to an item share shingles with it, so windows are placed where a shingle
of the document equals one of the item: the place of the shingle less its place
in the item.  That loses no window of the wanted similarity.

Each window and each item gets a 64-bit SimHash of its weighted shingles.  A
window is compared with its item if one of RADIUS + 1 blocks of the two
fingerprints is equal (by the pigeonhole principle that keeps every pair within
the radius), and then if they differ in RADIUS bits at most.  Exact weighted
Jaccard similarity of the shingle sets decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import cut, discard, row_id, spread

#: Words of a shingle; similarity in percent; bits that fingerprints may differ in: at a similarity of 0.8 they
#: differ in 9.7 of 64 bits on average, and in more than 24 with a probability of about 3e-6.
WORDS, PERCENT, RADIUS = 5, 80, 24
#: Benchmark shingles up to which the index is broadcast (20 bytes each); a larger one is joined by shuffles.
INDEX_ROWS = 2_000_000


def words(text: str | Column) -> Column:
    """Lower-case words of letters and digits; null and empty texts give one empty word."""
    column = F.col(text) if isinstance(text, str) else text
    return F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(column, F.lit(""))), r"[^\p{L}\p{N}]+", " ")), " ")


def shingles(w: str) -> Column:
    """64-bit hashes of the five-word shingles of array column w, in order; empty for fewer words."""
    at = F.sequence(F.lit(1), F.size(w) - (WORDS - 1))
    one = F.transform(at, lambda i: F.xxhash64(*(F.element_at(w, i + k) for k in range(WORDS))))
    return F.when(F.size(w) >= WORDS, one).otherwise(F.array().cast("array<bigint>"))


def weights(w: str) -> Column:
    """Weight of each shingle: its letters and digits, so that runs of short words say less."""
    at = F.sequence(F.lit(1), F.size(w) - (WORDS - 1))
    one = F.transform(at, lambda i: F.length(F.concat(*(F.element_at(w, i + k) for k in range(WORDS)))))
    return F.when(F.size(w) >= WORDS, one).otherwise(F.array().cast("array<int>"))


def weighted(h: Column, weight: Column) -> Column:
    """Sorted distinct (h, w) of aligned arrays; the weight of a repeated shingle counts once."""
    return F.array_sort(F.array_distinct(F.arrays_zip(h.alias("h"), weight.alias("w"))))


def simhash(pairs: str) -> Column:
    """64-bit SimHash of an array of (h, w)."""
    def bit(b: Column) -> Column:
        total = F.aggregate(pairs, F.lit(0).cast("bigint"), lambda acc, s: acc + F.when(F.call_function("getbit", s["h"], b) == 1, s["w"]).otherwise(-s["w"]))
        return F.when(total > 0, F.lit(1).cast("bigint")).otherwise(F.lit(0).cast("bigint"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("bigint"), lambda acc, b: acc.bitwiseOR(F.call_function("shiftleft", bit(b), b)))


def blocks(bits: int = 64, n: int = RADIUS + 1) -> list[int]:
    """Masks of n blocks that split the bits evenly, as signed 64-bit integers."""
    edges = [bits * i // n for i in range(n + 1)]
    masks = [sum(1 << b for b in range(a, e)) for a, e in zip(edges, edges[1:], strict=False)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _held(docs: DataFrame, benchmark: DataFrame, doc_id: str, text: str, item_id: str, item_text: str, percent: int) -> DataFrame:
    """rid, doc_id, item_id, first, len, shared, total of every window, of any row, that holds an item."""
    items = benchmark.where(F.col(item_id).isNotNull()).select(F.col(item_id).alias("item_id"), words(item_text).alias("w"))
    items = items.withColumn("h", shingles("w")).withColumn("wt", weights("w")).where(F.size("h") > 0)
    items = items.withColumn("set", weighted(F.col("h"), F.col("wt"))).withColumn("print", simhash("set"))
    items = cut(items.select(F.xxhash64("item_id", "h").alias("iid"), "item_id", "h", "set", "print", F.size("h").alias("m")).dropDuplicates(["iid"]), "items")
    # Of a shingle that an item repeats, the first place serves.
    index = items.select("iid", "m", F.posexplode_outer("h").alias("at", "h")).groupBy("iid", "m", "h").agg(F.min("at").alias("at"))
    if (items.agg(F.sum("m")).first()[0] or 0) <= INDEX_ROWS:
        index = F.broadcast(index)
    rows = spread(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))).withColumn("rid", row_id())
    worded = rows.select("rid", "doc_id", words("text").alias("w"))
    # Outer: else the planner adds a filter on the array's size, with the making of the words inlined for each element.
    places = worded.select("rid", "doc_id", shingles("w").alias("h")).select("rid", "doc_id", F.posexplode_outer("h").alias("pos", "h"))
    hits = places.join(index, "h")
    windows = cut(hits.select("rid", "doc_id", "iid", (F.col("pos") - F.col("at")).alias("start")).distinct(), "windows")
    # Only documents with a window are read again.
    there = windows.select("rid").distinct()
    again = worded.join(there, "rid").dropDuplicates(["rid"]).withColumn("h", shingles("w")).withColumn("wt", weights("w")).select("rid", "h", "wt")
    per = windows.join(again, "rid").join(items.select("iid", "item_id", "set", "print", "m"), "iid")
    first = F.greatest(F.col("start"), F.lit(0))
    length = F.least(F.col("start") + F.col("m"), F.size("h")) - first
    cutout = per.withColumn("first", first).withColumn("len", length)
    part = lambda c: F.slice(c, F.col("first") + 1, F.col("len"))
    own = cutout.select("rid", "doc_id", "item_id", "iid", "first", "len", "print", "set", weighted(part("h"), part("wt")).alias("win"))
    apart = own.withColumn("own_print", simhash("win")).withColumn("x", F.col("print").bitwiseXOR(F.col("own_print")))
    block = F.lit(False)
    for mask in blocks():
        block = block | (F.col("x").bitwiseAND(F.lit(mask).cast("bigint")) == 0)
    near = apart.where(block & (F.bit_count("x") <= RADIUS))
    weight = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda acc, s: acc + s["w"])
    shared = weight(F.array_intersect("set", "win"))
    decided = near.select("rid", "doc_id", "item_id", "first", "len", shared.alias("shared"), (weight(F.col("set")) + weight(F.col("win"))).alias("both"))
    return decided.withColumn("total", F.col("both") - F.col("shared")).where(F.col("shared") * 100 >= F.col("total") * percent)


def matches(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", percent: int = PERCENT) -> DataFrame:
    """doc_id, item_id, start (word), n_words, shared and total (weights of intersection and union): each document's best window of each item it holds.

    Best: the largest similarity, then the first window.  Items and documents of
    fewer than five words (null and empty texts too) have no shingles and match
    nothing; rows without an id take no part.  Rows that repeat an id count as
    further texts of it.
    """
    decided = _held(docs.where(F.col(doc_id).isNotNull()), benchmark, doc_id, text, item_id, item_text, percent)
    best = decided.groupBy("doc_id", "item_id").agg(F.max(F.struct((F.col("shared") / F.col("total")).alias("s"), (-F.col("first")).alias("f"), "len", "shared", "total")).alias("b"))
    return best.select(
        "doc_id", "item_id", (-F.col("b.f")).cast("long").alias("start"), (F.col("b.len") + (WORDS - 1)).cast("long").alias("n_words"),
        F.col("b.shared").alias("shared"), F.col("b.total").alias("total"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", percent: int = PERCENT) -> DataFrame:
    """docs without the rows whose own text holds a benchmark item, whether their id is null or repeated."""
    found = _held(docs, benchmark, doc_id, text, item_id, item_text, percent).select(F.col("rid").alias("_rid")).distinct()
    return docs.withColumn("_rid", row_id(doc_id, text)).join(found, "_rid", "left_anti").select(*docs.columns)


#: All windows that share a shingle with an item, compared exactly.
ORACLE = r"""
WITH dw AS (SELECT doc_id, row_number() OVER () AS rid, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS w FROM documents),
iw AS (SELECT item_id, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS w FROM benchmark),
ds AS (SELECT rid, doc_id, len(w) - 4 AS m, list_transform(range(1, len(w) - 3), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4]) AS h FROM dw WHERE len(w) >= 5),
s AS (SELECT item_id, len(w) - 4 AS m, list_transform(range(1, len(w) - 3), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4]) AS h FROM iw WHERE len(w) >= 5),
dp AS (SELECT rid, doc_id, m, unnest(range(0, m)) AS pos, unnest(h) AS h FROM ds),
ip AS (SELECT item_id, m, h, min(off) AS off FROM (SELECT item_id, m, unnest(range(0, m)) AS off, unnest(h) AS h FROM s) GROUP BY ALL),
win AS (SELECT DISTINCT rid, doc_id, item_id, ip.m AS im, dp.m AS dm, pos - off AS start FROM dp JOIN ip USING (h)),
ex AS (SELECT DISTINCT win.rid, win.doc_id, item_id, im, dm, start, dp.h FROM win JOIN dp ON dp.rid = win.rid AND dp.pos >= start AND dp.pos < start + im),
a AS (SELECT rid, doc_id, item_id, im, dm, start, sum(len(replace(ex.h, ' ', ''))) AS own, sum(CASE WHEN ip.h IS NOT NULL THEN len(replace(ex.h, ' ', '')) ELSE 0 END) AS shared
  FROM ex LEFT JOIN ip USING (item_id, h) GROUP BY ALL),
t AS (SELECT item_id, sum(len(replace(h, ' ', ''))) AS w FROM ip GROUP BY item_id),
r AS (SELECT doc_id, item_id, greatest(start, 0) AS start, least(start + im, dm) - greatest(start, 0) + 4 AS n_words, shared, t.w + own - shared AS total FROM a JOIN t USING (item_id) WHERE 100 * shared >= 80 * (t.w + own - shared)),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY CAST(shared AS DOUBLE) / total DESC, start, n_words DESC) AS k FROM r)
SELECT doc_id, item_id, CAST(start AS BIGINT) AS start, CAST(n_words AS BIGINT) AS n_words, CAST(shared AS BIGINT) AS shared, CAST(total AS BIGINT) AS total FROM o WHERE k = 1
"""
