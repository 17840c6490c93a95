"""Near-duplicate documents by circulant MinHash.

Shingles are hashed to 64 bits and placed on a ring of 2^32 positions.  Two
permutations of the ring serve all coordinates: the first, sigma, scatters the
positions once; coordinate k is the least pi(sigma(x) + k), the second
permutation read through a circular shift by k.  Rows of coordinates are banded;
documents that share a band are candidates, and links are confirmed by exact
Jaccard on the full sets.

Only connectivity is asked for, so candidates are not expanded into pairs:
equal sets are one class, each band's bucket is tested as a star around its
least class, and later rounds look only at buckets that still hold more than one
component.  Classes have numbers of their own, so rows that share an id are told
apart by their sets.  A bucket, family, component or class of copies with many
rows is dealt over several tasks wherever it is joined.  Unresolved buckets are looked through in blocks of bounded size, by byte
sketches of the signatures: first each member is tested against its likeliest
partner of another component, then families are made of what likely pairs hold
together, and in them whatever is still apart is compared by full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import cut, discard, freed, row_id, spread
from gristmill.llm.components import components

#: Words of a shingle, and bands and rows of a band.  At a similarity of 0.8 a
#: pair shares no band with probability (1 - 0.8^5)^40 = 1.3e-7.
WORDS, BANDS, ROWS = 4, 40, 5
#: Members of one side of a block in which an unresolved bucket is looked through.
CELL = 512
#: Characters of one side of a block in which families are compared by their full sets.
CELL_CHARS = 4_000_000
#: A pair is confirmed by its full sets if its sketches (a byte of each coordinate) agree this far below the
#: wanted similarity: 5.3 standard deviations of 200 coordinates, which a similar pair misses 6e-8 of the times.
SLACK = 0.15
#: Rows of a key that go to one task of a join, and keys with more rows that can be: their list, of 16 bytes a key, is broadcast.
HOT_ROWS, HOT_KEYS = 512, 100_000
#: Pieces in which rows without a key are dealt.
NULL_PIECES = 1024
#: Words with remembered hashes in a worker; the table is emptied when full.
CACHE = 150_000
#: Shingles whose coordinates are worked out together.
CHUNK = 1 << 15

_MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, hashes: dict, size: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text.

    Words are runs without ASCII white space; only A-Z are lower-cased.  A text
    with fewer words than a shingle is one shingle; without words it has none.
    """
    words = text.encode().lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = min(size, len(h))
    m = len(h) - n + 1
    out = np.full(m, n, np.uint64)
    for j in range(n):
        out = _scramble(out * _MIX[0] + h[j : j + m])
    return np.unique(out)


def sigma(x: np.ndarray) -> np.ndarray:
    """First permutation, on the ring positions of the shingle hashes."""
    p = (x >> np.uint64(32)).astype(np.uint32)
    p *= np.uint32(0x9E3779B1)
    p ^= p >> np.uint32(15)
    p *= np.uint32(0x2C1B3C6D)
    p ^= p >> np.uint32(12)
    return p


def signatures(sets: list[np.ndarray], coordinates: int = BANDS * ROWS) -> np.ndarray:
    """One row of coordinates for each non-empty set."""
    ends = np.cumsum([len(s) for s in sets])
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    at = sigma(np.concatenate(sets))
    out = np.empty((coordinates, len(sets)), np.uint32)
    v, w = np.empty_like(at), np.empty_like(at)
    for k in range(coordinates):
        np.add(at, np.uint32(k), out=v)  # the circular shift
        np.right_shift(v, 16, out=w)  # from here the second permutation
        np.bitwise_xor(v, w, out=v)
        np.multiply(v, np.uint32(0x85EBCA6B), out=v)
        np.right_shift(v, 13, out=w)
        np.bitwise_xor(v, w, out=v)
        np.multiply(v, np.uint32(0xC2B2AE35), out=v)
        np.right_shift(v, 16, out=w)
        np.bitwise_xor(v, w, out=v)
        out[k] = np.minimum.reduceat(v, starts)
    return out.T


def band_keys(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """(documents, bands) 64-bit keys; a key names its band too."""
    parts = signature[:, : bands * rows].reshape(len(signature), bands, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for r in range(rows):
        key = _scramble(key * _MIX[0] + parts[:, :, r])
    return key.view(np.int64)


def sketches(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = WORDS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, ra, rb (row_id of id and text), n_shingles, digest of the set, bands, sketch (a byte of each coordinate); the last three null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            texts, rest = batch.column(0), [batch.column(i) for i in (1, 2, 3)]
            sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
            start = 0
            while start < len(sizes):
                stop, held = start, 0
                while stop < len(sizes) and (stop == start or held < 4 << 20):
                    held += sizes[stop]
                    stop += 1
                sets = [shingle_set(t, hashes, size) for t in texts.slice(start, stop - start).to_pylist()]
                full, keys, bytes_of, i = [k for k, s in enumerate(sets) if len(s)], {}, {}, 0
                while i < len(full):
                    j, n = i, 0
                    while j < len(full) and (j == i or n < CHUNK):
                        n += len(sets[full[j]])
                        j += 1
                    signature = signatures([sets[k] for k in full[i:j]], bands * rows)
                    keys.update(zip(full[i:j], band_keys(signature, bands, rows), strict=True))
                    bytes_of.update(zip(full[i:j], (x.tobytes() for x in signature.astype(np.uint8)), strict=True))
                    i = j
                yield pa.RecordBatch.from_arrays(
                    [*(x.slice(start, stop - start) for x in rest), pa.array([len(s) for s in sets], pa.int64()), pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()), pa.array([keys.get(k) for k in range(len(sets))], pa.list_(pa.int64())), pa.array([bytes_of.get(k) for k in range(len(sets))], pa.binary())],
                    names=["doc_id", "ra", "rb", "n_shingles", "digest", "bands", "sketch"],
                )
                start = stop

    keyed = docs.select(F.col(text).alias("text"), F.col(doc_id).cast("long").alias("doc_id"), row_id(doc_id, text).alias("r")).select("text", "doc_id", "r.a", "r.b")
    return keyed.mapInArrow(freed(run), "doc_id long, ra long, rb long, n_shingles long, digest binary, bands array<long>, sketch binary")


def confirmed(pairs: DataFrame, texts: DataFrame, size: int = WORDS, percent: int = 80) -> DataFrame:
    """Those pairs (a, b) whose full sets have 100 * intersection >= percent * union.

    texts: (c, text) of every class that a pair names.
    """
    left = pairs.join(texts.select(F.col("c").alias("b"), F.col("text").alias("tb")), "b")
    rows = left.join(texts.select(F.col("c").alias("a"), F.col("text").alias("ta")), "a").select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        last, last_set = None, None
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            keep = []
            ta, tb = batch.column(2), batch.column(3)
            for i in range(batch.num_rows):
                if a[i] != last:
                    last, last_set = a[i], shingle_set(ta[i].as_py(), hashes, size)
                other = shingle_set(tb[i].as_py(), hashes, size)
                both = len(np.intersect1d(last_set, other, assume_unique=True))
                if 100 * both >= percent * (len(last_set) + len(other) - both):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), batch.column(1).take(pa.array(keep, pa.int64()))], names=["a", "b"])

    return rows.mapInArrow(freed(run), "a long, b long")


def _pieces(total: int) -> Column:
    """Tasks among which a key with n of the total rows is dealt."""
    return F.greatest(F.ceil(F.col("n") / _most(total)), F.lit(1)).cast("int")


def _most(total: int) -> int:
    return max(HOT_ROWS, -(-total // HOT_KEYS))


def dealt_join(rows: DataFrame, facts: DataFrame, key: str, by: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined with facts, a written table of one row a key with n, the number of rows that the key has.

    Keys with more rows than a task should get are dealt over pieces, by the
    hash of column by; the facts are repeated for each piece.  Of `total` rows
    fewer than HOT_KEYS keys can be such, so their list is broadcast.
    """
    hot = facts.where(F.col("n") > _most(total)).select(key, _pieces(total).alias("_p"))
    pieces = F.coalesce("_p", F.when(F.col(key).isNull(), NULL_PIECES), F.lit(1))
    left = rows.join(F.broadcast(hot), key, "left").withColumn("_s", F.pmod(F.xxhash64(by), pieces).cast("int")).drop("_p")
    right = facts.withColumn("_s", F.explode(F.sequence(F.lit(0), _pieces(total) - 1))).drop("n")
    return left.join(right, [key, "_s"], how).drop("_s")


def _pieces_of(facts: DataFrame) -> DataFrame:
    """Facts of buckets repeated for each piece s."""
    return facts.withColumn("s", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).drop("pieces")


def _stars(groups: DataFrame) -> DataFrame:
    """Pairs of each bucket's least class with its other classes, tested when of different components; groups: g, s, pieces, c, comp."""
    least = groups.groupBy("g").agg(F.min(F.struct("c", "comp")).alias("m"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max("pieces").alias("pieces")).where("lo <> hi")
    pairs = groups.drop("pieces").join(_pieces_of(least), ["g", "s"]).where("c <> m.c and comp <> m.comp")
    return pairs.select(F.col("m.c").alias("a"), F.col("c").alias("b")).distinct()


def _dealt(rows: DataFrame, group: str) -> DataFrame:
    """Blocks (group, i, j) in which every member outside its group's main component meets every member.

    rows: members with their group's main, ka and km: the numbers of blocks of
    all members and of those outside the main component.  Members come with few:
    whether they stand on the side of the latter.
    """
    chunk = lambda k, seed: F.pmod(F.xxhash64("c", F.lit(seed)), F.col(k)).cast("int")
    every = rows.select(group, F.explode(F.sequence(F.lit(0), F.col("km") - 1)).alias("i"), chunk("ka", 1).alias("j"), F.lit(False).alias("few"), "c", "comp")
    few = rows.where("comp <> main").select(group, chunk("km", 2).alias("i"), F.explode(F.sequence(F.lit(0), F.col("ka") - 1)).alias("j"), F.lit(True).alias("few"), "c", "comp")
    return every.unionByName(few)


def _blocks(n: Column, w: Column | None = None) -> Column:
    return F.greatest(F.ceil(n / CELL), F.ceil(w / CELL_CHARS) if w is not None else F.lit(1), F.lit(1)).cast("int")


def _cells(rest: DataFrame, classes: DataFrame) -> DataFrame:
    """Blocks of about CELL members a side that hold every pair of different components of each unresolved bucket; rest: g, s, pieces, c, comp."""
    by_comp = rest.groupBy("g", "comp").agg(F.count(F.lit(1)).alias("n"), F.max("pieces").alias("pieces"))
    top = by_comp.groupBy("g").agg(F.sum("n").alias("n"), F.max(F.struct("n", "comp")).alias("top"), F.max("pieces").alias("pieces"))
    sizes = top.select("g", "pieces", F.col("top.comp").alias("main"), _blocks(F.col("n")).alias("ka"), _blocks(F.col("n") - F.col("top.n")).alias("km"))
    cells = _dealt(rest.select("g", "s", "c", "comp").join(_pieces_of(sizes), ["g", "s"]), "g").join(classes.select("c", "sketch"), "c")
    return cells.groupBy("g", "i", "j").agg(F.collect_list(F.struct("few", "c", "comp", "sketch")).alias("m")).select("m")


def _likely(cells: DataFrame, spanning: bool, least: int) -> DataFrame:
    """Pairs of different components whose sketches agree in at least `least` places.

    The best pair of each member outside the main component; or, spanning, pairs
    that hold together what all such pairs of the cell would.  Either way fewer
    than the cell has members.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, left, right = batch.column(0), [], []
            for r in range(batch.num_rows):
                m = column[r].values
                few, c, comp = (m.field(f).to_numpy(zero_copy_only=False) for f in ("few", "c", "comp"))
                sk = np.frombuffer(b"".join(m.field("sketch").to_pylist()), np.uint8).reshape(len(c), -1)
                there = np.nonzero(~few)[0]
                _, family = np.unique(c, return_inverse=True)
                for x in np.nonzero(few)[0]:
                    other = there[comp[there] != comp[x]]
                    if spanning:
                        other = other[family[other] != family[x]]
                    if not len(other):
                        continue
                    agree = (sk[other] == sk[x]).sum(axis=1)
                    if spanning:
                        other = other[agree >= least]
                        met, first = np.unique(family[other], return_index=True)
                        other = other[first]
                        family[np.isin(family, met)] = family[x]
                    else:
                        best = int(agree.argmax())
                        other = other[best : best + 1] if agree[best] >= least else other[:0]
                    left.append(np.minimum(c[x], c[other]))
                    right.append(np.maximum(c[x], c[other]))
            empty = np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([empty, *z]), pa.int64()) for z in (left, right)], names=["a", "b"])

    return cells.mapInArrow(freed(run), "a long, b long").distinct()


def _family_links(members: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Links between components within families, from full sets, at most one from a member to another component.

    members: family, c, comp.  The members outside a family's largest component
    meet all others, in blocks of bounded size: each text travels once for
    every block of the other side.
    """
    weighed = cut(members.join(texts.select("c", F.length("text").alias("w")), "c"), "family")
    by_comp = weighed.groupBy("family", "comp").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"))
    totals = by_comp.groupBy("family").agg(F.sum("n").alias("n"), F.sum("w").alias("w"), F.max(F.struct("n", "w", "comp")).alias("top"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    sizes = totals.select("family", "n", F.col("top.comp").alias("main"), _blocks(F.col("n"), F.col("w")).alias("ka"), _blocks(F.col("n") - F.col("top.n"), F.col("w") - F.col("top.w")).alias("km"))
    placed = dealt_join(weighed.select("family", "c", "comp"), cut(sizes, "sizes"), "family", "c", weighed.count())
    cells = _dealt(placed, "family").join(texts, "c").groupBy("family", "i", "j").agg(F.collect_list(F.struct("few", "c", "comp", "text")).alias("m")).select("m")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            left, right = [], []
            for r in range(batch.num_rows):
                m = batch.column(0)[r].values
                few, c, comp = (m.field(f).to_numpy(zero_copy_only=False) for f in ("few", "c", "comp"))
                if not few.any() or few.all():
                    continue
                sets = [shingle_set(t, hashes, size) for t in m.field("text").to_pylist()]
                there = np.nonzero(~few)[0]
                sizes = np.array([len(sets[y]) for y in there])
                owner, flat = np.repeat(np.arange(len(there)), sizes), np.concatenate([sets[y] for y in there])
                order = np.argsort(flat, kind="stable")
                owner, flat = owner[order], flat[order]
                for x in np.nonzero(few)[0]:
                    lo, hi = np.searchsorted(flat, sets[x], "left"), np.searchsorted(flat, sets[x], "right")
                    n = hi - lo
                    places = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                    both = np.bincount(owner[places], minlength=len(there))
                    near = np.nonzero((100 * both >= percent * (sizes + len(sets[x]) - both)) & (comp[there] != comp[x]))[0]
                    _, first = np.unique(comp[there[near]], return_index=True)
                    y = c[there[near[first]]]
                    left.append(np.minimum(c[x], y))
                    right.append(np.maximum(c[x], y))
            empty = np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([empty, *z]), pa.int64()) for z in (left, right)], names=["a", "b"])

    return cells.mapInArrow(freed(run), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = WORDS, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs.

    component_id is the smallest doc_id of the rows reachable over confirmed
    links, itself included; kept: doc_id = component_id.  Documents without words
    (null, empty or white space) are linked with nothing.  Rows that repeat a
    doc_id are documents of their own, each linked by its own text.  Rows with a
    null id link no others and are not kept; their component_id is that of the
    rows with their text's set, null without such.  An empty table gives no rows.
    """
    out = grouped(docs, doc_id, text, size, percent, bands, rows)
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def grouped(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = WORDS, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """rid (row_id of id and text), doc_id, n_shingles, component (a number, null without words), component_id for every row, as near_duplicates()."""
    docs = spread(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")))
    sketch = cut(sketches(docs, "doc_id", "text", size, bands, rows), "sketch")
    equal = sketch.where("digest is not null and doc_id is not null").groupBy("digest")
    classes = equal.agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"), F.min(F.struct("ra", "rb")).alias("rid"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    classes = cut(classes.withColumn("c", F.monotonically_increasing_id()), "classes")
    buckets, places = classes.select("c", F.explode("bands").alias("g")), bands * classes.count()
    shared = cut(buckets.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("pieces", _pieces(places)), "shared")
    hot = F.broadcast(shared.where("pieces > 1").select("g", F.col("pieces").alias("_p")))  # fewer than HOT_KEYS
    placed = buckets.join(hot, "g", "left").withColumn("pieces", F.coalesce("_p", F.lit(1))).withColumn("s", F.pmod(F.xxhash64("c"), F.col("pieces")).cast("int"))
    groups = cut(placed.join(_pieces_of(shared.select("g", "pieces")), ["g", "s"]).select("g", "s", "pieces", "c"), "buckets")
    named = classes.join(groups.select("c").distinct(), "c").select("c", F.col("rid.ra").alias("ra"), F.col("rid.rb").alias("rb"))
    own = docs.select("text", row_id().alias("r")).select("text", F.col("r.a").alias("ra"), F.col("r.b").alias("rb"))
    texts = cut(own.join(named, ["ra", "rb"]).dropDuplicates(["c"]).select("c", "text"), "texts")
    labels = None

    def labelled(g: DataFrame) -> DataFrame:
        if labels is None:
            return g.withColumn("comp", F.col("c"))
        return g.join(labels.select(F.col("u").alias("c"), F.col("v").alias("_v")), "c", "left").withColumn("comp", F.coalesce("_v", "c")).drop("_v")

    def join_up(found: DataFrame) -> None:
        nonlocal labels
        links = cut(found, "links")
        labels = components(links if labels is None else links.unionByName(labels.select(F.col("u").alias("a"), F.col("v").alias("b"))))

    def unresolved() -> DataFrame:
        now = labelled(groups)
        mixed = now.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max("pieces").alias("pieces")).where("lo <> hi and n > 2")
        return cut(now.join(_pieces_of(mixed.select("g", "pieces")), ["g", "s"]).select("g", "s", "pieces", "c", "comp"), "rest")

    join_up(confirmed(_stars(labelled(groups)), texts, size, percent))
    least = int(bands * rows * (percent / 100 - SLACK))
    rest = unresolved()
    if rest.limit(1).count():
        join_up(confirmed(_likely(_cells(rest, classes), False, least), texts, size, percent))
        discard(rest)
        rest = unresolved()
        families = components(cut(_likely(_cells(rest, classes), True, least), "likely"))
        members = families.select(F.col("v").alias("family"), F.col("u").alias("c")).unionByName(families.select(F.col("v").alias("family"), F.col("v").alias("c")).distinct())
        comp = rest.select("c", "comp").distinct()
        join_up(_family_links(members.join(comp, "c"), texts, size, percent))
    discard(rest)
    discard(groups)
    discard(texts)
    # The least id of each component of several classes, and back to its classes.
    joined = labels.select(F.col("v").alias("component"), F.col("u").alias("c")).unionByName(labels.select(F.col("v").alias("component"), F.col("v").alias("c")).distinct())
    joined = cut(joined.join(classes.select("c", "least"), "c"), "joined")
    first = cut(joined.groupBy("component").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n")), "first")
    linked = dealt_join(joined.select("component", "c"), first, "component", "c", joined.count())
    ids = classes.select("digest", "n", "c", "least").join(linked, "c", "left")
    ids = cut(ids.select("digest", "n", F.coalesce("component", "c").alias("component"), F.coalesce("component_id", "least").alias("component_id")), "ids")
    out = dealt_join(sketch.select("doc_id", "ra", "rb", "n_shingles", "digest"), ids, "digest", "ra", sketch.count(), "left")
    alone = F.when(F.col("component").isNull(), F.col("doc_id"))
    return out.select(F.struct(F.col("ra").alias("a"), F.col("rb").alias("b")).alias("rid"), "doc_id", "n_shingles", "component", F.coalesce("component_id", alone).alias("component_id"))
