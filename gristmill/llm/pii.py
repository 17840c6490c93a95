r"""Personal data by rules and by bootstrapped contextual extraction, in DataFrame operations only.

Rules find e-mail and IP addresses, card and phone numbers: the seeds.  Around
every seed stand lexical patterns: the two words before it, and the word before
together with the word after.  Other identifier-like tokens (with a digit or an
@) in the same patterns are candidate instances.  Patterns and instances form a
bipartite graph that is scored in rounds: a pattern trusts a kind by the share
of its distinct instances that are known to be of the kind, and an instance
inherits the best trust among its patterns.  Instances trusted enough join the
seeds of the next round; those that patterns of high trust reach become spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.llm.common import cut, discard, row_id, spread

#: The kinds in listed order, with their patterns.  The guards in
#: front keep the scan linear: a match can only begin where a run of its first
#: class begins, or right behind the match before it.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]+){3}",
    "card": r"(?:(?<![0-9])|\G)[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = tuple(PATTERNS)
#: Identifier-like tokens: with a digit or an @.
TOKEN = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
#: A text that fails this has no match of the kind.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){11}", "phone": r"\+[0-9]"}
#: Trust that a pattern needs for its kind, distinct known instances behind it.
TRUST, SUPPORT = 0.8, 5
#: Characters looked at on either side for context words; of a longer word the nearest ones stand for it.
NEAR = 60


def _valid(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: F.coalesce(p.try_cast("int") <= 255, F.lit(False)))
    if kind == "card":
        return F.length(digits).between(12, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _around(kind: str, matches: str, pieces: str):
    """Of the k-th match: its kind and place in order, the length of the text between it and the match before, itself, and the text on either side, other matches included."""

    def of(m: Column, k: Column) -> Column:
        p, x = F.col(pieces), F.col(matches)
        gap, after = F.get(p, k), F.get(p, k + 1)
        # A match and the piece beside it have two characters at least, so NEAR / 2 of them cover NEAR.
        n, least = F.least(k, F.lit(NEAR // 2)), F.lit(NEAR // 2)
        left = F.zip_with(F.slice(p, k - n + 1, n), F.slice(x, k - n + 1, n), lambda g, y: F.concat(F.right(g, F.lit(NEAR)), F.right(y, F.lit(NEAR))))
        right = F.zip_with(F.slice(x, k + 2, least), F.slice(p, k + 3, least), lambda y, g: F.concat(F.left(y, F.lit(NEAR)), F.left(g, F.lit(NEAR))))
        before = F.right(F.concat(F.array_join(left, ""), F.right(gap, F.lit(NEAR))), F.lit(NEAR))
        behind = F.left(F.concat(F.left(after, F.lit(NEAR)), F.array_join(right, "")), F.lit(NEAR))
        return F.struct(F.lit(kind).alias("kind"), k.alias("k"), F.length(gap).alias("gap"), m.alias("m"), before.alias("before"), behind.alias("after"))

    return of


def _matches(docs: DataFrame, kinds: dict[str, tuple[str, str]]) -> DataFrame:
    """rid, kind, k, m, start, end, before, after of every match; docs: rid, text."""
    parts = []
    text = F.col("text")
    # One scan finds all kinds; each kind's pieces are made only for texts that can hold it.
    slim = docs.withColumns({f"has_{kind}": text.contains("@") if needs == "@" else text.rlike(needs) for kind, (_, needs) in kinds.items()})
    for kind, (pattern, _) in kinds.items():
        m, pieces = f"m_{kind}", f"p_{kind}"
        slim = slim.withColumn(m, F.when(F.col(f"has_{kind}"), F.regexp_extract_all("text", F.lit(pattern), F.lit(0))))
        slim = slim.withColumn(pieces, F.when(F.size(m) > 0, F.split("text", pattern, -1)))
        parts.append(F.when(F.size(m) > 0, F.transform(m, _around(kind, m, pieces))).otherwise(F.array()))
    # Outer: else the planner adds a filter on the array's size, with all patterns matched once more.
    found = slim.select("rid", F.explode_outer(F.concat(*parts) if len(parts) > 1 else parts[0]).alias("f")).where("f is not null")
    rows = found.select("rid", "f.*").dropDuplicates(["rid", "kind", "k"])
    # Places are running sums; rows are matches only, so this moves little.
    w = Window.partitionBy("rid", "kind").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.length("m")).over(w)
    return rows.withColumn("end", end).withColumn("start", F.col("end") - F.length("m")).drop("gap")


def base_spans(docs: DataFrame) -> DataFrame:
    """rid, kind, start, end, m, before, after of the spans that the rules accept."""
    found = _matches(docs, {k: (PATTERNS[k], NEEDS[k]) for k in KINDS})
    keep = F.lit(False)
    for kind in KINDS:
        keep = F.when(F.col("kind") == kind, _valid(kind, F.col("m"))).otherwise(keep)
    return found.where(keep).drop("k")


def _patterns() -> Column:
    """The lexical patterns around a match; null where context is missing."""
    last = F.lower(F.regexp_extract("before", r"(\S+)\s*$", 1))
    two = F.lower(F.regexp_extract("before", r"(\S+\s+\S+)\s*$", 1))
    first = F.lower(F.regexp_extract("after", r"^\s*(\S+)", 1))
    return F.array(
        F.when(two != "", F.concat(F.lit("2 "), F.regexp_replace(two, r"\s+", " "))),
        F.when((last != "") & (first != ""), F.concat(F.lit("1 "), last, F.lit(" _ "), first)),
    )


def grown_spans(docs: DataFrame, base: DataFrame, trust: float = TRUST, support: int = SUPPORT) -> DataFrame:
    """rid, kind, start, end of tokens outside the base spans that trusted patterns hold.

    Rounds go on until one adds no instance.  An instance keeps the kind it has
    first, so patterns only gain trust, the set only grows, and the rounds end.
    """
    tokens = _matches(docs, {"token": (TOKEN, "[0-9@]")}).drop("k", "kind")
    # Tokens that overlap a base span are parts of it.
    taken = base.groupBy("rid").agg(F.collect_list(F.struct(F.col("start").alias("a"), F.col("end").alias("b"))).alias("spans"))
    free = tokens.join(taken, "rid", "left").where(~F.coalesce(F.exists("spans", lambda s: (s["a"] < F.col("end")) & (F.col("start") < s["b"])), F.lit(False))).drop("spans")
    around = lambda df, kind: df.select("rid", kind.alias("kind"), "start", "end", F.lower("m").alias("value"), F.explode(F.filter(_patterns(), lambda p: p.isNotNull())).alias("pattern"))
    graph = cut(around(base, F.col("kind")).unionByName(around(free, F.lit(None).cast("string"))), "graph")
    # Edges of distinct instances; an instance's own kind, if a rule gave it one.
    edges = graph.groupBy("pattern", "value").agg(F.max("kind").alias("known"))
    grown, n = None, 0
    while True:
        if grown is not None:
            edges_now = edges.join(grown.withColumnRenamed("kind", "learned"), "value", "left").select("pattern", F.coalesce("known", "learned").alias("kind"))
        else:
            edges_now = edges.select("pattern", F.col("known").alias("kind"))
        counts = edges_now.groupBy("pattern").agg(*(F.count(F.when(F.col("kind") == k, 1)).alias(k) for k in KINDS), F.count(F.lit(1)).alias("n"))
        best = F.greatest(*(F.struct(F.col(k).alias("c"), F.lit(k).alias("kind")) for k in KINDS))
        trusted = counts.withColumn("best", best).select("pattern", F.col("best.kind").alias("kind"), F.col("best.c").alias("c"), (F.col("best.c") / F.col("n")).alias("trust")).where((F.col("c") >= support) & (F.col("trust") >= trust))
        step = edges.where("known is null").join(trusted, "pattern").groupBy("value").agg(F.max(F.struct("trust", "kind")).alias("t")).select("value", F.col("t.kind").alias("kind"))
        if grown is not None:
            step = step.join(grown.withColumnRenamed("kind", "first"), "value", "left").select("value", F.coalesce("first", "kind").alias("kind"))
        step = cut(step, "grown")
        last_trusted = cut(trusted.select("pattern", F.col("kind").alias("as_kind")), "trusted")
        found, n = n, step.count()
        if grown is not None:
            discard(grown)
        if n == found:
            discard(step)
            break
        grown = step
        discard(last_trusted)
    return graph.where("kind is null").join(last_trusted, "pattern").groupBy("rid", "start", "end").agg(F.min("as_kind").alias("kind"))


def spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """For every row: doc_id, n_email, n_ip, n_card, n_phone, base (spans of the rules), spans (all), as kind:start:end joined by commas, and rid, by which masked() finds it.

    Places are in code points, end exclusive, by start and then kind as listed.
    Null and empty texts have no spans.  Repeated rows are rows of their own.
    """
    rows = spread(docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))).withColumn("rid", row_id())
    order = F.array_position(F.array(*(F.lit(k) for k in KINDS)), F.col("kind"))
    base = cut(base_spans(rows), "spans")
    grown = grown_spans(rows, base)
    every = base.select("rid", "kind", "start", "end", F.lit(True).alias("rule")).unionByName(grown.select("rid", "kind", "start", "end", F.lit(False).alias("rule")))
    per = every.groupBy("rid").agg(
        *(F.count(F.when((F.col("kind") == k) & F.col("rule"), 1)).alias(f"n_{k}") for k in KINDS),
        F.array_sort(F.collect_list(F.struct("start", order.alias("o"), "end", "kind", "rule"))).alias("s"),
    )
    show = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    per = per.withColumn("base", show(F.filter("s", lambda x: x["rule"]))).withColumn("spans", show(F.col("s"))).drop("s")
    out = rows.select("rid", "doc_id").join(per, "rid", "left")
    return out.select("doc_id", *(F.coalesce(F.col(f"n_{k}"), F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS), F.coalesce("base", F.lit("")).alias("base"), F.coalesce("spans", F.lit("")).alias("spans"), "rid")


def masked(docs: DataFrame, found: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with every span of `found` (rid, spans: by spans() of the same rows) replaced by its kind in brackets; where spans overlap, the earlier one counts.

    Every row is masked by its own text's spans, whether its id is null or
    repeated; null texts stay null, and equal rows stay as many as they are.
    """
    parts = F.transform(F.filter(F.split("_spans", ","), lambda s: s != ""), lambda s: F.split(s, ":"))
    cleared = F.aggregate(
        parts,
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda acc, p: F.when(
            p[1].cast("int") >= acc["at"],
            F.struct(F.concat(acc["out"], F.substring(F.col(text), acc["at"] + 1, p[1].cast("int") - acc["at"]), F.lit("["), p[0], F.lit("]")).alias("out"), p[2].cast("int").alias("at")),
        ).otherwise(acc),
        lambda acc: F.concat(acc["out"], F.substring(F.col(text), acc["at"] + 1, F.length(text))),
    )
    some = found.where("spans <> ''").select(F.col("rid").alias("_rid"), F.col("spans").alias("_spans")).dropDuplicates(["_rid"])
    keyed = docs.withColumn("_text", F.coalesce(F.col(text), F.lit(""))).withColumn("_rid", row_id(doc_id, "_text")).drop("_text")
    return keyed.join(some, "_rid", "left").withColumn(text, F.when(F.col("_spans").isNotNull(), cleared).otherwise(F.col(text))).select(*docs.columns)


def digests(docs: DataFrame) -> DataFrame:
    """spans() with the SHA-256 of the rules' spans in place of column base: one row for each of docs, repeated rows, null ids and texts included."""
    out = spans(docs)
    return out.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")
