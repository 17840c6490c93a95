"""Collapse of cumulative conversation snapshots, and chat rendering.

A logged conversation is often the prefix of a later snapshot of itself.  Every
turn gets a rolling hash of the turns up to it: the running sum, over turns in
order, of two 60-bit hashes salted with the turn's place.  A conversation whose
last hash is the rolling hash of an earlier turn of another one is a prefix of
it and goes (anti-join); of equal conversations the one with the smallest id
stays.  What stays is rendered with role markers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The markers of the rendered form.
START, END = "<|im_start|>", "<|im_end|>"


def _turns(df: DataFrame) -> DataFrame:
    """Distinct turns with their place; nulls of role and text become empty strings, turns without conv_id take no part."""
    rows = df.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    return rows.distinct()


def prefix_hashes(df: DataFrame) -> DataFrame:
    """conv_id, place, p, last: the rolling hash p of each turn's prefix, and whether the turn is the last."""
    slim = _turns(df).select("conv_id", "turn", F.sha2(F.concat_ws("\u001f", "role", "text"), 256).alias("h"))
    by_turn = Window.partitionBy("conv_id").orderBy("turn", "h")
    placed = slim.withColumn("place", F.row_number().over(by_turn))
    lane = lambda salt: F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(salt), "place", "h"), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    run = Window.partitionBy("conv_id").orderBy("turn", "h").rowsBetween(Window.unboundedPreceding, 0)
    rolled = placed.withColumn("p", F.struct(F.sum(lane("a")).over(run).alias("a"), F.sum(lane("b")).over(run).alias("b")))
    return rolled.withColumn("last", F.lead("place").over(by_turn).isNull()).select("conv_id", "place", "p", "last")


def maximal(df: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies of the conversations that are no prefix of a longer one.

    n_copies counts the equal conversations, of which the smallest id stays.
    Identical turns of a conversation count once; turns of the same number are
    ordered by their hash.  An empty table gives no rows.
    """
    hashes = prefix_hashes(df)
    # Grouping by hash comes first: a conversation logged a million times is one row in the joins.
    whole = hashes.where("last").groupBy("p").agg(F.min("conv_id").alias("conv_id"), F.max("place").cast("long").alias("n_turns"), F.count(F.lit(1)).alias("n_copies"))
    inner = hashes.where(~F.col("last")).select("p").distinct()
    return whole.join(inner, "p", "left_anti").select("conv_id", "n_turns", "n_copies")


def render(df: DataFrame, kept: DataFrame) -> DataFrame:
    """kept with column rendered: the turns in order, each as start marker, role, line end, text, end marker, line end.

    Markers inside a text are broken by a space, so that a text can't open or
    close a turn.  One conversation is one value, so its turns meet in one row.
    """
    clean = F.regexp_replace("text", r"<\|(im_start|im_end)\|>", r"<| $1 |>")
    piece = F.concat(F.lit(START), "role", F.lit("\n"), clean, F.lit(END + "\n"))
    order = F.sha2(F.concat_ws("\u001f", "role", "text"), 256)
    rows = _turns(df).join(kept.select("conv_id"), "conv_id", "left_semi").select("conv_id", F.struct("turn", order.alias("h"), piece.alias("piece")).alias("t"))
    texts = rows.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("t")), lambda t: t["piece"]), "").alias("rendered"))
    return kept.join(texts, "conv_id")


def collapsed(df: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies, rendered of the maximal conversations.

    Null roles and texts are empty, repeated turns count once, turns without
    conv_id take no part; an empty table gives no rows.
    """
    return render(df, maximal(df))


#: The same by whole prefixes instead of hashes.
ORACLE = """
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT conv_id, turn, row_number() OVER w AS place, count(*) OVER (PARTITION BY conv_id) AS n,
  string_agg(role || chr(31) || text || chr(30), '') OVER (PARTITION BY conv_id ORDER BY turn, sha256(role || chr(31) || text) ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS prefix,
  string_agg('<|im_start|>' || role || chr(10) || regexp_replace(text, '<\\|(im_start|im_end)\\|>', '<| \\1 |>', 'g') || '<|im_end|>' || chr(10), '') OVER (PARTITION BY conv_id ORDER BY turn, sha256(role || chr(31) || text) ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS rendered
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, sha256(role || chr(31) || text))),
whole AS (SELECT prefix, min(conv_id) AS conv_id, max(place) AS n_turns, count(*) AS n_copies, any_value(rendered) AS rendered FROM p WHERE place = n GROUP BY prefix)
SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, CAST(n_copies AS BIGINT) AS n_copies, rendered FROM whole
WHERE prefix NOT IN (SELECT prefix FROM p WHERE place < n)
"""
