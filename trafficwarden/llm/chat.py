"""Preference formatting: one prompt and two masked completions from a chosen and a rejected conversation.

The turns that both conversations of a pair share at their start, the longest common prefix, are
rendered once as prompt; what follows is rendered for each side, and only the answers in it are to be
learned. The result has a row per rendered turn, so a conversation of any length is spread over
tasks: the prefix is found by a full outer join of the turns and the smallest turn that has no
partner, which is aggregated with map-side combination. Native functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trafficwarden.llm.common import materialise
from trafficwarden.operators.order import with_position

#: The role whose turns are learned, and what stands before and after a turn's text.
LEARNED, BEFORE, BETWEEN, AFTER = "assistant", "<|", "|>\n", "<|end|>\n"

KEY = ["pair", "turn", "role", "text", "copy"]


def _numbered(turns: DataFrame, pair: str) -> DataFrame:
    """Turns with nulls as empty strings, and a number for copies of the same turn."""
    t = turns.select(F.col(pair).alias("pair"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).filter("pair is not null and turn is not null")
    return t.withColumn("copy", F.row_number().over(W.partitionBy("pair", "turn", "role", "text").orderBy(F.lit(1))))


def format_preferences(chosen: DataFrame, rejected: DataFrame, pair: str = "conv_id") -> DataFrame:
    """Rows (pair, part, turn, role, copy, text, learned_from, learned_to); part is prompt, chosen or rejected.

    Both tables have the columns pair, turn, role, text; others are not read. Turns stand in the order
    of turn, then role, text and copy, which settles ties and repeated rows. A null role or text is
    empty; rows of a null pair or turn take no part. Pairs of one side only are left out; a pair
    whose sides are equal is all prompt. learned_from and learned_to bound the learned characters of
    the rendered text: the answer and its end mark in completions, else both 0. Empty tables give no
    rows.
    """
    one, two = _numbered(chosen, pair), _numbered(rejected, pair)
    both = one.withColumn("c", F.lit(True)).join(two.withColumn("r", F.lit(True)), KEY, "full_outer").select(*KEY, F.coalesce("c", F.lit(False)).alias("c"), F.coalesce("r", F.lit(False)).alias("r"))
    place = F.struct("turn", "role", "text", "copy")
    fork = both.groupBy("pair").agg(F.bool_or("c").alias("has_c"), F.bool_or("r").alias("has_r"), F.min(F.when(~(F.col("c") & F.col("r")), place)).alias("fork")).filter("has_c and has_r").select("pair", "fork")
    parts = F.when(F.col("fork").isNull() | (place < F.col("fork")), F.array(F.lit("prompt"))).otherwise(F.array_compact(F.array(F.when(F.col("c"), F.lit("chosen")), F.when(F.col("r"), F.lit("rejected")))))
    rows = both.join(fork, "pair").select("pair", F.explode(parts).alias("part"), "turn", "role", "copy", "text")
    head = F.concat(F.lit(BEFORE), F.col("role"), F.lit(BETWEEN))
    learned = (F.col("part") != "prompt") & (F.col("role") == LEARNED)
    whole = F.concat(head, F.col("text"), F.lit(AFTER))
    return rows.select(
        F.col("pair").alias(pair), "part", "turn", "role", F.col("copy").cast("long").alias("copy"), whole.alias("text"),
        F.when(learned, F.length(head)).otherwise(0).cast("long").alias("learned_from"), F.when(learned, F.length(whole)).otherwise(0).cast("long").alias("learned_to"),
    )


def _with_ends(turns: DataFrame, ends: DataFrame) -> DataFrame:
    before = turns.join(ends, "conv_id").filter("turn < end").select("conv_id", "turn", "role", "text")
    return before.unionByName(ends.select("conv_id", F.col("end").alias("turn"), F.lit(LEARNED).alias("role"), F.col("other").alias("text")))


def _last_answers(turns: DataFrame) -> DataFrame:
    return turns.filter((F.col("role") == LEARNED) & F.col("conv_id").isNotNull()).groupBy("conv_id").agg(F.max(F.struct("turn", "text")).alias("last"))


def swapped_answers(turns: DataFrame) -> DataFrame:
    """Rejected conversations: each conversation up to its last answer, with the last answer of the conversation of the next id in its place.

    Conversations without an answer, or whose id plus one has none, get none.
    """
    last = _last_answers(turns)
    given = last.select((F.col("conv_id") - 1).alias("conv_id"), F.col("last.text").alias("other"))
    return _with_ends(turns, last.join(given, "conv_id").select("conv_id", F.col("last.turn").alias("end"), "other"))


def swapped_answers_all(turns: DataFrame) -> DataFrame:
    """As ``swapped_answers``, but with the last answer of the next conversation in id order that has one; the first follows the last.

    Every conversation with an answer gets one; where a single one has an answer it gets its own.
    """
    last = materialise(_last_answers(turns.filter("turn is not null")), "answers")
    placed = materialise(with_position(last, ["conv_id"]), "placed")
    n = placed.count()
    given = placed.select(F.pmod(F.col("position") - 1, F.lit(max(n, 1))).alias("position"), F.col("last.text").alias("other"))
    return _with_ends(turns, placed.join(given, "position").select("conv_id", F.col("last.turn").alias("end"), "other"))


def op7_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation with an answer against itself with the last answer of the next one that has any."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    out = format_preferences(turns, swapped_answers_all(turns))
    return out.select("conv_id", "part", "turn", "role", "copy", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"), "learned_from", "learned_to")


OP7_SQL = r"""
WITH last AS (SELECT conv_id, max({'t': turn, 'x': text}) AS l FROM conversations WHERE role = 'assistant' AND conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY conv_id),
placed AS (SELECT *, row_number() OVER (ORDER BY conv_id) - 1 AS i, count(*) OVER () AS n FROM last),
ends AS (SELECT a.conv_id, a.l.t AS e, b.l.x AS other FROM last a JOIN placed p ON p.conv_id = a.conv_id JOIN placed b ON b.i = (p.i + 1) % p.n),
c0 AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
r0 AS (SELECT conv_id, turn, role, text FROM c0 JOIN ends USING (conv_id) WHERE turn < e UNION ALL SELECT conv_id, e, 'assistant', coalesce(other, '') FROM ends),
c AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn, role, text) AS copy FROM c0),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn, role, text) AS copy FROM r0),
b AS (SELECT conv_id, turn, role, text, copy, c.conv_id IS NOT NULL AS in_c, r.conv_id IS NOT NULL AS in_r FROM c FULL JOIN r USING (conv_id, turn, role, text, copy)),
f AS (SELECT conv_id, min({'t': turn, 'r': role, 'x': text, 'k': copy}) FILTER (NOT (in_c AND in_r)) AS fork FROM b GROUP BY conv_id HAVING bool_or(in_c) AND bool_or(in_r)),
p AS (SELECT b.*, fork IS NULL OR {'t': turn, 'r': role, 'x': text, 'k': copy} < fork AS shared FROM b JOIN f USING (conv_id)),
s AS (SELECT conv_id, 'prompt' AS part, turn, role, copy, text FROM p WHERE shared
  UNION ALL SELECT conv_id, 'chosen', turn, role, copy, text FROM p WHERE NOT shared AND in_c
  UNION ALL SELECT conv_id, 'rejected', turn, role, copy, text FROM p WHERE NOT shared AND in_r),
w AS (SELECT *, '<|' || role || '|>' || chr(10) AS head, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS whole, part <> 'prompt' AND role = 'assistant' AS learned FROM s)
SELECT conv_id, part, turn, role, copy, CAST(length(whole) AS BIGINT) AS n_chars, md5(whole) AS text_md5, CAST(CASE WHEN learned THEN length(head) ELSE 0 END AS BIGINT) AS learned_from, CAST(CASE WHEN learned THEN length(whole) ELSE 0 END AS BIGINT) AS learned_to FROM w
"""
