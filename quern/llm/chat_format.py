"""Multi-party perspective rotation of conversations.

For every participant of a conversation, the dialogue is rendered with that
speaker as the assistant and all others as named users; the mask says which
characters are the assistant's, its end mark included. Speakers in `context`
(system turns) take no perspective and are rendered as they are in all.

The rendering of a dialogue is the concatenation of its segments by `seq`; each
row is a segment with its place (start, end; code points) in the dialogue. So no
task ever holds a dialogue, however long: places come from sums over blocks of
`block` turns, and from sums over those blocks.

A segment is  <|assistant|>NL text <|end|>NL  or  <|user name=...|>NL text
<|end|>NL  or  <|system|>NL text <|end|>NL, where NL is a line break. In texts
and names <| is written <\\|, and in names |> is written |\\>, so that no text can
pose as a mark.

Defined results: turns follow by (turn with null last, speaker, text); a null
speaker is named unknown; a null text is empty; turns with a null conversation
belong to none, and are left out; repeated turns are rendered each; a conversation without
participants gives no rows; an empty table gives an empty result; other columns
are not used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm._store import written

CONTEXT = ("system",)
BLOCK = 256


def escaped(text: Column) -> Column:
    return F.replace(text, F.lit("<|"), F.lit("<\\|"))


def escaped_name(name: Column) -> Column:
    """A name cannot end its head, either."""
    return F.replace(escaped(name), F.lit("|>"), F.lit("|\\>"))


def rotate(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role", text_col: str = "text", context: tuple[str, ...] = CONTEXT, block: int = BLOCK) -> DataFrame:
    """Segments: conversation, perspective, seq, speaker, segment, start, end, mask_start, mask_end (null where nothing is the assistant's)."""
    speaker = F.coalesce(F.col(speaker_col).cast("string"), F.lit("unknown"))
    own = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), speaker.alias("speaker"), escaped(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("body"))
    own = written(own.where("conv IS NOT NULL").withColumn("block", F.coalesce(F.floor(F.col("turn") / block), F.lit(2**62))), "turns")
    people = written(own.select(F.col("conv").alias("__conv"), F.col("speaker").alias("perspective")).distinct().where(~F.col("perspective").isin(*context)), "people")
    both = own.join(people, F.col("conv").eqNullSafe(F.col("__conv"))).drop("__conv")
    mine = F.col("speaker") == F.col("perspective")
    head = F.when(F.col("speaker").isin(*context), F.concat(F.lit("<|"), F.col("speaker"), F.lit("|>\n"))).when(mine, F.lit("<|assistant|>\n")).otherwise(F.concat(F.lit("<|user name="), escaped_name(F.col("speaker")), F.lit("|>\n")))
    segments = both.withColumn("head", head).withColumn("segment", F.concat("head", "body", F.lit("<|end|>\n")))
    segments = segments.withColumn("size", F.char_length("segment").cast("long"))
    totals = segments.groupBy("conv", "perspective", "block").agg(F.sum("size").alias("chars"), F.count(F.lit(1)).alias("turns"))
    before = Window.partitionBy("conv", "perspective").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row per block of turns
    none = F.lit(0).cast("long")
    offsets = written(totals.select("conv", "perspective", "block", F.coalesce(F.sum("chars").over(before), none).alias("chars"), F.coalesce(F.sum("turns").over(before), none).alias("turns")), "offsets")
    order = Window.partitionBy("conv", "perspective", "block").orderBy(F.col("turn").asc_nulls_last(), "speaker", "body")
    inner = order.rowsBetween(Window.unboundedPreceding, -1)
    placed = segments.withColumn("at", F.coalesce(F.sum("size").over(inner), none)).withColumn("k", F.row_number().over(order) - 1)
    right = offsets.select(F.col("conv").alias("__conv"), F.col("perspective").alias("__p"), F.col("block").alias("__b"), "chars", "turns")
    joined = placed.join(right, F.col("conv").eqNullSafe(F.col("__conv")) & (F.col("perspective") == F.col("__p")) & (F.col("block") == F.col("__b")))
    start = F.col("chars") + F.col("at")
    mask_start = F.when(mine, start + F.char_length("head"))
    return joined.select(
        F.col("conv").alias(conv_col), "perspective", (F.col("turns") + F.col("k")).alias("seq"), "speaker", "segment", start.alias("start"), (start + F.col("size")).alias("end"),
        mask_start.alias("mask_start"), F.when(mine, start + F.col("size")).alias("mask_end"),
    )


def op3_chat_rotation(spark, sf_dir: str) -> DataFrame:
    return rotate(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


SQL = """
WITH own AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, replace(coalesce(text, ''), '<|', '<\\|') AS body FROM conversations WHERE conv_id IS NOT NULL),
people AS (SELECT DISTINCT conv_id, speaker AS perspective FROM own WHERE speaker NOT IN ('system')),
segments AS (SELECT o.*, perspective, CASE WHEN speaker = 'system' THEN '<|system|>' WHEN speaker = perspective THEN '<|assistant|>' ELSE '<|user name=' || replace(replace(speaker, '<|', '<\\|'), '|>', '|\\>') || '|>' END || chr(10) AS head
  FROM own o JOIN people p ON o.conv_id IS NOT DISTINCT FROM p.conv_id),
sized AS (SELECT *, head || body || '<|end|>' || chr(10) AS segment, length(head || body) + 8 AS size FROM segments),
placed AS (SELECT *, row_number() OVER w - 1 AS seq, coalesce(sum(size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM sized WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS LAST, speaker, body))
SELECT conv_id, perspective, seq, speaker, segment, start, start + size AS "end", CASE WHEN speaker = perspective THEN start + length(head) END AS mask_start, CASE WHEN speaker = perspective THEN start + size END AS mask_end FROM placed
"""
