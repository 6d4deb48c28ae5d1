"""Perspective rotation of multi-party dialogues.

For every participant of a dialogue the whole dialogue is rendered once with that speaker as the assistant, the others as
named users and the narrator's turns as system messages. The result has a row for each turn of each rendering, with its
place in the rendered text and whether it is trained on, so a dialogue of any length stays spread over many rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelens.llm.common import written

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def _unmarked(text: Column) -> Column:
    return F.replace(text, F.lit("<|im_"), F.lit("< |im_"))


def _header(role: Column, name: Column) -> Column:
    """A turn's first line. In the name markers are broken up as in texts, and line ends are spaces."""
    name = F.regexp_replace(_unmarked(name), r"[\r\n]+", " ")
    return F.concat(F.lit(OPEN), role, F.when(role == "user", F.concat(F.lit(" name="), name)).otherwise(F.lit("")), F.lit("\n"))


def rotate(turns: DataFrame, conv: str = "conv_id", order: str = "turn", speaker: str = "role", text: str = "text", narrators: tuple[str, ...] = ("system",)) -> DataFrame:
    """A row for each turn of each dialogue under each participant's perspective.

    Columns: conv_id, perspective, turn, position (from 0), speaker, chat_role (assistant, user, system), rendered,
    train (the perspective's own turns), start_char and end_char of the rendered turn in the rendered dialogue, and
    body_start and body_end of the text alone: the part that is trained on where train holds.

    Turns are ordered by (turn, speaker, text), a null turn first. A null or empty speaker is the participant "unknown";
    a null text is empty; markers inside a text are broken up by a space, so they can't open or close a turn, and in a
    speaker's name of the rendered header too, where line ends become a space; the column speaker is unchanged. Repeated
    rows are repeated turns. A dialogue with narrators only has no perspective and so no row; an empty table gives none.
    Other columns of the input are ignored. A null conv is a dialogue of its own.
    """
    named = F.when(F.coalesce(F.col(speaker), F.lit("")) == "", F.lit("unknown")).otherwise(F.col(speaker))
    rows = turns.select(
        F.col(conv).alias("conv_id"),
        F.col(order).alias("turn"),
        named.alias("speaker"),
        _unmarked(F.coalesce(F.col(text), F.lit(""))).alias("body"),
        F.monotonically_increasing_id().alias("_row"),
    )
    # Ranges of the total order, written once: a long dialogue lies in many of them, and a row's range never changes.
    keys = ["conv_id", "turn", "speaker", "body", "_row"]
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(rows.repartitionByRange(n, *keys).withColumn("_range", F.spark_partition_id()), "turns")
    # A dialogue's cast meets its ranges first, then the turns by range and dialogue: a very long dialogue, or one with
    # very many speakers, is dealt by range, and no list of speakers is ever made.
    casts = ranged.filter(~F.col("speaker").isin(*narrators)).select(F.col("conv_id").alias("_conv"), F.col("speaker").alias("perspective")).distinct()
    places = ranged.select(F.col("_range").alias("_at"), F.col("conv_id").alias("_of")).distinct()
    views = places.join(casts, F.col("_of").eqNullSafe(F.col("_conv"))).drop("_conv")
    seen = ranged.join(views, (F.col("_range") == F.col("_at")) & F.col("conv_id").eqNullSafe(F.col("_of"))).drop("_at", "_of")
    role = F.when(F.col("speaker") == F.col("perspective"), "assistant").when(F.col("speaker").isin(*narrators), "system").otherwise("user")
    head = _header(F.col("chat_role"), F.col("speaker"))
    seen = seen.withColumn("chat_role", role).withColumn("_head", F.length(head)).withColumn("_size", F.col("_head") + F.length("body") + len(CLOSE))
    # Two-level running sums: inside a range, and over the ranges before it.
    per = ["_range", "conv_id", "perspective"]
    before = Window.partitionBy("conv_id", "perspective").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        seen.groupBy(*per).agg(F.sum("_size").alias("_n"), F.count("*").alias("_k"))
        .select(F.col("_range").alias("_r"), F.col("conv_id").alias("_c"), F.col("perspective").alias("_p"),
                F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_chars"), F.coalesce(F.sum("_k").over(before), F.lit(0)).alias("_turns"))
    )
    inside = Window.partitionBy(*per).orderBy("turn", "speaker", "body", "_row")
    local = seen.withColumn("_end", F.sum("_size").over(inside.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_pos", F.row_number().over(inside))
    same = (F.col("_range") == F.col("_r")) & F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("perspective") == F.col("_p"))
    end = F.col("_chars") + F.col("_end")
    start = end - F.col("_size")
    return local.join(offsets, same).select(
        "conv_id",
        "perspective",
        "turn",
        (F.col("_turns") + F.col("_pos") - 1).cast("long").alias("position"),
        "speaker",
        "chat_role",
        F.concat(head, F.col("body"), F.lit(CLOSE)).alias("rendered"),
        (F.col("chat_role") == "assistant").alias("train"),
        start.cast("long").alias("start_char"),
        end.cast("long").alias("end_char"),
        (start + F.col("_head")).cast("long").alias("body_start"),
        (end - len(CLOSE)).cast("long").alias("body_end"),
    )


SQL = f"""
WITH t AS (
  SELECT conv_id, turn, CASE WHEN coalesce(role, '') = '' THEN 'unknown' ELSE role END AS speaker,
         replace(coalesce(text, ''), '<|im_', '< |im_') AS body
  FROM conversations),
p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> 'system'),
s AS (
  SELECT t.*, p.perspective,
         CASE WHEN speaker = perspective THEN 'assistant' WHEN speaker = 'system' THEN 'system' ELSE 'user' END AS chat_role
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
h AS (
  SELECT *, '{OPEN}' || chat_role || CASE WHEN chat_role = 'user' THEN ' name=' || regexp_replace(replace(speaker, '<|im_', '< |im_'), '[\\r\\n]+', ' ', 'g') ELSE '' END || chr(10) AS head
  FROM s),
r AS (
  SELECT *, head || body || '<|im_end|>' || chr(10) AS rendered,
         sum(length(head) + length(body) + 11) OVER w AS e, row_number() OVER w AS n
  FROM h
  WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, body ROWS UNBOUNDED PRECEDING))
SELECT conv_id, perspective, turn, CAST(n - 1 AS BIGINT) AS "position", speaker, chat_role, rendered,
       chat_role = 'assistant' AS train,
       CAST(e - length(rendered) AS BIGINT) AS start_char, CAST(e AS BIGINT) AS end_char,
       CAST(e - length(rendered) + length(head) AS BIGINT) AS body_start, CAST(e - 11 AS BIGINT) AS body_end
FROM r
"""
