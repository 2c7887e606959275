"""Chat formatting by perspective rotation, for dialogues of any number of speakers.

For every participant of a dialogue, all its turns are rendered with that speaker as assistant and
the others as named users; the loss mask marks the assistant's own words. A row is one turn of one
rendering, with its place in the rendered text, so a dialogue of any length stays in many tasks:
turns are range-sorted, placed within their partition, and moved by the sums of the partitions
before.

What a turn or a role says cannot open or close a turn: "<|" in it becomes "< |", and a line break in a
name becomes a blank; places count the text as rendered.

Defined cases: rows without a conv_id belong to no dialogue and give no row; a null or empty role is
a nameless user and no participant; system roles stay system and are no participants, so a dialogue
of system turns alone gives no row; a null text is empty; turns are ordered by turn (null first),
then role, then text, and repeated rows are all kept; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.llm.common import store

#: Marks around a turn, and the role that keeps its name.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
SYSTEM = "system"


def rotate(turns: DataFrame) -> DataFrame:
    """A row for each turn and participant: rendered text, its span, and the span that is learned."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    plain = lambda c: F.replace(c, F.lit("<|"), F.lit("< |"))
    rows = turns.filter("conv_id is not null").select("conv_id", "turn", text("role").alias("speaker"), plain(text("text")).alias("content"))
    people = rows.filter(~F.col("speaker").isin("", SYSTEM)).select("conv_id", F.col("speaker").alias("perspective")).distinct()
    head = (
        F.when(F.col("speaker") == F.col("perspective"), F.lit(OPEN + "assistant\n"))
        .when(F.col("speaker") == SYSTEM, F.lit(OPEN + "system\n"))
        .when(F.col("speaker") == "", F.lit(OPEN + "user\n"))
        .otherwise(F.concat(F.lit(OPEN + "user name="), F.translate(plain(F.col("speaker")), "\r\n", "  "), F.lit("\n")))
    )
    order = ["turn", "speaker", "content"]
    seen = (
        rows.join(people, "conv_id")
        .withColumn("head", head)
        .withColumn("size", (F.length("head") + F.length("content") + len(CLOSE) + 1).cast("long"))
        .repartitionByRange("conv_id", "perspective", *order)
        .withColumn("part", F.spark_partition_id())
    )
    stored = store(seen, "turns")
    inside = Window.partitionBy("part", "conv_id", "perspective").orderBy(*order)
    so_far = inside.rowsBetween(Window.unboundedPreceding, -1)
    placed = stored.withColumns({"k": F.row_number().over(inside) - 1, "at": F.coalesce(F.sum("size").over(so_far), F.lit(0))})
    sums = stored.groupBy("conv_id", "perspective", "part").agg(F.sum("size").alias("chars"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv_id", "perspective").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    moves = sums.select(
        "conv_id",
        "perspective",
        "part",
        F.coalesce(F.sum("chars").over(before), F.lit(0)).alias("move"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skip"),
    )
    mine = F.col("speaker") == F.col("perspective")
    start = F.col("at") + F.col("move")
    body = start + F.length("head")
    return placed.join(moves, ["conv_id", "perspective", "part"]).select(
        F.col("conv_id").cast("long"),
        "perspective",
        (F.col("k") + F.col("skip")).cast("long").alias("position"),
        F.col("turn").cast("long").alias("turn"),
        F.when(mine, "assistant").when(F.col("speaker") == SYSTEM, "system").otherwise("user").alias("role"),
        F.when(mine | F.col("speaker").isin("", SYSTEM), F.lit(None)).otherwise(F.col("speaker")).alias("name"),
        F.concat(F.col("head"), F.col("content"), F.lit(CLOSE + "\n")).alias("rendered"),
        start.cast("long").alias("start"),
        # The closing mark of the assistant's turn is learned with its words.
        F.when(mine, body).cast("long").alias("mask_start"),
        F.when(mine, body + F.length("content") + len(CLOSE)).cast("long").alias("mask_end"),
    )


ORACLE = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS speaker, replace(coalesce(text, ''), '<|', '< |') AS content FROM conversations WHERE conv_id IS NOT NULL
), p AS (
  SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker NOT IN ('', 'system')
), h AS (
  SELECT t.*, p.perspective, speaker = perspective AS mine,
    CASE WHEN speaker = perspective THEN '<|im_start|>assistant' || chr(10)
         WHEN speaker = 'system' THEN '<|im_start|>system' || chr(10)
         WHEN speaker = '' THEN '<|im_start|>user' || chr(10)
         ELSE '<|im_start|>user name=' || translate(replace(speaker, '<|', '< |'), chr(13) || chr(10), '  ') || chr(10) END AS head
  FROM t JOIN p USING (conv_id)
), s AS (
  SELECT *, length(head) + length(content) + 11 AS size FROM h
), w AS (
  SELECT *, row_number() OVER o - 1 AS position, coalesce(sum(size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begun
  FROM s WINDOW o AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, content)
)
SELECT CAST(conv_id AS BIGINT) AS conv_id, perspective, CAST(position AS BIGINT) AS position, CAST(turn AS BIGINT) AS turn,
  CASE WHEN mine THEN 'assistant' WHEN speaker = 'system' THEN 'system' ELSE 'user' END AS role,
  CASE WHEN NOT mine AND speaker NOT IN ('', 'system') THEN speaker END AS name,
  head || content || '<|im_end|>' || chr(10) AS rendered, CAST(begun AS BIGINT) AS start,
  CASE WHEN mine THEN CAST(begun + length(head) AS BIGINT) END AS mask_start,
  CASE WHEN mine THEN CAST(begun + length(head) + length(content) + 10 AS BIGINT) END AS mask_end
FROM w
"""
