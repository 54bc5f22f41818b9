"""Chat formatting by rotating perspectives: one training text for every participant.

For each participant of a conversation the dialogue is rendered with that speaker as
the assistant and all others as named users; system turns stay system turns. The mask
marks the parts to learn from: what the assistant says, with the closing token.

Long conversations are rendered in chunks of ``CHUNK`` turns, so a conversation of any
length is never gathered into one row; no turn is left out. Turns are numbered over
all tasks, so the chunks do not depend on how a conversation's rows are spread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import number_rows

CHUNK = 256
SYSTEM = "system"
UNNAMED = "unknown"


def perspectives(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", chunk: int = CHUNK
) -> DataFrame:
    """(conv_id, chunk, speaker, n_turns, n_own, text, mask) per conversation, chunk and participant.

    ``mask`` lists the character ranges "from:to" (the end not included) to learn from,
    in order, with commas between. Turns are ordered by turn, role and text, nulls
    first; repeated rows are turns of their own. A null or blank role is ``unknown``, a
    null text an empty turn, a null conversation one of its own. "<|" in names and texts
    is written "< |", so nothing in them can pose as a control token. A conversation of
    system turns only has no participant and gives no row; an empty table gives none.
    A participant who is silent in a chunk gets it with an empty mask.
    """
    safe = lambda c: F.replace(c, F.lit("<|"), F.lit("< |"))
    name = F.trim(F.coalesce(F.col(role_col).cast("string"), F.lit("")))
    rows = turns.select(
        F.col(conv_col).cast("long").alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"),
        F.col(role_col).cast("string").alias("role"),
        F.col(text_col).cast("string").alias("body"),
        F.when(name == "", UNNAMED).otherwise(safe(name)).alias("speaker"),
    )
    numbered = number_rows(rows, ["conv_id"], ["turn", "role", "body"], "n")
    body = safe(F.coalesce(F.col("body"), F.lit("")))
    chunks = (
        numbered.withColumn("chunk", (F.col("n") / chunk).cast("long"))
        .groupBy("conv_id", "chunk")
        .agg(F.array_sort(F.collect_list(F.struct("n", "speaker", body.alias("body")))).alias("turns"))
    )
    who = rows.where(F.col("speaker") != SYSTEM).groupBy(F.col("conv_id").alias("conv"), F.col("speaker").alias("who")).agg(F.lit(1).alias("one"))
    both = chunks.join(who, F.col("conv_id").eqNullSafe(F.col("conv")))
    parts = F.expr(
        f"transform(turns, t -> struct(concat('<|im_start|>', CASE WHEN t.speaker = who THEN 'assistant' WHEN t.speaker = '{SYSTEM}' "
        f"THEN '{SYSTEM}' ELSE concat('user name=', t.speaker) END, '\\n') AS head, concat(t.body, '<|im_end|>\\n') AS tail, "
        "t.speaker = who AS own))"
    )
    both = both.select("conv_id", "chunk", F.col("who").alias("speaker"), parts.alias("parts"))
    spans = F.expr(
        "aggregate(parts, struct(0L AS at, cast(array() AS array<string>) AS spans), (a, p) -> struct("
        "a.at + length(p.head) + length(p.tail) AS at, "
        "CASE WHEN p.own THEN array_append(a.spans, concat(a.at + length(p.head), ':', a.at + length(p.head) + length(p.tail))) ELSE a.spans END AS spans)).spans"
    )
    return both.select(
        "conv_id",
        "chunk",
        "speaker",
        F.size("parts").cast("long").alias("n_turns"),
        F.size(F.filter("parts", lambda p: p["own"])).cast("long").alias("n_own"),
        F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["tail"])), "").alias("text"),
        F.array_join(spans, ",").alias("mask"),
    )


ORACLE = f"""
WITH t AS (
  SELECT conv_id, CASE WHEN trim(coalesce(role, '')) = '' THEN '{UNNAMED}' ELSE replace(trim(role), '<|', '< |') END AS speaker,
    replace(coalesce(text, ''), '<|', '< |') AS body,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) - 1 AS n
  FROM conversations),
who AS (SELECT DISTINCT conv_id, speaker FROM t WHERE speaker <> '{SYSTEM}'),
parts AS (
  SELECT t.conv_id, t.n // {CHUNK} AS chunk, who.speaker, t.n, t.speaker = who.speaker AS own,
    '<|im_start|>' || CASE WHEN t.speaker = who.speaker THEN 'assistant' WHEN t.speaker = '{SYSTEM}' THEN '{SYSTEM}'
      ELSE 'user name=' || t.speaker END || chr(10) AS head,
    t.body || '<|im_end|>' || chr(10) AS tail
  FROM t JOIN who ON t.conv_id IS NOT DISTINCT FROM who.conv_id),
placed AS (
  SELECT *, sum(length(head) + length(tail)) OVER (PARTITION BY conv_id, chunk, speaker ORDER BY n ROWS UNBOUNDED PRECEDING) AS stop FROM parts)
SELECT conv_id, chunk, speaker, count(*) AS n_turns, count(*) FILTER (own) AS n_own,
  string_agg(head || tail, '' ORDER BY n) AS text,
  coalesce(string_agg(CAST(CAST(stop - length(tail) AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(stop AS BIGINT) AS VARCHAR), ',' ORDER BY n) FILTER (own), '') AS mask
FROM placed GROUP BY conv_id, chunk, speaker
"""
