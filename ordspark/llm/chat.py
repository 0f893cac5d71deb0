"""Multi-party chat formatting by perspective rotation, in DataFrame functions.

For every participant of a conversation the dialogue is rendered once with that
speaker as the assistant and all others as named users.  The unit of the result
is a turn's segment, so no conversation, however long, is gathered in one task;
a view's dialogue is its segments in the order of ``turn`` and ``tie``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: Speaker of turns without a role.
NOBODY = "unknown"


def _safe(text: Column) -> Column:
    """A turn cannot open or close turns: its control strings get a zero-width break."""
    return F.regexp_replace(text, r"<\|(im_start|im_end)\|>", "<\u200b|$1|>")


#: Characters of names that could end a name or look like a control string, and what stands for them.
_ESCAPES = {c: f"%{ord(c):02X}" for c in "% \t\n\x0b\x0c\r<|>"}


def _name(speaker: Column) -> Column:
    """A speaker's name on one line; different speakers have different names."""
    for c, escaped in _ESCAPES.items():
        speaker = F.replace(speaker, F.lit(c), F.lit(escaped))
    return speaker


def perspectives(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation, perspective and turn: (conv_id, perspective,
    turn, tie, role, name, segment, train_from, train_to).

    ``segment`` is the turn as rendered; characters [train_from, train_to) of it
    are trained on, which is the whole content with its end mark for the
    perspective's own turns and nothing for others.  ``name`` is the speaker;
    the segment shows it with white space, %, <, | and > as %XX.  ``tie``, a
    digest of speaker and text, orders turns of equal number.  Null roles speak as "unknown", null texts are empty, null
    conversation ids are one conversation of their own, null turns come first,
    repeated rows are repeated turns.  Participants are deduplicated before they
    are joined to the turns, and the join is on the conversation alone, so a
    conversation with a large share of all turns is split by Spark.
    """
    t = turns.select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit(NOBODY)).alias("speaker"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    people = t.select(F.col("conv_id").alias("conv"), F.col("speaker").alias("perspective")).distinct()
    both = t.join(people, F.col("conv_id").eqNullSafe(F.col("conv")))
    own = F.col("speaker") == F.col("perspective")
    head = F.when(own, F.lit(f"{OPEN}assistant\n")).otherwise(F.concat(F.lit(f"{OPEN}user name="), _name(F.col("speaker")), F.lit("\n")))
    body = F.concat(_safe(F.col("text")), F.lit(CLOSE))
    return both.select(
        "conv_id",
        "perspective",
        "turn",
        F.md5(F.concat_ws("\x1f", "speaker", "text")).alias("tie"),
        F.when(own, "assistant").otherwise("user").alias("role"),
        F.when(~own, F.col("speaker")).alias("name"),
        F.concat(head, body).alias("segment"),
        F.when(own, F.length(head)).otherwise(0).cast("long").alias("train_from"),
        F.when(own, F.length(head) + F.length(body)).otherwise(0).cast("long").alias("train_to"),
    )


def dialogues(segments: DataFrame) -> DataFrame:
    """(conv_id, perspective, text, spans) of whole dialogues, with the trained
    character spans.  For conversations that fit a task; ``perspectives`` is the
    form for any size."""
    order = F.sort_array(F.collect_list(F.struct("turn", "tie", "segment", "train_from", "train_to")))
    g = segments.groupBy("conv_id", "perspective").agg(order.alias("s"))
    start = lambda i: F.length(F.array_join(F.transform(F.slice("s", 1, i), lambda x: x.segment), ""))
    spans = F.filter(F.transform("s", lambda x, i: F.struct((start(i) + x.train_from).alias("start"), (start(i) + x.train_to).alias("end"))), lambda x: x.end > x.start)
    return g.select("conv_id", "perspective", F.array_join(F.transform("s", lambda x: x.segment), "").alias("text"), spans.alias("spans"))


def _name_sql(speaker: str) -> str:
    for c, escaped in _ESCAPES.items():
        speaker = f"replace({speaker}, chr({ord(c)}), '{escaped}')"
    return speaker


ORACLE = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text FROM conversations),
p AS (SELECT DISTINCT conv_id AS conv, speaker AS perspective FROM t),
b AS (
  SELECT *, speaker = perspective AS own, regexp_replace(text, '<\|(im_start|im_end)\|>', '<' || chr(8203) || '|\1|>', 'g') || '<|im_end|>' || chr(10) AS body,
    CASE WHEN speaker = perspective THEN '<|im_start|>assistant' || chr(10) ELSE '<|im_start|>user name=' || @NAME@ || chr(10) END AS head
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv
)
SELECT conv_id, perspective, turn, md5(speaker || chr(31) || text) AS tie, CASE WHEN own THEN 'assistant' ELSE 'user' END AS role, CASE WHEN NOT own THEN speaker END AS name, head || body AS segment,
  CAST(CASE WHEN own THEN length(head) ELSE 0 END AS BIGINT) AS train_from, CAST(CASE WHEN own THEN length(head) + length(body) ELSE 0 END AS BIGINT) AS train_to
FROM b
""".replace("@NAME@", _name_sql("speaker"))
