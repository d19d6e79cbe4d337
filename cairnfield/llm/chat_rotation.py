"""Multi-party perspective rotation of conversations, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN_START, TURN_END = "<|im_start|>", "<|im_end|>"
#: What marks begin with, and what that becomes where a text or a name holds it.
MARK, BROKEN = "<|im_", "< |im_"
#: Turn numbers whose rows are put in order together.
TURN_BLOCK = 4096


def rotate(
    conversations: DataFrame,
    context_roles: Sequence[str] = ("system",),
    unnamed: str = "unknown",
) -> DataFrame:
    """Render every dialogue once from the seat of each of its participants.

    Takes ``conv_id, turn, role, text`` (role is the speaker's name) and returns one row
    for each turn of each perspective: ``conv_id, perspective, place, turn, role, seat, segment,
    char_start, n_chars, train_start, train_end``. ``segment`` is the rendered turn; the
    dialogue is the segments of a (conv_id, perspective) in the order of ``place`` (from 1),
    which is that of (turn, role, segment), nulls first; ``char_start`` is the character of
    the dialogue with which the segment begins. The
    perspective's own turns take the seat ``assistant``; all others are ``user``, named in
    the turn's header. ``[train_start, train_end)`` are the characters of the segment that
    carry loss: the text and its end mark in the assistant's seat, none elsewhere (0, 0).

    A perspective's turns are rows, never one string or list, so a conversation with a
    third of all turns is not gathered anywhere: running sums are taken within blocks of
    TURN_BLOCK turn numbers, and those of whole blocks are added. Each turn meets each participant of its
    own conversation once, which is the size of the result.

    Defined cases: roles in ``context_roles`` are rendered as context (seat ``system``) in
    every perspective and get none of their own; a null role is a user named ``unnamed``
    and gets no perspective; a conversation without participants gives no rows; null text
    is empty; a null turn is kept as null; null conv_id is one conversation; repeated rows
    stay repeated; further columns are ignored; line breaks in a name become spaces; a turn
    mark inside a text or a name is broken by a space, so that no turn can forge another; an
    empty table gives no rows; texts of any length are taken whole.
    """
    turns = conversations.select("conv_id", "turn", "role", "text")
    context = F.coalesce(F.col("role").isin(*context_roles), F.lit(False)) if context_roles else F.lit(False)
    seats = (
        turns.where(F.col("role").isNotNull() & ~context)
        .select(F.col("conv_id").alias("seat_conv"), F.col("role").alias("perspective"))
        .distinct()
    )
    joined = turns.join(seats, F.col("conv_id").eqNullSafe(F.col("seat_conv")))
    own = F.coalesce(F.col("role") == F.col("perspective"), F.lit(False))
    seat = F.when(own, "assistant").when(context, "system").otherwise("user")
    name = _harmless(F.regexp_replace(F.coalesce("role", F.lit(unnamed)), r"[\r\n]", " "))
    header = F.concat(
        F.lit(TURN_START),
        F.when(own, "assistant").when(context, "system").otherwise(F.concat(F.lit("user name="), name)),
        F.lit("\n"),
    )
    return _placed(joined.select("conv_id", "perspective", "turn", "role", seat.alias("seat"), *_rendered(header, own)))


def _harmless(text: Column) -> Column:
    return F.replace(text, F.lit(MARK), F.lit(BROKEN))


def _placed(rows: DataFrame) -> DataFrame:
    """Adds each row's place in its dialogue and the character it begins with."""
    owner = ["conv_id", "perspective"]
    rows = rows.withColumn("turn_block", F.floor(F.col("turn") / TURN_BLOCK))
    inside = Window.partitionBy(*owner, "turn_block").orderBy(F.asc_nulls_first("turn"), F.asc_nulls_first("role"), "segment")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    ordered = rows.withColumn("nth", F.row_number().over(inside)).withColumn("sofar", F.coalesce(F.sum("n_chars").over(before), F.lit(0)))
    blocks = rows.groupBy(*owner, "turn_block").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))
    earlier = Window.partitionBy(*owner).orderBy(F.asc_nulls_first("turn_block")).rowsBetween(Window.unboundedPreceding, -1)
    sums = blocks.select(*(F.col(c).alias(f"b_{c}") for c in (*owner, "turn_block")), *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"b_{c}") for c in ("n", "chars")))
    here = F.lit(True)
    for c in (*owner, "turn_block"):
        here = here & F.col(c).eqNullSafe(F.col(f"b_{c}"))
    place, start = (F.col("b_n") + F.col("nth")).cast("long"), (F.col("b_chars") + F.col("sofar")).cast("long")
    return ordered.join(sums, here).select(*owner, place.alias("place"), "turn", "role", "seat", "segment", start.alias("char_start"), "n_chars", "train_start", "train_end")


def _rendered(header: Column, own: Column) -> list[Column]:
    body = F.concat(_harmless(F.coalesce("text", F.lit(""))), F.lit(TURN_END))
    start, whole = F.length(header), F.concat(header, body, F.lit("\n"))
    return [
        whole.alias("segment"),
        F.length(whole).alias("n_chars"),
        F.when(own, start).otherwise(0).alias("train_start"),
        F.when(own, start + F.length(body)).otherwise(0).alias("train_end"),
    ]


SQL = """
WITH seats AS (
  SELECT DISTINCT conv_id AS seat_conv, role AS perspective FROM conversations
  WHERE role IS NOT NULL AND role <> 'system'
), j AS (
  SELECT c.*, s.perspective, coalesce(c.role = s.perspective, false) AS own, coalesce(c.role = 'system', false) AS ctx
  FROM conversations c JOIN seats s ON c.conv_id IS NOT DISTINCT FROM s.seat_conv
), h AS (
  SELECT *, '<|im_start|>' || CASE WHEN own THEN 'assistant' WHEN ctx THEN 'system'
      ELSE 'user name=' || replace(regexp_replace(coalesce(role, 'unknown'), '[\\r\\n]', ' ', 'g'), '<|im_', '< |im_') END || chr(10) AS header,
    replace(coalesce(text, ''), '<|im_', '< |im_') || '<|im_end|>' AS body
  FROM j
), r AS (
  SELECT *, header || body || chr(10) AS segment FROM h
), o AS (
  SELECT *, row_number() OVER w AS place, CAST(coalesce(sum(length(segment)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS char_start
  FROM r WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, role NULLS FIRST, segment)
)
SELECT conv_id, perspective, place, turn, role, char_start,
  CASE WHEN own THEN 'assistant' WHEN ctx THEN 'system' ELSE 'user' END AS seat,
  segment, CAST(length(segment) AS INTEGER) AS n_chars,
  CAST(CASE WHEN own THEN length(header) ELSE 0 END AS INTEGER) AS train_start,
  CAST(CASE WHEN own THEN length(header) + length(body) ELSE 0 END AS INTEGER) AS train_end
FROM o
"""
