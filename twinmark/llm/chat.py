"""Chat formatting by perspective rotation.

For every participant of a dialogue, the dialogue is rendered with that speaker as the assistant and all
others as named users.  A rendering is a sequence of segments, one per turn, each with its loss mask;
so a dialogue of any length is spread over rows, and only DataFrame expressions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Roles that speak but are no participants: they keep their role in every rendering and are never learned.
NARRATORS = ("system",)
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def plain(words: Column) -> Column:
    """``words`` without a marker that would open or close a turn: a blank goes between ``<`` and ``|``."""
    return F.replace(words, F.lit("<|"), F.lit("< |"))


def name(role: Column) -> Column:
    """A participant's name in a header: one line, without markers."""
    return F.translate(plain(role), "\r\n", "  ")


def header(perspective: Column, role: Column) -> Column:
    """What stands before a turn: assistant for the perspective's own turns, narrators as they are, others as named users."""
    narrator = role.isin(*NARRATORS)
    own = F.when(narrator, role).when(role == perspective, F.lit("assistant")).otherwise(F.concat(F.lit("user name="), name(role)))
    return F.concat(F.lit(OPEN), own, F.lit("\n"))


def rotate(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per perspective and turn: conv_id, perspective, turn, role, segment, learn_from, learn_to.

    ``segment`` is the rendered turn; a rendering is its segments in the order of ``turn``.  The mask is
    the characters [learn_from, learn_to) of the segment, the words and end mark of the perspective's
    own turns; both are 0 where nothing is learned.  Markers inside a text or name are broken up and names
    are one line, so no turn can forge another.  A null role is the participant "unknown"; a null
    text is empty; turns with equal or null numbers and repeated rows each give a segment; rows without
    a conversation id form no dialogue and are left out; a dialogue of narrators alone has no rendering;
    an empty table gives an empty result; other columns are not read.
    """
    rows = turns.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("unknown")).alias("role"),
                        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).filter(F.col("conv_id").isNotNull())
    who = rows.filter(~F.col("role").isin(*NARRATORS)).select("conv_id", F.col("role").alias("perspective")).distinct()
    both = rows.join(who, "conv_id")
    before = header(F.col("perspective"), F.col("role"))
    own = F.col("role") == F.col("perspective")
    body = F.concat(plain(F.col("text")), F.lit(CLOSE))
    return both.select("conv_id", "perspective", "turn", "role", F.concat(before, body, F.lit("\n")).alias("segment"),
                       F.when(own, F.length(before)).otherwise(0).cast("long").alias("learn_from"),
                       F.when(own, F.length(before) + F.length(body)).otherwise(0).cast("long").alias("learn_to"))


ROTATE_SQL = f"""WITH t AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), who AS (
  SELECT DISTINCT conv_id, role AS perspective FROM t WHERE role <> '{NARRATORS[0]}'
), b AS (
  SELECT conv_id, turn, role, replace(text, '<|', '< |') AS text, perspective, '{OPEN}' || CASE WHEN role = '{NARRATORS[0]}' THEN role WHEN role = perspective THEN 'assistant'
    ELSE 'user name=' || translate(replace(role, '<|', '< |'), chr(13) || chr(10), '  ') END || chr(10) AS head
  FROM t JOIN who USING (conv_id)
)
SELECT conv_id, perspective, turn, role, head || text || '{CLOSE}' || chr(10) AS segment,
  CAST(CASE WHEN role = perspective THEN length(head) ELSE 0 END AS BIGINT) AS learn_from,
  CAST(CASE WHEN role = perspective THEN length(head || text || '{CLOSE}') ELSE 0 END AS BIGINT) AS learn_to
FROM b"""
