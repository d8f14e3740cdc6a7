"""Chat formatting by perspective rotation, in DataFrame expressions.

For every participant of a conversation the dialogue is rendered once with that
speaker as assistant and all others as named users; the loss mask covers what
the assistant says.  The rendering of a conversation is one text, stored in parts
of ``part_turns`` turns (by place in the conversation, whatever the turn numbers
are), so that a row is bounded however long a conversation is.  A part says where
in the whole text it starts; parts in order, joined, are the whole text.

Places come from one range shuffle: turns are numbered within their range, and
what earlier ranges hold of the same conversation is added, so that a conversation
with a third of all turns is not brought together in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkcohort.llm.common import Workspace, carried, partitions

PART_TURNS = 1024
SYSTEM = "system"
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
LAST = (1 << 63) - 1
#: Characters of a speaker's name that are written as % and two hex digits; % comes first.
ESCAPED = "% \t\n\u000b\f\r<>|"
#: How a speaker without a name is written, which no escaped name can be.
NO_NAME = "%null"


def _plain(text: Column) -> Column:
    """Text that cannot be taken for a mark."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |"))


def _name(speaker: Column) -> Column:
    """A speaker's name without blanks and marks; different speakers have different ones."""
    for c in ESCAPED:
        speaker = F.replace(speaker, F.lit(c), F.lit(f"%{ord(c):02X}"))
    return F.coalesce(speaker, F.lit(NO_NAME))


def _length(role: Column, text: Column) -> Column:
    return F.length(role) + F.length(text) + (len(OPEN) + len(CLOSE) + 2)


def _parts(turns: DataFrame, ws: Workspace, part_turns: int) -> DataFrame:
    """(key, conv_id, part, turns, total): the turns of a part in order, and its length with every speaker as user."""
    order = ["key", "turn", "name", "text"]
    ranged = turns.repartitionByRange(partitions(ws.spark), *order).sortWithinPartitions(*order)
    # an id is the number of its range and the place in it
    ranged = ws.save(ranged.select("*", F.monotonically_increasing_id().alias("id")), "ranged")
    ranged = ranged.withColumn("range", F.shiftrightunsigned("id", 33)).withColumn("at", F.col("id").bitwiseAND(F.lit((1 << 33) - 1)))
    held = ranged.groupBy("key", "range").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    earlier = F.sum("n").over(W.partitionBy("key").orderBy("range").rowsBetween(W.unboundedPreceding, -1))
    held = held.select("key", "range", (F.coalesce(earlier, F.lit(0)) - F.col("first")).alias("move"))
    placed = ranged.join(held, ["key", "range"]).withColumn("part", F.floor((F.col("at") + F.col("move")) / part_turns))
    role = F.when(F.col("who") == SYSTEM, SYSTEM).otherwise(F.concat(F.lit("user name="), "name"))
    placed = placed.withColumn("size", _length(role, F.col("text")))
    packed = placed.groupBy("key", "part").agg(F.first("conv_id").alias("conv_id"), F.sort_array(F.collect_list(F.struct("turn", "name", "text", "who"))).alias("turns"), F.sum("size").alias("total"))
    return ws.save(packed, "parts")


def rotate(turns: DataFrame, part_turns: int = PART_TURNS, conv: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, participant, part, start, n_turns, rendered, mask, n_masked) for every participant of every conversation.

    Participants are the different speakers but ``system``, which is rendered as
    itself; a conversation of system turns alone has no row.  Turns are ordered by
    number (null last), then speaker, then text; rows that are equal in all four
    columns are one turn.  A null speaker is a participant of its own (null); names
    are escaped where they are rendered, so that different ones stay different.  A
    null text is empty; rows with a null conv_id are one conversation.  ``start`` is
    the place of the part in the whole rendering; ``mask`` lists start:end (code
    points of ``rendered``, end exclusive) of the assistant's words with the closing
    mark; other columns are ignored.
    """
    ws = Workspace(turns.sparkSession, "chat")
    rows = turns.select(
        F.coalesce(F.col(conv).cast("long").cast("string"), F.lit("null")).alias("key"),
        F.col(conv).cast("long").alias("conv_id"),
        F.coalesce(F.col(turn).cast("long"), F.lit(LAST)).alias("turn"),
        F.col(speaker).cast("string").alias("who"),
        _name(F.col(speaker).cast("string")).alias("name"),
        _plain(F.col(text)).alias("text"),
    ).distinct()
    parts = _parts(rows, ws, part_turns)
    own = parts.select("key", "part", F.explode(F.transform("turns", lambda t: F.struct(t["name"].alias("name"), t.who.alias("who")))).alias("t"))
    own = own.filter(~F.col("t.who").eqNullSafe(F.lit(SYSTEM))).groupBy("key", "part", F.col("t.name").alias("name"), F.col("t.who").alias("participant")).agg(F.count("*").alias("n"))
    people = own.select("key", "name", "participant").distinct()
    # where a part starts: earlier parts with every speaker as user, and what their own turns are shorter as assistant
    totals = parts.select("key", "part", "total")
    totals = totals.withColumn("start", F.sum("total").over(W.partitionBy("key").orderBy("part").rowsBetween(W.unboundedPreceding, -1))).drop("total")
    grid = totals.join(people, "key").join(own.drop("participant"), ["key", "part", "name"], "left")
    mine = F.sum("n").over(W.partitionBy("key", "name").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    shift = F.coalesce(mine, F.lit(0)) * (F.lit(len("assistant") - len("user name=")) - F.length("name"))
    grid = grid.select("key", "part", "name", "participant", (F.coalesce("start", F.lit(0)) + shift).alias("start"))

    def render(t: Column) -> Column:
        mine = t["name"] == F.col("name")
        role = F.when(t.who == SYSTEM, SYSTEM).when(mine, "assistant").otherwise(F.concat(F.lit("user name="), t["name"]))
        return F.struct(F.concat(F.lit(OPEN), role, F.lit("\n")).alias("head"), F.concat(t.text, F.lit(CLOSE)).alias("body"), (mine & ~t.who.eqNullSafe(F.lit(SYSTEM))).alias("mine"))

    each = parts.drop("total").join(grid, ["key", "part"]).withColumn("r", F.transform("turns", render)).drop("turns")
    each = each.withColumn("size", F.transform("r", lambda t: F.length(t.head) + F.length(t.body) + 1))
    each = each.withColumn("before", carried(F.col("size")))
    spans = F.zip_with("r", "before", lambda t, b: F.struct(t.mine.alias("mine"), (b + F.length(t.head)).alias("s"), F.length(t.body).alias("n")))
    each = each.withColumn("spans", F.filter(spans, lambda t: t.mine))
    return each.select(
        "conv_id",
        "participant",
        "part",
        F.col("start").cast("long").alias("start"),
        F.size("r").cast("long").alias("n_turns"),
        F.array_join(F.transform("r", lambda t: F.concat(t.head, t.body, F.lit("\n"))), "").alias("rendered"),
        F.array_join(F.transform("spans", lambda t: F.concat_ws(":", t.s, t.s + t.n)), ",").alias("mask"),
        F.aggregate("spans", F.lit(0).cast("long"), lambda a, t: a + t.n).alias("n_masked"),
    )


def _oracle() -> str:
    name = "role"
    for c in ESCAPED:
        name = f"replace({name}, chr({ord(c)}), '%{ord(c):02X}')"
    return rf"""
WITH t AS (
  SELECT DISTINCT conv_id, coalesce(turn, {LAST}) AS turn, role AS who, coalesce({name}, '{NO_NAME}') AS name,
         replace(coalesce(text, ''), '<|', '< |') AS text
  FROM conversations
), p AS (
  SELECT *, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, name, text) - 1) // {PART_TURNS} AS part FROM t
), people AS (
  SELECT DISTINCT conv_id AS c, who AS participant, name AS own FROM t WHERE who IS DISTINCT FROM 'system'
), r AS (
  SELECT conv_id, participant, own, part, turn, name, text, name = own AS mine,
         '{OPEN}' || CASE WHEN who = 'system' THEN 'system' WHEN name = own THEN 'assistant' ELSE 'user name=' || name END || chr(10) AS head,
         text || '{CLOSE}' AS body
  FROM p JOIN people ON conv_id IS NOT DISTINCT FROM c
), s AS (
  SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER (
    PARTITION BY conv_id, own ORDER BY turn, name, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place
  FROM r
), u AS (
  SELECT *, min(place) OVER (PARTITION BY conv_id, own, part) AS start FROM s
)
SELECT conv_id, participant, CAST(part AS BIGINT) AS part, CAST(start AS BIGINT) AS start, count(*) AS n_turns,
       string_agg(head || body || chr(10), '' ORDER BY turn, name, text) AS rendered,
       coalesce(string_agg(CAST(place - start + length(head) AS BIGINT) || ':' || CAST(place - start + length(head) + length(body) AS BIGINT), ',' ORDER BY turn, name, text) FILTER (WHERE mine), '') AS mask,
       CAST(coalesce(sum(length(body)) FILTER (WHERE mine), 0) AS BIGINT) AS n_masked
FROM u GROUP BY conv_id, participant, own, part, start
"""


ORACLE = _oracle()
