"""Chat formatting after collapsing cumulative snapshots.

Chat logs often hold a conversation again and again, each time with a few more turns.  Every turn gets the rolling
hash of the turns up to it; a conversation whose whole hash equals the prefix hash of a longer one is a snapshot of
that one and goes (anti-join); of equal conversations the one with the smallest id stays.  What is left is rendered.

Prefix hashes are reduced to different values and whole hashes to one row each before they meet, so a first turn
or a conversation that occurs in a third of all rows costs one row a task.  Turns are ordered by number, then role,
then text (nulls first); a turn number twice is two turns.  Null roles and texts render as empty but differ from empty
ones when compared.  Turns with a null conversation id form one conversation.  A rendered conversation is one value,
so its turns meet in one task.  Extra columns are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TURN = "<|{role}|>\n{text}<|end|>\n"


#: a conversation's id where it has one, and whether it has none: what rows are dealt by throughout
KEY = ["conv", "none"]


def _rows(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    conv = F.col(f"`{conv_col}`")
    own = F.coalesce(conv, F.lit(0).cast(turns.schema[conv_col].dataType)).alias("conv")
    return turns.select(own, conv.isNull().alias("none"), *(F.col(f"`{c}`").alias(n) for c, n in ((turn_col, "turn"), (role_col, "role"), (text_col, "text"))))


def prefixes(rows: DataFrame) -> DataFrame:
    """Adds place, turns and the rolling prefix hash (two 64-bit halves) to conv, none, turn, role, text."""
    order = Window.partitionBy(*KEY).orderBy("turn", "role", "text")
    rows = rows.withColumn("place", F.row_number().over(order)).withColumn("turns", F.count(F.lit(1)).over(Window.partitionBy(*KEY)))
    said = (F.col("role").isNull(), F.col("role"), F.col("text").isNull(), F.col("text"), F.col("place"))
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for n in (1, 2):  # position-salted hashes under xor: each turn's prefix follows from the one before
        rows = rows.withColumn(f"hash{n}", F.bit_xor(F.xxhash64(F.lit(n), *said)).over(running))
    return rows


def maximal(marked: DataFrame) -> DataFrame:
    """conv and none of each conversation that is no proper prefix of another, one for equal ones (none last)."""
    ends = marked.where("place = turns").select("hash1", "hash2", "place", F.struct("none", "conv").alias("who"))
    whole = ends.groupBy("hash1", "hash2", "place").agg(F.min("who").alias("who"))
    part = marked.where("place < turns").select("hash1", "hash2", "place").distinct()
    return whole.join(part, ["hash1", "hash2", "place"], "left_anti").select("who.*")


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", template: str = TURN) -> DataFrame:
    """One row per maximal conversation: id, n_turns, rendered.

    Turns are dealt by conversation once: the search for prefixes and the rendering read the same exchange.
    """
    rows = _rows(turns, conv_col, turn_col, role_col, text_col)
    kept = maximal(prefixes(rows))
    head, middle, tail = template.replace("{role}", "\0").replace("{text}", "\0").split("\0")
    grouped = rows.join(kept.hint("merge"), KEY, "left_semi").groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("all"))
    lines = F.transform("all", lambda t: F.concat(F.lit(head), F.coalesce(t["role"], F.lit("")), F.lit(middle), F.coalesce(t["text"], F.lit("")), F.lit(tail)))
    return grouped.select(F.when(~F.col("none"), F.col("conv")).alias(conv_col), F.size("all").cast("long").alias("n_turns"), F.array_join(lines, "").alias("rendered"))


SQL = """
WITH t AS (SELECT conv_id, role, text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS place,
    count(*) OVER (PARTITION BY conv_id) AS turns FROM conversations),
p AS (SELECT conv_id, place, turns,
    string_agg(coalesce('r' || role, 'n') || chr(30) || coalesce('t' || text, 'n') || chr(31), '') OVER w AS said,
    string_agg('<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10), '') OVER w AS rendered
    FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
whole AS (SELECT min(conv_id) AS conv_id, turns AS n_turns, min(rendered) AS rendered, said FROM p WHERE place = turns GROUP BY turns, said)
SELECT conv_id, n_turns, rendered FROM whole WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.place < p.turns AND p.said = whole.said)
"""
