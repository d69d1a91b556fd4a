"""Chat formatting of conversation turns, in Spark expressions only.

Turns are formatted as ``<|role|>``, a newline, the text and ``<|end|>``. So that no
text can forge a turn, each ``<|`` of a text is written ``<||``, which no marker is,
and the characters of a role that markers are made of become underscores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.storage import id_of

OPEN, MIDDLE, END = "<|", "|>\n", "<|end|>\n"
#: Characters that a role is written without, and what stands for them.
_MARKS, _FOR = "<|>\n\r", "_____"


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, text): one formatted text for each conversation.

    Turns are sorted by number, null first, then by role and text, so ties and
    repeated rows have one order; neighbours of one role become one turn, their
    texts parted by a newline. A null role is ``unknown``, a null text empty; rows
    without a conversation are left out; conversations' ids may be of any type.
    ``n_turns`` counts the merged turns. An empty table gives no rows. Other
    columns are not looked at. A conversation is one value, so it must fit one.
    """
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    out = turns.where("conv_id IS NOT NULL").groupBy(id_of(turns, "conv_id").alias("conv_id")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    before = F.concat(F.array(F.lit(None).cast("string")), F.expr("slice(turns.role, 1, size(turns) - 1)"))
    out = out.select("conv_id", F.zip_with("turns", before, lambda t, b: F.struct(t["role"].alias("role"), t["text"].alias("text"), t["role"].eqNullSafe(b).alias("same"), b.isNull().alias("first"))).alias("turns"))
    n = F.aggregate("turns", F.lit(0).cast("long"), lambda n, t: n + F.when(t["same"], 0).otherwise(1))
    return out.select("conv_id", n.alias("n_turns"), F.concat(F.array_join(F.transform("turns", _part), ""), F.lit(END)).alias("text"))


def _part(turn: Column) -> Column:
    """What a turn adds to the text: a newline to its own role's, or the end of another's and a head."""
    head = F.concat(F.lit(OPEN), F.translate(turn["role"], _MARKS, _FOR), F.lit(MIDDLE))
    lead = F.when(turn["same"], F.lit("\n")).otherwise(F.concat(F.when(turn["first"], F.lit("")).otherwise(F.lit(END)), head))
    return F.concat(lead, F.replace(turn["text"], F.lit(OPEN), F.lit(OPEN + "|")))


SQL = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM t),
f AS (SELECT *, CASE WHEN lag(role) OVER (PARTITION BY conv_id ORDER BY i) IS NOT DISTINCT FROM role THEN 0 ELSE 1 END AS new FROM o),
g AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY i) AS island FROM f),
m AS (SELECT conv_id, island, any_value(role) AS role, string_agg(replace(text, '{OPEN}', '{OPEN}|'), chr(10) ORDER BY i) AS text FROM g GROUP BY conv_id, island)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  string_agg('{OPEN}' || translate(role, '<|>' || chr(10) || chr(13), '{_FOR}') || '|>' || chr(10) || text || '<|end|>' || chr(10), '' ORDER BY island) AS text
FROM m GROUP BY conv_id
"""
