"""Chat formatting with a grammar that round-trips, in DataFrame operations only.

A conversation is a run of turns. A turn is `<s>`, the role, a line feed, the content, `</s>`; a user's content stands
between `[INST] ` and ` [/INST]`. Content is first written as it is and reparsed; where the parser does not give the
source back, or meets a control string inside, the content is escaped: a backslash goes behind the first sign of each
control string, before the backslashes that are there already. The parser takes one such backslash away.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE, ASK, ASKED = "<s>", "</s>", "[INST] ", " [/INST]"
_PLAIN = r"[<\[]/?(?:s>|INST\])"
_ESCAPABLE, _ESCAPED = r"([<\[])(\\*)(/?(?:s>|INST\]))", r"([<\[])\\(\\*)(/?(?:s>|INST\]))"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPABLE, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def _role(role: Column) -> Column:
    """A role without line feeds and first signs of control strings."""
    for a, b in (("%", "%25"), ("\n", "%0A"), ("<", "%3C"), ("[", "%5B")):
        role = F.replace(role, F.lit(a), F.lit(b))
    return role


def _unrole(role: Column) -> Column:
    for a, b in (("[", "%5B"), ("<", "%3C"), ("\n", "%0A"), ("%", "%25")):
        role = F.replace(role, F.lit(b), F.lit(a))
    return role


def _turn(role: Column, content: Column) -> Column:
    body = F.when(role == "user", F.concat(F.lit(ASK), content, F.lit(ASKED))).otherwise(content)
    return F.concat(F.lit(OPEN), _role(role), F.lit("\n"), body, F.lit(CLOSE))


def _parse(piece: Column) -> Column:
    """(role, text) of a turn without its end sign; null if it breaks the grammar."""
    head = F.substring_index(piece, "\n", 1)
    role = _unrole(F.substr(head, F.lit(len(OPEN) + 1)))
    rest = F.substr(piece, F.length(head) + 2)
    size = F.length(rest) - len(ASK) - len(ASKED)
    wrapped = F.startswith(rest, F.lit(ASK)) & F.endswith(rest, F.lit(ASKED)) & (size >= 0)
    content = F.when(role != "user", rest).when(wrapped, F.substr(rest, F.lit(len(ASK) + 1), size))
    ok = F.startswith(piece, F.lit(OPEN)) & F.contains(piece, F.lit("\n")) & ~content.rlike(_PLAIN)
    return F.when(ok, F.struct(role.alias("role"), unescape(content).alias("text")))


def parse(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation; a null element stands for what breaks the grammar."""
    pieces = F.split(formatted, CLOSE)
    return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), _parse)


def render(turns: DataFrame) -> DataFrame:
    """turns(conv_id, turn, role, text): one row a turn. Returns (conv_id, formatted, mask, turns): mask holds the
    spans (start, size, in code points) of assistant content, turns what the parser reads back.

    Turns are ordered by turn, then role, then text, nulls first; a null role or text is empty; repeated rows are turns
    of their own; turns with a null conv_id make one conversation. A conversation that still does not read back as its
    source raises an error. One conversation is one row, so it must fit in memory. Other columns are not read.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    plain = _turn(F.col("role"), F.col("text"))
    rows = rows.withColumn("back", F.element_at(parse(plain), 1))
    same = (F.size(F.split(plain, CLOSE)) == 2) & F.col("back.role").eqNullSafe(F.col("role")) & F.col("back.text").eqNullSafe(F.col("text"))
    rows = rows.withColumn("content", F.when(same, F.col("text")).otherwise(escape(F.col("text")))).drop("back")
    rows = rows.withColumn("piece", _turn(F.col("role"), F.col("content")))
    before = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    skip = len(OPEN) + F.length(_role(F.col("role"))) + 1
    rows = rows.withColumn("start", F.coalesce(F.sum(F.length("piece").cast("long")).over(before), F.lit(0)) + skip)
    made = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", "start", F.length("content").alias("n"), "piece"))).alias("source"))
    made = made.withColumn("formatted", F.array_join(F.transform("source", lambda x: x.piece), ""))
    mask = F.transform(F.filter("source", lambda x: x.role == "assistant"), lambda x: F.struct(x.start.cast("int").alias("start"), x.n.alias("size")))
    made = made.select("conv_id", "formatted", mask.alias("mask"), parse(F.col("formatted")).alias("turns"), F.transform("source", lambda x: F.struct(x.role.alias("role"), x.text.alias("text"))).alias("source"))
    checked = F.when(F.col("turns") == F.col("source"), F.col("turns")).otherwise(F.raise_error(F.lit("a conversation does not read back as its source")))
    return made.select("conv_id", "formatted", "mask", checked.alias("turns"))


def masked_text(formatted: Column, mask: Column) -> Column:
    return F.array_join(F.transform(mask, lambda m: unescape(F.substr(formatted, m.start + 1, m.size))), "")
