"""Patches as rows: added lines with files and line numbers, by running windows over each patch."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftspark.functions import text as T


def added_lines(patch: DataFrame, key: str = "commit") -> DataFrame:
    """patch(key, n, text): lines in order. Returns (key, n, file, line, content) of added lines. A file section starts
    at `diff --git`; lines count from the hunk's start over added lines only; without a hunk the line is null."""
    by = Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    t = F.col("text")
    rows = patch.withColumn("_dg", F.sum(t.startswith("diff --git").cast("int")).over(by))
    sec = Window.partitionBy(key, "_dg").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    path = F.when(t.startswith("+++ b/"), F.substring(t, 7, 1 << 20))
    start = F.when(t.startswith("@@"), F.regexp_extract(t, r"\+(\d+)", 1).try_cast("int"))
    rows = rows.withColumn("file", F.last(path, True).over(sec)).withColumn("_hs", F.last(start, True).over(sec)).withColumn("_hn", F.count(start).over(sec))
    emit = t.startswith("+") & ~t.startswith("+++") & F.col("file").isNotNull()
    hunk = Window.partitionBy(key, "_dg", "_hn").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_emit", emit).withColumn("line", F.col("_hs") + F.sum(emit.cast("int")).over(hunk).cast("int") - 1)
    return rows.where("_emit").select(key, "n", "file", "line", F.substring(t, 2, 1 << 30).alias("content"))


def commit_messages(log: DataFrame, text: str = "text") -> DataFrame:
    """Splits a log of `hash\\nmessage\\n---END---\\n` records."""
    parts = log.select(F.explode(F.split(text, "---END---\n?")).alias("r")).where(F.trim("r") != "")
    r = F.regexp_replace("r", r"^\n+", "")
    return parts.select(F.substring_index(r, "\n", 1).alias("commit"), T.strip(F.substr(r, F.length(F.substring_index(r, "\n", 1)) + 2)).alias("message"))
