"""Licence scans by sparse TF-IDF cosine and nearest-ancestor inheritance, in DataFrame operations only.

Every line of every file that holds a licence cue is a header, long ones in overlapping windows of words, so that a notice
anywhere inside stands by itself; a file named as a licence file is one header as a whole as well.
Headers and templates become TF-IDF vectors over words; a header takes the template of the largest cosine. A file
without a header of its own inherits the licence of the nearest ancestor directory that has a licence file.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftspark.llm.common import durable, join_counted, let

THRESHOLD = 0.5
#: Words of a window, and from one window to the next: narrow ones for short notices inside of prose, wide ones for long
#: notices. A notice that is shorter than a window by a step is whole in one of them.
SPANS = ((16, 4), (48, 24))
#: Folders with a licence are broadcast up to this number (some 100 bytes each).
FEW = 50_000
# Short notices as their licences recommend them.
TEMPLATES = {
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD 3-Clause License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0, a Creative Commons Attribution License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0, a Creative Commons Attribution-NonCommercial License.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0, a Creative Commons Attribution-ShareAlike License.",
    "CC0-1.0": "To the extent possible under law the author has waived all copyright, CC0 1.0 Universal.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Proprietary": "All rights reserved.",
    "Unlicense": "This is free and unencumbered software released into the public domain, Unlicense.",
}
CUES = ("licens", "licenc", "copyright", "rights reserved", "public domain", "redistribution", "spdx", "cc0", "cc by")
LICENCE_FILE = r"(?i)(?:^|/)(?:licen[cs]e|copying|unlicense)(?:\.[a-z0-9]+)?$"


def has_cue(text: Column) -> Column:
    return let(F.lower(text), lambda t: reduce(or_, [F.contains(t, F.lit(c)) for c in CUES]))


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _vectors(units: DataFrame, key: str, idf: DataFrame) -> DataFrame:
    """(key, word, x): TF-IDF with length one."""
    tf = units.select(key, F.explode(words(F.col("text"))).alias("word")).groupBy(key, "word").agg(F.count("*").alias("tf"))
    x = tf.join(idf, "word").select(key, "word", (F.col("tf") * F.col("idf")).alias("x"))
    size = F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy(key)))
    return x.select(key, "word", (F.col("x") / size).alias("x"))


def _cut(span: int, step: int) -> Column:
    """Windows of the words `w`; a line of up to `span` words is one."""
    last = F.greatest(F.lit(0), F.ceil((F.size("w") - span) / step)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda k: F.array_join(F.slice("w", k * step + 1, span), " "))


def headers(files: DataFrame) -> DataFrame:
    """(path, text, whole): windows of lines with a licence cue, as words; and licence files as a whole."""
    named = F.col("path").rlike(LICENCE_FILE)
    some = files.where(F.col("path").isNotNull() & F.col("text").isNotNull())
    cued = some.where(has_cue(F.col("text")))
    lines = cued.select("path", F.explode(F.split("text", r"\r\n|[\r\n]")).alias("line")).where(has_cue(F.col("line")))
    pieces = lines.select("path", words(F.col("line")).alias("w")).select("path", F.explode(F.array_distinct(F.concat(*[_cut(*s) for s in SPANS]))).alias("text"), F.lit(False).alias("whole"))
    return pieces.where(has_cue(F.col("text"))).unionByName(some.where(named).select("path", "text", F.lit(True).alias("whole")))


def detect(files: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(path, license, score): the best template of each file with a header at or above `threshold`; ties go to the
    first name. Equal headers are compared once, however many files share them."""
    spark = files.sparkSession
    model = spark.createDataFrame(sorted((templates or TEMPLATES).items()), "license string, text string")
    found = durable(headers(files).withColumn("h", F.xxhash64("text", F.lower("text"))), "headers")  # read once, used thrice
    kinds = found.groupBy("h").agg(F.min("text").alias("text"), F.count("*").alias("n"))
    count = kinds.agg(F.sum("n").alias("all_n"))
    df = kinds.select("n", F.explode(F.array_distinct(words(F.col("text")))).alias("word"))
    df = df.unionByName(model.select(F.lit(1).cast("long").alias("n"), F.explode(F.array_distinct(words(F.col("text")))).alias("word")))
    df = df.groupBy("word").agg(F.sum("n").alias("df"))
    number = F.coalesce(F.col("all_n"), F.lit(0)) + len(templates or TEMPLATES)
    idf = df.join(F.broadcast(count)).select("word", (F.log((1 + number) / (1 + F.col("df"))) + 1).alias("idf"))
    a, b = _vectors(kinds, "h", idf), _vectors(model, "license", idf).withColumnRenamed("x", "y")
    match = a.join(F.broadcast(b), "word").groupBy("h", "license").agg(F.sum(F.col("x") * F.col("y")).alias("score"))  # templates are a fixed list
    best = match.groupBy("h").agg(F.max(F.struct(F.round("score", 9).alias("score"), F.lit(None).cast("string").alias("_"))).alias("top"), F.collect_list(F.struct("license", F.round("score", 9).alias("score"))).alias("all"))
    best = best.select("h", F.col("top.score").alias("score"), F.array_min(F.transform(F.filter("all", lambda x: x.score == F.col("top.score")), lambda x: x.license)).alias("license")).where(F.col("score") >= threshold)
    # a header may stand in very many files
    per = join_counted(found.select("h", "path"), best.join(kinds.select("h", "n"), "h"), ["h"], found.count()).groupBy("path").agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("m"))
    return per.select("path", F.col("m.license").alias("license"), (-F.col("m.s")).alias("score"))


def scan(files: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """files(path, text). Returns (path, license, score, origin, depth) for each distinct path: origin is `own`,
    `inherited` with depth the directories up to the licence file, or `none`.

    Null paths are left out; null and empty texts have no header; several rows of one path count as one file with all
    their headers; of several licence files of one folder the largest score counts, then the first name; lines of any
    length are read; other columns are not. An empty table gives none.
    """
    own = durable(detect(files, templates, threshold), "licences")
    paths = files.where("path is not null").select("path").distinct()
    folder = F.when(F.instr("path", "/") > 0, F.regexp_replace("path", r"/[^/]*$", "")).otherwise(F.lit(""))
    given = own.where(F.col("path").rlike(LICENCE_FILE)).select(folder.alias("dir"), "license", "score")
    given = given.groupBy("dir").agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("m")).select("dir", F.col("m.license").alias("license"), (-F.col("m.s")).alias("score"))
    given = durable(given, "folders")
    small = F.broadcast if given.count() <= FEW else (lambda df: df)
    open_ = paths.join(own.select("path"), "path", "left_anti").select("path", folder.alias("dir"))
    # folders, not files, look up their ancestors: a folder has one row, however many files it holds
    up = F.posexplode(F.transform(F.sequence(F.size("parts"), F.lit(0), F.lit(-1)), lambda k: F.array_join(F.slice("parts", 1, k), "/")))
    tries = open_.select("dir").distinct().withColumn("parts", F.split("dir", "/")).select(F.col("dir").alias("below"), up.alias("depth", "dir"))
    near = tries.join(small(given), "dir").groupBy("below").agg(F.min(F.struct("depth", "license", "score")).alias("m")).withColumnRenamed("below", "dir")
    inherited = open_.join(near, "dir", "left").select("path", "m.license", "m.score", F.when(F.col("m").isNull(), "none").otherwise("inherited").alias("origin"), F.col("m.depth").alias("depth"))
    return own.select("path", "license", "score", F.lit("own").alias("origin"), F.lit(None).cast("int").alias("depth")).unionByName(inherited)
