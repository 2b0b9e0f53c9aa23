"""Benchmark decontamination by template canonicalisation, in DataFrame operations only.

Numbers, names and units become typed placeholders, so a question with other parameters keeps its template. Windows of
template words are hash-joined between items and documents; what the placeholders stand for must map consistently.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftspark.llm.common import durable, let

WIDTH = 8
#: A document is contaminated by an item if this share of the item's windows is found, or RUN windows.
SHARE, RUN = 0.5, 13
#: Share of placeholders that must map one to one.
CONSISTENT = 0.8
#: Windows need this many words that are no placeholders.
LITERAL = 3
#: At most so many item windows are broadcast (some 100 bytes each); more are joined by a shuffle.
FEW = 200_000
# Units after a number.
UNITS = "km cm mm m mi ft in kg g mg lb lbs oz l ml s sec min h hr hrs hours hour minutes minute seconds days day years year percent usd eur dollars dollar euros euro cents mph kmh"
NUMBER, UNIT, NAME = "xnumberx", "xunitx", "xnamex"
#: A name is a capitalised word; one of capitals alone is not, so that a text in capitals keeps its words. Documents have
#: all of them replaced. Items are asked in three forms: like documents, with names inside sentences only (a sentence's
#: first word may be in lower case in a copy), and with none (a copy in lower case or capitals).
ANYWHERE = r"(?<![\p{L}\p{N}])\p{Lu}\p{Ll}[\p{L}\p{N}]*"
FORMS = (ANYWHERE, r"(?<=[\p{Ll},] )\p{Lu}\p{Ll}[\p{L}\p{N}]*", None)


def values(text: Column) -> Column:
    """The text with each number and unit as one word of its own, for what stands behind placeholders."""
    whole = F.regexp_replace(text, r"(?<=[0-9])[.,](?=[0-9])", "x")
    apart = F.regexp_replace(whole, rf"(?i)\b([0-9][0-9x]*)\s*({'|'.join(UNITS.split())}|%)(?![\p{{L}}\p{{N}}])", "$1 $2 ")
    return F.replace(apart, F.lit("%"), F.lit("percent"))


def template(text: Column, names: str | None = ANYWHERE) -> Column:
    """The text with placeholders for numbers, units and names, which the pattern `names` finds; None: names stay."""
    unit = F.regexp_replace(values(text), rf"(?i)\b[0-9][0-9x]*\s+(?:{'|'.join(UNITS.split())})\b", f"{NUMBER} {UNIT}")
    number = F.regexp_replace(unit, r"\b[0-9][0-9x]*\b", NUMBER)
    name = lambda t: F.regexp_replace(t, names, NAME) if names else t
    return F.when(text.rlike("[0-9]"), name(number)).otherwise(name(text))


def words(text: Column) -> Column:
    """Lower-cased words; the first and last may be empty, which no other word equals."""
    return F.split(F.lower(text), r"[^\p{L}\p{N}]+")


def whole(tokens: Column) -> Column:
    return F.filter(tokens, lambda w: w != "")


def _prints(tokens: Column) -> Column:
    """A hash of each word. The hash of a window is that of its words' hashes, as an array or one by one."""
    return F.transform(tokens, lambda t: F.xxhash64(t))


def _windows(tokens: Column, widths: list[int]) -> Column:
    """(w, i, h) of every window of each width."""
    def of(t, w):
        at = F.sequence(F.lit(0), F.size(t) - w)
        return F.when(F.size(t) >= w, F.transform(at, lambda i: F.struct(F.lit(w).alias("w"), i.alias("i"), F.xxhash64(*[F.get(t, i + k) for k in range(w)]).alias("h"))))

    if len(widths) == 1:
        return let(_prints(tokens), lambda t: of(t, widths[0]))
    return let(_prints(tokens), lambda t: F.flatten(F.array_compact(F.array(*[of(t, w) for w in widths]))))


def contaminated(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """Returns (doc_id, item_id, windows long, share double, consistency double) for each document and item whose
    windows match.

    Share and consistency are those of one occurrence: an item's place in a text (document word less item word), places
    at most `width` words apart (an edited copy), or all places of the document. A document is named if any of them
    passes, by the one with the most windows; so another place of the same template spoils no copy.

    Items shorter than `width` words are one window of their own length. Null or empty texts match nothing; rows with a
    null id are left out; rows that repeat an id count as one text. Equal items are both named; an item that a document
    repeats is named once. Texts of any length are read whole. Other columns are not read, whatever their names.
    """
    named = items.where("item_id is not null and text is not null")
    forms = F.array(*[F.struct(whole(words(template(F.col("text"), f))).alias("tokens")) for f in FORMS])
    own = named.select("item_id", whole(words(values(F.col("text")))).alias("raw"), F.explode(F.array_distinct(forms)).alias("f")).select("item_id", "raw", "f.tokens")
    own = own.where(F.size("tokens") > 0)
    own = own.withColumn("width", F.least(F.lit(width), F.size("tokens")))
    literal = lambda t: F.size(F.filter(t, lambda w: ~w.isin(NUMBER, UNIT, NAME)))
    part = F.posexplode(F.transform(F.sequence(F.lit(1), F.size("tokens") - F.col("width") + 1), lambda i: F.struct(F.slice("tokens", i, F.col("width")).alias("t"), F.slice("raw", i, F.col("width")).alias("r"))))
    own = own.select("item_id", "width", part.alias("at", "w")).select("item_id", "width", "at", F.col("w.t").alias("t"), F.col("w.r").alias("r"))
    own = own.where(literal(F.col("t")) >= F.least(F.lit(LITERAL), F.col("width"))).select("item_id", "width", "at", "r", "t", F.xxhash64(_prints(F.col("t"))).alias("h")).distinct()
    own = durable(own.withColumn("typed", literal(F.col("t")) < F.col("width")), "windows")
    total = own.groupBy("item_id").agg(F.countDistinct("at").alias("total"))
    small = F.broadcast if own.count() <= FEW else (lambda df: df)
    read = docs.where("doc_id is not null and text is not null").select("doc_id", "text")
    widths = [r[0] for r in own.select("width").distinct().orderBy("width").collect()]  # at most `width` of them
    if not widths:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, windows long, share double, consistency double")
    cut = read.select("doc_id", F.xxhash64("text").alias("part"), F.explode(_windows(words(template(F.col("text"))), widths)).alias("x"))
    cut = cut.select("doc_id", "part", F.col("x.w").alias("width"), F.col("x.i").alias("i"), F.col("x.h").alias("h"))
    hits = durable(cut.join(small(own.select("item_id", "width", "at", "typed", "h")), ["h", "width"]).select("doc_id", "part", "item_id", "width", "at", "typed", "h", "i"), "hits")
    # what stands behind placeholders is read again, of the documents that need it
    asked = hits.where("typed").groupBy("doc_id", "part").agg(F.collect_set(F.struct("item_id", "at", "width", "h", "i")).alias("asked"))
    asked = F.broadcast(asked) if hits.where("typed").count() <= FEW else asked  # some 40 bytes a hit
    texts = read.withColumn("part", F.xxhash64("text")).join(asked, ["doc_id", "part"]).select("doc_id", "part", "asked", words(values(F.col("text"))).alias("raw"), words(template(F.col("text"))).alias("tokens"))
    cut = lambda name: F.slice(name, F.col("a.i") + 1, F.col("a.width"))
    there = texts.select("doc_id", "part", "raw", "tokens", F.explode("asked").alias("a")).select("doc_id", "part", "a.item_id", "a.at", "a.i", F.col("a.h").alias("h"), cut("raw").alias("y"), F.xxhash64(_prints(cut("tokens"))).alias("g")).where("g = h")
    zipped = there.join(small(own.select("item_id", "at", "h", "t", "r")), ["item_id", "at", "h"])
    pairs = F.filter(F.arrays_zip("t", "r", "y"), lambda z: z["t"].isin(NUMBER, UNIT, NAME))
    pairs = zipped.select("doc_id", "part", "item_id", "at", "i", F.transform(pairs, lambda z: F.struct(z["r"].alias("x"), z["y"].alias("y"))).alias("slots"))
    bare = hits.where("not typed").select("doc_id", "part", "item_id", "at", "i", F.array().cast("array<struct<x:string,y:string>>").alias("slots"))
    # one row a window of an item at a place first: what repeats in many rows of a document stays one row
    once = bare.unionByName(pairs).groupBy("doc_id", "part", "item_id", "at", (F.col("i") - F.col("at")).alias("place")).agg(F.array_distinct(F.flatten(F.collect_set("slots"))).alias("slots"))
    by = Window.partitionBy("doc_id", "part", "item_id").orderBy("place")
    near = once.withColumn("apart", F.coalesce((F.col("place") - F.lag("place").over(by) > width).cast("int"), F.lit(0)))
    near = near.withColumn("run", F.sum("apart").over(by))  # equal places are peers: one of them may be apart, all get the sum
    key = lambda kind, part, k: F.struct(F.lit(kind).alias("kind"), part.cast("long").alias("part"), k.cast("long").alias("k"))
    kinds = F.array(key("place", F.col("part"), F.col("place")), key("run", F.col("part"), F.col("run")), key("all", F.lit(0), F.lit(0)))
    per = near.select("doc_id", "item_id", "at", "slots", F.explode(kinds).alias("occurrence")).groupBy("doc_id", "item_id", "occurrence")
    met = per.agg(F.size(F.collect_set("at")).cast("long").alias("windows"), F.array_distinct(F.flatten(F.collect_set("slots"))).alias("slots"))
    # one to one: neither may one value of the item stand for two of the text, nor two for one
    distinct = lambda side: F.size(F.array_distinct(F.transform("slots", side)))
    one = F.least(distinct(lambda s: s.x), distinct(lambda s: s.y)) / F.greatest(F.size("slots"), F.lit(1))
    met = met.join(total, "item_id").select("doc_id", "item_id", "windows", (F.col("windows") / F.col("total")).alias("share"), F.when(F.size("slots") == 0, 1.0).otherwise(one).alias("consistency"))
    met = met.where(((F.col("share") >= SHARE) | (F.col("windows") >= RUN)) & (F.col("consistency") >= CONSISTENT))
    best = met.groupBy("doc_id", "item_id").agg(F.max(F.struct("windows", "consistency", "share")).alias("m"))
    return best.select("doc_id", "item_id", "m.windows", "m.share", "m.consistency")


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without those that contaminated() names: all rows of a doc_id of which one text is contaminated go; rows
    without a doc_id or text stay, repeated rows stay repeated, and all columns are kept."""
    bad = contaminated(docs, items).select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti").select(*docs.columns)
