"""A character model: counts of the next character after each context, and perplexity of texts under it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftspark.functions import patterns as P
from siftspark.functions import text as T

ORDER = 5


def safe_text(docs: DataFrame, text: str = "text", most: int | None = None) -> DataFrame:
    """Texts without lines that look like secrets; up to `most` characters of each where that is given."""
    kept = F.array_join(F.filter(T.split_lines(F.col(text)), lambda x: ~x.rlike(P.SECRET_LOOKALIKE)), "\n")
    return docs.withColumn(text, kept if most is None else F.substring(kept, 1, most))


def ngrams(docs: DataFrame, text: str = "text", order: int = ORDER, *keys: str) -> DataFrame:
    padded = F.concat(F.lit(" " * (order - 1)), F.col(text))
    cut = docs.where(F.length(text) > 0).select(*keys, padded.alias("_p"), F.length(text).alias("_n"))
    rows = cut.select(*keys, F.explode(F.transform(F.sequence(F.lit(1), F.col("_n")), lambda i: F.substr(F.col("_p"), i, F.lit(order)))).alias("g"))
    return rows.select(*keys, F.substring("g", 1, order - 1).alias("ctx"), F.substring("g", order, 1).alias("ch"))


def train(docs: DataFrame, text: str = "text", order: int = ORDER) -> DataFrame:
    """(ctx, ch, n); merging two models is a union and a sum."""
    return ngrams(docs, text, order).groupBy("ctx", "ch").agg(F.count("*").alias("n"))


def perplexity(docs: DataFrame, model: DataFrame, key: str, text: str = "text", order: int = ORDER) -> DataFrame:
    """(key, perplexity): 2 ^ -mean(log2 p), p = (n + 0.1) / (total + 25.6), 1/256 in an unseen context; texts shorter
    than the order get 2 ^ 999."""
    total = model.groupBy("ctx").agg(F.sum("n").alias("total"))
    grams = ngrams(docs, text, order, key).groupBy(key, "ctx", "ch").agg(F.count("*").alias("m"))
    p = F.when(F.col("total").isNull(), 1 / 256).otherwise(F.greatest(F.lit(1e-15), (F.coalesce("n", F.lit(0)) + 0.1) / (F.col("total") + 25.6)))
    scored = grams.join(model, ["ctx", "ch"], "left").join(total, "ctx", "left").groupBy(key).agg((F.sum(F.col("m") * F.log2(p)) / F.sum("m")).alias("h"))
    short = F.length(F.coalesce(text, F.lit(""))) < order
    return docs.select(key, short.alias("_s")).join(scored, key, "left").select(key, F.pow(F.lit(2.0), -F.when(F.col("_s"), -999.0).otherwise(F.col("h"))).alias("perplexity"))


def limit_for(path) -> object:
    return T.lookup(T.extension(path), P.PERPLEXITY_LIMITS, 14.0)
