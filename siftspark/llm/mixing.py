"""Mixing sources to target weights by Poisson replication, in DataFrame operations only.

Each document is repeated a Poisson-distributed number of times whose mean is its source's repetition rate. The number
comes from inverting the distribution at a value in [0, 1) hashed from seed and document, so a lost task gives the same
rows again. The copies are shuffled globally by a hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftspark.llm.common import join_counted, let

#: Weights are source sizes to this power where none are given: 1 keeps the mix, 0 makes all sources equal.
POWER, SEED = 0.5, "mix-1"
#: Means above this are drawn as a sum of several equal ones: exp(-mean) stays far from underflow.
STEP = 500
#: Rates of at most so many sources are broadcast (at most some 6 kB each, the table of a mean of STEP); of more sources
#: only the hot ones.
FEW = 2_000


def uniform(key: Column) -> Column:
    """A value in [0, 1) with 52 bits hashed from a string."""
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long") / float(1 << 52)


def poisson_table(mean: Column) -> Column:
    """P(X <= 0), P(X <= 1), ... as far as they differ from 1 in double precision."""
    most = F.ceil(mean + 10 * F.sqrt(mean) + 20).cast("int")
    zero = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("t"))

    def step(a, k):
        p = a.p * mean / k
        return F.struct(p.alias("p"), F.concat(a.t, F.array(F.element_at(a.t, -1) + p)).alias("t"))

    return F.aggregate(F.sequence(F.lit(1), most), zero, step, lambda a: a.t)


def rates(docs: DataFrame, weights: dict[str | None, float] | None = None, power: float = POWER) -> DataFrame:
    """(source, n, rate): its rows, and how often a document of each source is repeated in the mean, so that the expected
    number of rows stays that of docs and sources get shares in proportion to their weights; a source that `weights`
    does not name gets none."""
    sizes = docs.groupBy("source").agg(F.count("*").alias("n"))
    if weights is None:
        weight = F.pow(F.col("n").cast("double"), F.lit(power))
    else:
        weight = F.coalesce(*[F.when(F.col("source").eqNullSafe(F.lit(k)), F.lit(float(w))) for k, w in weights.items()], F.lit(0.0))
    sizes = sizes.withColumn("w", weight)
    total = sizes.agg(F.sum("n").alias("all_n"), F.sum("w").alias("all_w"))
    return sizes.join(F.broadcast(total)).select("source", "n", F.when(F.col("all_w") > 0, F.col("w") / F.col("all_w") * F.col("all_n") / F.col("n")).otherwise(0.0).alias("rate"))


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, power: float = POWER, seed: str = SEED, few: int = FEW) -> DataFrame:
    """docs(doc_id, source, ...) with copy (from 1) and shuffle_key; rows are in the order of shuffle_key.

    A null source is a source; a null doc_id hashes like an empty one, a null text stays; rows of one doc_id get the
    same number of copies; columns named copy or shuffle_key are replaced, all others are kept, whatever their names.
    An empty table gives an empty result.
    """
    rate = rates(docs, weights, power)
    draws = F.greatest(F.lit(1), F.ceil(F.col("rate") / STEP)).cast("int")
    named = lambda source: F.coalesce(F.concat(F.lit("="), source), F.lit(""))  # noqa: E731  # null is a source too
    rate = rate.withColumn("rate", F.greatest("rate", F.lit(0.0))).select(named(F.col("source").cast("string")).alias("key"), "n", draws.alias("draws"), poisson_table(F.col("rate") / draws).alias("table"))
    names = [c for c in docs.columns if c.lower() not in ("copy", "shuffle_key")]
    own = F.coalesce(F.col("row.doc_id").cast("string"), F.lit(""))
    times = F.aggregate(
        F.sequence(F.lit(1), F.col("draws")), F.lit(0),
        lambda n, k: n + let(uniform(F.concat_ws(":", F.lit(seed), own, k.cast("string"))), lambda u: F.size(F.filter("table", lambda c: c <= u))),
    )
    # the row is one column, so that no name of docs meets one of ours; copies are counted once a document
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")).withColumn("key", named(F.col("row.source").cast("string")))
    met = rows.join(F.broadcast(rate.drop("n")), "key") if rate.count() <= few else join_counted(rows, rate, ["key"], docs.count(), 1_000)
    counted = met.select("row", times.alias("times")).where("times > 0")
    copies = counted.select("row", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy"))
    key = F.md5(F.concat_ws(":", F.lit(seed), F.lit("order"), own, F.col("copy").cast("string")))
    return copies.select("row.*", "copy", key.alias("shuffle_key")).orderBy("shuffle_key")
