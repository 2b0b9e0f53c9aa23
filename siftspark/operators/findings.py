"""Set operations, aggregates and scores over findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftspark.functions import patterns as P
from siftspark.functions import text as T

#: Keys of a finding's identity for each stage.
KEYS = {"tree": ("type", "file", "line", "match"), "entropy": ("file", "line", "match"), "injection": ("type", "file", "match"), "validated": ("type", "match")}


def deduplicate(findings: DataFrame, keys: tuple[str, ...], order: str = "ordinal") -> DataFrame:
    """The first row by `order` of each key; a null counts as an empty string."""
    # an aggregate, not a ranking window: copies combine before the shuffle, so a hot key is no hot task
    names = findings.columns
    key = [F.coalesce(F.col(k).cast("string"), F.lit("")).alias(f"_k{i}") for i, k in enumerate(keys)]
    first = findings.select(*key, F.struct(F.col(order).alias("_o"), F.struct(*names).alias("row")).alias("_r"))
    return first.groupBy(*[f"_k{i}" for i in range(len(keys))]).agg(F.min("_r").alias("_r")).select("_r.row.*")


def without_tokens(findings: DataFrame, tokens: DataFrame) -> DataFrame:
    """Findings whose match is no row of tokens(token)."""
    return findings.join(tokens.select(F.col("token").alias("match")).distinct(), "match", "left_anti")


def prune_noise(findings: DataFrame, least: float = 3.8) -> DataFrame:
    t = F.col("type")
    noisy = (t == "PRONOUN") | t.startswith("Cloudflare API Key") | t.startswith("Pinecone")
    return findings.where(~noisy & (F.col("entropy").isNull() | (F.col("entropy") >= least)))


def top_types(findings: DataFrame, n: int = 10) -> DataFrame:
    return findings.groupBy("type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "type").limit(n)


def by_source(findings: DataFrame, *keys: str) -> DataFrame:
    """Counts over every prefix of keys."""
    return findings.rollup(*keys).agg(F.count("*").alias("n"))


def replacement_list(findings: DataFrame) -> DataFrame:
    """Distinct matches as lines of a history filter."""
    m = T.strip(F.col("match"))
    return findings.where(m != "").select(F.concat(m, F.lit("==>[REDACTED]")).alias("rule")).distinct().orderBy("rule")


def ignore_suggestions(flagged: DataFrame, present: DataFrame) -> DataFrame:
    return flagged.select("file").distinct().join(present.select("file"), "file", "left_anti")


def injection_score(findings: DataFrame, *keys: str) -> DataFrame:
    name = F.substring_index("type", ":", -1)
    weight = F.when(F.col("category") == "injection", T.lookup(name, P.INJECTION_WEIGHTS, 5)).otherwise(0)
    return findings.groupBy(*keys).agg(F.least(F.lit(100), F.coalesce(F.sum(weight), F.lit(0))).cast("int").alias("injection_score"))


def safety(secrets: Column, pii: Column, entropy: Column, sast: Column | None = None) -> Column:
    cost = 40 * secrets + 20 * pii + 10 * entropy + (10 * sast if sast is not None else 0)
    return F.greatest(F.lit(0), F.least(F.lit(100), 100 - cost)).cast("int")


def label(score: Column) -> Column:
    return F.when(score >= 90, "GREEN").when(score < 50, "RED").otherwise("YELLOW")


def totals(findings: DataFrame, *keys: str) -> DataFrame:
    """Counts for each category, the sum, the safety score and its label."""
    n = lambda c: F.count_if(F.col("category") == c)
    out = findings.groupBy(*keys).agg(*[n(c).alias(c) for c in ("secret", "pii", "entropy", "injection", "commit", "sast", "nlp_pii")])
    total = sum((F.col(c) for c in ("secret", "pii", "entropy", "injection", "commit", "sast", "nlp_pii")), F.lit(0))
    score = safety(F.col("secret"), F.col("pii") + F.col("nlp_pii"), F.col("entropy"), F.col("sast"))
    return out.withColumn("total_issues", total).withColumn("safety_score", score).withColumn("risk_label", label(score))


def file_risk(findings: DataFrame) -> DataFrame:
    has = lambda c: F.bool_or(F.coalesce(F.col("category").isin(*c), F.lit(False)))
    out = findings.groupBy(F.coalesce("file", F.lit("unknown")).alias("file")).agg(F.count("*").alias("n"), has(("validated", "stego")).alias("a"), has(("taint",)).alias("t"), has(("injection",)).alias("i"), has(("sast",)).alias("s"))
    risk = F.when(F.col("a"), "critical").when(F.col("t") | (F.col("i") & F.col("s")), "high").when(F.col("i") | F.col("s"), "medium").otherwise("low")
    return out.select("file", "n", risk.alias("risk"))


def stats(findings: DataFrame) -> DataFrame:
    """One row: findings, files, files by risk."""
    per = file_risk(findings)
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count("*").alias("files"), *[F.count_if(F.col("risk") == r).alias(r) for r in ("critical", "high", "medium", "low")])


def live_counts(validated: DataFrame) -> DataFrame:
    return validated.agg(F.count_if(F.col("valid") & F.col("checked")).alias("live"), F.count_if(F.col("checked") & ~F.col("valid")).alias("dead"))


# What a flat list calls the findings of each source.
FLAT = {"history/secrets": "History Secret", "history/pii": "History PII", "history/entropy": "History Entropy", "tree/current_secrets": "Tree Secret", "tree/nlp_pii": "NLP PII", "crosscheck": "PS Crosscheck", "semgrep": "Semgrep SAST"}


def flatten(findings: DataFrame) -> DataFrame:
    """findings of all sources as one list (category, file, line as text, type, match, entropy); others are left out."""
    source = F.col("source")
    kind = F.when(source == "history/entropy", "High Entropy").when(source == "semgrep", F.concat(F.lit("SAST ("), "type", F.lit(")"))).otherwise(F.coalesce("type", F.lit("Secret")))
    line = F.when(source.isin("tree/nlp_pii", "crosscheck"), "?").otherwise(F.coalesce(F.col("line").cast("string"), F.lit("?")))
    rows = findings.where(source.isin(*FLAT))
    return rows.select(T.lookup(source, FLAT, None).alias("category"), F.coalesce("file", F.lit("unknown")).alias("file"), line.alias("line"), kind.alias("type"), F.coalesce("match", F.lit("")).alias("match"), "entropy")


def capped(findings: DataFrame, n: int = 500, order: str = "ordinal") -> DataFrame:
    """The first n rows by `order`, then content: a cut inside of a tie does not depend on how the rows are partitioned."""
    return findings.orderBy(order, "type", "file", "match").limit(n)


def head_tail(lines: DataFrame, n: int, *keys: str) -> DataFrame:
    """First and last n lines of each text, with the number left out between them."""
    size = F.count("*").over(Window.partitionBy(*keys))
    return lines.withColumn("_n", size).where((F.col("line") <= n) | (F.col("line") > F.col("_n") - n)).withColumn("omitted", F.greatest(F.lit(0), F.col("_n") - 2 * n)).drop("_n")
