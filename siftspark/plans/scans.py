"""Whole scans: snippet, tree, history, risk pipeline; each a chain of transforms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftspark.operators import detect, diffs, risk
from siftspark.operators import findings as A


def snippet(docs: DataFrame, key: str, text: str = "text", threshold: float = 3.8, **options) -> DataFrame:
    """docs(key, text) -> findings(key, line, category, type, match, entropy), in one pass over the lines."""
    found = detect.scan(detect.lines(docs, text, key), entropy=threshold, **options)
    return found.select(key, "line", "category", "type", "match", "entropy")


def document_risk(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 3.8) -> DataFrame:
    """One row a document, also for those without findings: counts, safety score, label."""
    found = snippet(docs, key, text, threshold, injections={}).select(key, "line", "category", "type", "match").distinct()
    per = found.groupBy(key).agg(*[F.count_if(F.col("category") == c).alias(a) for c, a in (("secret", "secrets"), ("pii", "pii"), ("entropy", "entropy"))])
    out = docs.select(key).join(per, key, "left").select(key, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("secrets", "pii", "entropy")])
    score = A.safety(F.col("secrets"), F.col("pii"), F.col("entropy"))
    return out.withColumn("safety_score", score).withColumn("risk_label", A.label(F.col("safety_score")))


def tree(files: DataFrame, **options) -> DataFrame:
    """files(file, text): personal data counts as secrets, no entropy; look-alikes are read as what they stand for;
    deduplicated."""
    found = detect.scan(detect.lines(files, "text", "file"), pii_as_secret=True, **({"lookalikes": True} | options))
    found = found.unionByName(detect.language_rules(detect.lines(files, "text", "file")))
    return A.deduplicate(found, A.KEYS["tree"])


def history(patch: DataFrame, key: str = "commit", **options) -> DataFrame:
    rows = diffs.added_lines(patch, key)
    return A.deduplicate(detect.scan(rows, drop_hashes=False, **options), A.KEYS["tree"])


def risk_pipeline(findings: DataFrame) -> DataFrame:
    return findings.transform(risk.evidence).transform(risk.score).transform(risk.route).transform(risk.triage)
