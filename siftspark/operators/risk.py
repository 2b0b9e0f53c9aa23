"""The risk pipeline: evidence, score, tier, routing, dispatch, verification, correlation, triage. Row transforms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftspark.functions import patterns as P
from siftspark.functions import text as T

# Fixed values of the rules.
STRONG = ["AKIA", "ghp_", "gho_", "sk-", "hf_", "pplx-", "sk-ant-", "AIza", "nvapi-", "gsk_"]
SENSITIVE_PATHS = [".env", "config", "secret", "credential", "token", "password", ".aws/", ".ssh/", "deploy"]
TEST_PATHS = ["test_", "_test.", "mock", "fixture", "example", "__pycache__"]
CREDIBILITY = {"validated": 0.95, "semgrep": 0.80, "taint": 0.85, "tree/current_secrets": 0.50, "history/secrets": 0.60, "tree/nlp_pii": 0.40, "injection": 0.55}
CREDENTIAL_WORDS = ["password", "secret", "token", "key", "api_key", "credential", "auth", "passwd"]
TIERS = [(80, "critical"), (60, "high"), (35, "medium"), (15, "low")]
VALIDATE_WORDS = ["api", "token", "key", "secret", "password", "credential", "github", "aws", "pat"]
CODE = ["py", "js", "ts", "tsx", "jsx", "mjs", "java"]
PRODUCTION = ["prod", "production", "deploy", ".env", "config/", "settings", "terraform", "cloudformation", "k8s", "kubernetes", "docker-compose"]
PERSONAL = ["pii", "ssn", "email", "phone", "address", "nin", "sin", "insee", "tfn", "credit"]
IMAGES = ["png", "jpg", "jpeg", "bmp", "gif", "tiff"]
ASSETS = [(r"\.aws[/\\]", "aws-config"), (r"terraform[/\\]", "terraform-iac"), (r"k8s[/\\]|kubernetes[/\\]", "kubernetes"), (r"docker[/\\]|Dockerfile", "docker"), (r"\.github[/\\]workflows[/\\]", "github-actions"), (r"\.github[/\\]", "github-config"), (r"deploy[/\\]|deployment[/\\]", "deployment"), (r"config[/\\]|settings[/\\]", "application-config"), (r"\.env", "environment-vars"), (r"src[/\\].*auth", "authentication"), (r"src[/\\].*api", "api-layer"), (r"src[/\\].*db|database", "database"), (r"tests?[/\\]", "test-code"), (r"scripts?[/\\]", "scripts"), (r"docs?[/\\]", "documentation")]


def evidence(findings: DataFrame) -> DataFrame:
    """findings(type, match, file, source, entropy) with evidence: array of (source, confidence)."""
    match, path, kind = F.coalesce("match", F.lit("")), F.lower(F.coalesce("file", F.lit(""))), F.lower(F.coalesce("type", F.lit("")))
    size, h = F.length(match), F.col("entropy")
    sign = lambda name, value: F.struct(F.lit(name).alias("source"), value.cast("double").alias("confidence"))
    strong = F.lit(False)
    for p in STRONG:
        strong = strong | match.startswith(p)
    all_ = F.array(
        F.when(size > 0, sign("pattern_length", F.when(size >= 40, 0.85).when(size >= 20, 0.60).otherwise(0.25))),
        F.when(strong, sign("known_pattern", F.lit(0.95))),
        F.when(h >= 3.5, sign("entropy", F.when(h >= 5.0, 0.80).when(h >= 4.0, 0.50).otherwise(0.25))),
        F.when(T.any_contains(path, SENSITIVE_PATHS), sign("sensitive_path", F.lit(0.70))),
        F.when(T.any_contains(path, TEST_PATHS), sign("test_file", F.lit(-0.60))),
        sign("source_credibility", T.lookup(F.col("source"), CREDIBILITY, 0.30)),
        F.when(T.any_contains(kind, CREDENTIAL_WORDS), sign("suspicious_type", F.lit(0.60))),
    )
    return findings.withColumn("evidence", F.array_compact(all_))


def tier(score: Column) -> Column:
    out = F.lit("info")
    for least, name in reversed(TIERS):
        out = F.when(score >= least, name).otherwise(out)
    return out


def score(findings: DataFrame) -> DataFrame:
    """score 0 to 100 and risk_tier from evidence and an optional column valid."""
    valid = F.coalesce(F.col("valid"), F.lit(False)) if "valid" in findings.columns else F.lit(False)
    points = F.aggregate("evidence", F.lit(10), lambda a, e: a + F.bround(e.confidence * 40, 6).cast("int")) + F.when(valid, 50).otherwise(0)
    tested = F.exists("evidence", lambda e: e.source == "test_file")
    points = F.when(tested, F.greatest(F.lit(0), points - 30)).otherwise(points)
    return findings.withColumn("score", F.greatest(F.lit(0), F.least(F.lit(100), points)).cast("int")).withColumn("risk_tier", tier(F.col("score")))


def route(findings: DataFrame) -> DataFrame:
    """engines: what should look at a finding next, in order."""
    kind, path, t = F.lower("type"), F.lower(F.coalesce("file", F.lit(""))), F.col("risk_tier")
    ext = F.when(F.contains(path, F.lit(".")), F.substring_index(path, ".", -1)).otherwise("")
    hot = t.isin("critical", "high")
    engines = F.array_compact(F.array(
        F.when(T.any_contains(kind, VALIDATE_WORDS) & hot, F.lit("validate")),
        F.when(ext.isin(*CODE) & hot, F.lit("taint")),
        F.when(T.any_contains(path, PRODUCTION) & t.isin("critical", "high", "medium"), F.lit("audit-report")),
        F.when(F.contains(kind, F.lit("injection")), F.lit("semgrep")),
        F.when(T.any_contains(kind, PERSONAL) & hot, F.lit("presidio")),
        F.when(F.contains(kind, F.lit("entropy")) & (t == "high"), F.lit("perplexity")),
        F.when(ext.isin(*IMAGES), F.lit("stego")),
    ))
    return findings.withColumn("engines", F.when(hot & (F.size(engines) <= 1), F.array_append(engines, F.lit("llm-escalate"))).otherwise(engines))


def dispatch(findings: DataFrame, results: DataFrame) -> DataFrame:
    """results(finding_id, engine, outcome): `valid` +30 and critical, taint `high` +20, stego `risk` +40; a semgrep
    outcome is attached as rule. The score is capped at 100 and the tier follows."""
    gain = F.when((F.col("engine") == "validate") & (F.col("outcome") == "valid"), 30).when((F.col("engine") == "taint") & (F.col("outcome") == "high"), 20).when((F.col("engine") == "stego") & (F.col("outcome") == "risk"), 40).otherwise(0)
    per = results.groupBy("finding_id").agg(F.sum(gain).alias("_gain"), F.bool_or((F.col("engine") == "validate") & (F.col("outcome") == "valid")).alias("_live"), F.min(F.when(F.col("engine") == "semgrep", F.col("outcome"))).alias("rule"))
    out = findings.join(per, "finding_id", "left").withColumn("score", F.least(F.lit(100), F.col("score") + F.coalesce("_gain", F.lit(0))).cast("int"))
    return out.withColumn("risk_tier", F.when(F.coalesce("_live", F.lit(False)), "critical").otherwise(tier(F.col("score")))).drop("_gain", "_live")


def validator(type_: Column) -> tuple[Column, Column]:
    """Endpoint and status of a live secret, by the first rule whose name the type holds; null for others."""
    endpoint, ok = F.lit(None).cast("string"), F.lit(None).cast("int")
    for name, url, live, _ in reversed(P.VALIDATORS):
        fits = F.contains(F.lower(type_), F.lit(name.lower()))
        endpoint, ok = F.when(fits, url).otherwise(endpoint), F.when(fits, live).otherwise(ok)
    return endpoint, ok


def validate(findings: DataFrame, responses: DataFrame) -> DataFrame:
    """valid and checked from a table of responses(endpoint, match, status), one row a key; nothing is called. Every
    finding stays a row of its own, equal ones too."""
    endpoint, ok = validator(F.col("type"))
    out = findings.withColumn("endpoint", endpoint).withColumn("_ok", ok).join(responses, ["endpoint", "match"], "left")
    out = out.withColumn("checked", F.col("status").isNotNull()).withColumn("valid", F.coalesce(F.col("status") == F.col("_ok"), F.lit(False)))
    return out.select(*findings.columns, "endpoint", "status", "checked", "valid")


def needs_check(findings: DataFrame) -> DataFrame:
    return findings.where(F.col("risk_tier").isin("critical", "high") & (F.coalesce("validation", F.lit("unchecked")) == "unchecked"))


def asset(path: Column) -> Column:
    out = F.lit("uncategorized")
    for pattern, name in reversed(ASSETS):
        out = F.when(path.rlike("(?i)" + pattern), name).otherwise(out)
    return out


def correlate(findings: DataFrame) -> DataFrame:
    """One row an asset: counts by tier, the highest score, a tier and a summary."""
    n = lambda t: F.count_if(F.col("risk_tier") == t).alias(t)
    out = findings.groupBy(asset(F.coalesce("file", F.lit(""))).alias("asset")).agg(F.count("*").alias("n"), F.max("score").alias("max_score"), n("critical"), n("high"), n("medium"), n("low"))
    t = F.when((F.col("critical") > 0) | (F.col("max_score") >= 80), "critical").when(F.col("max_score") >= 60, "high").when(F.col("max_score") >= 35, "medium").otherwise("low")
    text = F.format_string("%d findings: %dC/%dH/%dM/%dL", "n", "critical", "high", "medium", "low")
    return out.withColumn("asset_tier", t).withColumn("summary", text)


def top_assets(assets: DataFrame, n: int = 10) -> DataFrame:
    return assets.orderBy(F.desc("max_score"), "asset").limit(n)


def triage(findings: DataFrame) -> DataFrame:
    """Verdict without a model: known noise and very short matches are false positives."""
    size = F.length(F.coalesce("match", F.lit("")))
    noise = F.col("type").rlike("Cloudflare|Pinecone|PRONOUN") | ((size > 0) & (size < 6))
    return findings.withColumn("verdict", F.when(noise, "false_positive").otherwise("true_positive")).withColumn("verdict_confidence", F.when(noise, 85).otherwise(70))


def parse_verdicts(answers: DataFrame) -> DataFrame:
    """answers(file, answer): one row a line of a model's answer, with its number and verdict."""
    rows = answers.select("file", F.posexplode(F.filter(F.split("answer", "\n"), lambda x: F.trim(x) != "")).alias("n", "line"))
    low = F.lower("line")
    return rows.select("file", "n", F.when(low.rlike("false.?positive"), "false_positive").when(low.rlike("true.?positive"), "true_positive").otherwise("uncertain").alias("verdict"))


def prompts(findings: DataFrame, most: int = 20) -> DataFrame:
    """One prompt a file with its first findings in order of ordinal, masked."""
    row = F.row_number().over(Window.partitionBy("file").orderBy("ordinal", "type", "match"))
    top = findings.withColumn("_n", row).where(F.col("_n") <= most)
    text = F.format_string("%d. %s: %s", F.col("_n"), F.col("type"), T.redact(F.col("match")))
    per = top.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", text.alias("t")))), lambda x: x.t), "\n").alias("body"))
    return per.select("file", F.concat(F.lit("Review the findings in "), "file", F.lit(". Answer true positive or false positive for each line.\n"), "body").alias("prompt"))


def summary_prompt(findings: DataFrame, top: int = 10) -> DataFrame:
    """One row: a prompt with the counts by tier and the most frequent types."""
    tiers = findings.groupBy("risk_tier").agg(F.count("*").alias("n")).agg(F.array_join(F.array_sort(F.collect_list(F.format_string("%s: %d", "risk_tier", "n"))), ", ").alias("tiers"))
    kinds = findings.groupBy("type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "type").limit(top).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "type"))), lambda x: F.format_string("%s: %d", x["type"], -x.m)), ", ").alias("kinds"))
    return tiers.crossJoin(F.broadcast(kinds)).select(F.format_string("Summarise the risk of these findings for an owner of the code.\nBy tier: %s\nBy type: %s", "tiers", "kinds").alias("prompt"))  # one row each


#: What to do about a finding, by words of its type; the last one fits all.
REMEDIES = [("injection", "Treat the text as data and escape it."), ("entropy", "If it is a secret, move it to a store of secrets."), ("email", "Replace the address by a reserved one."), ("ssn", "Remove the number."), ("credit", "Remove the number."), ("key", "Revoke it and read it from the environment."), ("token", "Revoke it and read it from the environment."), ("password", "Change it and read it from the environment."), ("", "Remove it from the file and its history.")]


def fix_prompts(findings: DataFrame) -> DataFrame:
    """One prompt a file: its distinct types with masked examples and what to do about each."""
    remedy = F.lit(None).cast("string")
    for word, text in reversed(REMEDIES):
        remedy = F.when(F.contains(F.lower("type"), F.lit(word)), text).otherwise(remedy)
    per = findings.groupBy("file", "type").agg(F.min("line").alias("line"), F.min(T.redact(F.col("match"))).alias("example"), F.count("*").alias("n"))
    text = F.format_string("- %s (%d, first in line %s, such as %s): %s", F.col("type"), F.col("n"), F.coalesce(F.col("line").cast("string"), F.lit("?")), F.col("example"), remedy)
    return per.groupBy("file").agg(F.array_join(F.array_sort(F.collect_list(text)), "\n").alias("body")).select("file", F.concat(F.lit("Correct the file "), F.coalesce("file", F.lit("unknown")), F.lit(" and return it whole.\n"), "body").alias("prompt"))


def numbered(findings: DataFrame, order: str = "ordinal", ranges: int = 200) -> DataFrame:
    """finding_id f000000, f000001, ... by rank of `order` (a number, nearly unique), then content.

    Rows are ranked inside of ranges of `order`, whose bounds are constants of the plan: no task sees all rows, and a
    row's number does not depend on how the rows happen to be partitioned."""
    key, value = [order, "type", "file", "match"], F.col(order).cast("double")
    cuts = findings.agg(F.percentile_approx(value, [k / ranges for k in range(1, ranges)], 10_000)).first()[0] or []
    cuts = sorted(set(cuts))
    bounds = F.array(*[F.lit(float(c)) for c in cuts]).cast("array<double>")
    range_ = F.when(value.isNull(), 0).otherwise(1 + F.size(F.filter(bounds, lambda c: c < value)))
    spread = findings.withColumn("_p", range_)
    sizes = {r["_p"]: r["n"] for r in spread.groupBy("_p").agg(F.count("*").alias("n")).collect()}  # one row a range
    start, starts = 0, []
    for k in range(len(cuts) + 2):
        starts.append(start)
        start += sizes.get(k, 0)
    rank = F.row_number().over(Window.partitionBy("_p").orderBy(*key)) - 1
    first = F.element_at(F.array(*[F.lit(x).cast("long") for x in starts]), F.col("_p") + 1)
    return spread.withColumn("_i", rank).withColumn("finding_id", F.format_string("f%06d", first + F.col("_i"))).drop("_p", "_i")
