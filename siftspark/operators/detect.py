"""Detectors over lines. A line goes on only for the patterns whose gate it passes (a literal that every match holds, or
a cheap regex), one row each; so the costly regexes see few lines, and a plan holds each of them once."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftspark.functions import homoglyph
from siftspark.functions import patterns as P
from siftspark.functions import text as T

TOKEN = r"\b[A-Za-z0-9_\-]{16,}\b"
BASE64 = r"(?U)\b[A-Za-z0-9+/]{24,}={0,2}\b"


@dataclass(frozen=True)
class Rule:
    """One pattern. name finds its gate; decoded: it is looked for inside of Base64 words too."""

    category: str
    type: str
    pattern: str
    ordinal: int
    name: str = ""
    decoded: bool = False


def lines(docs: DataFrame, text: str = "text", *keys: str) -> DataFrame:
    """keys, line (from 1) and content of each line of each text."""
    return docs.select(*keys, F.posexplode_outer(T.split_lines(F.col(text))).alias("_at", "content")).where("content is not null").select(*keys, (F.col("_at") + 1).alias("line"), "content")


def _rules(family: str, table: dict[str, str], prefix: str = "", base: int = 0, decoded: bool = False) -> list[Rule]:
    return [Rule(family, prefix + name, pattern, base + k, name, decoded) for k, (name, pattern) in enumerate(table.items())]


def _decoded(content: Column) -> Column:
    """(text, word) of each Base64 word that decodes to at least eleven printable ASCII characters."""
    words = F.array_distinct(F.regexp_extract_all(content, F.lit(BASE64), F.lit(0)))
    bare = lambda w: F.regexp_replace(w, "=+$", "")
    padded = lambda w: F.concat(bare(w), F.repeat(F.lit("="), ((4 - F.length(bare(w)) % 4) % 4).cast("int")))
    plain = lambda w: F.when(F.length(bare(w)) % 4 != 1, F.try_to_binary(padded(w), F.lit("base64")))
    pairs = F.transform(words, lambda w: F.struct(F.when(F.is_valid_utf8(plain(w).cast("string")), plain(w).cast("string")).alias("text"), w.alias("word")))
    return F.filter(pairs, lambda p: p.text.rlike(r"^[\x20-\x7e\r\n\t]{11,}$"))


def _low(text: Column) -> Column:
    # the one letter that (?i) takes for an ASCII one and lower() does not
    return F.replace(F.lower(text), F.lit("\u017f"), F.lit("s"))


def _worth(text: Column, signs: bool, others: list[Rule], lookalikes: bool) -> Column:
    """Lines that any rule may match: most are done with here, before anything is built for them."""
    if any(r.name not in P.GATES for r in others):
        return F.lit(True)
    out = text.rlike(P.SIGNS + (r"|[^\x00-\x7f]" if lookalikes else "")) if signs or lookalikes else F.lit(False)
    if others:
        words = F.array(*[F.lit(x) for x in sorted({x for r in others for x in P.GATES[r.name]})])
        out = out | T.let(_low(text), lambda t: F.exists(words, lambda x: F.contains(t, x)))
    return out


def _gated(text: Column, rules: list[tuple[int, Rule]]) -> Column:
    """Numbers of the rules that may match."""
    literals = [(x, k) for k, r in rules for x in P.GATES.get(r.name, ())]
    low = _low(text)
    table = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(k).alias("k")) for x, k in literals])
    parts = [T.let(low, lambda t: F.transform(F.filter(table, lambda g: F.contains(t, g.x)), lambda g: g.k))] if literals else []
    free = [F.when(text.rlike(P.REGEX_GATES[r.name]), F.lit(k)) if r.name in P.REGEX_GATES else F.lit(k) for k, r in rules if r.name not in P.GATES]
    if free:
        parts.append(F.array_compact(F.array(*free)))
    return F.array_distinct(F.concat(*parts)) if parts else F.array().cast("array<int>")


def match_rules(rows: DataFrame, content: str, rules: list[Rule], base64: bool = False, lookalikes: bool = False, allowed=None) -> DataFrame:
    """rows with category, type, match and ordinal: one row a match of a rule. allowed(rule): a condition on the row
    under which a rule is looked for."""
    if not rules:
        return rows.select(*rows.columns, *[F.lit(None).cast(t).alias(n) for n, t in (("category", "string"), ("type", "string"), ("match", "string"), ("ordinal", "int"))]).where("false")
    c, names = F.col(content), rows.columns
    numbered = list(enumerate(rules))
    signs = [(k, r) for k, r in numbered if r.category not in ("injection", "word")]
    others = [(k, r) for k, r in numbered if r.category in ("injection", "word")]
    rows = rows.where(c.isNotNull() & _worth(c, bool(signs), [r for _, r in others], lookalikes))
    own = F.array(F.struct(c.alias("text"), F.lit(None).cast("string").alias("word")))
    none = F.array().cast("array<struct<text:string,word:string>>")
    forms = [own]
    if base64:
        forms.append(F.when(c.rlike(r"[A-Za-z0-9+/]{24,}"), _decoded(c)).otherwise(none))
    if lookalikes:
        clean = homoglyph.deconfuse_single(c)
        forms.append(F.when(c.rlike(r"[^\x00-\x7f]") & (clean != c), F.array(F.struct(clean.alias("text"), F.lit(None).cast("string").alias("word")))).otherwise(none))
    seen = rows.select(*names, F.explode(F.concat(*forms)).alias("_v")) if len(forms) > 1 else rows.select(*names, own[0].alias("_v"))
    text = F.col("_v.text")
    parts = [F.when(text.rlike(P.SIGNS), _gated(text, signs)).otherwise(F.array().cast("array<int>"))] if signs else []
    parts += [_gated(text, others)] if others else []
    seen = seen.select(*names, "_v", F.explode(F.concat(*parts)).alias("_k"))
    if base64:
        inner = [k for k, r in numbered if r.decoded]
        seen = seen.where(F.col("_v.word").isNull() | F.col("_k").isin(*inner))
    hits = F.lit(None).cast("array<string>")
    for k, r in reversed(numbered):
        ok = F.col("_k") == k
        hits = F.when(ok if allowed is None else ok & allowed(r), T.find_all(text, r.pattern)).otherwise(hits)
    found = seen.select(*names, "_v", "_k", F.explode(hits).alias("match"))
    of = lambda value: F.element_at(F.array(*[F.lit(value(r)) for r in rules]), F.col("_k") + 1)
    word, match = F.col("_v.word"), T.strip(F.col("match"))
    return found.select(
        *names, F.when(of(lambda r: r.category) == "word", "secret").otherwise(of(lambda r: r.category)).alias("category"),
        F.when(word.isNotNull(), F.concat(F.lit("Obfuscated:"), of(lambda r: r.type))).otherwise(of(lambda r: r.type)).alias("type"),
        F.when(word.isNotNull(), F.concat(word, F.lit(" (Decoded: "), match, F.lit(")"))).otherwise(match).alias("match"),
        F.when(word.isNotNull(), 1000 + of(lambda r: r.ordinal)).otherwise(of(lambda r: r.ordinal)).alias("ordinal"),
    )


def scan(rows: DataFrame, content: str = "content", secrets: dict | None = None, pii: dict | None = None, injections: dict | None = None, words: Iterable[str] = (), base64: bool = True, pii_as_secret: bool = False, drop_hashes: bool = True, ignore: list[str] | None = None, lookalikes: bool = False, entropy: float | None = None) -> DataFrame:
    """rows with category, type, match and ordinal: one row a finding. With lookalikes, lines are also read with
    look-alike characters replaced; what both forms show comes twice, for deduplicate(). With entropy (a threshold),
    words of high entropy come too, and a column entropy."""
    secrets, pii, injections = P.SECRETS if secrets is None else secrets, P.PII if pii is None else pii, P.INJECTIONS if injections is None else injections
    rules = _rules("secret", secrets, decoded=True)
    rules += [Rule("word", f"Sensitive Word: {w}", r"(?i)\Q" + w.replace(r"\E", r"\E\\E\Q") + r"\E", 2000 + k) for k, w in enumerate(words or ())]
    rules += _rules("secret" if pii_as_secret else "pii", pii, "PII:" if pii_as_secret else "", 3000)
    rules += _rules("injection", injections, "INJECTION:", 4000)
    if entropy is not None:
        rules.append(Rule("entropy", "ENTROPY", TOKEN, 5000, "ENTROPY"))
    found = match_rules(rows, content, rules, base64 and bool(secrets), lookalikes)
    if entropy is not None:
        token = F.col("category") == "entropy"
        found = found.where(~token | _entropy_token(F.col("match"))).withColumn("entropy", F.when(token, F.round(T.entropy(F.col("match")), 2))).where(~token | (T.entropy(F.col("match")) >= entropy))
    if drop_hashes:
        found = found.where(~((F.col("category") == "secret") & T.hex_hash(F.col("match"))))
    if pii_as_secret:
        found = found.where(~(F.col("type").startswith("PII:") & F.col("match").isin(*P.PII_IGNORED)))
    if ignore:
        found = found.where((F.col("category") == "injection") | ~F.col("match").isin(*ignore))
    return found


def language_rules(rows: DataFrame, file: str = "file", content: str = "content") -> DataFrame:
    """Findings of the rule pack that fits the file's extension."""
    ext, rules, exts = T.extension(F.col(file)), [], {}
    for of, pack in P.LANGUAGE_RULES:
        for r in _rules("secret", pack):
            rules.append(r)
            exts[r.type] = of
    return match_rules(rows.where(ext.isin(*[x for of, _ in P.LANGUAGE_RULES for x in of])), content, rules, allowed=lambda r: ext.isin(*exts[r.type]))


def _entropy_token(m: Column, skip_hashes: bool = True) -> Column:
    ok = ~m.rlike("^[0-9]+$") & ~T.ignored_token(m)
    return ok & ~(m.rlike("^[a-fA-F0-9]+$") & F.length(m).isin(32, 40)) if skip_hashes else ok


def entropy_tokens(rows: DataFrame, content: str = "content", threshold: float = 3.8, skip_hashes: bool = True) -> DataFrame:
    """rows with match and entropy of words of 16 and more characters whose entropy reaches the threshold."""
    some = rows.where(F.col(content).rlike(P.REGEX_GATES["ENTROPY"]))
    found = some.select(*rows.columns, F.explode(T.find_all(F.col(content), TOKEN)).alias("match"))
    m = F.col("match")
    found = found.where(_entropy_token(m, skip_hashes))
    return found.withColumn("entropy", F.round(T.entropy(m), 2)).where(T.entropy(m) >= threshold)


# Fixed values.
PRONOUNS = "he him his himself she her hers herself".split()


def pronouns(texts: list[str]) -> list[list[tuple[str, str]]]:
    """The recogniser that needs no model."""
    return [[("PRONOUN", m[0]) for m in re.finditer(rf"(?i)\b(?:{'|'.join(PRONOUNS)})\b", t)] for t in texts]


def recognise(rows: DataFrame, recogniser: Callable[[list[str]], list[list[tuple[str, str]]]] = pronouns, content: str = "content", prefix: str = "") -> DataFrame:
    """rows with category nlp_pii, type and match, as any recogniser finds them: a function that executors can import,
    from a batch of texts to the (type, match) pairs of each. Models go in here, `prefix` before their types."""
    def find(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"type": prefix + t, "match": m} for t, m in found] for found in recogniser([x or "" for x in texts])])

    found = F.pandas_udf(find, "array<struct<type:string,match:string>>")(F.col(content))
    return rows.withColumn("_x", found).select(*rows.columns, F.explode("_x").alias("_f")).select(*rows.columns, F.lit("nlp_pii").alias("category"), "_f.*")


def suspicious_files(files: DataFrame, path: str = "path") -> DataFrame:
    return files.where(T.matches_glob(F.col(path), P.SUSPICIOUS_FILES))


def first_matches(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """Cross-check: the first match of four kinds in each text file."""
    kinds = {"SSN": r"\b\d{3}-\d{2}-\d{4}\b", "AWS Key": r"AKIA[0-9A-Z]{16}", "Google API Key": r"AIza[0-9A-Za-z\-_]{35}", "Email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"}
    rows = files.where(T.extension(F.col(path)).isin("txt", "csv", "md", "json", "yml", "yaml", "env", "py", "xml"))
    found = F.array(*[F.struct(F.lit(k).alias("type"), F.regexp_extract(F.col(text), "(?i)" + p, 0).alias("match")) for k, p in kinds.items()])
    return rows.select(path, F.explode(F.filter(found, lambda x: x.match != "")).alias("f")).select(F.col(path).alias("file"), "f.*")


def context(findings: DataFrame, all_lines: DataFrame, around: int = 2, key: str = "file") -> DataFrame:
    """findings(key, line) with `context`: the lines around, the hit marked. Joined by equality on key and line."""
    near = findings.select(key, "line").distinct().select(key, "line", F.explode(F.sequence(F.col("line") - around, F.col("line") + around)).alias("at"))
    text = near.join(all_lines.select(key, F.col("line").alias("at"), "content"), [key, "at"])
    shown = F.format_string("%s%d: %s", F.when(F.col("at") == F.col("line"), " > ").otherwise("   "), F.col("at"), F.col("content"))
    joined = text.groupBy(key, "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", shown.alias("s")))), lambda x: x.s), "\n").alias("context"))
    return findings.join(joined, [key, "line"], "left")
