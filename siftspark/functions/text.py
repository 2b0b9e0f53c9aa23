"""Scalar functions as Column expressions."""

from __future__ import annotations

import fnmatch

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftspark.functions import patterns as P

# What ends a line, and the form of a UUID.
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"


def java(pattern: str) -> str:
    return "(?U)" + pattern


def let(value: Column, body) -> Column:
    """body(value) with `value` evaluated once, also where body uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def split_lines(text: Column) -> Column:
    """Lines without their ends; a last empty piece is no line."""
    cut = lambda parts: F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    return let(F.split(text, LINE_BREAK, -1), cut)


def find_all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(java(pattern)), F.lit(group))


def entropy(c: Column) -> Column:
    """Shannon entropy over characters in bits; 0 for an empty string."""
    n = F.length(c)
    share = F.transform(F.array_distinct(F.split(c, "")), lambda x: (n - F.length(F.replace(c, x, F.lit("")))) / n)
    return F.when(n == 0, 0.0).otherwise(F.abs(F.aggregate(share, F.lit(0.0), lambda a, p: F.when(p > 0, a - p * F.log2(p)).otherwise(a))))


def ignored_token(c: Column) -> Column:
    """UUIDs and long Base64-like words are no entropy findings."""
    return c.rlike(UUID) | c.rlike(r"^[A-Za-z0-9+/]{24,}={0,2}$")


def hex_hash(c: Column) -> Column:
    return c.rlike("^[a-fA-F0-9]+$") & F.length(c).isin(32, 40, 64)


def redact(match: Column) -> Column:
    """Known prefix or the first four characters, then [REDACTED]; a decoded part is treated the same way."""
    def one(c):
        prefix = F.regexp_extract(c, "^(" + "|".join(P.REDACT_PREFIXES) + ")", 1)
        return F.when(F.length(c) <= 4, F.lit("[REDACTED]")).otherwise(F.concat(F.when(prefix != "", prefix).otherwise(F.substring(c, 1, 4)), F.lit("[REDACTED]")))

    sign = " (Decoded: "
    at = F.instr(match, sign)
    head = F.substr(match, F.lit(1), at - 1)
    tail = F.regexp_replace(F.substr(match, at + len(sign)), r"\)$", "")
    return F.when(at > 0, F.concat(one(head), F.lit(sign), one(tail), F.lit(")"))).otherwise(one(F.coalesce(match, F.lit(""))))


def escape_html(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def sanitize(c: Column) -> Column:
    """Live injections are replaced by signs that they were there; the rest is escaped for HTML."""
    # Patterns and their signs.
    for pattern, sign in (
        (r"(?i)ignore\s+(all\s+)?previous\s+instructions", "[INJECTION_BLOCKED]"), (r"<\|im_start\|>|<\|im_end\|>", "[DELIM_BLOCKED]"),
        (r"(?i)(you\s+are\s+now\s+)", "[OVERRIDE_BLOCKED] "), (r"(?i)(act\s+as\s+)", "[ROLE_BLOCKED] "), (P.INJECTIONS["PROMPT_LEAK_REQUEST"], "[LEAK_BLOCKED]"),
    ):
        c = F.regexp_replace(c, pattern, sign)
    return escape_html(c)


def glob_regex(glob: str) -> str:
    return "^" + fnmatch.translate(glob).removeprefix("(?s:").removesuffix(r")\Z").removesuffix(r")\z") + "$"


def matches_glob(path: Column, globs: list[str]) -> Column:
    """A glob fits the path or its last part; `*` crosses slashes."""
    name = F.substring_index(path, "/", -1)
    out = F.lit(False)
    for g in globs:
        out = out | path.rlike(glob_regex(g)) | name.rlike(glob_regex(g))
    return out


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))


def decay(when: Column, now: Column, half_life: float = 180.0, least: float = 0.05) -> Column:
    """0.5 ^ (age in days / half life), at least `least`; 1 for no or a future date. Rounded to four places."""
    age = (F.unix_timestamp(now) - F.unix_timestamp(when)) / 86400.0
    return F.round(F.when(when.isNull() | (age < 0), 1.0).otherwise(F.greatest(F.lit(least), F.pow(F.lit(0.5), age / half_life))), 4)


def parse_date(c: Column) -> Column:
    formats = ("yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss Z", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in formats])


def lookup(key: Column, table: dict, default) -> Column:
    out = F.lit(default)
    for k, v in reversed(table.items()):
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def any_contains(c: Column, parts) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(c, F.lit(p))
    return out


def offset_line(text: Column, offset: Column) -> Column:
    """1-based line of a 0-based offset in code points."""
    before = F.substr(text, F.lit(1), offset)
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1


def fenced(text: Column) -> Column:
    """The code of Markdown fences, joined by line feeds; the whole text where there is none."""
    blocks = F.regexp_extract_all(text, F.lit(r"(?s)```(?:[a-zA-Z0-9+#-]+)?\n(.*?)\n```"), F.lit(1))
    return F.when(F.size(blocks) > 0, F.array_join(blocks, "\n")).otherwise(text)


# Language names and their codes.
LANGUAGE_CODES = {"english": "en", "german": "de", "french": "fr", "spanish": "es", "italian": "it", "portuguese": "pt", "dutch": "nl", "swedish": "sv", "norwegian": "no", "danish": "da", "finnish": "fi", "polish": "pl"}


def language_code(c: Column) -> Column:
    low = F.lower(F.trim(c))
    return F.when(low.rlike("^[a-z]{2}$"), low).otherwise(lookup(low, LANGUAGE_CODES, "en"))
