"""Look-alike characters: removal of invisible ones, compatibility forms, letters of other scripts."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Invisible characters; look-alikes and the ASCII letters they stand for.
INVISIBLE = "[\u200b-\u200f\u202a-\u202e\u2060-\u206f\u00ad\ufeff]"
CYRILLIC = ("АВЕКМНОРСТУХаеорсухѕіһӕ", "ABEKMHOPCTYXaeopcyxsiha")
GREEK = ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαβεηικνορτυχ", "ABEZHIKMNOPTYXabenikvoptux")
PHONETIC = ("ɡɪɾʃʒᴀᴃᴄᴅᴇᴊᴋᴌᴍᴏᴘᴠᴡᴢ", "girszabcdejklmopvwz")
_FROM, _TO = (a + b + c for a, b, c in zip(CYRILLIC, GREEK, PHONETIC, strict=True))


def visible(c: Column) -> Column:
    return F.regexp_replace(c, INVISIBLE, "")


def _compatible(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def deconfuse(c: Column) -> Column:
    """ASCII where look-alikes stand for it. Only texts with other than ASCII characters meet Python."""
    clean = visible(c)
    plain = F.when(clean.rlike(r"[^\x00-\x7F]"), F.pandas_udf(_compatible, "string")(clean)).otherwise(clean)
    return F.translate(plain, _FROM, _TO)


def _single() -> dict[str, str]:
    """Characters whose compatibility form is one ASCII character, by Unicode's own rule, and look-alikes."""
    table = {c: x for c in map(chr, (*range(0x80, 0xD800), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800))) if len(x := unicodedata.normalize("NFKC", c)) == 1 and x < "\x7f"}
    return table | dict(zip(_FROM, _TO, strict=True))


_SINGLE = _single()


def deconfuse_single(c: Column) -> Column:
    """Like deconfuse() for every character that stands for one ASCII character, without Python: for scans."""
    return F.translate(visible(c), "".join(_SINGLE), "".join(_SINGLE.values()))


def suspicious(c: Column) -> Column:
    """Text that deconfuse() changes, or with letters of more than one of Latin, Cyrillic and Greek."""
    scripts = sum(c.rlike(rf"\p{{Is{s}}}").cast("int") for s in ("Latin", "Cyrillic", "Greek"))
    return (deconfuse(c) != c) | (scripts > 1)


def has_lookalike(c: Column) -> Column:
    wide = r"[\uff10-\uff19\uff21-\uff3a\uff41-\uff5a\u2460-\u2468\x{1d7e2}-\x{1d7eb}]"
    return c.rlike(INVISIBLE) | c.rlike(wide) | c.rlike(f"[{_FROM}]")
