"""Personal data by anchor expansion: one Aho-Corasick pass finds anchors, local parsers find and check the bounds."""

from __future__ import annotations

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIGITS = frozenset("0123456789")
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
LABEL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789-")
UPPER = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
DIALLED = frozenset(" ().0123456789-")
BASE = ("email", "ip", "card", "phone")
#: What the method adds, in the order of the result.
ADDED = ("iban", "ssn", "account", "address", "login")
KINDS = BASE + ADDED
# Cues before an account number, and the last words of street addresses, in lower case.
CUES = ("account", "acct", "konto", "kontonummer", "cuenta", "compte")
BETWEEN = frozenset("no nr num number numbers nummer numero número numéro id is of ist es est".split())
STREETS = frozenset("street st avenue ave road rd boulevard blvd lane ln drive dr court ct way place pl square sq".split())


def _automaton():
    a = ahocorasick.Automaton()
    a.add_word("@", ("@", 1))
    a.add_word("+", ("+", 1))
    a.add_word("://", (":", 3))
    for d in DIGITS:
        a.add_word(d, ("0", 1))
    for cue in CUES:
        a.add_word(cue, ("a", len(cue)))
    a.make_automaton()
    return a


def _run(text: str, at: int, of: frozenset) -> int:
    n = len(text)
    while at < n and text[at] in of:
        at += 1
    return at


def email_at(text: str, at: int, low: int):
    """The address around the at-sign at `at` that starts at `low` or later."""
    start = at
    while start > low and text[start - 1] in LOCAL:
        start -= 1
    end = _run(text, at + 1, LABEL)
    if start == at or end == at + 1:
        return None
    labels = 0
    while end + 1 < len(text) and text[end] == "." and text[end + 1] in LABEL:
        end, labels = _run(text, end + 1, LABEL), labels + 1
    return (start, end) if labels else None


def quad_from(text: str, at: int):
    """Four runs of digits with dots between, from the digit at `at`."""
    end = _run(text, at, DIGITS)
    for _ in range(3):
        if end + 1 >= len(text) or text[end] != "." or text[end + 1] not in DIGITS:
            return None
        end = _run(text, end + 1, DIGITS)
    return at, end


def chain_from(text: str, at: int) -> int:
    """The end of the digits from `at` with at most one space or hyphen between two of them."""
    n, end = len(text), at + 1
    while end < n:
        if text[end] in DIGITS:
            end += 1
        elif text[end] in " -" and end + 1 < n and text[end + 1] in DIGITS:
            end += 2
        else:
            break
    return end


def phone_from(text: str, at: int):
    """From the plus sign at `at`: a digit, at least one more dialled character, a digit."""
    if at + 1 >= len(text) or text[at + 1] not in DIGITS:
        return None
    end = _run(text, at + 2, DIALLED)
    while end > at + 3 and text[end - 1] not in DIGITS:
        end -= 1
    return (at, end) if end > at + 3 and text[end - 1] in DIGITS else None


def digits_of(text: str) -> str:
    return "".join(c for c in text if c in DIGITS)


def octet(digits: str) -> bool:
    """At most 255; the run may be longer than int() takes."""
    low = digits.lstrip("0")
    return len(low) < 4 and int(low or 0) <= 255


def luhn(digits: str) -> bool:
    double = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)
    return sum(double[int(c)] if k % 2 else int(c) for k, c in enumerate(reversed(digits))) % 10 == 0


def iban_at(text: str, at: int):
    """An account number whose two check digits start at `at`; spaces after each fourth character only."""
    if at < 2 or text[at - 1] not in UPPER or text[at - 2] not in UPPER or (at > 2 and text[at - 3].isalnum()) or not (at + 1 < len(text) and text[at + 1] in DIGITS):
        return None
    end, got = at - 2, ""
    while end < len(text) and len(got) < 35:
        c = text[end]
        if c in DIGITS or c in UPPER:
            got, end = got + c, end + 1
        elif c == " " and len(got) % 4 == 0 and end + 1 < len(text) and (text[end + 1] in DIGITS or text[end + 1] in UPPER):
            end += 1
        else:
            break
    whole = end >= len(text) or not text[end].isalnum()
    ok = 15 <= len(got) <= 34 and whole and int("".join(str(int(c, 36)) for c in got[4:] + got[:4])) % 97 == 1
    return (at - 2, end) if ok else None


def address_from(text: str, at: int):
    """A house number of one to five digits, one to four capitalised words, a word for a street."""
    end = _run(text, at, DIGITS)
    if end - at > 5 or (at and (text[at - 1].isalnum() or text[at - 1] in "-.,/")):
        return None
    words = 0
    while words < 5 and end + 1 < len(text) and text[end] == " " and text[end + 1].isupper():
        stop = end + 1
        while stop < len(text) and text[stop].isalpha() and stop - end < 30:
            stop += 1
        if words and text[end + 1 : stop].lower() in STREETS:
            return at, stop
        end, words = stop, words + 1
    return None


def account_after(text: str, at: int):
    """Eight to seventeen digits behind a cue that ends at `at`: a few signs and words for a number may stand between,
    and single spaces or hyphens group the digits."""
    start, n = at, len(text)
    while start < n and text[start] not in DIGITS:
        if text[start] in " \t:#.-=":
            start += 1
            continue
        stop = start
        while stop < n and stop - start < 8 and text[stop].isalpha():
            stop += 1
        if text[start:stop].lower() not in BETWEEN or stop - at > 32:
            return None
        start = stop
    if start >= n or start - at > 40:
        return None
    end = chain_from(text, start)
    return (start, end) if 8 <= len(digits_of(text[start:end])) <= 17 else None


def ssn_at(text: str, at: int):
    """Three, two and four digits with hyphens, from a digit that follows no other; another number may stand a space
    away, but not a hyphen or dot."""
    end = at + 11
    got = text[at:end]
    if len(got) < 11 or got[3] != "-" or got[6] != "-" or not all(c in DIGITS for c in got[:3] + got[4:6] + got[7:]):
        return None
    joined = (at and text[at - 1] in "-.") or (end < len(text) and (text[end] in DIGITS or (text[end] in "-." and end + 1 < len(text) and text[end + 1] in DIGITS)))
    ok = got[:3] not in ("000", "666") and got[0] != "9" and got[4:6] != "00" and got[7:] != "0000"
    return (at, end) if ok and not joined else None


def login_at(text: str, at: int, done: int):
    """scheme://user:secret@host around the scheme's signs that end at `at`, up to the first delimiter, and where the
    search ended. Nothing before `done` is read again: what it holds has no delimiter and belongs to the last login."""
    start = at - 3
    while start and text[start - 1].isascii() and text[start - 1].isalpha() and at - start < 16:
        start -= 1
    if at < done:
        return None, done
    end, sign = at, -1
    while end < len(text) and text[end] not in "/?#\"'<>" and not text[end].isspace():
        sign = end if text[end] == "@" else sign
        end += 1
    return ((start, end) if start < at - 3 and sign > at and sign + 1 < end and ":" in text[at:sign] else None), end


_AUTOMATON = None


def find(text) -> dict[str, list[tuple[int, int]]]:
    """Spans (start, end) in code points for each kind; those of one kind do not overlap."""
    global _AUTOMATON
    if _AUTOMATON is None:
        _AUTOMATON = _automaton()
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if not text:
        return out
    low = text.lower()
    if len(low) != len(text):
        low = "".join(x if len(x := c.lower()) == 1 else c for c in text)
    email = ip = card = run = login = 0
    for last, (sign, width) in _AUTOMATON.iter(low):
        if sign == "@":
            if x := email_at(text, last, email):
                out["email"].append(x)
                email = x[1]
        elif sign == "+":
            if x := phone_from(text, last):
                if 9 <= len(digits_of(text[x[0] : x[1]])) <= 15:
                    out["phone"].append(x)
        elif sign == "0":
            if last >= card:
                card = chain_from(text, last)
                got = digits_of(text[last:card])
                if 13 <= len(got) <= 19 and luhn(got):
                    out["card"].append((last, card))
            if last >= ip and last >= run:
                if x := quad_from(text, last):
                    ip = x[1]
                    if all(octet(p) for p in text[x[0] : x[1]].split(".")):
                        out["ip"].append(x)
            if last >= run:
                run = _run(text, last, DIGITS)
                if x := ssn_at(text, last):
                    out["ssn"].append(x)
                if x := iban_at(text, last):
                    out["iban"].append(x)
                if x := address_from(text, last):
                    out["address"].append(x)
        elif sign == "a":
            x = account_after(text, last + 1)
            if x and x not in out["account"][-1:]:
                out["account"].append(x)
        else:
            x, login = login_at(text, last + 1, login)
            if x:
                out["login"].append(x)
    return out


def joined(spans: dict[str, list[tuple[int, int]]], kinds=KINDS) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in spans[k])


def masked(text: str, spans: dict[str, list[tuple[int, int]]]) -> str:
    """The text with each found stretch replaced by its kind in brackets; overlapping ones become the first's."""
    out, done = [], 0
    for a, b, kind in sorted(((a, b, k) for k in KINDS for a, b in spans[k]), key=lambda x: (x[0], -x[1], KINDS.index(x[2]))):
        if a >= done:
            out += [text[done:a], f"[{kind.upper()}]"]
        done = max(done, b)
    return "".join([*out, text[done:]])


def _found(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for text in texts:
        x = find(text)
        rows.append((*(len(x[k]) for k in BASE), joined(x, BASE), joined(x)))
    return pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base", "spans"])


def _masked(texts: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else masked(t, x) if any((x := find(t)).values()) else t for t in texts], dtype=object)


def personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Returns (doc_id, n_email, n_ip, n_card, n_phone, base, spans) for every row.

    Null and empty texts have no spans; repeated rows and null ids are kept as they are; other columns are not read.
    """
    return docs.select(F.col(doc_id).alias("doc_id"), F.pandas_udf(_found, "n_email long, n_ip long, n_card long, n_phone long, base string, spans string")(text).alias("x")).select("doc_id", "x.*")


def mask(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with personal data in `text` replaced by its kind in brackets; a null text stays null, an empty one empty;
    texts are read whole; repeated rows, null ids and all other columns stay as they are."""
    return docs.withColumn(text, F.pandas_udf(_masked, "string")(text))
