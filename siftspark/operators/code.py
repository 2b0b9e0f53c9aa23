"""Operators that need a text's structure: taint, syntax context, offsets, archives, images."""

from __future__ import annotations

import ast
import base64
import io
import re
import tarfile
import tokenize
import zipfile
from functools import cache
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftspark.functions import patterns as P
from siftspark.functions import text as T

# Parts of names of functions and classes that hold test code.
TEST_NAMES = ("test_", "mock_", "fake_", "stub_", "dummy_", "setup", "teardown", "setUp", "tearDown", "beforeEach", "afterEach", "beforeAll", "afterAll", "describe", "it(", "spec_", "example_")


def taint(findings: DataFrame, files: DataFrame, before: int = 5, after: int = 20) -> DataFrame:
    """findings(file, line, match) joined to files(file, text): sinks holds the
    first five sinks that precede the token in the window line-5 .. line+20 and make it high; a token that is only
    elsewhere in the text is low."""
    rows = findings.join(files.select("file", F.col("text").alias("_t")), "file").withColumn("_l", T.split_lines(F.col("_t")))
    start = F.greatest(F.lit(1), F.col("line") - before)
    rows = rows.withColumn("_w", F.array_join(F.slice("_l", start, F.col("line") + after - start), "\n"))
    token = F.concat(F.lit(r"\Q"), F.replace(F.col("match"), F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    found = F.array_compact(F.array(*[F.when(F.expr("_w").rlike("(?i)" + s) & F.regexp_like(F.col("_w"), F.concat(F.lit(f"(?is){s}.*?"), token)), F.lit(s)) for s in P.SINKS]))
    rows = rows.withColumn("sinks", F.slice(found, 1, 5))
    level = F.when(F.size("sinks") > 0, "high").when(F.contains(F.col("_t"), F.col("match")), "low").otherwise("none")
    return rows.withColumn("exploitability", level).withColumn("method", F.lit("regex")).drop("_t", "_l", "_w")


def taint_rows(tainted: DataFrame) -> DataFrame:
    return tainted.where(T.extension(F.col("file")).isin("py", "js", "mjs", "ts", "tsx") & F.col("exploitability").isin("high", "medium"))


def tainted_names(source: str, token: str) -> tuple[list[str], list[str]]:
    """Names that a Python text assigns the token to, and the calls that use them."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return [], []
    names = {t.id for n in ast.walk(tree) if isinstance(n, ast.Assign) and any(isinstance(x, ast.Constant) and isinstance(x.value, str) and token in x.value for x in ast.walk(n.value)) for t in n.targets if isinstance(t, ast.Name)}
    calls = {ast.unparse(n.func) for n in ast.walk(tree) if isinstance(n, ast.Call) and any(isinstance(x, ast.Name) and x.id in names for a in [*n.args, *(k.value for k in n.keywords)] for x in ast.walk(a))}
    return sorted(names), sorted(calls)


SCRIPTS = ("js", "mjs", "cjs", "ts", "tsx", "jsx")


def script_names(source: str, token: str) -> tuple[list[str], list[str]]:
    """The same for JavaScript and TypeScript, by assignments and calls of a line."""
    names = {m[1] for line in source.splitlines() if token in line for m in [re.match(r"\s*(?:(?:export\s+)?(?:const|let|var)\s+)?([A-Za-z_$][\w$]*)\s*(?::[^=]+)?=(?!=)", line)] if m}
    calls = {m[1] for m in re.finditer(r"([A-Za-z_$][\w$.]*)\s*\(([^()]*)\)", source) if names & set(re.findall(r"[A-Za-z_$][\w$]*", m[2]))}
    return sorted(names), sorted(calls)


def _extension(file) -> str:
    return (file or "").rsplit(".", 1)[-1].lower()


def syntax_taint(rows: DataFrame, file: str | None = None) -> DataFrame:
    """rows(text, match, ...) with tainted_vars and calls; `file` tells scripts from Python, which is the default."""
    def find(texts: pd.Series, tokens: pd.Series, files: pd.Series) -> pd.DataFrame:
        of = lambda f: script_names if _extension(f) in SCRIPTS else tainted_names
        return pd.DataFrame([of(f)(t or "", m or "") if m else ([], []) for t, m, f in zip(texts, tokens, files, strict=True)], columns=["tainted_vars", "calls"])

    at = F.col(file) if file else F.lit("x.py")
    return rows.withColumn("_x", F.pandas_udf(find, "tainted_vars array<string>, calls array<string>")("text", "match", at)).select(*rows.columns, "_x.*")


def in_noise(source: str, line: int) -> bool:
    """Whether a Python line starts in a comment or in a function or class named as test code."""
    try:
        for t in tokenize.generate_tokens(io.StringIO(source).readline):
            if t.type == tokenize.COMMENT and t.start[0] == line and not t.line[: t.start[1]].strip():
                return True
        return any(isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)) and n.lineno <= line <= n.end_lineno and any(m in n.name for m in TEST_NAMES) for n in ast.walk(ast.parse(source)))
    except (SyntaxError, ValueError, tokenize.TokenError):
        lines = source.splitlines()
        return 0 < line <= len(lines) and bool(re.match(r"\s*(#|//|/\*|\*|--)", lines[line - 1]))


_SCRIPT = re.compile(r"""(?P<block>/\*.*?(?:\*/|\Z))|(?P<line>//[^\n]*)|(?P<text>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`)|(?P<open>\{)|(?P<close>\})""", re.S)


def script_noise(source: str, line: int) -> bool:
    """Whether a line of a script starts in a comment or in a block headed by a name of test code."""
    lines = source.split("\n")
    if not 0 < line <= len(lines):
        return False
    begin = sum(len(x) + 1 for x in lines[: line - 1])
    begin += len(lines[line - 1]) - len(lines[line - 1].lstrip())
    heads, last = [], 0
    for m in _SCRIPT.finditer(source):
        if m.start() > begin:
            break
        if m["block"] or m["line"]:
            if m.start() <= begin < m.end():
                return True
        elif m["open"]:
            head = source[last : m.start()].rsplit(";", 1)[-1]
            heads.append(any(n in head for n in TEST_NAMES))
        elif m["close"] and heads:
            heads.pop()
        if not m["text"]:
            last = m.end()
    return any(heads)


def context_filter(rows: DataFrame, file: str | None = None) -> DataFrame:
    """rows(text, line, ...) without those in comments and test code; `file` tells scripts from Python, the default."""
    def noisy(texts: pd.Series, at: pd.Series, files: pd.Series) -> pd.Series:
        of = lambda f: script_noise if _extension(f) in SCRIPTS else in_noise
        return pd.Series([of(f)(a or "", int(b)) for a, b, f in zip(texts, at, files, strict=True)])

    return rows.where(~F.pandas_udf(noisy, "boolean")("text", "line", F.col(file) if file else F.lit("x.py")))


@cache
def _patterns(family: str) -> list[tuple[re.Pattern, tuple[str, ...], bool]]:
    """(regex, literals of which a match holds one, whether it holds a digit) of each rule."""
    table = P.SECRETS if family == "secret" else P.PII
    return [(re.compile(p), P.GATES.get(n, ()), family == "pii" and n != "Email Address") for n, p in table.items()]


def _spans(text: str, family: str) -> list[tuple[int, int]]:
    low, digit = text.lower().replace("\u017f", "s"), re.search(r"\d", text)
    live = (p for p, gates, counted in _patterns(family) if (not gates or any(g in low for g in gates)) and (digit or not counted))
    return [m.span() for p in live for m in p.finditer(text)]


def _hidden(text: str) -> list[tuple[int, int]]:
    """Base64 words with a secret inside."""
    out = []
    for m in re.finditer(r"\b[A-Za-z0-9+/]{24,}={0,2}\b", text):
        try:
            word = m[0].rstrip("=")
            plain = base64.b64decode(word + "=" * (-len(word) % 4)).decode()
        except ValueError:
            continue
        if len(plain) > 10 and all(" " <= c <= "~" or c in "\r\n\t" for c in plain) and _spans(plain, "secret"):
            out.append(m.span())
    return out


def redact_text(text: str, words: tuple[str, ...] = ()) -> str:
    """The text with all secrets, also those in Base64 words, personal data and words redacted; overlaps go to the first
    and longest."""
    spans = _spans(text, "secret") + _hidden(text) + _spans(text, "pii")
    spans += [m.span() for w in words for m in re.finditer(re.escape(w), text, re.IGNORECASE)]
    out, last = [], 0
    for a, b in sorted(spans, key=lambda s: (s[0], -s[1])):
        if a >= last and b > a:
            hit = text[a:b]
            prefix = next((p for p in P.REDACT_PREFIXES if hit.startswith(p)), hit[:4])
            out += [text[last:a], "[REDACTED]" if len(hit) <= 4 else prefix + "[REDACTED]"]
            last = b
    return "".join([*out, text[last:]])


def redact_documents(docs: DataFrame, text: str = "text", words: tuple[str, ...] = ()) -> DataFrame:
    def each(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else redact_text(t, words))

    return docs.withColumn(text, F.pandas_udf(each, "string")(text))


def redact_file(path: str, words: tuple[str, ...] = (), dry_run: bool = False, most: int | None = 1_000_000) -> str:
    """Redacts a file in place behind a backup `.bak`; nothing is written for `missing`, `too large`, `clean` and, on a
    dry run, `would change` files. The backup is complete before the file changes, and an old one is kept, so a task
    that runs again changes nothing more. most: bytes of a file at most, None for any."""
    at = Path(path)
    if not at.is_file():
        return "missing"
    if most is not None and at.stat().st_size > most:
        return "too large"
    text = at.read_text(encoding="utf-8", errors="ignore")
    clean = redact_text(text, words)
    if clean == text:
        return "clean"
    if dry_run:
        return "would change"
    backup, new = at.with_name(at.name + ".bak"), at.with_name(at.name + ".new")
    if not backup.exists():
        new.write_text(text, encoding="utf-8")
        new.replace(backup)
    new.write_text(clean, encoding="utf-8")
    new.replace(at)
    return "redacted"


def redact_files(files: DataFrame, path: str = "path", words: tuple[str, ...] = (), dry_run: bool = False, most: int | None = 1_000_000) -> DataFrame:
    """(path, status) of each distinct path of files on a folder that the executors share; findings do as files."""
    def each(paths: pd.Series) -> pd.Series:
        return paths.map(lambda p: redact_file(p.removeprefix("file:"), words, dry_run, most))

    names = files.select(F.col(path).alias("path")).where("path is not null").distinct()
    return names.withColumn("status", F.pandas_udf(each, "string")("path"))


def unpack(files: DataFrame, kind: str) -> DataFrame:
    """files(label, content) -> (label, content): members of tar archives (layers of images too) or of zip archives;
    a broken archive stays as it is."""
    def members(label, data):
        if kind == "zip":
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                return [(f"{label}/{n}", z.read(n)) for n in z.namelist() if not n.endswith("/")]
        with tarfile.open(fileobj=io.BytesIO(data)) as t:
            found = [(f"{label}::{m.name}", t.extractfile(m).read()) for m in t.getmembers() if m.isfile()]
        return [x for n, d in found for x in (members(label, d) if n.endswith(".tar") else [(n, d)])]

    def each(frames):
        for f in frames:
            out = []
            for label, data in zip(f["label"], f["content"], strict=True):
                try:
                    out += members(label, bytes(data))
                except (tarfile.TarError, zipfile.BadZipFile, OSError, EOFError):
                    out.append((label, data))
            yield pd.DataFrame(out, columns=["label", "content"])

    return files.select("label", "content").mapInPandas(each, "label string, content binary")


def stego(images: DataFrame, blocks: int = 1000, risk: float = 0.10) -> DataFrame:
    """images(label, height, width, pixels array<int>): |R - S| / N over seeded 2 x 2 blocks with flipped low bits."""
    def ratio(pixels, height, width):
        if height < 2 or width < 2 or len(pixels) < 4:
            return 0.0
        img, rng = np.asarray(pixels, np.int16).reshape(height, width), np.random.RandomState(42)
        y, x = rng.randint(0, height - 1, blocks), rng.randint(0, width - 1, blocks)
        b = np.stack([img[y, x], img[y, x + 1], img[y + 1, x], img[y + 1, x + 1]], 1)
        rough = lambda v: np.abs(np.diff(v, axis=1)).sum(1)
        a, c = rough(b), rough(b ^ np.array([0, 1, 1, 0], np.int16))
        return abs(int((c > a).sum()) - int((c < a).sum())) / blocks

    def each(p: pd.Series, h: pd.Series, w: pd.Series) -> pd.Series:
        return pd.Series([ratio(a, int(b), int(c)) for a, b, c in zip(p, h, w, strict=True)])

    out = images.withColumn("rs_ratio", F.round(F.pandas_udf(each, "double")("pixels", "height", "width"), 4))
    return out.withColumn("risk", F.col("rs_ratio") > risk).withColumn("confidence", F.round(F.least(F.lit(1.0), 6 * F.col("rs_ratio")), 3)).drop("pixels")


def notebook_cells(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(label, text) of each cell's source and outputs of notebooks in JSON."""
    shape = "struct<cells:array<struct<source:string,outputs:array<struct<text:string,data:map<string,string>>>>>>"
    whole = lambda c: F.coalesce(F.array_join(F.from_json(c, "array<string>"), ""), c)
    cells = files.select(path, F.posexplode(F.from_json(text, shape)["cells"]).alias("i", "cell"))
    source = cells.select(F.format_string("%s:cell%d", path, "i").alias("label"), whole(F.col("cell.source")).alias("text"))
    outs = cells.select(path, "i", F.explode("cell.outputs").alias("o")).select(F.format_string("%s:cell%d:output", path, "i").alias("label"), whole(F.coalesce(F.col("o.data")["text/plain"], F.col("o.text"))).alias("text"))
    return source.unionByName(outs).where("text is not null and text != ''")
