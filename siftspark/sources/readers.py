"""Sources: each gives rows (source_id, label, ext, origin, size_bytes, content) or texts."""

from __future__ import annotations

import json
import os
import re
import subprocess
import tomllib
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftspark.functions import patterns as P
from siftspark.functions import text as T
from siftspark.operators import code

KINDS = ("path", "text", "env", "url", "docker", "clipboard", "repo")


def read(spark: SparkSession, kind: str, target: str = "", exclude: list[str] | None = None) -> DataFrame:
    """Any source by its kind. `clipboard` takes its text as target; `repo` is the working tree of a repository."""
    if kind in ("path", "repo"):
        return path(spark, target, exclude)
    if kind in ("text", "clipboard"):
        return text(spark, target)
    if kind == "env":
        return env(spark)
    if kind == "url":
        return urls(spark.createDataFrame([(target,)], "label string"))
    if kind == "docker":
        return as_sources(code.unpack(spark.read.format("binaryFile").load(target).select(F.col("path").alias("label"), "content"), "tar"), "docker")
    raise ValueError(f"unknown source {kind}: one of {', '.join(KINDS)}")


def as_sources(rows: DataFrame, origin: str) -> DataFrame:
    """rows(label, content)."""
    return rows.select(F.sha2(F.concat(F.lit(origin + ":"), "label"), 256).alias("source_id"), "label", T.extension(F.col("label")).alias("ext"), F.lit(origin).alias("origin"), F.octet_length("content").cast("long").alias("size_bytes"), "content")


def path(spark: SparkSession, root: str, exclude: list[str] | None = None, max_kb: int = 1024) -> DataFrame:
    """Files under root without excluded ones; the size gate is pushed to the scan, so larger files are not read. Spark
    passes over names that start with a dot or an underscore, `.env` for one: in a folder of the file system, which all
    machines see, these are listed and read by themselves; of other stores they are not read."""
    base = os.path.abspath(root) if "://" not in root else root
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base).where(F.col("length") <= max_kb * 1024)
    files = files.select(F.regexp_replace("path", "^file:", "").alias("label"), "content")
    if "://" not in base:
        files = files.unionByName(_hidden_files(spark, base, max_kb * 1024))
    return as_sources(excluded(files, base, exclude).select("label", "content"), "path")


def _hidden_files(spark: SparkSession, base: str, most: int) -> DataFrame:
    """(label, content) of the files that Spark's listing passes over, few as a rule."""
    found = []
    for top, folders, names in os.walk(base):
        folders[:] = [d for d in folders if d != ".git"]
        inside = any(x.startswith((".", "_")) for x in Path(os.path.relpath(top, base)).parts if x != ".")
        found += [(f"{top}/{n}",) for n in names if inside or n.startswith((".", "_"))]

    def read_(labels: pd.Series) -> pd.Series:
        return labels.map(lambda p: Path(p).read_bytes() if Path(p).is_file() and Path(p).stat().st_size <= most else None)

    rows = spark.createDataFrame(found, "label string")
    return rows.withColumn("content", F.pandas_udf(read_, "binary")("label")).where("content is not null")


def excluded(files: DataFrame, base: str, globs: list[str] | None = None) -> DataFrame:
    """files(label) without those that a glob fits, or in a folder that one fits: by its path or its name, with or
    without a slash behind; so `name/` prunes a top folder, and `name` a folder at any depth."""
    globs = P.EXCLUDES if globs is None else globs
    rel = F.regexp_replace("label", "^" + re.escape(base.rstrip("/")) + "/?", "") if base else F.col("label")
    out = files.where(~rel.rlike(r"(^|/)\.git/"))
    if not globs:
        return out
    parts = F.split(rel, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    inside = F.when(F.size(parts) > 1, F.exists(above, lambda d: T.matches_glob(d, globs) | T.matches_glob(F.concat(d, F.lit("/")), globs))).otherwise(False)
    return out.where(~T.matches_glob(rel, [g for g in globs if not g.endswith("/")]) & ~inside)


def submodules(root: str) -> list[str]:
    """Paths of a repository's submodules, from its .gitmodules."""
    if not Path(root, ".gitmodules").exists():
        return []
    done = subprocess.run(["git", "config", "--file", str(Path(root, ".gitmodules")), "--get-regexp", r"\.path$"], capture_output=True, text=True, errors="replace")
    return [line.split(" ", 1)[1] for line in done.stdout.splitlines() if " " in line]


def with_submodules(sources: DataFrame, root: str) -> DataFrame:
    """sources(label) of a repository with `submodule`: the path of the one that a file belongs to, null for the rest."""
    base, of = os.path.abspath(root), F.lit(None).cast("string")
    for path_ in sorted(submodules(root), key=len):  # an inner one wins
        of = F.when(F.startswith("label", F.lit(f"{base}/{path_}/")), path_).otherwise(of)
    return sources.withColumn("submodule", of)


def is_binary(content) -> object:
    return F.contains(F.substring(content, 1, 8192), F.unhex(F.lit("00")))


def as_text(sources: DataFrame) -> DataFrame:
    """Sources without binary ones, with text: bytes that are no UTF-8 are left out."""
    return sources.where(~is_binary(F.col("content"))).withColumn("text", F.replace(F.make_valid_utf8(F.col("content").cast("string")), F.lit("�"), F.lit(""))).drop("content")


def text(spark: SparkSession, value: str, name: str = "text_snippet") -> DataFrame:
    return as_sources(spark.createDataFrame([(name, value.encode())], "label string, content binary"), "text")


def env(spark: SparkSession) -> DataFrame:
    return as_sources(spark.createDataFrame([(f"env:{k}", v.encode()) for k, v in os.environ.items()], "label string, content binary"), "env")


def urls(rows: DataFrame, timeout: int = 15) -> DataFrame:
    """rows(label): pages fetched by the executors; one that fails has null content."""
    def fetch(frames):
        from urllib.request import urlopen

        for f in frames:
            out = []
            for url in f["label"]:
                try:
                    with urlopen(url, timeout=timeout) as r:
                        out.append((url, r.read()))
                except OSError:
                    out.append((url, None))
            yield pd.DataFrame(out, columns=["label", "content"])

    return as_sources(rows.select("label").mapInPandas(fetch, "label string, content binary"), "url")


def git_patches(spark: SparkSession, repo: str, kind: str = "history", since: str | None = None, base: str = "main") -> DataFrame:
    """(commit, n, text, origin) of a repository's history, reflog, diff to a base or stash; n counts the lines of a
    commit. A history's commits are listed here and read by the executors, which share the folder of the repository."""
    if kind == "history":
        dated = since and any(w in since for w in ("-", "/", ":", "ago", "week", "day", "month", "year"))
        range_ = [f"--since={since}", "--all"] if dated else [f"{since}..HEAD"] if since else ["--all"]
        listed = subprocess.run(["git", "-C", repo, "rev-list", *range_], capture_output=True, text=True, errors="replace").stdout.split()

        def show(frames):
            for f in frames:
                for commit in f["commit"]:
                    done = subprocess.run(["git", "-C", repo, "log", "-p", "-1", "--no-color", commit], capture_output=True, text=True, errors="replace")
                    lines = done.stdout.split("\n")
                    yield pd.DataFrame({"commit": commit, "n": range(len(lines)), "text": lines, "origin": kind})

        commits = spark.createDataFrame([(c,) for c in listed], "commit string")
        return commits.mapInPandas(show, "commit string, n long, text string, origin string")
    calls = {"reflog": [["reflog", "show", "--all", "-p"]], "diff": [["diff", f"{base}...HEAD", "--unified=0"], ["diff", base, "HEAD", "--unified=0"]], "stash": [["stash", "list", "-p"]]}[kind]
    out = ""
    for call in calls:
        done = subprocess.run(["git", "-C", repo, *call], capture_output=True, text=True, errors="replace")
        if done.returncode == 0:
            out = done.stdout
            break
    commit, rows = "", []
    for n, line in enumerate(out.split("\n")):
        commit = line.split()[1] if line.startswith("commit ") else commit
        rows.append((commit, n, line, kind))
    return spark.createDataFrame(rows, "commit string, n long, text string, origin string")


def ignore_file(content: str) -> tuple[list[str], list[str]]:
    """(globs, tokens) of an ignore file."""
    rows = [x.strip() for x in content.splitlines() if x.strip() and not x.strip().startswith("#")]
    return [x for x in rows if not x.startswith("token:")], [x[6:].strip() for x in rows if x.startswith("token:")]


def settings(root: str, given: dict | None = None, names: tuple[str, ...] = (".sift.toml",)) -> dict:
    """Options of the first TOML file that is there, overridden by given ones."""
    found = next((tomllib.loads(p.read_text()) for n in names if (p := Path(root, n)).exists()), {})
    return found | {k: v for k, v in (given or {}).items() if v is not None}


def pattern_pack(content: str) -> dict[str, str]:
    """Name -> regex of a JSON pack: an object, or a list of objects with name and regex; invalid ones are left out."""
    data = json.loads(content)
    pairs = data.items() if isinstance(data, dict) else [(x.get("name"), x.get("regex") or x.get("pattern")) for x in data]
    out = {}
    for name, regex in pairs:
        try:
            re.compile(regex)
            out[name] = regex
        except (re.error, TypeError):
            continue
    return out


def external(reports: DataFrame, tool: str) -> DataFrame:
    """reports(content: JSON) of gitleaks, trivy or semgrep -> findings."""
    first = lambda *names: F.coalesce(*[F.try_element_at("r", F.lit(n)) for n in names])
    if tool == "gitleaks":
        rows = reports.select(F.explode(F.from_json("content", "array<map<string,string>>")).alias("r"))
        return rows.select(F.concat(F.lit("Gitleaks:"), first("RuleID", "ruleId")).alias("type"), first("File", "file").alias("file"), first("StartLine", "line").cast("int").alias("line"), first("Secret", "Match", "match").alias("match"), F.lit("secret").alias("category"))
    if tool == "trivy":
        rows = reports.select(F.explode(F.from_json("content", "struct<Results:array<struct<Target:string,Secrets:array<struct<RuleID:string,StartLine:int,Match:string>>>>>")["Results"]).alias("t")).select("t.Target", F.explode("t.Secrets").alias("r"))
        return rows.select(F.concat(F.lit("Trivy:"), "r.RuleID").alias("type"), F.col("Target").alias("file"), F.col("r.StartLine").alias("line"), F.col("r.Match").alias("match"), F.lit("secret").alias("category"))
    rows = reports.select(F.explode(F.from_json("content", "struct<results:array<struct<path:string,start:struct<line:int>,check_id:string,extra:struct<message:string,lines:string,severity:string>>>>")["results"]).alias("r"))
    return rows.select(F.col("r.check_id").alias("type"), F.col("r.path").alias("file"), F.col("r.start.line").alias("line"), F.col("r.extra.lines").alias("match"), F.lit("sast").alias("category"))


def _tagged(source: str):
    return lambda x: F.struct(F.lit(source).alias("source"), x.alias("x"))


def report(reports: DataFrame) -> DataFrame:
    """Findings of saved JSON reports (content), tagged with their source."""
    item = "array<struct<type:string,file:string,line:int,match:string,token:string,entropy:double>>"
    shape = f"struct<findings:struct<history:struct<secrets:{item},pii:{item},entropy:{item}>,current_tree:struct<current_secrets:{item},nlp_pii:{item}>,injection_attacks:{item}>>"
    f = reports.select(F.from_json("content", shape)["findings"].alias("f"))
    groups = {"history/secrets": "f.history.secrets", "history/pii": "f.history.pii", "history/entropy": "f.history.entropy", "tree/current_secrets": "f.current_tree.current_secrets", "tree/nlp_pii": "f.current_tree.nlp_pii", "injection": "f.injection_attacks"}
    tagged = F.concat(*[F.coalesce(F.transform(F.col(c), _tagged(n)), F.array().cast(f"array<struct<source:string,x:{item[6:-1]}>>")) for n, c in groups.items()])
    return f.select(F.explode(tagged).alias("g")).select("g.source", "g.x.type", "g.x.file", "g.x.line", F.coalesce("g.x.match", "g.x.token").alias("match"), "g.x.entropy")
