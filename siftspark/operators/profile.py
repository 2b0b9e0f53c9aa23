"""Profile of a collection of files: languages, frameworks, type, engines worth running."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftspark.functions import text as T

# Fixed values.
LANGUAGES = {"py": "python", "pyi": "python", "pyx": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "tsx": "typescript", "jsx": "javascript", "java": "java", "kt": "kotlin", "scala": "scala", "go": "go", "rs": "rust", "cpp": "cpp", "c": "c", "h": "c", "hpp": "cpp", "cc": "cpp", "rb": "ruby", "php": "php", "cs": "csharp", "swift": "swift", "tf": "terraform", "tfvars": "terraform", "yml": "yaml", "yaml": "yaml", "json": "json", "toml": "toml", "sh": "shell", "bash": "shell", "zsh": "shell", "ps1": "powershell", "psm1": "powershell", "sql": "sql", "md": "markdown", "rst": "restructuredtext", "html": "html", "css": "css", "scss": "scss", "dockerfile": "docker", "ipynb": "jupyter", "pbix": "powerbi"}
FRAMEWORKS = {"fastapi": "from fastapi import|import fastapi", "flask": "from flask import|import flask", "django": r"from django\.|import django|DJANGO_SETTINGS_MODULE", "langchain": "from langchain|import langchain", "llamaindex": "from llama_index|import llama_index", "terraform": r'provider\s+"aws"|resource\s+"aws_', "kubernetes": "apiVersion:|kind:|kubectl", "docker": r"^FROM\s+|^docker build", "pytorch": "import torch|from torch import", "tensorflow": "import tensorflow|from tensorflow import", "express": r"require\(['\"]express['\"]|from ['\"]express['\"]", "nextjs": "next/config|getStaticProps|getServerSideProps", "react": r"from ['\"]react['\"]|import React", "spring": r"org\.springframework|@SpringBootApplication"}
ENGINES = ["audit-report", "entropy", "injection", "llm-escalate", "nlp", "perplexity", "pii", "presidio", "secrets", "semgrep", "stego", "taint", "validate"]


def language(path) -> object:
    return F.when(F.substring_index(path, "/", -1) == "Dockerfile", "docker").otherwise(T.lookup(T.extension(path), LANGUAGES, "other"))


def languages(files: DataFrame, path: str = "path", top: int = 20, size=None) -> DataFrame:
    """(language, files), and bytes where `size` gives those of a file."""
    sums = [] if size is None else [F.sum("_n").alias("bytes")]
    rows = files.select(language(F.col(path)).alias("language"), (F.lit(0) if size is None else size).cast("long").alias("_n"))
    return rows.where("language != 'other'").groupBy("language").agg(F.count("*").alias("files"), *sums).orderBy(F.desc("files"), "language").limit(top)


def frameworks(files: DataFrame, text: str = "text") -> DataFrame:
    """(framework) that any file shows."""
    found = files.agg(*[F.max(F.col(text).rlike("(?m)" + p).cast("int")).alias(n) for n, p in FRAMEWORKS.items()])
    return found.select(F.explode(F.array_compact(F.array(*[F.when(F.col(n) == 1, F.lit(n)) for n in FRAMEWORKS]))).alias("framework"))


def repo_type(languages_: DataFrame, frameworks_: DataFrame) -> DataFrame:
    """One row: repo_type by a cascade of rules, and the engines it does not need."""
    a = languages_.agg(F.coalesce(F.map_from_entries(F.collect_list(F.struct("language", "files"))), F.create_map().cast("map<string,bigint>")).alias("l"))
    b = frameworks_.agg(F.collect_set("framework").alias("f"))
    has = lambda *names: F.arrays_overlap("f", F.array(*[F.lit(n) for n in names]))
    l = F.col("l")  # noqa: E741
    kind = (
        F.when(F.map_contains_key(l, "terraform") | has("terraform"), "infrastructure").when(has("fastapi", "flask", "django", "express", "spring"), "application")
        .when(has("langchain", "llamaindex", "pytorch", "tensorflow"), "ai-ml").when((F.coalesce(F.try_element_at(l, F.lit("python")), F.lit(0)) > 50) & F.map_contains_key(l, "jupyter"), "data-science")
        .when(has("docker") & (F.size(l) <= 3), "container").otherwise("general")
    )
    code = F.arrays_overlap(F.map_keys(l), F.array(*[F.lit(x) for x in ("python", "javascript", "typescript", "java")]))
    needed = F.array_compact(F.array(*[F.lit(e) for e in ENGINES if e not in ("taint", "semgrep", "stego", "nlp")], F.when(code, F.lit("taint")), F.when(code, F.lit("semgrep")), F.when(F.map_contains_key(l, "markdown"), F.lit("nlp"))))
    return a.join(F.broadcast(b)).select(kind.alias("repo_type"), F.array_sort(F.array_except(F.array(*[F.lit(e) for e in ENGINES]), needed)).alias("skipped_engines"))  # one row each


def plan_counts(files: DataFrame, path: str = "path", patches: DataFrame | None = None) -> DataFrame:
    """What a scan would read, without reading content; with the number of commits of patches(commit)."""
    from siftspark.functions import patterns as P

    out = files.agg(F.count("*").alias("files"), F.count_if(T.matches_glob(F.col(path), P.SUSPICIOUS_FILES)).alias("suspicious"), F.count_if(T.matches_glob(F.col(path), P.EXCLUDES)).alias("excluded"))
    if patches is None:
        return out
    return out.crossJoin(F.broadcast(patches.where("commit != ''").agg(F.countDistinct("commit").alias("commits"))))  # one row each
