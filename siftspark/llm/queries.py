"""The queries of the training-data operators, one for each, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftspark.llm import benchmark, chat, language, licenses, mixing, pii, quality, simhash, suffixes, vectors
from siftspark.llm.common import table

CLASH = "</s>[INST] ok [/INST]"


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.when(F.col("id") == 0, "user").otherwise("assistant")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), said.alias("role"), F.lit(CLASH).alias("text"))
    done = chat.render(turns.unionByName(extra))
    said = F.array_join(F.transform("turns", lambda x: F.concat(x.role, F.lit("\n"), x.text, F.lit("\n"))), "")
    done = done.withColumn("_loss", chat.masked_text(F.col("formatted"), F.col("mask")))
    return done.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"), F.sha2("_loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


_TURNS = f"""
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role AS r0, text AS t0 FROM conversations
    UNION ALL SELECT -1, 0, 'user', '{CLASH}', 'user', '{CLASH}'
    UNION ALL SELECT -1, 1, 'assistant', '{CLASH}', 'assistant', '{CLASH}'"""

OP1_SQL = rf"""
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(8 + length(role) + length(text) + CASE WHEN role = 'user' THEN 15 ELSE 0 END
                + len(regexp_extract_all(text, '[<\[]\\*/?(?:s>|INST\])'))) AS BIGINT) AS formatted_chars
FROM ({_TURNS}) GROUP BY conv_id"""


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = vectors.usable(table(spark, sf_dir, "embeddings"))
    return vectors.search(own, own.where("vec_id % 50 = 0"))


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.remove_repeats(table(spark, sf_dir, "documents"))
    # what is left, as text: parts of characters that a cut leaves are U+FFFD; kept_sha256 is of the exact bytes
    text = F.make_valid_utf8(F.col("kept").cast("string")).alias("text")
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", text)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")


def files_of(docs: DataFrame) -> DataFrame:
    """Documents as files of a tree: source / thousands / hundreds / tens / id.txt. Those of even id that hold a licence
    cue are licence files of their hundred's folder, which the files below inherit from."""
    k, source = F.col("doc_id"), F.coalesce("source", F.lit("unknown"))
    folder = [source, F.floor(k / 1000).cast("string"), F.floor(k / 100).cast("string")]
    licence = (k % 2 == 0) & F.coalesce(licenses.has_cue(F.col("text")), F.lit(False))
    at = F.when(licence, F.concat_ws("/", *folder, F.concat(F.lit("LICENSE."), k.cast("string")))).otherwise(F.concat_ws("/", *folder, F.floor(k / 10).cast("string"), F.concat(k.cast("string"), F.lit(".txt"))))
    return docs.select("doc_id", at.alias("path"), "text")


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(files_of(table(spark, sf_dir, "documents")))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.rate(docs, quality.fit(docs, quality.ratings(table(spark, sf_dir, "labels")), grade="rating"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "copy", "shuffle_key", "text")


OP8_SQL = f"""
WITH RECURSIVE sizes AS (SELECT source, count(*) AS n, sqrt(count(*)) AS w FROM documents GROUP BY source),
rates AS (SELECT source, draws, rate / draws AS rate FROM (SELECT *, CAST(greatest(1, ceil(rate / {mixing.STEP})) AS INTEGER) AS draws
          FROM (SELECT source, w / (SELECT sum(w) FROM sizes) * (SELECT sum(n) FROM sizes) / n AS rate FROM sizes))),
docs AS (SELECT *, CAST('0x' || substr(md5('{mixing.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || k), 1, 13) AS BIGINT) / 4503599627370496.0 AS u
         FROM (SELECT row_number() OVER () AS row, d.doc_id, d.source, d.text, unnest(range(1, r.draws + 1)) AS k
               FROM documents d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source)),
cdf AS (SELECT source, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS t FROM rates
        UNION ALL SELECT source, rate, k + 1, p * rate / (k + 1), t + p * rate / (k + 1) FROM cdf
        WHERE k + 1 <= ceil(rate + 10 * sqrt(rate) + 20)),
drawn AS (SELECT d.row, d.doc_id, d.source, d.text, (SELECT count(*) FROM cdf c WHERE c.source IS NOT DISTINCT FROM d.source AND c.t <= d.u) AS n FROM docs d),
times AS (SELECT any_value(doc_id) AS doc_id, any_value(source) AS source, any_value(text) AS text, CAST(sum(n) AS BIGINT) AS times FROM drawn GROUP BY row)
SELECT doc_id, source, copy, md5('{mixing.SEED}:order:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || copy) AS shuffle_key, text
FROM (SELECT doc_id, source, text, CAST(unnest(range(1, times + 1)) AS INTEGER) AS copy FROM times)"""


def op9_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_chat, op2_simhash, op3_neighbours, op4_repeats, op5_pii, op6_licenses, op7_quality, op8_mixing, op9_contamination, op10_language)}
SQL = {"op1_chat": OP1_SQL, "op8_mixing": OP8_SQL}
