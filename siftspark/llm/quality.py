"""Quality by ordinal cumulative-link regression: P(grade > k) = sigmoid(w . x - t_k) with one weight vector over hashed
words and word pairs of the whole text (counts scaled to length one), and thresholds t_0 < t_1 < ... . Fitted on a bounded sample of graded rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftspark.llm.hashed import counted, words

BITS, SAMPLE, EPOCHS, RATE, DECAY, SEED = 18, 4000, 6, 4.0, 1e-6, 5
#: A document is selected if P(top grade) is at least this.
SELECT = 0.5


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Ordinal:
    grades: list[int]
    weights: np.ndarray
    cuts: np.ndarray  # ascending, one less than grades

    def score(self, texts: list) -> np.ndarray:
        """w . x of each text; 0 without words."""
        z = np.zeros(len(texts))
        for keep, offsets, buckets in words(texts, BITS):
            own = np.repeat(np.arange(len(keep)), np.diff(offsets)) << BITS | buckets
            own, n = np.unique(own, return_counts=True)
            text, n = own >> BITS, n.astype(float)
            total = np.bincount(text, self.weights[own & (1 << BITS) - 1] * n)
            z[keep] = total / np.sqrt(np.bincount(text, n * n))
        return z

    def tails(self, z: np.ndarray) -> np.ndarray:
        """P(grade > k) for each k but the last."""
        return sigmoid(z[:, None] - self.cuts)


def train(rows: list[tuple[int, np.ndarray, np.ndarray]]) -> Ordinal:
    """rows: (grade, buckets, weight of each)."""
    grades = sorted({r[0] for r in rows})
    w = np.zeros(1 << BITS)
    if len(grades) < 2:
        return Ordinal(grades or [0], w.astype(np.float32), np.zeros(0))
    y = np.array([grades.index(r[0]) for r in rows])
    above = np.array([(y > k).mean() for k in range(len(grades) - 1)]).clip(1e-3, 1 - 1e-3)
    cuts = np.maximum.accumulate(-np.log(above / (1 - above)) + 1e-6 * np.arange(len(above)))
    rng, done, steps = np.random.default_rng(SEED), 0, EPOCHS * len(rows)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            _, at, x = rows[i]
            rate = RATE * (1 - done / steps)
            done += 1
            g = sigmoid(x @ w[at] - cuts) - (y[i] > np.arange(len(cuts)))
            w[at] -= rate * (g.sum() * x + DECAY * w[at])
            cuts = np.maximum.accumulate(cuts + 0.01 * rate * g)  # in order at every step
    return Ordinal(grades, w.astype(np.float32), cuts)


def ratings(labels: DataFrame) -> DataFrame:
    """(doc_id, rating) of labels(doc_id, quality, toxic): 0 toxic, 1 of low quality, 2 good. One row a doc_id; any
    toxic row makes it toxic; without a toxic label quality alone counts; null where neither tells."""
    one = labels.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"), F.max(F.col("quality").cast("int")).alias("quality"))
    return one.select("doc_id", F.when(F.col("toxic") > 0, 0).when(F.col("quality") > 0, 2).when(F.col("quality") == 0, 1).alias("rating"))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, grade: str = "quality") -> Ordinal:
    """About `sample` graded documents, chosen by a hash of doc_id, teach the model; null texts and grades don't."""
    graded = labels.select(F.col("doc_id").alias("id"), F.col(grade).cast("int").alias("grade")).dropna().groupBy("id").agg(F.max("grade").alias("grade"))
    n = graded.count()
    chosen = graded.where(F.pmod(F.xxhash64("id", F.lit(SEED)), F.lit(1 << 20)) < min(1.0, sample / max(1, n)) * (1 << 20))
    rows = docs.select(F.col("doc_id").alias("id"), "text").where("text is not null").join(F.broadcast(chosen), "id")  # about `sample` rows of two numbers
    rows = rows.groupBy("id", "grade").agg(F.min("text").alias("text"))  # an id in very many rows is one of them

    def counts(frames):
        for f in frames:
            grades, out = f["grade"].tolist(), []
            for keep, offsets, buckets in words(f["text"].tolist(), BITS):
                for i, k in enumerate(keep):
                    at, share = counted(buckets[offsets[i] : offsets[i + 1]])
                    out.append((grades[k], at, share / np.sqrt(share @ share)))
            yield pd.DataFrame(out, columns=["grade", "at", "x"])

    got = rows.select("grade", "text").mapInPandas(counts, "grade int, at array<int>, x array<float>").toPandas()
    rows = [(g, np.asarray(a), np.asarray(x, float)) for g, a, x in zip(got["grade"], got["at"], got["x"], strict=True)]
    return train(sorted(rows, key=lambda r: (r[0], len(r[1]), r[1][:50].tolist(), float(r[2][0]))))


def rate(docs: DataFrame, model: Ordinal, select: float = SELECT) -> DataFrame:
    """Returns (doc_id, expected_grade, tail_prob, selected) for every row of docs(doc_id, text).

    tail_prob is P(top grade). A text without words, null or empty, gets the grades' prior and is not selected.
    Rows repeat as they are; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is fixed by BITS

    def grade(texts: pd.Series) -> pd.DataFrame:
        m = shared.value
        tails = m.tails(m.score(texts.tolist()))
        steps = np.diff(m.grades)
        return pd.DataFrame({"expected_grade": m.grades[0] + tails @ steps if len(steps) else np.full(len(texts), float(m.grades[0])), "tail_prob": tails[:, -1] if len(steps) else np.ones(len(texts))})

    x = F.pandas_udf(grade, "expected_grade double, tail_prob double")("text")
    out = docs.select("doc_id", x.alias("x"), F.coalesce(F.col("text").rlike(r"\w|[^\x00-\x7f]"), F.lit(False)).alias("some"))
    return out.select("doc_id", "x.expected_grade", "x.tail_prob", (F.col("some") & (F.col("x.tail_prob") >= select)).alias("selected"))
