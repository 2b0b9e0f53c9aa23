"""Language identification: averaged hashed subword embeddings, a linear softmax, calibrated rejection.

The model is fitted on the driver by stochastic gradient descent on a bounded sample of labelled rows (`sample`, spread
evenly over the languages); texts come to the driver as counts of hashed subwords, whose number is bounded too.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftspark.llm.common import fresh, join_counted
from siftspark.llm.hashed import counted, subwords

BITS, DIM, SAMPLE, EPOCHS, STEPS, RATE, SEED = 16, 16, 2400, 4, 9600, 0.5, 7
#: A prediction under this calibrated probability is rejected.
REJECT = 0.4
#: Share of an n-gram that a language's rows do not have; quantiles of held-out rows under their own language and under
#: the others' alone, between which the cut for the unknown lies; held-out rows that a cut needs.
UNSEEN, OWN, OTHER, ENOUGH = 1e-6, 0.002, 0.98, 20
UNKNOWN = "und"
FEW = 50_000
DIGITS = re.compile(r"\S*\d\S*")


@dataclass
class Model:
    langs: list[str]
    logits: np.ndarray  # of each bucket, already divided by the temperature
    bias: np.ndarray
    seen: np.ndarray  # log of the share of each bucket in each language's rows
    cut: float  # texts whose mean of `seen` is lower are in no learned language

    def predict(self, texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the language (-1: no text), its calibrated probability, and whether the n-grams are that language's."""
        best, score, known = np.full(len(texts), -1), np.zeros(len(texts)), np.zeros(len(texts), bool)
        if not self.langs:
            return best, score, known
        for keep, offsets, buckets in subwords(texts, BITS):
            z = np.stack([np.add.reduceat(col[buckets], offsets[:-1], dtype=np.float64) for col in self.logits.T], axis=1)
            p = softmax(z / np.diff(offsets)[:, None] + self.bias)
            best[keep] = p.argmax(1)
            score[keep] = p.max(1)
            known[keep] = self.fits(best[keep], offsets, buckets)
        # numbers and secrets are no language: a text that holds many of them is judged by its other words
        rest = [DIGITS.sub(" ", t) if t and b >= 0 and not k else None for t, b, k in zip(texts, best, known, strict=True)]
        for keep, offsets, buckets in subwords([t if t and any(map(str.isalpha, t)) else None for t in rest], BITS):
            known[keep] = self.fits(best[keep], offsets, buckets)
        return best, score, known

    def fits(self, lang: np.ndarray, offsets: np.ndarray, buckets: np.ndarray) -> np.ndarray:
        n = np.diff(offsets)
        return np.add.reduceat(self.seen[buckets, np.repeat(lang, n)], offsets[:-1], dtype=np.float64) / n >= self.cut


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def unknown_cut(seen: np.ndarray, rows: list, y: np.ndarray) -> float:
    """Between what held-out rows reach under their own language and what they reach where it is left out; where these
    overlap, the former. With one language the latter is that of n-grams never seen. -inf with fewer than ENOUGH rows."""
    if len(rows) < ENOUGH:
        return -np.inf
    reach = np.array([share @ seen[at] for _, at, share in rows])
    own = np.quantile(reach[np.arange(len(y)), y], OWN)
    reach[np.arange(len(y)), y] = np.log(UNSEEN)
    return float(min(own, (own + np.quantile(reach.max(1), OTHER)) / 2))


def train(rows: list[tuple[str, np.ndarray, np.ndarray]]) -> Model:
    """rows: (language, buckets, shares). A fifth is kept from training and sets the temperature and the cut."""
    langs = sorted({r[0] for r in rows})
    if not langs:
        return Model([], np.zeros((1 << BITS, 0)), np.zeros(0), np.zeros((1 << BITS, 0)), -np.inf)
    rng = np.random.default_rng(SEED)
    emb, out, bias = rng.normal(0, 0.1, (1 << BITS, DIM)), np.zeros((DIM, len(langs))), np.zeros(len(langs))
    order = rng.permutation(len(rows))
    held, own = order[: len(rows) // 5], order[len(rows) // 5 :]
    target = np.eye(len(langs))[[langs.index(r[0]) for r in rows]]
    epochs = max(EPOCHS, -(-STEPS // max(1, len(own))))  # a small sample is gone through more often
    steps, done = epochs * len(own), 0
    for _ in range(epochs):
        for k in rng.permutation(own):
            _, at, share = rows[k]
            rate = RATE * (1 - done / steps)
            done += 1
            x = share @ emb[at]
            g = softmax(x @ out + bias) - target[k]
            back = out @ g
            out -= rate * np.outer(x, g)
            bias -= 0.01 * rate * g
            emb[at] -= rate * 10 * share[:, None] * back
    table = emb @ out
    z = np.array([rows[k][2] @ table[rows[k][1]] + bias for k in (held if len(held) else own)])
    y = target[held if len(held) else own].argmax(1)
    loss = lambda t: -np.log(softmax(z / t)[np.arange(len(y)), y] + 1e-12).mean()
    heat = min(np.geomspace(0.0005, 5, 120), key=loss)
    seen = np.zeros((1 << BITS, len(langs)))
    for k in own:
        seen[rows[k][1], langs.index(rows[k][0])] += rows[k][2]
    seen = np.log(seen / np.maximum(seen.sum(0), UNSEEN) + UNSEEN).astype(np.float32)
    return Model(langs, np.ascontiguousarray(table / heat, np.float32), bias / heat, seen, unknown_cut(seen, [rows[k] for k in held], y))


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Model:
    """docs: the rows to learn from; those without text or language are left out. About `sample` of them are read, in
    the mean equally many of each language or all it has, chosen by a hash of the id. Where there are more languages than
    `sample`, each has the same chance of having a row in it; a language without one can't be learned."""
    rows = docs.select(F.col(doc_id).cast("string").alias("id"), F.col(lang).alias("lang"), F.col(text).alias("text")).where("lang is not null and text is not null")
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"))
    langs = sizes.count()
    each = sample / max(1, langs)
    draw = F.pmod(F.xxhash64("id", F.lit(SEED)), F.lit(1 << 40))
    drawn, shares = rows.select("id", "lang", draw.alias("draw")), sizes.select("lang", "n", F.least(F.lit(1.0), F.lit(each) / F.col("n")).alias("share"))
    # a language may hold most rows: up to FEW languages (some 50 bytes each) are broadcast, of more only the hot ones
    drawn = drawn.join(F.broadcast(shares), "lang") if langs <= FEW else join_counted(drawn, shares, ["lang"], rows.count())
    chosen = drawn.where(F.col("draw") < F.col("share") * (1 << 40))
    chosen = F.broadcast(chosen.select("id", "lang").distinct())  # about `sample` rows
    rows = rows.join(chosen, ["id", "lang"]).groupBy("id", "lang").agg(F.min("text").alias("text"))  # an id in very many rows is one of them

    def counts(frames):
        for frame in frames:
            langs, out = frame["lang"].tolist(), []
            for keep, offsets, buckets in subwords(frame["text"].tolist(), BITS):
                for i, k in enumerate(keep):
                    out.append((langs[k], *counted(buckets[offsets[i] : offsets[i + 1]])))
            yield pd.DataFrame(out, columns=["lang", "at", "share"])

    got = rows.select("lang", "text").mapInPandas(counts, "lang string, at array<int>, share array<float>").toArrow().combine_chunks()
    if not len(got):
        return train([])
    at, share = (got.column(c).chunk(0) for c in ("at", "share"))  # views of two flat arrays, no object a row
    ends, at, share = at.offsets.to_numpy(), at.values.to_numpy(), share.values.to_numpy()
    got = [(lang, at[a:b], share[a:b]) for lang, a, b in zip(got.column("lang").to_pylist(), ends[:-1], ends[1:], strict=True)]
    return train(sorted(got, key=lambda r: (r[0], len(r[1]), r[1][:50].tolist(), float(r[2][0]))))


def predict(docs: DataFrame, model: Model, name: str, text: str = "text") -> DataFrame:
    """docs with a struct `name` of lang_pred, score and rejected. A text that is null or has no letter is `und` with
    score 0, and rejected, as are predictions under REJECT and texts whose n-grams are no learned language's."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is fixed by BITS and the number of languages

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def guess(texts: pd.Series, letters: pd.Series) -> pd.DataFrame:
        m = shared.value
        best, score, known = m.predict([t if ok else None for t, ok in zip(texts, letters, strict=True)])
        return pd.DataFrame({"lang_pred": [m.langs[b] if b >= 0 else UNKNOWN for b in best], "score": score, "rejected": (score < REJECT) | ~known})

    has = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    return docs.withColumn(name, guess(F.col(text), has))


def held_out(doc_id: str = "doc_id"):
    """True for the fold that training never sees; a null id belongs to it."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(True))


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Returns (doc_id, held_out, lang_pred, score, rejected) for every row of docs(doc_id, text, lang).

    Trained on the rows outside the held-out fold. Texts that are null, empty or without a letter are `und`, score 0,
    and rejected, as are predictions under REJECT and texts whose n-grams are no learned language's. Without any
    labelled row all are `und`. Repeated rows and null ids stay as they are; a null id belongs to the held-out fold.
    Texts are read whole. Other columns are not read.
    """
    own = docs.select("doc_id", "text", "lang", held_out().alias("held_out"))
    model = fit(own.where("not held_out"), sample=sample)
    return predict(own.drop("lang"), model, "guess").select("doc_id", "held_out", "guess.lang_pred", "guess.score", "guess.rejected")


def keep_identified(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """docs without those that identify() would reject; all columns stay as they are, whatever their names."""
    model = fit(docs.where(~held_out()), sample=sample)
    name = fresh(docs, "guess")
    return predict(docs, model, name).where(~F.col(f"{name}.rejected")).select(*[F.col(f"`{c}`") for c in docs.columns])
