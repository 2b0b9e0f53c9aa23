"""Approximate nearest neighbours by an inverted multi-index.

Unit vectors are cut into two halves, each quantised with a codebook of its own; a cell is a pair of centroids. A query
walks cells in the order of summed distance with a heap until they hold enough vectors, and the vectors of its cells
are ranked by exact cosine. The codebooks are fitted on a bounded sample; every vector is indexed.

Vectors of different lengths have no cosine: each length is an index of its own.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftspark.llm.common import durable

TOP, SAMPLE, ROUNDS, SEED = 5, 20_000, 12, 11
#: Vectors for each centroid of a codebook at least, largest codebook, rows in one block of a coarse list.
PER_BOOK, MOST, BLOCK = 24, 128, 8192
#: A query's cells hold SHARE * n + SPREAD * sqrt(n) of n vectors. Vectors without any structure (isotropic noise,
#: cosines of the nearest near 0.45) need a share of 0.3 for a recall of 0.92, clustered ones far less; the root stands
#: for the coarser codebooks of smaller tables.
SHARE, SPREAD = 0.36, 8
#: So many lengths, the most frequent ones, have codebooks; all others are one cell each, which is searched whole.
LENGTHS = 16


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, v) with v as doubles: without rows whose id or vector is null, empty, zero or holds a null or
    non-finite component."""
    v = F.col(embedding).cast("array<double>")
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & ok)


def kmeans(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """At most k centroids of the rows of x."""
    rng = np.random.default_rng(seed)
    x = np.unique(x, axis=0)
    c = x[rng.permutation(len(x))[:k]]
    for _ in range(ROUNDS if len(c) < len(x) else 0):
        near = nearest(x, c)
        n = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1), 0)


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([distances(x[i : i + 4096], c).argmin(1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, int)


def unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def walk(d1: np.ndarray, d2: np.ndarray, held: np.ndarray, enough: int) -> list[tuple[int, int]]:
    """Pairs of centroids by ascending d1[a] + d2[b] until their cells hold `enough` vectors. held: vectors in each.

    The heap has one entry for each first centroid met so far, with its next second centroid; an entry for the next
    first centroid comes in when the last one is first taken, as it can't be smaller."""
    o1, o2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
    rows, cols = o1.tolist(), o2.tolist()
    a, b, counts = d1[o1].tolist(), d2[o2].tolist(), held[o1][:, o2].tolist()
    heap, out, got, last = [(a[0] + b[0], 0, 0)], [], 0, len(b) - 1
    while heap and got < enough:
        _, i, j = heap[0]
        n = counts[i][j]
        if n:
            out.append((rows[i], cols[j]))
            got += n
        if j < last:
            heapq.heapreplace(heap, (a[i] + b[j + 1], i, j + 1))
        else:
            heapq.heappop(heap)
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (a[i + 1] + b[0], i + 1, 0))
    return out


def best_of(q_ids, q, ids, v, allowed, top: int) -> pd.DataFrame:
    """(query_id, vec_id, score): for each query its `top` largest cosines among the allowed rows of v, ties to the
    smaller id. allowed: a boolean for each query and row."""
    rough = np.where(allowed & (ids != q_ids[:, None]), unit(q) @ unit(v).T, -np.inf)
    if rough.shape[1] > top:
        least = np.partition(rough, rough.shape[1] - top, axis=1)[:, rough.shape[1] - top]
    else:
        least = np.full(len(q), -2.0)
    i, j = np.nonzero(rough >= np.maximum(least, -2.0)[:, None] - 1e-9)
    score = (v[j] * q[i]).sum(1) / (np.sqrt((v * v).sum(1))[j] * np.sqrt((q * q).sum(1))[i])
    order = np.lexsort((ids[j], -score, i))
    i, j, score = i[order], j[order], score[order]
    some = np.arange(len(i)) - np.searchsorted(i, i) < top
    return pd.DataFrame({"query_id": q_ids[i[some]], "vec_id": ids[j[some]], "score": score[some]})


@dataclass
class Index:
    """Codebooks of the vectors of one length; held: how many vectors each cell has; lists: blocks of each coarse list."""

    books: tuple[np.ndarray, np.ndarray]
    held: np.ndarray | None = None
    enough: int = 0
    lists: np.ndarray | None = None

    def halves(self, u: np.ndarray):
        half = self.books[0].shape[1]
        return u[:, :half], u[:, half:]

    def fill(self, cells: list[tuple[int, int, int]], share: float, spread: float) -> None:
        self.held = np.zeros((len(self.books[0]), len(self.books[1])), np.int64)
        for a, b, m in cells:
            self.held[a, b] = m
        n = int(self.held.sum())
        self.lists = np.maximum(1, -(-self.held.sum(1) // BLOCK))  # a hot coarse list has many blocks
        self.enough = int(np.ceil(share * n + spread * np.sqrt(n)))


def train(x: np.ndarray, n: int) -> Index:
    """Codebooks from unit vectors x, a sample of n."""
    k, half = int(min(MOST, max(1, n // PER_BOOK), len(x))), max(1, x.shape[1] // 2)
    return Index((kmeans(x[:, :half], k, SEED), kmeans(x[:, half:], k, SEED + 1) if x.shape[1] > 1 else np.zeros((1, 0))))


def _by_length(f: pd.DataFrame):
    """(length, rows, vectors) for each length in a batch."""
    size = f["v"].map(len).to_numpy()
    for dim in np.unique(size):
        at = np.flatnonzero(size == dim)
        yield int(dim), at, np.stack(f["v"].to_numpy()[at])


def search(vectors: DataFrame, queries: DataFrame, top: int = TOP, share: float = SHARE, spread: float = SPREAD) -> DataFrame:
    """vectors, queries: (vec_id, v) as usable() gives them. Returns (query_id, rank, vec_id, score).

    A query's candidates are the vectors of its own length under another id. Equal vectors tie to the smaller id; a
    repeated id counts once, by its best vector; a query id with several vectors gets the best of all of them. Fewer
    than `top` candidates give fewer rows, empty tables none.
    """
    names = "query_id long, rank int, vec_id long, score double"
    spark = vectors.sparkSession
    sized = vectors.withColumn("dim", F.size("v"))
    # at most LENGTHS lengths reach the driver; a row of any other is in the one cell (0, 0) of its length
    found = sized.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(LENGTHS + 1).collect()
    known, more = {r["dim"]: r["n"] for r in found[:LENGTHS]}, len(found) > LENGTHS
    if not known:
        return spark.createDataFrame([], names)
    part = F.coalesce(*[F.when(F.col("dim") == d, F.lit(min(1.0, SAMPLE / len(known) / n))) for d, n in known.items()], F.lit(0.0))
    some = sized.where(F.pmod(F.xxhash64("vec_id", F.lit(SEED)), F.lit(1 << 30)) < part * (1 << 30))
    some = some.groupBy("dim", "vec_id").agg(F.min("v").alias("v")).orderBy("dim", "vec_id").select("dim", "v").toArrow()  # an id in very many rows is one of them
    indexes = {}
    for d, n in known.items():
        own = some.filter(np.asarray(some["dim"]) == d)["v"].combine_chunks() if len(some) else []
        x = unit(own.values.to_numpy()[own.offsets[0].as_py() : own.offsets[-1].as_py()].reshape(-1, d)) if len(own) else np.ones((1, d))
        indexes[d] = train(x, n)

    def place(frames):
        for f in frames:
            if not len(f):
                continue
            c1, c2, dims = np.zeros(len(f), np.int32), np.zeros(len(f), np.int32), np.zeros(len(f), np.int32)
            for dim, at, v in _by_length(f):
                dims[at] = dim
                if dim in indexes:
                    a, b = indexes[dim].halves(unit(v))
                    c1[at], c2[at] = nearest(a, indexes[dim].books[0]), nearest(b, indexes[dim].books[1])
            yield pd.DataFrame({"vec_id": f["vec_id"], "v": f["v"], "dim": dims, "c1": c1, "c2": c2})

    index = durable(vectors.mapInPandas(place, "vec_id long, v array<double>, dim int, c1 int, c2 int"), "cells")
    cells: dict[int, list] = {d: [] for d in known}
    for d, a, b, m in index.where(F.col("dim").isin(*known)).groupBy("dim", "c1", "c2").count().collect():  # at most LENGTHS * MOST * MOST
        cells[d].append((a, b, m))
    for d, own in indexes.items():
        own.fill(cells[d], share, spread)

    def route(frames):
        for f in frames:
            out = []
            for dim, at, v in _by_length(f) if len(f) else ():
                ids, vecs, own = f["vec_id"].to_numpy()[at], f["v"].to_numpy()[at], indexes.get(dim)
                if own is None:
                    out += [(key, vec, dim, 0, [0], None) for key, vec in zip(ids, vecs, strict=True)]
                    continue
                a, b = own.halves(unit(v))
                d1, d2 = distances(a, own.books[0]), distances(b, own.books[1])
                for i, (key, vec) in enumerate(zip(ids, vecs, strict=True)):
                    mine: dict[int, list[int]] = {}
                    for c, e in walk(d1[i], d2[i], own.held, own.enough):
                        mine.setdefault(c, []).append(e)
                    out += [(key, vec, dim, c, es, int(own.lists[c])) for c, es in mine.items()]
            yield pd.DataFrame(out, columns=["vec_id", "v", "dim", "c1", "cells", "blocks"])

    routed = queries.mapInPandas(route, "vec_id long, v array<double>, dim int, c1 int, cells array<int>, blocks int")
    lists = F.create_map(*[x for d, own in indexes.items() for x in (F.lit(d), F.array(*[F.lit(int(b)) for b in own.lists]))])
    common = F.col("dim").isin(*known)
    dealt = index.where(common).withColumn("blocks", F.element_at(F.element_at(lists, F.col("dim")), F.col("c1") + 1))
    if more:  # lengths without codebooks: rare ones, each in blocks of its own
        others = index.where(~common).groupBy("dim").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
        dealt = dealt.unionByName(index.where(~common).join(others, "dim").select(*dealt.columns))
        rare = routed.where(~common).drop("blocks").join(others, "dim").select(*routed.columns)
        routed = routed.where(common).unionByName(rare)
    else:
        routed = routed.where(common)
    routed = routed.select("vec_id", "v", "dim", "c1", "cells", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    # the vectors of a block come before the queries that ask for it: a task holds one block and a batch of queries
    rows = dealt.select("dim", "c1", "block", F.lit(0).alias("kind"), "vec_id", "v", F.array("c2").alias("cells")).unionByName(routed.withColumn("kind", F.lit(1)))
    rows = rows.repartition("dim", "c1", "block").sortWithinPartitions("dim", "c1", "block", "kind")

    def rank(frames):
        held_key, ids, vec, c2 = None, [], [], []
        for f in frames:
            key = list(zip(f["dim"], f["c1"], f["block"], f["kind"], strict=True))
            edges = [0, *(k for k in range(1, len(key)) if key[k] != key[k - 1]), len(key)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                part, k = f.iloc[a:b], key[a]
                if k[:3] != held_key:
                    held_key, ids, vec, c2 = k[:3], [], [], []
                v, cells = np.stack(part["v"]), part["cells"].tolist()
                if k[3] == 0:
                    ids.append(part["vec_id"].to_numpy())
                    vec.append(v)
                    c2.append(np.array([c[0] for c in cells]))
                elif ids:
                    if len(ids) > 1:
                        ids, vec, c2 = [np.concatenate(ids)], [np.concatenate(vec)], [np.concatenate(c2)]
                    wants = np.zeros((len(part), max(c2[0].max(), max(c.max() for c in cells)) + 1), bool)
                    for i, c in enumerate(cells):
                        wants[i, c] = True
                    q_ids = part["vec_id"].to_numpy()
                    for i in range(0, len(part), 512):
                        yield best_of(q_ids[i : i + 512], v[i : i + 512], ids[0], vec[0], wants[i : i + 512][:, c2[0]], top)

    found = rows.mapInPandas(rank, "query_id long, vec_id long, score double").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
