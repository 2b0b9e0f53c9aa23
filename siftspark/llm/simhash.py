"""SimHash near-duplicates: fingerprints, vantage-point trees that find links, components.

Full 64-bit fingerprints of unrelated texts lie at 32 +- 4 bits from any vantage point, so a ball of radius 4 overlaps
both sides of nearly every split. Of three blocks of 21 or 22 bits, however, a linked pair differs by at most one bit in
at least one. So there is a vantage-point tree for each block, by Hamming distance on that block: its band of width 1
overlaps a sixth of a split.

1. The upper levels of the trees are fitted on a bounded sample of distinct fingerprints and broadcast. Every fingerprint
   descends them: it goes to its own side of each split and, where it lies within the band behind the boundary, to the
   inner side too. The leaves are the shards.
2. Each shard goes on splitting in the same way around vantages of its own until LEAF fingerprints are left, which are
   compared with each other by all 64 bits. What one block can't split (a dense ball) is split by full distance.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftspark.llm.common import durable, fresh, utf8
from siftspark.llm.components import components

SHINGLE, RADIUS, SEED, LEAF = 4, 4, 42, 512
#: Blocks of bits; distinct fingerprints that teach the upper levels of the trees, at most; fingerprints in a shard,
#: about; a fingerprint of more documents than one in HOT of all is joined apart, so there are at most HOT of these.
BLOCKS, SAMPLE, SHARD, HOT = 3, 50_000, 2000, 10_000
_BITS = ((np.arange(256)[:, None] >> np.arange(7, -1, -1)) & 1).astype(np.int64)


def fingerprint(text, width: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned SimHash of one text; 0 for a text that is null or has no word."""
    words = utf8(text).lower().split()
    if not words:
        return 0
    joined, h64 = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) < width:
        return h64(joined, seed)
    ends = list(accumulate(map(len, words), lambda a, n: a + n + 1))
    starts = [0, *(e + 1 for e in ends)]
    h = np.array([h64(joined[a:b], seed) for a, b in zip(starts, ends[width - 1 :], strict=False)], dtype=">u8")
    places = h.view(np.uint8).reshape(-1, 8).astype(np.int64) + np.arange(0, 2048, 256)
    votes = np.einsum("bv,vk->bk", np.bincount(places.ravel(), minlength=2048).reshape(8, 256), _BITS).ravel()
    return int.from_bytes(np.packbits(2 * votes > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text", width: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """docs with a long column `fp`: the fingerprint's bits as a signed long."""

    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, width, seed) for t in texts], np.uint64).view(np.int64))

    return docs.withColumn("fp", fp(F.col(text)))


class Forest:
    """Union-find over positions; the smallest position is the root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def _cross(fps, left, right, radius, forest, block=2048):
    for i in range(0, len(left), block):
        rows = left[i : i + block]
        for j in range(0, len(right), block):
            cols = right[j : j + block]
            near = np.bitwise_count(fps[rows, None] ^ fps[None, cols]) <= radius
            for a, b in np.argwhere(near):
                forest.join(int(rows[a]), int(cols[b]))


def vantage_links(fps: np.ndarray, radius: int, forest: Forest, leaf: int = LEAF) -> None:
    """Joins in `forest` what is linked by fingerprints at most `radius` apart, by a vantage-point tree."""
    todo = [np.arange(len(fps))]
    while todo:
        own = todo.pop()
        if len(own) <= leaf:
            _cross(fps, own, own, radius, forest)
            continue
        dist = np.bitwise_count(fps[own] ^ fps[own[0]]).astype(int)
        for k in own[dist <= radius]:
            forest.join(int(own[0]), int(k))
        if dist.max() <= radius:  # all of them are linked to the vantage
            continue
        if dist.max() == dist[1:].min():
            cut = int(dist.max())
        else:
            cut = int(np.median(dist))
            cut = cut if cut < dist.max() else int(dist[dist < dist.max()].max())
        inner, outer = own[dist <= cut], own[dist > cut]
        if len(outer) == 0 or len(inner) <= 1:  # a sphere around the vantage: the vantage is done with
            todo.append(own[1:])
            continue
        todo += [inner, outer]
        a, b = own[(dist <= cut) & (dist > cut - radius)], own[(dist > cut) & (dist <= cut + radius)]
        _bands(fps, a, b, radius, forest, leaf)


def _bands(fps, left, right, radius, forest, leaf):
    """Links across a boundary; large bands are split again around a vantage of their own."""
    todo = [(left, right, 0)]
    while todo:
        left, right, depth = todo.pop()
        if not len(left) or not len(right):
            continue
        if len(left) * len(right) <= 64 * leaf * leaf or depth > 12:
            _cross(fps, left, right, radius, forest)
            continue
        v = fps[left[0]]
        dl, dr = np.bitwise_count(fps[left] ^ v).astype(int), np.bitwise_count(fps[right] ^ v).astype(int)
        for k in right[dr <= radius]:
            forest.join(int(left[0]), int(k))
        if dl.max() == 0:
            continue
        cut = int(np.median(dl))
        cut = cut if cut < dl.max() else cut - 1
        todo.append((left[dl <= cut], right[dr <= cut + radius], depth + 1))
        todo.append((left[dl > cut], right[dr > cut - radius], depth + 1))


def block_of(fps: np.ndarray, k: int) -> np.ndarray:
    """The k-th block of bits of unsigned fingerprints."""
    a, b = 64 * k // BLOCKS, 64 * (k + 1) // BLOCKS
    return (fps >> np.uint64(a)) & np.uint64((1 << (b - a)) - 1)


def split_at(dist: np.ndarray, near: int):
    """The distance at which a vantage halves best: inner side up to it, with the band behind it, outer side beyond.
    None if the sides would hold half as much again as the whole: what lies so close together is split no further here."""
    n = np.bincount(dist)
    up = np.cumsum(n)
    inner = up[np.minimum(np.arange(len(n)) + near, len(n) - 1)]
    larger = np.maximum(inner, len(dist) - up)
    cut = int(larger.argmin())
    return cut if inner[cut] + len(dist) - up[cut] <= 1.5 * len(dist) and larger[cut] < len(dist) else None


class Tree:
    """The upper levels of a vantage-point tree over one block: nodes of (vantage, cut, inner, outer); a negative child
    is a leaf, shard -child - 1."""

    def __init__(self, blocks: np.ndarray, near: int, least: int, seed: int):
        rng, self.near, self.nodes, self.leaves = np.random.default_rng(seed), near, [], 0
        todo = [(blocks, -1, 0)]
        while todo:
            own, parent, side = todo.pop()
            cut = None
            if len(own) > least:
                v = own[rng.integers(len(own))]
                dist = np.bitwise_count(own ^ v).astype(int)
                cut = split_at(dist, near)
            if cut is None:
                self.leaves += 1
                child = -self.leaves
            else:
                child = len(self.nodes)
                self.nodes.append([v, cut, 0, 0])
                todo += [(own[dist <= cut + near], child, 2), (own[dist > cut], child, 3)]
            if parent >= 0:
                self.nodes[parent][side] = child

    def route(self, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, shards): every row in each shard that it may have a link in."""
        rows, shards = [], []
        todo = [(0 if self.nodes else -1, np.arange(len(blocks)))]
        while todo:
            at, own = todo.pop()
            if not len(own):
                continue
            if at < 0:
                rows.append(own)
                shards.append(np.full(len(own), -at - 1))
                continue
            v, cut, inner, outer = self.nodes[at]
            dist = np.bitwise_count(blocks[own] ^ v)
            todo += [(inner, own[dist <= cut + self.near]), (outer, own[dist > cut])]
        return (np.concatenate(rows), np.concatenate(shards)) if rows else (np.zeros(0, int), np.zeros(0, int))


def block_links(fps: np.ndarray, k: int, radius: int, forest: Forest, leaf: int = LEAF) -> None:
    """Joins in `forest` what is linked by fingerprints at most `radius` apart and alike in block k."""
    near, blocks, rng = radius // BLOCKS, block_of(fps, k), np.random.default_rng(k)
    todo = [np.arange(len(fps))]
    while todo:
        own = todo.pop()
        if len(own) <= leaf:
            _cross(fps, own, own, radius, forest)
            continue
        dist = np.bitwise_count(blocks[own] ^ blocks[own[rng.integers(len(own))]]).astype(int)
        cut = split_at(dist, near)
        if cut is None:
            part = Forest(len(own))
            vantage_links(fps[own], radius, part, 48)
            for i in range(len(own)):
                forest.join(int(own[i]), int(own[part.find(i)]))
            continue
        todo += [own[dist <= cut + near], own[dist > cut]]


def fingerprint_links(nodes: DataFrame, radius: int = RADIUS, sample: int = SAMPLE, shard: int = SHARD, leaf: int = LEAF) -> DataFrame:
    """nodes(node long, fp long), one row a fingerprint. Returns links (a, b) that join exactly what is
    connected by fingerprints at most `radius` apart; of a dense group only a spanning forest is given."""
    n, near = nodes.count(), radius // BLOCKS
    part = min(1.0, sample / max(1, n))
    some = nodes.where(F.pmod(F.xxhash64("fp", F.lit(SEED)), F.lit(1 << 30)) < int(part * (1 << 30))).select("fp").toArrow()["fp"].to_numpy()
    some = np.sort(some).view(np.uint64)
    trees = [Tree(block_of(some, k), near, max(8, int(shard * part)), k) for k in range(BLOCKS)]
    upper = nodes.sparkSession.sparkContext.broadcast(trees)  # at most 2 * BLOCKS * sample / 8 small nodes

    def deal(frames):
        for f in frames:
            node, fps = f["node"].to_numpy(), f["fp"].to_numpy()
            for k, tree in enumerate(upper.value):
                rows, shards = tree.route(block_of(fps.view(np.uint64), k))
                if len(rows):
                    yield pd.DataFrame({"node": node[rows], "fp": fps[rows], "shard": shards * BLOCKS + k})

    dealt = nodes.select("node", "fp").mapInPandas(deal, "node long, fp long, shard long")
    dealt = dealt.repartition("shard").sortWithinPartitions("shard", "node")

    def search(frames):
        rest = None
        for part in frames:
            if rest is not None:
                part = pd.concat([rest, part], ignore_index=True)
            shard = part["shard"].to_numpy()
            if not len(shard):
                continue
            cut = int(np.searchsorted(shard, shard[-1]))  # the last shard may go on in the next batch
            rest = part.iloc[cut:]
            if cut:
                yield _links_of(part.iloc[:cut], radius, leaf)
        if rest is not None and len(rest):
            yield _links_of(rest, radius, leaf)

    return dealt.mapInPandas(search, "a long, b long")


def _links_of(part: pd.DataFrame, radius: int, leaf: int) -> pd.DataFrame:
    """Links in a run of whole shards, sorted by shard and node."""
    node, shard = part["node"].to_numpy(), part["shard"].to_numpy()
    fps = part["fp"].to_numpy().view(np.uint64)
    first = np.r_[np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]), len(shard)]
    ends = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        forest = Forest(b - a)
        block_links(fps[a:b], int(shard[a] % BLOCKS), radius, forest, leaf)
        roots = np.array([forest.find(x) for x in range(b - a)])
        i = np.flatnonzero(roots != np.arange(b - a))
        ends.append((node[a:b][roots[i]], node[a:b][i]))
    out = pd.DataFrame({"a": np.concatenate([x for x, _ in ends]), "b": np.concatenate([y for _, y in ends])})
    return out.astype("int64").drop_duplicates()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """Returns (doc_id, fp, component_id) for every row of docs.

    Nulls and texts without words have fingerprint 0 and are linked like any other; repeated rows stay, with the same
    component; rows of one doc_id with several texts connect what they reach. A row whose doc_id is null gets the
    component of its fingerprint, null if no row with an id has it. An empty table gives an empty result. Other columns
    are not read.
    """
    prints = durable(fingerprints(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))).select("doc_id", "fp"), "prints")
    nodes = durable(prints.groupBy("fp").agg(F.min("doc_id").alias("node"), F.count("*").alias("n")), "nodes")
    roots = components(fingerprint_links(nodes.where("node is not null").select("node", "fp"), radius))
    named = nodes.join(roots, "node", "left").select("fp", "n", F.coalesce("root", "node").alias("component_id"))
    # a fingerprint of very many documents goes to them by broadcast: there are at most HOT of these
    hot = F.broadcast(named.where(F.col("n") > prints.count() / HOT).select("fp", F.struct("component_id").alias("hot")))
    found = prints.join(hot, "fp", "left")
    rest = found.where("hot is null").select("doc_id", "fp").join(named.select("fp", "component_id"), "fp")
    return found.where("hot is not null").select("doc_id", "fp", "hot.component_id").unionByName(rest.select("doc_id", "fp", "component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each component stays: the row of its smallest doc_id. Columns are those of docs, all of them kept.
    Texts without words form one group like any other. Of several rows of one doc_id the one with the smallest text
    (null first), then the smallest hash of the whole row, stays. Rows without a doc_id can't be named and all stay.
    """
    own, key = fresh(docs, "own"), fresh(docs, "id")
    ids = near_duplicates(docs).where("doc_id is not null").groupBy("doc_id").agg(F.min("component_id").alias("c"), F.count("*").alias("n"))
    ids = durable(ids.where("c != doc_id or n > 1").select(F.col("doc_id").alias(key), (F.col("c") == F.col("doc_id")).alias(own)), "copies")
    named = docs.withColumn(key, F.col("doc_id").cast("long"))
    once = named.join(ids.select(key), key, "left_anti").select(*docs.columns)
    # ids with several rows, few as a rule: one row of each
    several = named.join(ids.where(own).select(key), key, "left_semi")
    order = F.struct(F.col("text").isNotNull(), F.coalesce("text", F.lit("")), F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in docs.columns]))
    one = several.groupBy(key).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), order).alias(own))
    return once.unionByName(one.select(f"{own}.*"))
