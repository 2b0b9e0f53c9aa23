"""Exact removal of long repeated substrings over a whole corpus, decided by suffix arrays.

1. Each document is cut into runs of window starts that share the window's minimiser (the leftmost smallest hash of a
   gram), an anchor that depends on the window's content alone: equal windows have equal anchors at equal places.
2. Runs whose anchor occurs nowhere else are done with. Runs whose whole content (by a 128-bit digest of its bytes)
   occurs twice are repeated as they are. Where an anchor has runs of several contents, one run of each content goes on:
   the text around their anchor, dealt by `RANGE` offsets, becomes a short context around a core that all windows of the
   offsets share.
3. For each core that occurs twice a generalised suffix array over its distinct contexts is built by linear grouping
   (suffix_array); neighbours that share a whole window mark it as repeated.
4. The windows' bytes are joined to spans and removed in one pass over the documents.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftspark.llm.common import Powers, chunks_of, durable, forget, join_counted, utf8

WINDOW, GRAM, RANGE = 400, 100, 32
#: A core with more distinct contexts than this is no single task's suffix array: its windows are dealt by their bytes
#: and counted, which is the same decision in an exact split.
CROWD = 2000


def suffix_array(s: list[int]) -> list[int]:
    """Suffix array of a list of integers by grouping, without recursion or renaming.

    Suffixes start in groups by their first symbol. Groups are taken in descending order; each member's
    previous-smaller pointer names the suffix whose prefix the group's prefix extends, and those suffixes move to a
    new group just above their old one, the more repetitions the higher. At the end a group holds the suffixes with
    one Lyndon prefix. The second pass emits suffixes in ascending order: a placed suffix places, at the front of
    their groups, those whose next smaller suffix it is.
    """
    n = len(s)
    sa = sorted(range(n), key=s.__getitem__)
    pos, group, size, prev = [0] * n, [0] * n, [0] * n, [-1] * n
    start = 0
    for k, i in enumerate(sa):
        if s[i] != s[sa[start]]:
            start = k
        pos[i], group[i] = k, start
        size[start] += 1
    end = n
    while end:
        start = group[sa[end - 1]]
        found: dict[int, int] = {}
        if end - start == 1:
            i = sa[start]
            j = i - 1
            while j >= 0 and group[j] >= start:
                j = prev[j]
            prev[i] = j
            if j >= 0:
                found[j] = 1
        else:
            for i in sorted(sa[start:end]):
                j = i - 1
                while j >= 0 and group[j] >= start:
                    j = prev[j]
                prev[i] = j
                if j >= 0:
                    found[j] = found.get(j, 0) + 1
        moves: dict[tuple[int, int], list[int]] = {}
        for j, times in found.items():
            moves.setdefault((-times, group[j]), []).append(j)
        for (_, g), members in sorted(moves.items()) if len(moves) > 1 else moves.items():
            top = g + size[g]
            new = top - len(members)
            if new == g:
                continue
            for j in members:
                top -= 1
                p, other = pos[j], sa[top]
                sa[p], pos[other] = other, p
                sa[top], pos[j] = j, top
                group[j] = new
            size[new] = len(members)
            size[g] -= len(members)
        end = start
    out = [0] * n
    front = list(range(n))
    j = n - 1
    while j != -1:
        out[front[group[j]]] = j
        front[group[j]] += 1
        j = prev[j]
    for at in range(n):
        i = out[at]
        j, stop = i - 1, prev[i]
        while j != stop:
            g = group[j]
            out[front[g]] = j
            front[g] += 1
            j = prev[j]
    return out


def common_prefixes(s: list[int], sa: list[int]) -> list[int]:
    """At k: how many symbols suffixes sa[k - 1] and sa[k] share; 0 first."""
    n = len(s)
    rank, out, h = [0] * n, [0] * n, 0
    for k, i in enumerate(sa):
        rank[i] = k
    for i in range(n):
        k = rank[i]
        if k:
            j = sa[k - 1]
            m = n - max(i, j)
            while h < m and s[i + h] == s[j + h]:
                h += 1
            out[k] = h
            h -= h > 0
        else:
            h = 0
    return out


def repeated_starts(contexts: list[list[int]], window: int) -> list[int]:
    """For each list of symbols, a bit mask of the starts of windows that start anywhere else in them as well."""
    s, owner, at, top = [], [], [], 1 << 40
    for k, c in enumerate(contexts):
        s += c
        s.append(top + k)  # separators differ
        owner += [k] * (len(c) + 1)
        at += range(len(c) + 1)
    sa = suffix_array(s)
    lcp = common_prefixes(s, sa)
    out = [0] * len(contexts)
    for k in range(1, len(s)):
        if lcp[k] >= window:
            for i in (sa[k - 1], sa[k]):
                out[owner[i]] |= 1 << at[i]
    return out


def anchored_runs(data: np.ndarray, starts: np.ndarray, powers: Powers, window: int = WINDOW, gram: int = GRAM):
    """data: bytes of several documents, the k-th at starts[k]:starts[k + 1]. Yields arrays: document, anchor, first
    and last window start (relative to the document), anchor hash, and first and last byte of the run's whole content
    in data. The hash only names anchors: runs that it takes for one anchor are still told apart by their bytes."""
    n = len(data) - window + 1
    if n <= 0:
        return None
    prefix = powers.prefix(data)
    i = np.arange(len(data) - gram + 1)
    bits = max(20, int(len(i)).bit_length())
    key = powers.hashes(prefix, i, i + gram) >> np.uint64(bits) << np.uint64(bits) | i.astype(np.uint64)
    width, reach = window - gram + 1, 1
    least = key
    while 2 * reach <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < width:
        least = np.minimum(least[: n], least[width - reach :][: n])
    anchor = (least[:n] & np.uint64((1 << bits) - 1)).astype(np.int64)
    doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))[:n]
    ok = i[:n] + window <= starts[1:][doc]
    fresh = np.r_[True, (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])]
    first = np.flatnonzero(fresh & ok)
    if not len(first):
        return None
    stops = np.flatnonzero(np.r_[fresh[1:] | (ok[:-1] & ~ok[1:]), True])
    last = stops[np.searchsorted(stops, first)]
    d, a = doc[first], anchor[first]
    return d, a - starts[d], first - starts[d], last - starts[d], powers.hashes(prefix, a, a + gram), first, last + window


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(id, key, text): key tells the rows of one id with several texts apart."""
    return docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(-(2**63))).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).select("id", F.xxhash64("text").alias("key"), "text")


def _runs(base: DataFrame, window: int) -> DataFrame:
    """(id, key, place, h, whole): place holds the first window start, how many follow, and how far on the anchor is;
    whole is a 128-bit digest of the run's bytes."""

    def find(frames):
        powers, digest = Powers(), xxhash.xxh3_128_digest
        for part in frames:
            texts = [utf8(t) for t in part["text"]]
            ids, keys = part["id"].to_numpy(), part["key"].to_numpy()
            long = [k for k, t in enumerate(texts) if len(t) >= window]
            for got in chunks_of([texts[k] for k in long]):
                own = np.array([long[k] for k in got])
                starts = np.r_[0, np.cumsum([len(texts[k]) for k in own])]
                joined = b"".join(texts[k] for k in own)
                runs = anchored_runs(np.frombuffer(joined, np.uint8), starts, powers, window)
                if runs is not None:
                    d, a, p, q, h, begin, end = runs
                    place, view = p.astype(np.int64) << 32 | (q - p) << 16 | (a - p), memoryview(joined)
                    whole = [digest(view[x:y]) for x, y in zip(begin.tolist(), end.tolist(), strict=True)]
                    yield pd.DataFrame({"id": ids[own[d]], "key": keys[own[d]], "place": place, "h": h.view(np.int64), "whole": whole})

    return base.where(F.octet_length("text") >= window).mapInPandas(find, "id long, key long, place long, h long, whole binary")


def _contexts(open_runs: DataFrame, base: DataFrame, window: int) -> DataFrame:
    """(core, l, r, id, key, at): the bytes left and right of a core, and where in the document they start."""
    wanted = open_runs.groupBy("id", "key").agg(F.collect_set("place").alias("runs"))

    def cut(frames):
        digest = xxhash.xxh3_128_digest
        for part in frames:
            out = []
            for i, key, text, runs in zip(part["id"], part["key"], part["text"], part["runs"], strict=False):
                t = utf8(text)
                for x in runs.tolist():
                    p = x >> 32
                    q, a = p + (x >> 16 & 0xFFFF), p + (x & 0xFFFF)
                    for s0 in range((a - q) // RANGE * RANGE, a - p + 1, RANGE):
                        low, high = max(s0, a - q), min(s0 + RANGE - 1, a - p)
                        begin, end = a - s0, a - s0 - RANGE + 1 + window
                        core = digest(t[begin:end], s0 & 0xFFFF)
                        out.append((core, t[a - high : begin], t[end : a - low + window], i, key, a - high))
            yield pd.DataFrame(out, columns=["core", "l", "r", "id", "key", "at"])

    return base.join(wanted, ["id", "key"]).select("id", "key", "text", "runs").mapInPandas(cut, "core binary, l binary, r binary, id long, key long, at int")


def _decided(contexts: DataFrame, window: int) -> DataFrame:
    """(id, key, p, q): runs of window starts that are repeated, by the contexts of each core."""
    distinct = contexts.groupBy("core", "l", "r").agg(F.count("*").alias("n"))
    total = contexts.count()
    cores = distinct.groupBy("core").agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).where("n > 1")
    few, many = cores.where(F.col("kinds") <= CROWD).select("core", "n"), cores.where(F.col("kinds") > CROWD).select("core", "n")

    def sort(frames):
        rest = None
        for part in frames:
            part = part if rest is None else pd.concat([rest, part], ignore_index=True)
            if not len(part):
                continue
            core = part["core"].tolist()
            cut = next((k + 1 for k in range(len(core) - 2, -1, -1) if core[k] != core[-1]), 0)
            rest = part.iloc[cut:]
            if cut:
                yield _masks(part.iloc[:cut])
        if rest is not None and len(rest):
            yield _masks(rest)

    ask = join_counted(distinct, few, ["core"], total).repartition("core").sortWithinPartitions("core")
    masks = ask.mapInPandas(sort, "core binary, l binary, r binary, mask long, n long")
    marked = join_counted(contexts, durable(masks.where("mask != 0"), "masks"), ["core", "l", "r"], total)
    bits = F.expr(f"filter(sequence(0, {RANGE - 1}), k -> (shiftright(mask, k) & 1) = 1)")
    one = marked.select("id", "key", F.explode(bits).alias("k"), "at").select("id", "key", (F.col("at") + F.col("k")).alias("p"))
    # a crowd: each window by itself, named by its core, its bytes left and right and its place
    crowd = join_counted(contexts, many, ["core"], total).select("core", "l", "r", "id", "key", "at", F.explode(F.sequence(F.lit(0), F.octet_length("l") + F.octet_length("r") - (RANGE - 1))).alias("k"))
    left = F.expr("substring(l, k + 1, octet_length(l))")
    crowd = crowd.select("core", left.alias("x"), F.expr(f"substring(r, 1, {RANGE - 1} - octet_length(l) + k)").alias("y"), "id", "key", (F.col("at") + F.col("k")).alias("p"))
    twice = crowd.groupBy("core", "x", "y").agg(F.count("*").alias("n")).where("n > 1")
    return one.unionByName(join_counted(crowd, twice, ["core", "x", "y"], RANGE * total).select("id", "key", "p"))


def _masks(part: pd.DataFrame) -> pd.DataFrame:
    """part: whole cores, sorted. A suffix array for about 20 000 symbols at a time."""
    lefts, rights, cores, n = part["l"].tolist(), part["r"].tolist(), part["core"].tolist(), part["n"].tolist()
    masks, todo, size, number = [0] * len(cores), [], 0, 255

    def work():
        nonlocal todo, size
        for k, m in zip([k for k, _ in todo], repeated_starts([c for _, c in todo], RANGE), strict=True):
            masks[k] |= m
        todo, size = [], 0

    begin = 0
    for k in range(len(cores)):
        if k and cores[k] != cores[k - 1]:
            begin, number = k, number + 1
            if size > 20_000:
                work()
        if n[k] > 1:  # the same context elsewhere: all of its windows are repeated
            masks[k] = (1 << (len(lefts[k]) + len(rights[k]) - RANGE + 2)) - 1
        if (k > begin or k + 1 < len(cores) and cores[k + 1] == cores[k]):
            todo.append((k, [*lefts[k], number + 1, *rights[k]]))
            size += len(todo[-1][1])
    if todo:
        work()
    return pd.DataFrame({"core": cores, "l": lefts, "r": rights, "mask": np.array(masks, np.int64), "n": n})


def repeated_windows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(id, key, p, q): windows that start at p to q occur elsewhere too; rows may overlap."""
    base = _keyed(docs, doc_id, text)
    every = durable(_runs(base, window), "runs")
    # an anchor that occurs once repeats nothing: its runs go before anything wide is shuffled
    twice, total = every.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), every.count()
    runs = durable(join_counted(every, twice, ["h"], total), "runs")
    forget(every)
    # of one row each: every first() of a group is taken from the row that comes first, and any row of it will do
    one = [F.first(c).alias(c) for c in ("id", "key", "place")]
    kinds = durable(runs.groupBy("h", "whole").agg(F.count("*").alias("n"), *one), "kinds")
    anchors = kinds.groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    open_runs = join_counted(kinds.select("h", "id", "key", "place"), anchors, ["h"], total)
    contexts = durable(_contexts(open_runs.select("id", "key", "place"), base, window), "contexts")
    same = join_counted(runs, kinds.where("n > 1").select("h", "whole", "n"), ["h", "whole"], total)
    p = F.shiftright("place", 32).cast("int")
    same = same.select("id", "key", p.alias("p"), (p + F.shiftright("place", 16).bitwiseAND(F.lit(0xFFFF)).cast("int")).alias("q"))
    return same.unionByName(_decided(contexts, window).select("id", "key", "p", F.col("p").alias("q")))


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Returns (doc_id, kept binary, n_bytes, n_removed, n_spans, kept_sha256) for every row of docs.

    Every byte covered by a `window`-byte string that also starts anywhere else in the table is removed. A null text
    counts as empty; texts under `window` bytes stay whole; rows repeated entirely are copies of each other, so both
    lose what is long enough. Rows with a null doc_id take part like others and keep the null. Strings may be cut
    inside a character, so the kept text is bytes. Other columns are not read.
    """
    base = _keyed(docs, doc_id, text)
    run = F.expr("shiftleft(cast(p as long), 32) + (q - p)")
    spans = repeated_windows(docs, doc_id, text, window).groupBy("id", "key").agg(F.collect_set(run).alias("runs"))

    @F.pandas_udf("kept binary, n_removed long, n_spans long")
    def cut(texts: pd.Series, runs: pd.Series) -> pd.DataFrame:
        out = []
        for text, found in zip(texts, runs, strict=False):
            t = utf8(text)
            if found is None or not len(found):
                out.append((t, 0, 0))
                continue
            begin = np.sort(found)
            end = np.maximum.accumulate((begin >> 32) + (begin & 0xFFFFFFFF)) + window
            begin >>= 32
            fresh = np.r_[True, begin[1:] > end[:-1]]
            begin, end = begin[fresh].tolist(), end[np.r_[fresh[1:], True]].tolist()
            kept = b"".join(t[a:b] for a, b in zip([0, *end], [*begin, len(t)], strict=True))
            out.append((kept, len(t) - len(kept), len(begin)))
        return pd.DataFrame(out, columns=["kept", "n_removed", "n_spans"])

    done = base.join(spans, ["id", "key"], "left").select("id", F.octet_length("text").cast("long").alias("n_bytes"), cut("text", "runs").alias("x"))
    real = F.when(F.col("id") != -(2**63), F.col("id"))
    return done.select(real.alias("doc_id"), "x.kept", "n_bytes", "x.n_removed", "x.n_spans", F.sha2("x.kept", 256).alias("kept_sha256"))
