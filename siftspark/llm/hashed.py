"""Hashed features of whole texts with numpy, many texts at a time."""

from __future__ import annotations

import numpy as np

from siftspark.llm.common import Powers, chunks_of, utf8

_GAP = np.uint64(0x9E3779B97F4A7C15)
#: Of each byte: 0 white space, 1 a word's, 2 another sign.
_CLASS = np.full(256, 2, np.uint8)
_CLASS[[32, *range(9, 14)]] = 0
_CLASS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1


def _joined(texts: list, keep: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes with a space around each text, and where each text starts."""
    raw = [b" " + utf8(texts[k].lower()) + b" " for k in keep]
    return np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(x) for x in raw])]


def subwords(texts: list, bits: int):
    """Yields (positions in texts, offsets, buckets): byte trigrams and tetragrams of the i-th text of a chunk are
    buckets[offsets[i]:offsets[i + 1]]. Texts that are null are left out."""
    live = [k for k, t in enumerate(texts) if t]
    for got in chunks_of([texts[k] for k in live], 1 << 19):
        keep = [live[k] for k in got]
        data, starts = _joined(texts, keep)
        pad = np.concatenate([data, np.full(3, 32, np.uint8)]).astype(np.uint64)
        n = len(data)
        three = pad[:n] << np.uint64(16) | pad[1 : n + 1] << np.uint64(8) | pad[2 : n + 2]
        four = three << np.uint64(8) | pad[3 : n + 3] | np.uint64(1 << 40)
        out = np.empty(2 * n, np.int32)
        out[0::2] = three * _GAP >> np.uint64(64 - bits)
        out[1::2] = four * _GAP >> np.uint64(64 - bits)
        yield keep, 2 * starts, out


def words(texts: list, bits: int):
    """Like subwords(), with the words, the runs of other signs and the pairs of neighbours among them; texts of white
    space alone are left out."""
    powers = Powers()
    live = [k for k, t in enumerate(texts) if t]
    for got in chunks_of([texts[k] for k in live], 1 << 19):
        keep = [live[k] for k in got]
        data, starts = _joined(texts, keep)
        kind = _CLASS[data]
        edge = np.flatnonzero(kind[1:] != kind[:-1]) + 1
        token = kind[edge[:-1]] > 0 if len(edge) else np.zeros(0, bool)
        a, b = edge[:-1][token], edge[1:][token]
        if not len(a):
            continue
        h = powers.hashes(powers.prefix(data), a, b)
        pair = h * _GAP ^ np.r_[h[1:], h[:1]]
        out = np.empty(2 * len(h), np.int32)
        out[0::2] = h >> np.uint64(64 - bits)
        out[1::2] = pair * _GAP >> np.uint64(64 - bits)
        offsets = 2 * np.searchsorted(a, starts)
        some = np.flatnonzero(np.diff(offsets))
        out = np.delete(out, offsets[some + 1] - 1)  # a pair across two texts
        offsets = offsets - np.r_[0, np.cumsum(np.diff(offsets) > 0)]
        yield [keep[k] for k in some], np.r_[offsets[some], offsets[-1]], out


def counted(buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets and their shares."""
    got, n = np.unique(buckets, return_counts=True)
    return got, n / len(buckets)
