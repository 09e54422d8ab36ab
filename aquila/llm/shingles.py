"""Sets of word shingles as 64-bit hashes, with numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

from aquila.llm.text import words_of

GOLD, MIX1, MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str | None], n: int) -> list[np.ndarray]:
    """For each text its distinct shingles of ``n`` words as sorted int64; a text of fewer words is one shingle of all, one
    without words has none."""
    words = [words_of(t) for t in texts]
    counts = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(counts)
    coded = pa.array([w for ws in words for w in ws], pa.binary()).dictionary_encode()
    table = np.fromiter(map(xxhash.xxh3_64_intdigest, coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    h = table[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else np.zeros(0, np.uint64)
    rolled = np.zeros(max(0, len(h) - n + 1), np.uint64)
    for k in range(n):
        rolled = mixed(rolled * GOLD + h[k : k + len(rolled)])
    out = []
    for start, end in zip((ends - counts).tolist(), ends.tolist()):
        if end - start >= n:
            own = np.sort(rolled[start : end - n + 1].view(np.int64))
            keep = np.empty(len(own), bool)
            keep[0] = True
            np.not_equal(own[1:], own[:-1], out=keep[1:])
            out.append(own[keep])
        elif end > start:
            short = np.full(1, end - start, np.uint64)
            for k in range(start, end):
                short = mixed(short * GOLD + h[k])
            out.append(short.view(np.int64))
        else:
            out.append(np.zeros(0, np.int64))
    return out


def fingerprint(shingles: np.ndarray) -> int:
    """Of the whole set, as a signed 64-bit number."""
    x = xxhash.xxh3_64_intdigest(shingles.tobytes())
    return x - (1 << 64) if x >> 63 else x
