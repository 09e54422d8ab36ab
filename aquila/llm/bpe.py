"""Byte-level BPE encoding and decoding with numpy.

Distinct pieces of text are encoded together in matrices, one row a piece, grouped by length. Each round every row merges
its leftmost pair of least rank, and the matrix is compacted by the column that each row has lost.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from aquila.llm.batches import map_chunks
from aquila.llm.tables import load

NONE = np.int32(2**31 - 1)
#: Pieces of more bytes are merged by a heap, as rounds over them would take quadratic time.
LONG = 192
#: Distinct pieces that a worker remembers.
REMEMBERED = 150_000
#: White space, letters and numbers up to U+00FF, for which re is faster than regex and gives the same pieces.
LATIN = {r"\s": "\t\n\x0b\x0c\r \x85\xa0", r"\p{L}": "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", r"\p{N}": "0-9\xb2\xb3\xb9\xbc-\xbe"}


def latin_pattern(pattern: str) -> str | None:
    """``pattern`` with its classes spelled out, or None if it has others."""
    inside = re.sub(r"\[(\^?)((?:\\s|\\p\{[LN]\})+)\]", lambda m: f"[{m[1]}{''.join(LATIN[x] for x in re.findall(r'\\s|\\p{.}', m[2]))}]", pattern)
    out = re.sub(r"\\s|\\p\{[LN]\}", lambda m: f"[{LATIN[m[0]]}]", inside).replace(r"\S", f"[^{LATIN[r'\s']}]")
    return None if "\\" in out else out


class PairTable:
    """Rank of a pair of ids by open addressing; a pair has a rank if its joined bytes are a token."""

    def __init__(self, ranks: dict[bytes, int]):
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.pairs = pairs
        self.bits = max(4, (8 * len(pairs)).bit_length())
        keys = np.fromiter(pairs, np.int64, len(pairs))
        values = np.fromiter(pairs.values(), np.int32, len(pairs))
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int32)
        self.probes, left, slot = 0, np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.keys[slot] == -1
            self.keys[slot[free]] = keys[left[free]]  # of several that meet in a slot the last stays
            placed = self.keys[slot] == keys[left]
            self.values[slot[placed]] = values[left[placed]]
            left, slot = left[~placed], (slot[~placed] + 1) & (len(self.keys) - 1)
            self.probes += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """NONE where there is no such pair, or either id is -1."""
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        keys[(left < 0) | (right < 0)] = -2
        slot = self._slot(keys)
        out = np.full(keys.shape, NONE, np.int32)
        open_ = np.arange(keys.size)
        flat, slot, found = keys.ravel(), slot.ravel(), out.ravel()
        for _ in range(self.probes):
            here = self.keys[slot]
            hit = here == flat[open_]
            found[open_[hit]] = self.values[slot[hit]]
            go_on = ~hit & (here != -1)
            open_, slot = open_[go_on], (slot[go_on] + 1) & (len(self.keys) - 1)
            if not len(open_):
                break
        return found.reshape(keys.shape)


class Codec:
    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.table = PairTable(self.ranks)
        self.any_split = regex.compile(pattern).findall
        self.latin_split = re.compile(latin).findall if (latin := latin_pattern(pattern)) else self.any_split
        self.numbers = list(range(max(self.tokens) + 1))  # so that equal ids are one object
        self.digits = list(map(str, self.numbers))
        self.known: dict[str, tuple[int, ...]] = {}
        self.written: dict[str, str] = {}

    def _merge_rows(self, rows: list[bytes]) -> list[tuple[int, ...]]:
        """Rows padded to the longest with -1. A gather drops a row's merged column and the rows that are done at once."""
        number, width = self.numbers, max(map(len, rows))
        lengths = np.fromiter(map(len, rows), np.int64, len(rows))
        ids = np.full((len(rows), width), -1, np.int32)
        ids[np.arange(width) < lengths[:, None]] = self.byte_ids[np.frombuffer(b"".join(rows), np.uint8)]
        even = bool((lengths == width).all())
        out: list[tuple[int, ...]] = [()] * len(rows)
        at = np.arange(len(rows))
        ranks = self.table.ranks(ids[:, :-1], ids[:, 1:])
        while True:
            n, width = ids.shape
            if width > 1:
                where = ranks.argmin(axis=1)
                least = ranks.ravel()[where + np.arange(0, n * (width - 1), width - 1)]
                on = np.flatnonzero(least != NONE)
            else:
                on = at[:0]
            if len(on) < n:
                done = np.ones(n, bool)
                done[on] = False
                for row, i in zip(ids[done].tolist(), at[done].tolist()):
                    out[i] = tuple([number[x] for x in row if even or x >= 0])
                if not len(on):
                    return out
                at, where, least = at[on], where[on], least[on]
            column = np.arange(width - 1)
            r = np.arange(len(on))
            ids = ids.ravel()[(on * width)[:, None] + (column + (column > where[:, None]))]
            ids[r, where] = least
            column = column[:-1]
            ranks = ranks.ravel()[(on * (width - 1))[:, None] + (column + (column >= where[:, None]))]
            # the ranks on both sides of the new token
            left, right = np.flatnonzero(where > 0), np.flatnonzero(where < width - 2)
            rows_, cols = np.concatenate([left, right]), np.concatenate([where[left] - 1, where[right]])
            ranks[rows_, cols] = self.table.ranks(ids[rows_, cols], ids[rows_, cols + 1])

    def _merge_long(self, piece: bytes) -> tuple[int, ...]:
        """The same merges in the same order, by a heap of (rank, position) over a linked list."""
        pairs = self.table.pairs
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(rank, i) for i in range(n - 1) if (rank := pairs.get(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            if not alive[i] or (j := after[i]) >= n or pairs.get(ids[i] << 32 | ids[j]) != rank:
                continue
            ids[i], alive[j], after[i] = rank, False, after[j]
            if after[j] < n:
                before[after[j]] = i
                if (x := pairs.get(rank << 32 | ids[after[j]])) is not None:
                    heapq.heappush(heap, (x, i))
            if (h := before[i]) >= 0 and (x := pairs.get(ids[h] << 32 | rank)) is not None:
                heapq.heappush(heap, (x, h))
        return tuple(x for x, a in zip(ids, alive) if a)

    def split(self, text: str) -> list[str]:
        if not text.isascii():
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return self.any_split(text)
        return self.latin_split(text)

    def learn(self, pieces: set[str]) -> None:
        new = pieces.difference(self.known)
        if len(self.known) + len(new) > REMEMBERED:  # what these texts use stays
            self.known = {p: self.known[p] for p in pieces - new}
            self.written = {p: self.written[p] for p in pieces - new}
        pieces = new
        buckets: dict[int, list[tuple[str, bytes]]] = {}
        whole, known = self.ranks.get, self.known
        for p in pieces:
            raw = p.encode()
            if (rank := whole(raw)) is not None:
                known[p] = (rank,)
            elif (n := len(raw)) > LONG:
                known[p] = self._merge_long(raw)
            else:
                buckets.setdefault(n if n <= 24 else 24 + -(-n // 24), []).append((p, raw))
        for group in buckets.values():
            for i in range(0, len(group), 20_000):
                names, raws = zip(*group[i : i + 20_000])
                known.update(zip(names, self._merge_rows(raws)))
        digits, written = self.digits, self.written
        for p in pieces:
            written[p] = " ".join([digits[x] for x in known[p]])

    def encode(self, texts: list[str]) -> list[list[str]]:
        """The pieces of each text; ``known`` has their ids until the next call."""
        split = [self.split(t) for t in texts]
        self.learn(set(chain.from_iterable(split)))
        return split

    def ids(self, pieces: list[str]) -> list[int]:
        return list(chain.from_iterable(map(self.known.__getitem__, pieces)))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=1)
def codec(path: str, pattern: str) -> Codec:
    """One a worker."""
    return Codec(path, pattern)


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id and ids (array<int>) of each row; null and empty texts have no ids. Ids and copies may repeat, a null id stays,
    an empty table gives an empty table, and other columns are ignored. ``path`` must be readable on every executor."""
    path, pattern = path or default_vocabulary()[0], pattern or default_vocabulary()[1]

    def start():
        own = codec(path, pattern)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            split = own.encode([t or "" for t in batch.column(1).to_pylist()])
            return pa.record_batch([batch.column(0), pa.array([own.ids(p) for p in split], pa.list_(pa.int32()))], ["doc_id", "ids"])

        return step

    kind = docs.schema[id_col].dataType.simpleString()
    return map_chunks(docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")), "text", f"doc_id {kind}, ids array<int>", start)


def decode(encoded: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id and bytes (binary) of rows of ``encode``; null ids give no bytes."""
    path, pattern = path or default_vocabulary()[0], pattern or default_vocabulary()[1]

    def run(batches):
        own = codec(path, pattern)
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([own.decode(ids or []) for ids in b.column(1).to_pylist()], pa.binary())], ["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, bytes binary")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Encodes each text, decodes its ids, and gives doc_id, n_tokens, ids_sha256 and decoded_sha256; the ids stay in the
    worker. Nulls, repeats, empty tables and other columns are treated as in ``encode``."""
    path, pattern = path or default_vocabulary()[0], pattern or default_vocabulary()[1]
    sha = lambda raw: hashlib.sha256(raw).hexdigest()

    def start():
        own = codec(path, pattern)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            n, ids_sha, text_sha = [], [], []
            for pieces in own.encode([t or "" for t in batch.column(1).to_pylist()]):
                ids = own.ids(pieces)
                n.append(len(ids))
                ids_sha.append(sha(" ".join(map(own.written.__getitem__, pieces)).encode()))
                text_sha.append(sha(own.decode(ids)))
            return pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

        return step

    kind = docs.schema[id_col].dataType.simpleString()
    return map_chunks(docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")), "text", f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string", start)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(load(spark, sf_dir, "documents"))
