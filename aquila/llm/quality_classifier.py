"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Every word, and every shape of words, has a fixed sparse index vector; its vector is the sum of the index vectors of what
stands about it in the whole corpus. Words share a fixed number of vectors by hash, so in a large vocabulary a vector is that
of a few words. A document's features are the mean and spread of its words' and shapes' vectors. The network is trained on labelled
documents and its logits are scaled by a temperature fitted on documents that training has not seen.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aquila.llm.batches import map_chunks, trim
from aquila.llm.tables import load, ship

#: Words share WORD_ROWS vectors by hash and shapes SHAPE_ROWS, however large the vocabulary; numbers of a vector; non-zero
#: entries of an index vector.
WORD_ROWS, SHAPE_ROWS, DIM, NONZERO = 1 << 15, 1 << 12, 32, 2
ROWS = WORD_ROWS + SHAPE_ROWS
#: Labelled documents that the network is fitted on, at most, those of least hash. Everything else covers all documents.
FIT_ROWS = 20_000
HIDDEN, EPOCHS, BATCH, RATE, SEED = 24, 40, 128, 5e-3, 11
#: Groups of rows that the sums of all tasks are added in.
BLOCKS = 256
#: Words that a worker remembers, of at most so many bytes.
REMEMBERED, LONG_WORD = 50_000, 100
#: Bytes of text handled at once; a longer text is handled in pieces.
PIECE = 1 << 17
_SHAPE = bytes(ord("A") if 65 <= c <= 90 else ord("0") if 48 <= c <= 57 else ord("a") if 97 <= c <= 122 or c >= 128 else c for c in range(256))
_RUN, _WHITE = re.compile(rb"([Aa0])\1+"), re.compile(rb"[ \t-\r]")


def shape(word: bytes) -> bytes:
    """A word with runs of capitals, small letters and digits as one A, a and 0: Ab12!! is Aa0!!."""
    return _RUN.sub(rb"\1", word.translate(_SHAPE))


def rows_of(word: bytes) -> tuple[int, int]:
    """Rows of a word in small letters and of its shape."""
    return zlib.crc32(word.lower()) % WORD_ROWS, WORD_ROWS + zlib.crc32(shape(word)) % SHAPE_ROWS


class Vocabulary(dict):
    """Rows of words, packed into one number."""

    def __missing__(self, word: bytes) -> int:
        row, form = rows_of(word)
        packed = row << 32 | form
        if len(word) <= LONG_WORD:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = packed
        return packed


_vocabulary = Vocabulary()


def word_pieces(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Words of all texts in turn, a bounded number at once: their rows, their shapes' rows, and their texts' numbers. Where
    a text is cut depends on it alone."""

    def coded(parts: list[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        words = [p.split() for _, p in parts]
        counts = np.fromiter(map(len, words), np.int64, len(words))
        packed = np.fromiter((_vocabulary[w] for ws in words for w in ws), np.int64, int(counts.sum()))
        return packed >> 32, packed & 0xFFFFFFFF, np.repeat(np.array([i for i, _ in parts], np.int64), counts)

    group, size = [], 0
    for i, text in enumerate(texts):
        raw = memoryview(text.as_buffer()) if text.is_valid else b""
        if size + len(raw) > PIECE and group:
            yield coded(group)
            group, size = [], 0
        if len(raw) <= PIECE:
            group.append((i, bytes(raw)))
            size += len(raw)
            continue
        start = 0
        while start < len(raw):
            white = _WHITE.search(raw, start + PIECE)
            end = white.end() if white else len(raw)
            yield coded([(i, bytes(raw[start:end]))])
            start = end
    if group:
        yield coded(group)


def index_vectors() -> np.ndarray:
    """Of each row the places of its index vector's entries: 2 * place, and 1 more where the entry is negative."""
    return np.random.default_rng(SEED).integers(0, 2 * DIM, (ROWS, NONZERO))


def add_contexts(total: np.ndarray, places: np.ndarray, texts: pa.Array) -> None:
    """Adds to the ROWS x 2 DIM counters what stands about each word and shape of the texts: a word's own shape, the next
    and the last word, and a shape's next and last shape, next word and, of words, the last shape."""
    last = None
    for word, form, text in word_pieces(texts):
        if last is not None:
            word, form, text = (np.concatenate([x, y]) for x, y in zip(last, (word, form, text)))
        same = np.flatnonzero(text[1:] == text[:-1])
        first = 0 if last is None else 1  # the word of before has met its shape
        pairs = [(word[first:], form[first:]), (word[same], word[same + 1]), (form[same], form[same + 1]), (form[same], word[same + 1])]
        bins = [x * (2 * DIM) + places[y, k] for a, b in pairs for x, y in ((a, b), (b, a)) for k in range(NONZERO)]
        total += np.bincount(np.concatenate(bins), minlength=len(total))
        last = (word[-1:], form[-1:], text[-1:]) if len(word) else last


def count_contexts(docs: DataFrame) -> np.ndarray:
    """Word vectors of the corpus, ROWS x DIM: each task sums its own, then blocks of rows are summed over tasks."""
    ship(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = index_vectors()
        total = np.zeros(ROWS * 2 * DIM, np.int64)
        for batch in batches:
            add_contexts(total, places, batch.column(0))
        if total.any():
            total = (total[::2] - total[1::2]).astype("<i4" if len(total) < 1 << 31 and np.abs(total).max() < 1 << 31 else "<i8")
            yield pa.record_batch([pa.array(range(BLOCKS), pa.int32()), pa.array([total.dtype.char.encode() + zlib.compress(b.tobytes(), 1) for b in np.split(total, BLOCKS)], pa.binary())], ["block", "sums"])
        trim()

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(ROWS * DIM // BLOCKS, np.int64)
        for b in batches:
            for raw in b.column(1).to_pylist():
                total += np.frombuffer(zlib.decompress(raw[1:]), raw[:1].decode())
        yield pa.record_batch([pa.array([key[0].as_py()], pa.int32()), pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], ["block", "sums"])

    out = np.zeros((BLOCKS, ROWS * DIM // BLOCKS))
    for r in docs.select("text").mapInArrow(run, "block int, sums binary").groupBy("block").applyInArrow(add, "block int, sums binary").collect():  # BLOCKS rows
        out[r["block"]] = np.frombuffer(zlib.decompress(r["sums"]), np.int64)
    vectors = out.reshape(ROWS, DIM)
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    return (vectors / np.maximum(length, 1e-9)).astype(np.float32)


def pool(texts: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """For each text the mean and the spread of its words' and shapes' vectors, and its length and mean's length."""
    n, sums = np.zeros(len(texts)), np.zeros((len(texts), 2 * DIM))
    for word, form, text in word_pieces(texts):
        if not len(word):
            continue
        kinds, which = np.unique(word * ROWS + form, return_inverse=True)
        a, b = vectors[kinds // ROWS], vectors[kinds % ROWS]
        own = np.concatenate([a + b, a * a + b * b], axis=1)
        starts = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
        sums[text[starts]] += np.add.reduceat(own[which], starts, axis=0, dtype=np.float64)
        n[text[starts]] += 2 * np.diff(np.append(starts, len(word)))
    out = np.zeros((len(texts), 2 * DIM + 2), np.float32)
    used = np.flatnonzero(n)
    mean, square = np.split(sums[used] / n[used, None], 2, axis=1)
    out[used, :DIM] = mean
    out[used, DIM : 2 * DIM] = np.sqrt(np.maximum(square - mean * mean, 0))
    out[used, -2] = np.log1p(n[used])
    out[used, -1] = np.linalg.norm(mean, axis=1)
    return out


@dataclass
class Network:
    centre: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.centre) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def train(x: np.ndarray, y: np.ndarray) -> Network:
    """Adam on the cross-entropy of four fifths of the rows; the temperature is fitted on the last fifth."""
    rng = np.random.default_rng(SEED)
    width = x.shape[1]
    centre, scale = x.mean(0), x.std(0) + 1e-3
    p = [rng.normal(0, width**-0.5, (width, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    order = rng.permutation(len(x))
    fit, calibrate = order[len(x) // 5 :], order[: len(x) // 5]
    z = (x - centre) / scale
    m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(EPOCHS):
        rng.shuffle(fit)
        for i in range(0, len(fit), BATCH):
            xb, yb = z[fit[i : i + BATCH]], y[fit[i : i + BATCH]]
            h = np.tanh(xb @ p[0] + p[1])
            d = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -40, 40))) - yb) / len(xb)
            back = np.outer(d, p[2]) * (1 - h * h)
            grads = [xb.T @ back + 1e-4 * p[0], back.sum(0), h.T @ d + 1e-4 * p[2], d.sum(keepdims=True)]
            t += 1
            for a, g, mm, vv in zip(p, grads, m, v):
                mm += 0.1 * (g - mm)
                vv += 0.001 * (g * g - vv)
                a -= RATE * (mm / (1 - 0.9**t)) / (np.sqrt(vv / (1 - 0.999**t)) + 1e-8)
    net = Network(centre, scale, p[0], p[1], p[2], float(p[3][0]))
    if len(calibrate):
        logits, target = net.logits(x[calibrate]), y[calibrate]
        loss = lambda k: np.logaddexp(0, -np.where(target > 0.5, logits, -logits) / k).mean()
        net.temperature = float(min(np.geomspace(0.5, 8, 60), key=loss))
    return net


@dataclass
class Constant:
    score: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.score)


def held_out(id_col: str) -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, Network | Constant]:
    """Word vectors of all ``docs``, and a network fitted on at most FIT_ROWS labelled rows that are not held out."""
    vectors = count_contexts(docs)
    chosen = (
        labels.where("doc_id is not null and quality is not null").where(~held_out("doc_id"))
        .groupBy("doc_id").agg(F.max("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS)
    )
    texts = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "text")  # at most FIT_ROWS ids and labels

    def features(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = pool(batch.column(2), vectors)
        return pa.record_batch([batch.column(0), batch.column(1), pa.array(list(x), pa.list_(pa.float32()))], ["doc_id", "quality", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = map_chunks(texts, "text", f"doc_id {kind}, quality int, x array<float>", lambda: features).groupBy("doc_id").agg(F.first("quality").alias("quality"), F.min("x").alias("x")).toPandas()
    y = rows["quality"].to_numpy(np.float64)
    if len(y) < 10 or y.min() == y.max():
        return vectors, Constant(float(y.mean()) if len(y) else 0.5)
    x = np.array(rows["x"].tolist(), np.float64)
    order = np.lexsort((*x.T, y))  # rows arrive in any order
    return vectors, train(x[order], y[order])


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out (crc32 of the id as text is divisible by 5), score (0 to 1, higher:
    label 1 likelier), predicted (1 from ``threshold`` on).

    ``labels``: doc_id, quality (0 or 1); null ids and labels are left out, of several labels of an id the largest
    counts. With fewer than 10 labelled documents, or one class alone, every score is the mean label, or 0.5 without
    any. Null and empty texts are scored from features of 0; a null id is not held out; repeated rows each get a row;
    an empty table gives an empty table; other columns are ignored.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    vectors, network = fit(docs, labels.select("doc_id", F.col("quality").cast("int").alias("quality")))
    held = docs.select("doc_id", "text", held_out("doc_id").alias("held_out"))

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        s = network.scores(pool(batch.column(1), vectors)).astype(np.float64)
        return pa.record_batch([batch.column(0), batch.column(2), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_chunks(held, "text", f"doc_id {kind}, held_out boolean, score double, predicted int", lambda: step)


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, with all their columns, that score_quality gives ``threshold`` or more, in one pass."""
    vectors, network = fit(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), labels.select("doc_id", F.col("quality").cast("int").alias("quality")))

    def step(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        texts = batch.column(batch.schema.get_field_index(text_col))
        kept = np.flatnonzero(network.scores(pool(texts, vectors)) >= threshold)
        return batch.take(pa.array(kept)) if len(kept) else None

    return map_chunks(docs, text_col, docs.schema, lambda: step)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
