"""Benchmark decontamination: documents that hold a passage of a benchmark item, word edits allowed.

The CGK embedding walks along a window of words: at each step it puts out the word that it stands on, and a coin that hangs on
the step and that word tells whether it goes on to the next. Walks over two windows that differ by an edit soon stand on the
same words again, so edits become few differing steps. Words at a few steps (a sample) make a key; with several walks, and
windows that begin at each word of an item and of a document, some key of an edited passage agrees with its item's nearly
always. Where keys agree the exact edit distance decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aquila.llm.batches import map_chunks
from aquila.llm.shingles import GOLD, mixed
from aquila.llm.tables import load
from aquila.llm.text import words_of

#: An item is found where at most this share of its words is edited (inserted, deleted or replaced).
EDITS = 0.2
#: By the least words of an item: the steps whose words make a key, and how many walks there are. By simulation (tests/llm holds
#: it) 0.99 and more of passages with the full share of edits are met. Items below EXACT words allow no edit and are met whole.
CLASSES, EXACT = {5: ((0, 2), 8), 8: ((0, 2, 4), 6), 16: ((0, 2, 4, 6, 8), 8)}, 5
#: Words of benchmark items that a task holds at once; a larger benchmark is searched in blocks.
BLOCK_WORDS = 1_000_000


class Searcher:
    """Finds items in documents. items: (item_id, words); those without words are never found."""

    def __init__(self, items: list[tuple[int, list[bytes]]]):
        self.items = [(i, w) for i, w in items if w]
        self.ids: dict[bytes, int] = {}
        for _, words in self.items:
            for w in words:
                self.ids.setdefault(w, len(self.ids) + 1)
        self.pad = len(self.ids) + 1
        self.coded = [np.array([self.ids[w] for w in words], np.int32) for _, words in self.items]
        self.hashes = mixed(np.arange(self.pad + 1, dtype=np.uint64) * GOLD + np.uint64(1))
        sizes = np.array([len(c) for c in self.coded], np.int64)
        self.walks = []
        for least, width, steps, walks in self._schedules(sizes):
            own = np.flatnonzero(sizes == width if width else (sizes >= least) & (sizes < min([c for c in CLASSES if c > least], default=1 << 62)))
            for walk in range(walks):
                self.walks.append(self._index(own, width, steps, walk))

    def _schedules(self, sizes: np.ndarray) -> list[tuple[int, int, tuple[int, ...], int]]:
        """(least words, window's width where it is that of the item, steps, walks) of the classes that have items."""
        exact = [(m, m, tuple(range(2 * m)), 1) for m in range(1, EXACT) if (sizes == m).any()]
        bounds = [*sorted(CLASSES), 1 << 62]
        return exact + [(low, 0, *CLASSES[low]) for low, high in zip(bounds, bounds[1:]) if ((sizes >= low) & (sizes < high)).any()]

    def _coins(self, walk: int) -> np.ndarray:
        """For each word the coins of all steps, a bit each."""
        return (mixed(np.arange(self.pad + 1, dtype=np.uint64) * GOLD + np.uint64(walk + 1)) >> np.uint64(34)).astype(np.int32)

    def _embed(self, words: np.ndarray, width: int, steps: tuple[int, ...], coins: np.ndarray, tables: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Of windows that begin at each known word: the starts, the words walked, and the keys after each step of the sample.
        With tables, only windows that no table rules out are walked to the end, and the last keys are given alone. words end
        with a pad."""
        start = np.flatnonzero((words > 0) & (words < self.pad))
        moved, key, keys = np.zeros(len(start), np.int32), np.zeros(len(start), np.uint64), []
        for t in range(steps[-1] + 1):
            word = words[np.minimum(start + moved, len(words) - 1)]
            if width:
                word = np.where(moved < width, word, self.pad)
            if t in steps:
                key = key * GOLD + self.hashes[word]
                keys.append(key)
                if tables:
                    table = tables[len(keys) - 1]
                    on = np.flatnonzero(table[key >> np.uint64(65 - len(table).bit_length())])
                    start, moved, key, word = start[on], moved[on], key[on], word[on]
            if t < steps[-1]:
                moved = moved + (coins[word] >> t & 1)
        return start, moved, [key] if tables else keys

    def _index(self, own: np.ndarray, width: int, steps: tuple[int, ...], walk: int) -> tuple:
        coins, rows = self._coins(walk), []
        for k in own.tolist():
            start, moved, keys = self._embed(np.append(self.coded[k], np.int32(self.pad)), width, steps, coins)
            # a sample lies in the item, and a walk that hardly moved tells too little
            use = start == 0 if width else (start + moved < len(self.coded[k])) & (moved >= len(steps) - 1)
            rows.append((np.full(use.sum(), k), start[use], [c[use] for c in keys]))
        item, start = (np.concatenate([r[i] for r in rows]) for i in (0, 1))
        keys = [np.concatenate([r[2][j] for r in rows]) for j in range(len(steps))]
        bits = max(12, (16 * len(item)).bit_length())  # most windows fall out by tables of that size
        tables = [np.zeros(1 << bits, bool) for _ in steps]
        for table, c in zip(tables, keys):
            table[c >> np.uint64(64 - bits)] = True
        order = np.argsort(keys[-1], kind="stable")
        return width, steps, coins, tables, keys[-1][order], np.stack([item[order], start[order]], axis=1)

    def candidates(self, words: np.ndarray) -> np.ndarray:
        """Rows (place, start, item): a key of the item agrees at a place, by which an unedited item would begin at start.
        words: of all documents, a pad after each."""
        out = [np.zeros((0, 3), np.int64)]
        for width, steps, coins, tables, keys, owners in self.walks:
            at, _, (own,) = self._embed(words, width, steps, coins, tables)
            low, high = np.searchsorted(keys, own, "left"), np.searchsorted(keys, own, "right")
            counts = high - low
            which = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts - low, counts)
            at = np.repeat(at, counts)
            out.append(np.stack([at, at - owners[which, 1], owners[which, 0]], axis=1))
        return np.concatenate(out)

    def verify(self, item: np.ndarray, region: np.ndarray) -> tuple[int, int, int]:
        """Least edit distance of the item to a run of words of the region, and the run's start and end; the first such end,
        and the shortest run to it."""

        def last_row(item: np.ndarray, region: np.ndarray, free: bool) -> np.ndarray:
            ramp = np.arange(len(region) + 1)
            row = np.zeros(len(region) + 1, np.int64) if free else ramp.copy()
            for word in item:
                new = np.empty_like(row)
                new[0] = row[0] + 1
                new[1:] = np.minimum(row[1:] + 1, row[:-1] + (region != word))
                row = np.minimum.accumulate(new - ramp) + ramp
            return row

        row = last_row(item, region, True)
        end = int(row.argmin())
        back = last_row(item[::-1], region[:end][::-1], False)
        return int(row[end]), end - int(np.flatnonzero(back == row[end])[0]), end

    def search(self, texts: list[str | None]) -> list[tuple[int, int, int, int, int, int]]:
        """(row, item_id, distance, item's words, start, end) of the nearest run of words for each text and item."""
        if not self.items:
            return []
        split = [words_of(t) for t in texts]
        counts = np.fromiter(map(len, split), np.int64, len(split))
        get, pad = self.ids.get, self.pad
        coded: list[int] = []
        for words in split:
            coded.extend([get(w, 0) for w in words])
            coded.append(pad)
        flat = np.array(coded, np.int32)
        begins = np.cumsum(counts + 1) - counts - 1
        best: dict[tuple[int, int], tuple[int, int, int, int]] = {}
        found = self.candidates(flat)
        rows = np.searchsorted(begins, found[:, 0], "right") - 1
        regions: dict[tuple[int, int], list[list[int]]] = {}
        for row, k, start in np.unique(np.stack([rows, found[:, 2], found[:, 1]], axis=1), axis=0).tolist():
            m = len(self.coded[k])
            slack = int(EDITS * m)
            low, high = max(int(begins[row]), start - 2 * slack - 1), min(int(begins[row] + counts[row]), start + m + 2 * slack + 1)
            spans = regions.setdefault((row, k), [])
            if spans and low <= spans[-1][1]:  # starts are sorted
                spans[-1][1] = max(spans[-1][1], high)
            else:
                spans.append([low, high])
        for (row, k), spans in regions.items():
            item = self.coded[k]
            for low, high in spans:
                # as many words as are not edited must be there
                if np.isin(flat[low:high], item).sum() < len(item) - int(EDITS * len(item)):
                    continue
                distance, start, end = self.verify(item, flat[low:high])
                if distance <= EDITS * len(item):
                    hit = (distance, len(item), low - int(begins[row]) + start, low - int(begins[row]) + end)
                    key = (row, self.items[k][0])
                    if key not in best or hit < best[key]:
                        best[key] = hit
        return [(*key, *hit) for key, hit in sorted(best.items(), key=lambda x: (x[0][0], str(x[0][1])))]


def _blocks(benchmark: DataFrame, block_words: int) -> Iterator[list[tuple[int, list[bytes]]]]:
    block, total = [], 0
    for r in benchmark.orderBy("item_id", "text").toLocalIterator():
        words = words_of(r["text"])
        block.append((r["item_id"], words))
        total += len(words)
        if total >= block_words:
            yield block
            block, total = [], 0
    yield block


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """A row for each document and item found in it: doc_id, item_id, distance (edited words), item_words, and start_word
    and end_word of the nearest run of words. Words are compared with A-Z lower-cased.

    An item of m words is looked for where at most EDITS * m words are edited, so items of fewer than 5 words need an exact run.
    What is returned is exact; copies are always found, a passage with edits where a key of it agrees (see CLASSES).
    Null and empty texts and items are in nothing and hold nothing. Rows that repeat a document each give their rows; items
    that repeat an id are one item with several texts, of which the nearest counts. Null ids stay null. Empty tables give no
    rows; other columns are ignored. Items travel to the tasks in blocks of ``block_words`` words.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "item_id", "distance", "item_words", "start_word", "end_word"]
    schema = f"doc_id {kind}, item_id bigint, distance int, item_words int, start_word int, end_word int"
    parts = []
    for block in _blocks(benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text"), block_words):
        items = docs.sparkSession.sparkContext.broadcast(block)

        def start(items=items):
            searcher = Searcher(items.value)

            def step(batch: pa.RecordBatch) -> pa.RecordBatch | None:
                rows = searcher.search(batch.column(1).to_pylist())
                if not rows:
                    return None
                own, *rest = zip(*rows)
                return pa.record_batch([batch.column(0).take(pa.array(own)), pa.array(rest[0], pa.int64()), *(pa.array(c, pa.int32()) for c in rest[1:])], names)

            return step

        parts.append(map_chunks(docs, "text", schema, start))
    out = reduce(DataFrame.unionByName, parts)
    if len(parts) > 1:  # texts of one item id can lie in two blocks
        out = out.groupBy("doc_id", "item_id").agg(F.min(F.struct(*names[2:])).alias("m")).select("doc_id", "item_id", *[f"m.{c}" for c in names[2:]])
    return out


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs``, with all their columns, in which find_leaks finds no item; a pass for each block of items."""
    for block in _blocks(benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text"), block_words):
        items = docs.sparkSession.sparkContext.broadcast(block)

        def start(items=items):
            searcher = Searcher(items.value)

            def step(batch: pa.RecordBatch) -> pa.RecordBatch | None:
                hit = {row for row, *_ in searcher.search(batch.column(batch.schema.get_field_index(text_col)).to_pylist())}
                kept = [i for i in range(batch.num_rows) if i not in hit]
                return batch.take(pa.array(kept)) if kept else None

            return step

        docs = map_chunks(docs, text_col, docs.schema, start)
    return docs


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
