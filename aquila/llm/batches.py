"""Arrow batches in pieces of bounded text, for the operators that run in Python."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame

from aquila.llm.tables import ship

#: Bytes of text handled at once; a single longer text is handled alone.
CHUNK_BYTES = 1_000_000


def chunks(batches: Iterable[pa.RecordBatch], text_col: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(text_col))
        sizes = pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        start = total = 0
        for i, size in enumerate(sizes.tolist()):
            if total and total + size > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size
        if start < batch.num_rows:
            yield batch.slice(start)


def trim() -> None:
    """Gives freed memory back to the system at the end of a task, as workers live on."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def map_chunks(df: DataFrame, text_col: str, schema: str, start: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]]) -> DataFrame:
    """``start()`` is called once a task and returns what turns a chunk into result rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = start()
        for chunk in chunks(batches, text_col):
            if (out := step(chunk)) is not None:
                yield out
        trim()

    ship(df.sparkSession)
    return df.mapInArrow(run, schema)
