"""Rows as a stream to the driver."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row


class Limited:
    """Up to ``most`` rows of a DataFrame, fetched a partition ahead; afterwards ``overflow`` tells whether there were more."""

    def __init__(self, df: DataFrame, most: int | None):
        self.df, self.most, self.overflow = df, most, False

    def __iter__(self) -> Iterator[Row]:
        for i, row in enumerate(self.df.toLocalIterator(prefetchPartitions=True)):
            if self.most is not None and i >= self.most:
                self.overflow = True
                return
            yield row
