"""Sums over partitions for linear models: every task adds up its rows, the sums are added in a tree.

Feature rows are (doc_id, features array<double>); what a task emits is one packed block of doubles whose size depends on
the number of features only, and the driver receives at most SUMS of them whatever the input.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SUMS = 16


def matrix(column, width: int) -> np.ndarray:
    """An Arrow list column of equal lengths as rows of a matrix."""
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, width)


def partition_sums(rows: DataFrame, block: Callable[[pa.RecordBatch], np.ndarray], size: int) -> np.ndarray:
    """The sum of `block(batch)`, a vector of `size` doubles, over all batches of `rows`."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += block(batch)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["block"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                total += np.frombuffer(x)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["block"])

    summed = rows.mapInArrow(local, "block binary").repartition(SUMS).mapInArrow(add, "block binary")
    return sum((np.frombuffer(bytes(r["block"])) for r in summed.collect()), np.zeros(size))
