"""Integer vectors in Arrow batches, and exact sums of them over a whole table."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.tasks import map_batches

#: Integers saturate here (vectors near a thousand million), so that exact sums keep to 38 digits.
LARGEST = 1 << 40
SUM_SCHEMA = "key int, value decimal(38,0)"


def finite_rows(batch, column: str = "embedding") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(usable, length, values): which rows are not null and all finite, and the flat values of every row as double."""
    lists = batch.column(column)
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # a null entry is NaN here
    row = np.repeat(np.arange(len(lengths)), lengths)
    odd = np.bincount(row, ~np.isfinite(values), len(lengths)) > 0
    usable = lists.is_valid().to_numpy(zero_copy_only=False) & ~odd
    return usable, lengths, values


def scaled(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * value), held within the largest integer."""
    return np.floor(np.clip(values, -LARGEST // scale, LARGEST // scale) * scale).astype(np.int64)


def list_column(rows: np.ndarray) -> pa.Array:
    """A matrix of longs as an Arrow column of lists."""
    n, width = rows.shape
    offsets = pa.array(np.arange(0, (n + 1) * width, width or 1, np.int32)[: n + 1] if width else np.zeros(n + 1, np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(rows.ravel()))


def matrix(batch, column: str, width: int) -> np.ndarray:
    """A column of equally long lists of longs as a matrix."""
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)


class Sums:
    """Exact sums that a task keeps under integer keys and gives once at its end."""

    def __init__(self):
        self.total: dict[int, int] = {}

    def add(self, first: int, values) -> None:
        """Add integers of any size to the keys from ``first`` on."""
        for key, value in enumerate(np.asarray(values).ravel().tolist(), first):
            self.total[key] = self.total.get(key, 0) + value

    def finish(self) -> Iterator[dict]:
        if self.total:
            yield {"key": list(self.total), "value": [Decimal(v) for v in self.total.values()]}


def total(df: DataFrame, kernel, *args) -> dict[int, int]:
    """The sums of every key over all tasks of ``kernel``, a class built on ``Sums``.

    A task gives a row per key, whatever its input; the driver gets a row per key.
    """
    parts = map_batches(df, kernel, SUM_SCHEMA, *args)
    return {r.key: int(r.value) for r in parts.groupBy("key").agg(F.sum("value").alias("value")).collect()}
