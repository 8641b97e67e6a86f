"""Arrow plumbing shared by the operators that run numpy or plain Python inside Spark tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

SLICE_BYTES = 4 << 20


_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def small_batches(spark: SparkSession, limit: int = SLICE_BYTES):
    """Rows reach Python in batches of about ``limit`` bytes while a table is written.

    Both the JVM and the worker hold a whole batch, which else has up to 10,000 rows.
    """
    before = spark.conf.get(_BATCH_BYTES)
    spark.conf.set(_BATCH_BYTES, str(limit))
    try:
        yield
    finally:
        spark.conf.set(_BATCH_BYTES, before)


def slices(batch: pa.RecordBatch, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about ``limit`` bytes, one row at least."""
    rows = batch.num_rows
    if rows:
        step = max(1, rows * limit // max(batch.nbytes, 1))
        for at in range(0, rows, step):
            yield batch.slice(at, step)


def map_batches(
    df: DataFrame, kernel: Callable[..., dict], schema: str | StructType, *args
) -> DataFrame:
    """Apply ``kernel(batch, *args)`` to runs of rows; it returns the output columns by name.

    A kernel that has to be set up once per task gives an object with ``__call__`` from a function
    marked with ``per_task``; one that has something left at the end of its partition has a
    ``finish`` method that yields column dictionaries.
    """
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once = getattr(kernel, "per_task", False)
        work = kernel(*args) if once else kernel
        for batch in batches:
            for part in slices(batch):
                out = work(part) if once else work(part, *args)
                if out:
                    yield pa.RecordBatch.from_pydict(out, schema=target)
        for out in work.finish() if hasattr(work, "finish") else ():
            yield pa.RecordBatch.from_pydict(out, schema=target)

    return df.mapInArrow(run, schema)


def per_task(kernel):
    """Mark a class or function that is called once per task and gives the kernel."""
    kernel.per_task = True
    return kernel


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch; null counts as empty."""
    return [t or "" for t in batch.column(column).to_pylist()]
