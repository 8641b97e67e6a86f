"""Building blocks that keep every task bounded when one key holds much of the data."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.session import store

SALTS = 64
SLICE_BYTES = 1 << 20
_ROW_BITS = 33


def pinned(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column that is evaluated exactly once per row.

    It leaves through a generator over a single value. Filters and join-key tests on a plain column
    would be pushed below its projection and evaluate the expression a second time; they cannot
    pass a generator.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def slices(batch: pa.RecordBatch, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about ``limit`` bytes, one row at least."""
    step = max(1, batch.num_rows * limit // max(batch.nbytes, 1))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def first_per_key(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row with the smallest ``order`` for each key; combines before the shuffle."""
    others = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(
        F.min_by(F.struct(*others), F.col(order)).alias("_row")
    ).select(*keys, "_row.*")


def salted_lookup(
    facts: DataFrame, dim: DataFrame, keys: list[str], spread: Column, how: str = "inner"
) -> DataFrame:
    """Join ``facts`` to ``dim`` (unique on ``keys``) without piling a hot key onto one task.

    Facts of one key are spread over as many buckets as there are shuffle partitions, ``SALTS`` at
    least, by ``spread``; the dim row is copied only to the (key, bucket) pairs that occur, found by a
    distinct that collapses before its shuffle.
    """
    partitions = int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = facts.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(max(SALTS, partitions))))
    wanted = salted.select(*keys, "_salt").distinct()
    copies = wanted.join(dim, keys, "inner")
    return salted.join(copies, [*keys, "_salt"], how).drop("_salt")


def number_rows(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """Dense 0-based numbers in the total order ``order``.

    Range partitions are sorted and counted in parallel; only one count per partition meets in one
    place. Storing the ranges pins their bounds, which a second evaluation could draw
    differently. ``order`` has to identify rows, so that no range grows beyond its share.
    """
    ranged = store(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_at", F.monotonically_increasing_id()),
        "ranged",
    )
    part = F.shiftright("_at", _ROW_BITS)
    # One row per shuffle partition: the only thing ordered in a single task or broadcast here.
    offsets = (
        ranged.groupBy(part.alias("_part"))
        .agg(F.count("*").alias("_rows"))
        .withColumn(
            "_before",
            F.coalesce(
                F.sum("_rows").over(
                    Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
                ),
                F.lit(0),
            ),
        )
        .drop("_rows")
    )
    return (
        ranged.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(
            name, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
        )
        .drop("_part", "_before", "_at")
    )


def number_within(
    df: DataFrame, group: list[str], order: list[Column], name: str = "position"
) -> DataFrame:
    """Dense 0-based numbers inside each group, for groups of any size.

    Rows are numbered over the whole table in (group, order) order and the group's first number,
    a combinable minimum, is taken off again.
    """
    numbered = number_rows(df, [*[F.col(c) for c in group], *order], "_number")
    first = numbered.groupBy(*group).agg(F.min("_number").alias("_first"))
    return (
        salted_lookup(numbered, first, group, F.col("_number"))
        .withColumn(name, F.col("_number") - F.col("_first"))
        .drop("_number", "_first")
    )


def single_value(df: DataFrame, value: Column) -> Column:
    """A whole-table aggregate as a scalar subquery."""
    return df.agg(value.alias("v")).scalar()
