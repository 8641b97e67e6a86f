"""Page tables, page streams and line lists."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusloom.functions.text import trim_space
from corpusloom.sources.files import file_system

PAGE_SCHEMA = "page_id long, url string, html string"
_BATCH_BYTES = 4 << 20


def _as_pages(df: DataFrame) -> DataFrame:
    return df.select(F.col("page_id").alias("idx"), "url", "html")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """One row per fetched page: ``idx``, ``url``, ``html``; ``idx`` is the page order."""
    return _as_pages(spark.read.schema(PAGE_SCHEMA).parquet(path))


def read_stream(
    spark: SparkSession,
    path: str,
    schema: str | StructType,
    pattern: str = "*.parquet",
    files_per_trigger: int = 100,
) -> DataFrame:
    """A table as a stream of its files: ``path`` is a single file, or a folder in which files land.

    A stream takes a plain path for a folder, a glob for either. It does not miss what a glob does not
    find, so the plain path is looked up first.
    """
    spark.read.schema(schema).parquet(path)
    folder, slash, name = path.rstrip("/").rpartition("/")
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(f"{folder}{slash}{{{name}}}")
    )


def read_pages_stream(
    spark: SparkSession, path: str, pattern: str = "*.parquet", files_per_trigger: int = 100
) -> DataFrame:
    """The same rows as a stream of files: the single file ``path``, or those landing in that folder."""
    return _as_pages(read_stream(spark, path, PAGE_SCHEMA, pattern, files_per_trigger))


def list_lines(df: DataFrame, line: Column, name: str = "line") -> DataFrame:
    """Trimmed lines without blanks and ``#`` comments."""
    kept = df.withColumn(name, trim_space(line))
    return kept.filter((F.col(name) != "") & ~F.col(name).startswith("#"))


def read_objects(objects: DataFrame, path: str) -> DataFrame:
    """``file, text``: the whole objects below ``path`` that ``objects`` names in ``file``.

    Tasks open them by their names. Spark's own readers list the folders first, one after the other, which for
    a folder per page takes many times as long as reading.
    """

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = file_system(path)

        def read() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"file": names, "content": pa.array(found, pa.binary())})

        for batch in batches:
            names, found, size = [], [], 0
            for name in batch.column("file").to_pylist():
                with system.open_input_stream(f"{base}/{name}") as data:
                    found.append(data.read())
                names.append(name)
                size += len(found[-1])
                if size >= _BATCH_BYTES:
                    yield read()
                    names, found, size = [], [], 0
            if names:
                yield read()

    whole = objects.select("file").mapInArrow(contents, "file string, content binary")
    return whole.select("file", F.col("content").cast("string").alias("text"))


def read_line_list(spark: SparkSession, path: str) -> DataFrame:
    return list_lines(spark.read.text(path), F.col("value")).select("line")
