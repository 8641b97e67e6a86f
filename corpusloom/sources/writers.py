"""Writers for rendered documents and line lists.

A rendered document is a table ``(file, part, sort_key, text)``: the lines of ``text`` in
``(part, sort_key)`` order are the file. Nothing gathers a file's rows in one task: range-sorted
tasks write pieces, and only their bytes are streamed into the object.
"""

from __future__ import annotations

from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.session import scratch_path, store
from corpusloom.sources.files import FORMAT, FilesSource, file_system, stage_pieces

#: A file of more bytes goes on in further objects, so that no task has to write more than this and one piece.
OBJECT_BYTES = 4 << 30


def write_rendered(
    sections: DataFrame, path: str, mode: str = "errorifexists", object_bytes: int = OBJECT_BYTES
) -> DataFrame | None:
    """Every ``file`` as an object at its own path below ``path``, so that relative links lead somewhere.

    A file beyond ``object_bytes`` is ``file``, ``file.00001``, ``file.00002`` and so on, cut at line ends; put
    together in the order of their names they are the file. Modes: ``errorifexists``, ``ignore``, ``overwrite``
    (the folder is emptied first) and ``append`` (files of the same name are replaced).

    Returns the names of the objects written, a table ``file`` that a reader may start from
    (:func:`corpusloom.sources.readers.read_objects`) in place of a listing; None where nothing was to be written.
    """
    if mode not in ("error", "errorifexists", "ignore", "overwrite", "append"):
        raise ValueError(f"unknown mode: {mode}")
    system, base = file_system(path)
    if system.get_file_info(base).type != fs.FileType.NotFound and mode != "append":
        if mode == "ignore":
            return
        if mode != "overwrite":
            raise FileExistsError(path)
    spark = sections.sparkSession
    staged = scratch_path(spark, "pieces")
    order = ["file", *[c for c in ("part", "sort_key") if c in sections.columns]]
    lines = sections.repartitionByRange(*order).sortWithinPartitions(*order)
    pieces = lines.select("file", "text", F.spark_partition_id().alias("part")).mapInArrow(
        lambda batches: stage_pieces(batches, staged), "file string, part int, start long, bytes long, piece string"
    )
    pieces = store(pieces, "piece-list")
    # A file has at most one piece per task, so both windows and lists are bounded by the number of partitions.
    before = F.sum("bytes").over(Window.partitionBy("file").orderBy("part")) - F.col("bytes")
    objects = (
        pieces.withColumn("number", F.floor(before / object_bytes))
        .groupBy("file", "number")
        .agg(F.array_sort(F.collect_list(F.struct("part", "piece", "start", "bytes"))).alias("pieces"))
        .withColumn("place", F.row_number().over(Window.partitionBy("file").orderBy("number")) - 1)
    )
    target = F.when(F.col("place") == 0, F.col("file")).otherwise(
        F.concat("file", F.lit("."), F.lpad(F.col("place").cast("string"), 5, "0"))
    )
    if mode == "overwrite" and system.get_file_info(base).type == fs.FileType.Directory:
        system.delete_dir_contents(base)
    spark.dataSource.register(FilesSource)
    # A row is short and its object is not: rows are dealt to all cores, neighbours in the staged objects together.
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = objects.select(target.alias("target"), "pieces").repartitionByRange(tasks, F.get("pieces", F.lit(0))["piece"], F.get("pieces", F.lit(0))["start"])
    dealt = store(dealt, "object-list")
    dealt.write.format(FORMAT).option("staged", staged).mode("append").save(path)
    return dealt.select(F.col("target").alias("file"))


def write_lines(df: DataFrame, line: Column, path: str, mode: str = "errorifexists") -> None:
    """One line per row."""
    df.select(line.cast("string").alias("value")).write.mode(mode).text(path)


def write_table(df: DataFrame, path: str, mode: str = "errorifexists", by: list[str] = ()) -> None:
    """Parquet, optionally partitioned by columns with few values."""
    writer = df.write.mode(mode)
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_json_rows(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON object per row."""
    df.write.mode(mode).json(path)
