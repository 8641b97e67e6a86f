"""Extraction, first-arrival de-duplication and running totals on streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from corpusloom.functions.quality import PASS_SCORE, QualityRules
from corpusloom.functions.urls import CRAWL_RULES, UrlRules
from corpusloom.operators.dedup import with_canonical
from corpusloom.operators.distributed import SALTS
from corpusloom.operators.extract import extract_pages
from corpusloom.operators.quality import analyze_content
from corpusloom.session import scratch_path

#: Names the unbounded state of ``stream_dedup_urls``.
FOREVER = "forever"


def stream_extract(pages: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """Clean and scored pages, page by page, without state."""
    return analyze_content(extract_pages(pages), rules)


def stream_dedup_urls(
    rows: DataFrame,
    rules: UrlRules = CRAWL_RULES,
    url: str = "url",
    spread: str = "idx",
    event_time: str | None = None,
    delay: str = "1 hour",
    forget_after: str = "30 days",
) -> DataFrame:
    """The first arrival of each canonical URL; unparsable URLs never pass.

    A stream cannot combine before its shuffle, so a URL seen very often would pile up on one task.
    A first pass therefore de-duplicates by URL and bucket of ``spread``; at most as many rows of a URL as there
    are shuffle partitions (``SALTS`` at least) ever reach the second, which is by URL alone.

    State is bounded: a key is forgotten ``forget_after`` its arrival, a batch later at the soonest, or, with
    ``event_time``, once the watermark of that column has passed it by ``delay``. A URL that comes again after
    that passes again. Only ``forget_after=FOREVER`` keeps every key.
    """
    keyed = with_canonical(rows, rules, url).filter(F.col("canonical").isNotNull())
    buckets = max(SALTS, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    salted = keyed.withColumn("_salt", F.pmod(F.xxhash64(F.col(spread)), F.lit(buckets)))
    if event_time is None and forget_after == FOREVER:
        return salted.dropDuplicates(["canonical", "_salt"]).dropDuplicates(["canonical"]).drop("_salt")
    if event_time is None:
        # The batch's own time; no row is ever late by it.
        timed = salted.withColumn("_arrived", F.current_timestamp()).withWatermark("_arrived", forget_after)
    else:
        timed = salted.withWatermark(event_time, delay)
    once = timed.dropDuplicatesWithinWatermark(["canonical", "_salt"]).dropDuplicatesWithinWatermark(["canonical"])
    return once.drop("_salt", "_arrived")


def stream_quality_stats(scored: DataFrame) -> DataFrame:
    """Running totals over all pages so far (complete or update mode)."""
    score = F.col("quality.score")
    return scored.groupBy().agg(
        F.count("*").alias("total_pages"),
        F.count_if(score >= PASS_SCORE).alias("passed_pages"),
        F.count_if(score < PASS_SCORE).alias("failed_pages"),
        F.avg(score).alias("average_score"),
        F.sum(F.col("quality.word_count").cast("long")).alias("total_words"),
    )


def stream_crawl_profile(log: DataFrame, window: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Fetch-log totals per window of event time."""
    return (
        log.withWatermark("ts", delay)
        .groupBy(F.window("ts", window))
        .agg(
            F.count("*").alias("pages_scraped"),
            F.sum("bytes").alias("total_bytes"),
            F.count_if("had_error").alias("errors"),
            F.sum("duration_ns").alias("total_duration_ns"),
        )
        .select(F.col("window.start").alias("window_start"), "pages_scraped", "total_bytes",
                "errors", "total_duration_ns")
    )


def write_with_progress(
    df: DataFrame,
    write: Callable[[DataFrame, int], None],
    report: Callable[[int, int, int, str | None], None],
    mode: str = "append",
    url: str | None = "url",
    order: str = "idx",
):
    """A stream writer that hands each batch to ``write`` and then tells ``report`` what went through.

    ``report`` gets the batch's number, its rows, the rows of all batches since the start, and the URL of
    the last row by ``order`` (None for an empty batch or where ``url`` is None). Both figures are observed while ``write`` reads the batch, so
    nothing is read twice; ``write`` has to run one action over it. A batch that is repeated after a failure is
    reported again.
    """
    total = 0

    def batch_done(batch: DataFrame, batch_id: int) -> None:
        nonlocal total
        seen = Observation()
        facts = [F.count(F.lit(1)).alias("rows")]
        facts += [F.max_by(F.col(url), F.col(order)).alias("last")] if url else []
        write(batch.observe(seen, *facts), batch_id)
        found = seen.get
        total += found["rows"]
        report(batch_id, found["rows"], total, found.get("last"))

    return df.writeStream.outputMode(mode).foreachBatch(batch_done)


def with_progress(df: DataFrame, report: Callable[[int, int], None], mode: str = "append"):
    """A stream writer that tells ``report`` each batch's number and row count and keeps no rows."""
    return write_with_progress(
        df,
        lambda batch, _: batch.write.format("noop").mode("append").save(),
        lambda number, rows, total, last: report(number, rows),
        mode,
        url=None,
    )


def run_available(df: DataFrame, label: str, keep_last: bool = False) -> DataFrame:
    """Process what is there, stop, and read the result back.

    Rows append to parquet files under the checkpoint root. ``keep_last`` is for running totals:
    each batch replaces the result of the one before.
    """
    spark = df.sparkSession
    base = scratch_path(spark, label)
    writer = df.writeStream.option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
    if keep_last:
        spark.createDataFrame([], df.schema).write.parquet(f"{base}/rows")  # a stream without a batch leaves no rows
        query = (
            writer.outputMode("complete")
            .foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{base}/rows"))
            .start()
        )
    else:
        query = writer.outputMode("append").format("parquet").start(f"{base}/rows")
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{base}/rows")
