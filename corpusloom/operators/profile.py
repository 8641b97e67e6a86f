"""Totals and report lines over a fetch log ``(idx, ts, duration_ns, bytes, had_error)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.numbers import div
from corpusloom.operators.distributed import number_rows


def crawl_profile(log: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Totals of a log, or of each key. Mean duration is an integer division, 0 for no pages."""
    start, end = F.unix_micros(F.min("ts")), F.unix_micros(F.max("ts"))
    pages = F.count("*")
    return log.groupBy(*keys).agg(
        pages.alias("pages_scraped"),
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("total_bytes"),
        F.count_if("had_error").alias("errors"),
        F.coalesce((end - start) * F.lit(1000), F.lit(0)).alias("total_duration_ns"),
        F.when(pages > 0, div(F.sum("duration_ns"), pages)).otherwise(F.lit(0)).alias("average_ns"),
    )


def format_duration(ns: Column) -> Column:
    """Nanoseconds as ``1h2m3.5s``, ``150ms``, ``1.5µs`` or ``0s``."""

    def number(value: Column, unit: int) -> Column:
        whole = div(value, unit)
        digits = len(str(unit)) - 1
        rest = F.lpad((value % unit).cast("string"), digits, "0") if digits else F.lit("")
        tail = F.regexp_replace(rest, r"0+\z", "")
        return F.concat(
            whole.cast("string"), F.when(tail == "", "").otherwise(F.concat(F.lit("."), tail))
        )

    seconds = F.concat(number(ns % 60_000_000_000, 1_000_000_000), F.lit("s"))
    minutes = div(ns, 60_000_000_000)
    hours = div(minutes, 60)
    return (
        F.when(ns == 0, F.lit("0s"))
        .when(ns < 1_000, F.concat(ns.cast("string"), F.lit("ns")))
        .when(ns < 1_000_000, F.concat(number(ns, 1_000), F.lit("µs")))
        .when(ns < 1_000_000_000, F.concat(number(ns, 1_000_000), F.lit("ms")))
        .when(minutes == 0, seconds)
        .when(hours == 0, F.concat(minutes.cast("string"), F.lit("m"), seconds))
        .otherwise(
            F.concat(
                hours.cast("string"),
                F.lit("h"),
                (minutes % 60).cast("string"),
                F.lit("m"),
                seconds,
            )
        )
    )


def crawl_profile_lines(log: DataFrame, file: str = "performance_report.txt") -> DataFrame:
    """The textual report: totals, then one line per page in ``idx`` order."""
    megabytes = F.format_string("%.2f", F.col("total_bytes") / F.lit(1024.0) / F.lit(1024.0))
    totals = crawl_profile(log).select(
        F.concat(
            F.lit("Performance Report\n==================\n\nTotal Duration: "),
            format_duration(F.col("total_duration_ns")),
            F.lit("\nPages Scraped: "),
            F.col("pages_scraped").cast("string"),
            F.lit("\nAverage Time per Page: "),
            format_duration(F.col("average_ns")),
            F.lit("\nTotal Data Downloaded: "),
            F.col("total_bytes").cast("string"),
            F.lit(" bytes ("),
            megabytes,
            F.lit(" MB)\nErrors Encountered: "),
            F.col("errors").cast("string"),
            F.when(F.col("pages_scraped") > 0, F.lit("\n\nPage Timing Details:")).otherwise(""),
        ).alias("text")
    )
    timings = number_rows(log.select("idx", "duration_ns"), [F.col("idx")]).select(
        "position",
        F.concat(
            F.lit("Page "),
            (F.col("position") + 1).cast("string"),
            F.lit(": "),
            format_duration(F.col("duration_ns")),
        ).alias("text"),
    )
    head = totals.select(F.lit(0).alias("part"), F.lit(0).cast("long").alias("sort_key"), "text")
    rows = timings.select(F.lit(1).alias("part"), F.col("position").alias("sort_key"), "text")
    return head.unionByName(rows).select(F.lit(file).alias("file"), "part", "sort_key", "text")
