"""The streaming operators, run until the files at hand are used up."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.catalog import bindings as B
from corpusloom.catalog.texts import metrics_sql
from corpusloom.catalog.sites import _CANON
from corpusloom.operators.distributed import single_value
from corpusloom.session import scratch_path
from corpusloom.sources.readers import read_pages_stream
from corpusloom.streaming import streams as S

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


_X = f"WITH {B.EXTRACTED_SQL}, {metrics_sql('x')}"


def _pages(s, sf):
    return read_pages_stream(s, f"{sf}/pages.parquet")


@query(
    "stream_extract",
    f"{_X} SELECT idx, url, title, content, round(score, 9) AS score FROM s WHERE content <> ''",
)
def _stream_extract(s, sf):
    scored = S.stream_extract(_pages(s, sf)).select(
        "idx", "url", "title", "content", F.round("quality.score", 9).alias("score")
    )
    return S.run_available(scored, "stream-extract")


@query(
    "stream_dedup_urls",
    f"{_CANON} SELECT DISTINCT canonical FROM c WHERE canonical IS NOT NULL",
)
def _stream_dedup(s, sf):
    """Which spelling arrives first is up to the stream, so only the key is compared."""
    listed = F.array(*[F.expr(e) for e in B.URL_SPELLINGS])
    spelled = (
        _pages(s, sf)
        .withColumnRenamed("idx", "page_id")
        .select("page_id", F.posexplode(listed).alias("k", "url"))
        .select((F.col("page_id") * 10 + F.col("k")).alias("idx"), "url")
    )
    return S.run_available(S.stream_dedup_urls(spelled).select("canonical"), "stream-dedup")


@query(
    "stream_quality_stats",
    f"{_X} SELECT count(*) AS total_pages, count(*) FILTER (score >= 0.4) AS passed_pages, "
    "count(*) FILTER (score < 0.4) AS failed_pages, round(avg(score), 6) AS average_score, "
    "CAST(sum(words) AS BIGINT) AS total_words FROM s WHERE content <> ''",
)
def _stream_stats(s, sf):
    stats = S.stream_quality_stats(S.stream_extract(_pages(s, sf)))
    return S.run_available(stats, "stream-stats", keep_last=True).withColumn(
        "average_score", F.round("average_score", 6)
    )


@query(
    "stream_crawl_profile",
    f"WITH {B.LOG_SQL} SELECT date_trunc('hour', ts) AS window_start, count(*) AS pages_scraped, "
    "CAST(sum(bytes) AS BIGINT) AS total_bytes, count(*) FILTER (had_error) AS errors, "
    "CAST(sum(duration_ns) AS BIGINT) AS total_duration_ns FROM log GROUP BY 1",
)
def _stream_profile(s, sf):
    """Complete output, so the windows still open at the end are there too."""
    profile = S.stream_crawl_profile(B.fetch_log_stream(s, sf))
    return S.run_available(profile, "stream-profile", keep_last=True).withColumn(
        "window_start", F.col("window_start").cast("timestamp_ntz")
    )


@query(
    "stream_progress",
    "SELECT CAST(count(*) AS BIGINT) AS rows, CAST(count(*) AS BIGINT) AS total, max_by(url, page_id) AS last_url, "
    "count(*) AS written FROM pages",
)
def _stream_progress(s, sf):
    """What the callback was told, whatever the batches were, and what the wrapped writer wrote."""
    told, rows = [], scratch_path(s, "stream-progress")
    s.createDataFrame([], "idx long, url string").write.parquet(f"{rows}/rows")  # no page, no batch
    writer = S.write_with_progress(
        _pages(s, sf).select("idx", "url"),
        lambda batch, _: batch.write.mode("append").parquet(f"{rows}/rows"),
        lambda *facts: told.append(facts),
    )
    writer.option("checkpointLocation", f"{rows}/state").trigger(availableNow=True).start().awaitTermination()
    said = s.createDataFrame(told, "number long, rows long, total long, last_url string")
    done = s.read.schema("idx long, url string").parquet(f"{rows}/rows")
    written = single_value(done, F.count("*"))
    # Files may come in any order, so the last batch need not hold the last page.
    places = done.groupBy(F.col("url").alias("last_url")).agg(F.max("idx").alias("idx"))
    said = said.join(places, "last_url", "left")
    facts = {"rows": F.sum("rows"), "total": F.max("total")}
    facts = [F.coalesce(fact, F.lit(0).cast("long")).alias(name) for name, fact in facts.items()]
    return said.agg(*facts, F.max_by("last_url", "idx").alias("last_url")).withColumn("written", written)
