import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from corpusloom.catalog import streams as C
from corpusloom.sources.readers import read_pages_stream
from corpusloom.streaming import streams as S


def page_files(spark, folder, batches):
    for i, rows in enumerate(batches):
        df = spark.createDataFrame(rows, "page_id long, url string, html string")
        df.coalesce(1).write.mode("append").parquet(str(folder))


BATCHES = [
    [(0, "https://h.example/a", "<article>one</article>"), (1, "https://www.h.example/a/", "<article>two</article>")],
    [(2, "https://h.example/b", "<article>three</article>"), (3, "://bad", "<article>x</article>"),
     (4, "https://H.example/A#x", "<article></article>")],
]


def test_pages_flow_in_batches(spark, tmp_path):
    page_files(spark, tmp_path / "in", BATCHES)
    stream = read_pages_stream(spark, str(tmp_path / "in"), files_per_trigger=1)
    assert stream.isStreaming
    extracted = S.run_available(S.stream_extract(stream).select("idx", "content"), "t-extract")
    assert {r.idx: r.content for r in extracted.collect()} == {0: "one", 1: "two", 2: "three", 3: "x"}
    unique = S.run_available(S.stream_dedup_urls(stream).select("canonical"), "t-dedup")
    assert sorted(r.canonical for r in unique.collect()) == ["https://h.example/a", "https://h.example/b"]


def test_hot_url(spark, tmp_path):
    spark.range(5000).select(
        F.col("id").alias("page_id"),
        F.concat(F.lit("https://h.example/"), F.col("id") % 2).alias("url"),
        F.lit("").alias("html"),
    ).repartition(3).write.parquet(str(tmp_path / "in"))
    stream = read_pages_stream(spark, str(tmp_path / "in"), files_per_trigger=1)
    found = S.run_available(S.stream_dedup_urls(stream).select("canonical"), "t-hot")
    assert sorted(r.canonical for r in found.collect()) == ["https://h.example/0", "https://h.example/1"]


def test_bounded_state(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(i, "https://h.example/a", start + dt.timedelta(seconds=i)) for i in range(5)]
    spark.createDataFrame(rows, "idx long, url string, ts timestamp").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("idx long, url string, ts timestamp").parquet(str(tmp_path / "in"))
    unique = S.stream_dedup_urls(stream, event_time="ts", delay="1 minute")
    assert S.run_available(unique.select("canonical"), "t-bounded").count() == 1


@pytest.mark.parametrize("forget_after", ["1 second", S.FOREVER])
def test_state_past_its_time(spark, tmp_path, forget_after):
    """Every batch brings 40 new URLs and one of the first batch again."""
    batches = 6
    for k in range(batches):
        rows = [(k * 100 + i, f"https://h.example/{k}/{i}", "") for i in range(40)] + [(k * 100 + 50, "https://h.example/0/0", "")]
        page_files(spark, tmp_path / "in", [rows])
    stream = read_pages_stream(spark, str(tmp_path / "in"), files_per_trigger=1)
    kept = S.stream_dedup_urls(stream, forget_after=forget_after).select("canonical")

    def slow(batch, number):
        batch.write.mode("append").parquet(str(tmp_path / "out"))
        time.sleep(1.5)

    writer = kept.writeStream.foreachBatch(slow).option("checkpointLocation", str(tmp_path / "state"))
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    states = [max(op["numRowsTotal"] for op in p["stateOperators"]) for p in query.recentProgress if p["stateOperators"]]
    found = [r.canonical for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert len(set(found)) == 40 * batches
    if forget_after == S.FOREVER:
        assert max(states) >= 40 * batches and len(found) == 40 * batches
    else:
        assert max(states) < 40 * batches * 0.8 and len(found) > 40 * batches


def test_running_stats_and_progress(spark, tmp_path):
    page_files(spark, tmp_path / "in", BATCHES)
    stream = read_pages_stream(spark, str(tmp_path / "in"), files_per_trigger=1)
    stats = S.run_available(S.stream_quality_stats(S.stream_extract(stream)), "t-stats", keep_last=True)
    assert stats.first().total_pages == 4 and stats.first().total_words == 4
    seen = []
    query = (
        S.with_progress(stream.select("idx"), lambda batch, rows: seen.append(rows))
        .option("checkpointLocation", str(tmp_path / "state"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    assert sum(seen) == 5 and len(seen) >= 2


def test_windowed_profile(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(start + dt.timedelta(minutes=m), 10, 100, m % 40 == 0) for m in range(0, 120, 20)]
    schema = "ts timestamp, duration_ns long, bytes long, had_error boolean"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    log = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    found = S.run_available(S.stream_crawl_profile(log), "t-profile", keep_last=True).orderBy("window_start")
    assert [(r.pages_scraped, r.total_bytes, r.errors) for r in found.collect()] == [(3, 300, 2), (3, 300, 1)]


def test_progress_around_a_writer(spark, tmp_path):
    source = str(tmp_path / "in")
    for k in range(3):
        rows = spark.range(10 * k, 10 * k + k + 1).selectExpr("id AS idx", "concat('u', id) AS url").coalesce(1)
        rows.write.mode("append").parquet(source)
    stream = spark.readStream.schema("idx long, url string").option("maxFilesPerTrigger", 1).parquet(source)
    told = []
    query = (
        S.write_with_progress(stream, lambda batch, number: batch.write.mode("append").parquet(str(tmp_path / "out")), lambda *facts: told.append(facts))
        .option("checkpointLocation", str(tmp_path / "state"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    assert [t[0] for t in told] == [0, 1, 2] and sorted(t[1] for t in told) == [1, 2, 3]
    assert [t[2] for t in told] == [sum(x[1] for x in told[: k + 1]) for k in range(3)]
    assert {t[3] for t in told} == {"u0", "u11", "u22"}
    assert spark.read.parquet(str(tmp_path / "out")).count() == 6


def table_of_files(spark, folder, batches):
    """``pages.parquet`` as a folder of files, as larger tables come."""
    page_files(spark, folder / "pages.parquet", batches)
    return str(folder)


@pytest.mark.parametrize("files", [1, 100])
def test_progress_over_a_folder_of_files(spark, tmp_path, monkeypatch, files):
    """The last page stands in the first file."""
    sf = table_of_files(spark, tmp_path, BATCHES[::-1])
    monkeypatch.setattr(C, "_pages", lambda s, sf: read_pages_stream(s, f"{sf}/pages.parquet", files_per_trigger=files))
    assert tuple(C.QUERIES["stream_progress"](spark, sf).first()) == (5, 5, "https://H.example/A#x", 5)


def test_progress_of_no_page(spark, tmp_path):
    (tmp_path / "pages.parquet").mkdir()
    assert tuple(C.QUERIES["stream_progress"](spark, str(tmp_path)).first()) == (0, 0, None, 0)


def test_single_file_and_missing_table(spark, tmp_path):
    page_files(spark, tmp_path / "in", BATCHES[:1])
    (part,) = (tmp_path / "in").glob("*.parquet")
    found = S.run_available(read_pages_stream(spark, str(part)).select("idx"), "t-single")
    assert sorted(r.idx for r in found.collect()) == [0, 1]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_pages_stream(spark, str(tmp_path / "nowhere.parquet"))


def test_stats_over_a_folder_of_files(spark, tmp_path):
    stats = C.QUERIES["stream_quality_stats"](spark, table_of_files(spark, tmp_path / "some", BATCHES)).first()
    assert (stats.total_pages, stats.total_words) == (4, 4)
    (tmp_path / "none" / "pages.parquet").mkdir(parents=True)
    assert C.QUERIES["stream_quality_stats"](spark, str(tmp_path / "none")).collect() == []


def test_profile_over_a_folder_of_files(spark, tmp_path):
    rows = [(k, dt.datetime(2024, 1, 1, k), "error", 1.5, 7, "abc") for k in range(3)]
    schema = "event_id long, ts timestamp, event_type string, value double, user_id long, props string"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    found = C.QUERIES["stream_crawl_profile"](spark, str(tmp_path)).collect()
    assert [(r.pages_scraped, r.total_bytes, r.errors) for r in found] == [(1, 307, 1)] * 3
