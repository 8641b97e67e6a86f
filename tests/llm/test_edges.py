"""Nulls, empty and very long texts, repeated rows, empty tables and clashing column names."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpusloom.llm import chunking, crf, decontam, density, langid, licenses, packing, pii, ppm, simhash

BENCHMARK = "item_id long, text string"


def predicted(docs):
    return langid.predict(docs.withColumn("held_out", langid.held_out()), langid.fit(docs), ["doc_id", "held_out"])


def judged(docs):
    labels = docs.sparkSession.createDataFrame([(4, 1), (5, 1), (6, 0), (6, None), (None, 1)], "doc_id long, quality int")
    return crf.score(docs, crf.fit(docs, labels))


def searched(docs):
    items = docs.sparkSession.createDataFrame([(1, "short"), (1, "short"), (2, None), (None, "x")], BENCHMARK)
    return decontam.contaminated(docs, items)


ROW_WISE = [pii.personal_data, chunking.shift_fingerprints, ppm.score, predicted, licenses.license_scan, judged, simhash.near_duplicates]
OTHERS = [packing.pack, searched]


@pytest.mark.parametrize("operator", ROW_WISE, ids=lambda f: f.__name__)
def test_a_row_per_row(operator, odd, clashing, empty):
    plain = operator(odd)
    rows = sorted(map(str, plain.collect()))
    assert len(rows) == odd.count()
    assert sorted(map(str, operator(clashing).collect())) == rows
    assert operator(empty).collect() == []
    twice = [r for r in plain.where("doc_id = 6").collect()]
    assert len(twice) == 2
    if operator is not chunking.shift_fingerprints:  # the second one has another next document
        assert twice[0] == twice[1]


@pytest.mark.parametrize("operator", OTHERS, ids=lambda f: f.__name__)
def test_other_operators(operator, odd, clashing, empty):
    rows = sorted(map(str, operator(odd).collect()))
    assert sorted(map(str, operator(clashing).collect())) == rows and rows
    assert operator(empty).collect() == []


def test_defined_results(odd):
    marks = {r.doc_id: r for r in simhash.near_duplicates(odd).collect()}
    assert marks[1].fingerprint == "0" * 16 and {marks[k].component_id for k in (1, 2, 3)} == {1}
    assert marks[5].component_id == 4
    found = {r.doc_id: r for r in predicted(odd).collect()}
    assert (found[1].lang_pred, found[1].score) == ("und", 0.0) and found[8].lang_pred == "und"
    spans = {r.doc_id: r for r in pii.personal_data(odd).collect()}
    assert spans[4].n_card == 4000 and spans[1].spans == ""
    packed = packing.pack(odd)
    assert packed.where("doc_id = 1").first().doc_tokens == 1 and packed.where("doc_id = 6").count() == 2
    alone = chunking.shift_fingerprints(odd.where("doc_id = 4")).first()
    assert alone.near_next == 1.0 and alone.n_chars == alone.n_chars
    assert {(r.doc_id, r.item_id) for r in searched(odd).collect()} == {(6, 1)}
    scores = {r.doc_id: r for r in ppm.score(odd).collect()}
    assert scores[1].n_tokens == 1 and scores[2].score == scores[1].score < 0


def test_pages(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<p>x</p>"), (3, "u", "<b>" * 50000), (4, "u", "<p title='" * 2000 + ">"), (5, "u", "a" * 300000), (5, "u", "a" * 300000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = [(r.page_id, r.n_chars) for r in density.main_text(pages.select("*", F.lit(1).alias("text"))).collect()]
    assert len(found) == 7 and {(1, 0), (2, 0), (None, 1), (3, 0)} <= set(found) and found.count((5, 300000)) == 2
    assert density.main_text(pages.limit(0)).collect() == []


def test_pipeline_stages(spark, odd, clashing, tmp_path):
    spark.createDataFrame([(1, "short")], BENCHMARK).write.parquet(f"{tmp_path}/benchmark.parquet")
    for docs in (odd, clashing, odd.limit(0)):
        kept = docs
        for _, stage in corpus_pipeline.STAGES[:-1]:
            kept = stage(spark, kept, str(tmp_path))
            assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
            kept = spark.createDataFrame(kept.collect(), docs.schema)
        assert corpus_pipeline.STAGES[-1][1](spark, kept, str(tmp_path)).where("doc_id IS NULL").count() <= 1
        rows = {r.doc_id: r for r in kept.collect()}
        assert not {1, 2, 3, 6, 8} & rows.keys()
        if 4 in rows:
            assert "4111" not in rows[4].text and rows[4].n_chars == len(rows[4].text)


def test_pipeline_against_brute_force(spark):
    from test_brute_force import components, plain_simhash, shingles

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = langid.fit(docs)
    texts = {r.doc_id: r.text for r in langid.predict(docs, model, ["doc_id", "text"]).collect() if r.lang_pred != "und" and r.score >= langid.SURE}
    groups = components({i: plain_simhash(t) for i, t in texts.items()})
    texts = {i: t for i, t in texts.items() if groups[i] == i}
    items = [shingles(r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    clean = {i: t for i, t in texts.items() if not any(len(shingles(t) & s) >= 0.8 * len(s) for s in items)}
    lengths = {i: len(packing.encode(pii.redacted(t))) + 1 for i, t in clean.items()}
    rows = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id: r.doc_tokens for r in rows} == lengths
    assert sum(r.length for r in rows) == sum(lengths.values())
