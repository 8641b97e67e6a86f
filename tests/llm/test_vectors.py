"""Clustering, whitening and token files against plain recomputations."""

import hashlib
import math
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.llm import clusters, pfor, queries, whitening

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>"


def whole(x, scale):
    return math.floor(scale * x)


def finite(vector):
    return vector is not None and all(x is not None and math.isfinite(x) for x in vector)


def plain_clusters(rows):
    """{vec_id: columns} with Python integers only."""
    kept = [(i, [whole(x, 1024) for x in v]) for i, v in rows if finite(v) and len(v) == 64]
    digest = lambda i: (i is None, hashlib.sha256(f"3:{i}".encode()).hexdigest())
    centres = [v for _, v in sorted(kept, key=lambda r: digest(r[0]))[:8]]

    def assign():
        away = [[sum((a - b) ** 2 for a, b in zip(v, c)) for c in centres] for _, v in kept]
        return [(min(d), d.index(min(d))) for d in away]

    for _ in range(10):
        labels = [k for _, k in assign()]
        for k in range(len(centres)):
            own = [v for (_, v), label in zip(kept, labels) if label == k]
            if own:
                centres[k] = [sum(column) // len(own) for column in zip(*own)]
    found = assign()
    inertia = [sum(d for d, label in found if label == k) for k in range(len(centres))]
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(
        (str(i), k, d, inertia[k], sum(inertia), hashes[k]) for (i, _), (d, k) in zip(kept, found)
    )


def as_rows(df):
    return sorted((str(r[0]), *r[1:]) for r in df.collect())


@pytest.fixture(scope="module")
def embeddings(spark):
    return spark.read.parquet(f"{SF}/embeddings.parquet")


@pytest.fixture(scope="module")
def odd_vectors(spark):
    """Nulls, other lengths, NaN, infinity, ties, repeated rows, clashing columns."""
    draw = np.random.default_rng(1)
    rows = [(i, draw.normal(0, 0.3, 64).astype(float).tolist()) for i in range(40)]
    rows += [rows[3], rows[3], (100, rows[3][1]), (None, rows[5][1]), (41, None), (42, []), (43, [1.0] * 63)]
    rows += [(44, [None] + [0.0] * 63), (45, [float("nan")] * 64), (46, [float("inf")] + [0.0] * 63), (47, [-0.0] * 64)]
    df = spark.createDataFrame(rows, VECTORS).repartition(5)
    return df.select("*", *[F.lit("x").alias(n) for n in "cluster distance key value x size n component coefficients".split()])


def test_clusters(spark, embeddings):
    rows = [(r.vec_id, r.embedding) for r in embeddings.limit(200).collect()]
    few = spark.createDataFrame(rows, VECTORS).repartition(7)
    assert as_rows(clusters.cluster(few)) == plain_clusters(rows)


def test_clusters_of_odd_rows(spark, odd_vectors):
    rows = [(r.vec_id, r.embedding) for r in odd_vectors.collect()]
    assert as_rows(clusters.cluster(odd_vectors)) == plain_clusters(rows)
    few = spark.createDataFrame(rows[:3], VECTORS)
    assert as_rows(clusters.cluster(few)) == plain_clusters(rows[:3])
    assert clusters.cluster(odd_vectors.limit(0)).collect() == []


def test_clusters_of_large_vectors(spark):
    draw = np.random.default_rng(2)
    rows = [(i, (draw.normal(0, 1, 64) * 3e4).tolist()) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert as_rows(clusters.cluster(df)) == plain_clusters(rows)
    huge = spark.createDataFrame([(1, [1e9] * 64), (2, [-1e9] * 64), (3, [1e300] * 64)], "vec_id long, embedding array<double>")
    assert {r.vec_id for r in clusters.cluster(huge, centroids=1).where("distance IS NULL AND inertia IS NULL").collect()} <= {1, 2, 3}


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32 - 1), st.integers(1, 9), st.sampled_from([2, 50, 10**6, 10**9]))
def test_search_finds_the_nearest(seed, count, size):
    draw = np.random.default_rng(seed)
    points, targets = draw.integers(-size, size, (25, 64)), draw.integers(-size, size, (count, 64))
    targets[-1] = targets[0]  # a tie
    label, distance = clusters.nearest(clusters.transform(points), clusters.transform(targets))
    away = ((points[:, None].astype(object) - targets[None].astype(object)) ** 2).sum(axis=2)
    assert label.tolist() == [row.tolist().index(min(row.tolist())) for row in away]
    assert [int(d) for d in distance] == [min(row.tolist()) for row in away]


def test_transform_is_exact():
    rows = np.random.default_rng(3).integers(-(10**6), 10**6, (20, 64))
    changes = [(np.diff(np.sign(clusters.inverse(np.eye(64, dtype=np.int64)[[k]] * 64)[0])) != 0).sum() for k in range(64)]
    assert (clusters.inverse(clusters.transform(rows)) == rows).all() and changes == list(range(64))


def plain_whitening(rows):
    kept = [(i, [whole(x, 256) for x in v]) for i, v in rows if finite(v)]
    lengths = [len(v) for _, v in kept]
    width = min(set(lengths), key=lambda n: (-lengths.count(n), n))
    fit = sorted({tuple(v) for _, v in kept if len(v) == width})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    x = np.array(fit, float) - np.array([float(Fraction(s, n)) for s in sums])
    values, columns = np.linalg.eigh(x.T @ x / n)
    return kept, width, n, sums, values[::-1], columns[:, ::-1]


def check_whitening(df, rows):
    kept, width, n, sums, values, columns = plain_whitening(rows)
    found = df.collect()
    assert len(found) == 4 * len(kept)
    signs = {}
    plain = {}
    for i, v in kept:
        plain.setdefault(i, []).append(v)
    for r in found:
        assert r.n == n and r.identity_error <= 1e-9
        assert r.explained == pytest.approx(values[r.component - 1] / values.sum(), rel=1e-9)
        options = plain[r.vec_id]
        assert r.deviation in [sum((n * a - s) ** 2 for a, s in zip(v, sums)) if len(v) == width else None for v in options]
        assert r.deviation_text == (None if r.deviation is None else str(r.deviation))
        if r.deviation is None:
            assert r.whitened is None
            continue
        v = next(v for v in options if len(v) == width)
        centred = np.array([float(Fraction(n * a - s, n)) for a, s in zip(v, sums)])
        expected = centred @ columns[:, r.component - 1] / math.sqrt(values[r.component - 1])
        if r.component not in signs and abs(expected) > 1e-3:
            signs[r.component] = np.sign(expected * r.whitened)
        assert r.whitened == pytest.approx(expected * signs.get(r.component, 1), abs=1e-9)


def test_whitening(embeddings):
    rows = [(r.vec_id, r.embedding) for r in embeddings.collect()]
    check_whitening(whitening.whiten(embeddings.repartition(6)), rows)


def test_whitening_of_odd_rows(spark, odd_vectors):
    rows = [(r.vec_id, r.embedding) for r in odd_vectors.collect()]
    check_whitening(whitening.whiten(odd_vectors), rows)
    assert whitening.whiten(odd_vectors.limit(0)).collect() == []
    one = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])], VECTORS)).collect()
    assert [(r.component, r.whitened, r.explained, r.deviation) for r in one] == [(1, 0.0, 0.0, 0), (2, 0.0, 0.0, 0)]
    assert whitening.whiten(spark.createDataFrame([(1, [])], VECTORS)).collect() == []


def test_deviation_beyond_a_long():
    rows = np.random.default_rng(4).integers(-(2**35), 2**35, (50, 64))
    sums = rows.sum(axis=0).astype(object)
    expected = [sum((50 * a - s) ** 2 for a, s in zip(v, sums.tolist())) for v in rows.tolist()]
    assert whitening.deviations(rows, 50, sums) == expected
    wide = rows.astype(object)
    assert (whitening.gram(rows) == wide.T @ wide).all()


SPECTRA = [
    np.linspace(1, 64, 64), np.array([1.0] * 60 + [5.0] * 4), np.ones(64), np.array([0.0] * 62 + [3.0, 1e-9]),
    10.0 ** np.arange(-12, 52 - 12) / 1e30, np.array([7.0]), np.array([2.0, 2.0, 2.0]), np.zeros(5),
    np.array([1.0] * 20 + [1 + 1e-9] * 2 + [9, 9 - 1e-7, 9 - 2e-7]), np.array([1.0] * 8 + [100.0] * 12),
]


@pytest.mark.parametrize("spectrum", SPECTRA, ids=range(len(SPECTRA)))
def test_contour_against_whole_decomposition(spectrum):
    size = len(spectrum)
    basis, _ = np.linalg.qr(np.random.default_rng(size).standard_normal((size, size)))
    symmetric = basis * spectrum @ basis.T
    symmetric = (symmetric + symmetric.T) / 2
    exact = np.linalg.eigvalsh(symmetric)[::-1]
    for shift in (-1.0, 0.5 * exact[0], 2 * exact[0] + 1):
        assert whitening.inertia_above(symmetric, shift) == (exact > shift).sum()
    values, columns = whitening.principal(symmetric, 4)
    noise = 64 * size * np.finfo(float).eps * exact[0]
    assert len(values) >= min(4, (exact > noise).sum()) and len(values) <= 4
    assert values == pytest.approx(exact[: len(values)], abs=noise)
    assert np.abs(columns.T @ columns - np.eye(len(values))).max(initial=0) < 1e-10
    assert np.abs(symmetric @ columns - columns * values).max(initial=0) <= 1e3 * size * np.finfo(float).eps * max(exact[0], 0)


def test_token_files(spark, texts_by_id):
    import public_tokenizers
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found = {r.doc_id: r for r in queries.QUERIES["op13_patched_blocks"](spark, SF).collect()}
    at = 0
    for doc_id in sorted(texts_by_id):
        ids = [*slow.encode(texts_by_id[doc_id], add_special_tokens=False).ids, 0]
        r = found.pop(doc_id)
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert not found


def test_token_files_of_odd_rows(spark, odd, clashing, empty, tmp_path):
    from corpusloom.llm.packing import encode

    results = []
    for k, docs in enumerate((odd, clashing)):
        pfor.write_ids(docs, f"file:{tmp_path}/{k}")
        rows = sorted(pfor.read_ids(spark, f"{tmp_path}/{k}").collect(), key=lambda r: r.start)
        results.append([(r.doc_id, r.start, r.n_tokens, bytes(r.ids)) for r in rows])
    assert results[0] == results[1] and len(rows) == odd.count()
    assert [r.doc_id for r in rows] == sorted((r.doc_id for r in rows), key=lambda i: (i is not None, i))
    texts = {r.doc_id: r.text or "" for r in odd.collect()}
    at = 0
    for r in rows:
        assert r.start == at and bytes(r.ids) == np.append(encode(texts[r.doc_id]), 0).astype("<u4").tobytes()
        at += r.n_tokens
    pfor.write_ids(empty, f"{tmp_path}/none")
    assert pfor.read_ids(spark, f"{tmp_path}/none").collect() == []


ids_of_any_size = st.lists(
    st.one_of(st.integers(0, 50256), st.integers(0, 3), st.sampled_from([2**32 - 1, 2**31, 0])), min_size=1, max_size=700
)


@settings(max_examples=150, deadline=None)
@given(ids_of_any_size)
def test_blocks_round_trip(ids):
    data, starts = pfor.pack_blocks(np.array(ids, np.uint32))
    assert pfor.unpack_blocks(data, starts)[: len(ids)].tolist() == ids
    for at, block in enumerate(data[a:b] for a, b in zip(starts, [*starts[1:], len(data)])):  # the layout, byte by byte
        minimum, width, count = int.from_bytes(block[:4], "little"), block[4], block[5]
        mine = ids[at * 128 : at * 128 + 128]
        over = sorted(v - minimum for v in mine + [minimum] * (128 - len(mine)))
        assert minimum == min(mine) and width == over[115].bit_length() and len(block) == 6 + 16 * width + 5 * count
        bits = int.from_bytes(block[6 : 6 + 16 * width], "little")
        places = block[6 + 16 * width : 6 + 16 * width + count]
        for k, value in enumerate(mine):
            low = bits >> k * width & (1 << width) - 1
            rest = block[6 + 16 * width + count :]
            high = int.from_bytes(rest[4 * places.index(k) :][:4], "little") if k in places else 0
            assert minimum + low + (high << width) == value


def test_documents_alone(tmp_path):
    draw = np.random.default_rng(5)
    docs = [draw.integers(0, 50257, n).astype(np.uint32) for n in (1, 127, 128, 129, 1, 5000, 300)]
    with pa.OSFile(f"{tmp_path}/x", "wb") as stream:
        writer = pfor.Writer(stream)
        for k, ids in enumerate(docs):
            writer.add(k or None, ids)
        writer.close()
    with pa.OSFile(f"{tmp_path}/x", "rb") as stream:
        reader = pfor.Reader(stream)
        for k in (5, 0, 6, 3, 1, 2, 4):
            assert (reader.document(k) == docs[k]).all()
        for limit in (1, 200, 10**6):
            parts = [(first, ids) for first, _, ids in reader.runs(limit)]
            assert (np.concatenate([ids for _, ids in parts]) == np.concatenate(docs)).all()
        assert reader.doc_ids.tolist() == [0, 1, 2, 3, 4, 5, 6] and reader.named.tolist() == [0, 1, 1, 1, 1, 1, 1]
