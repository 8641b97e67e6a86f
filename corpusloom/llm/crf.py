"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. Line features come from its characters and words and from the lines beside it; transitions tie
neighbours together. Forward-backward gives each line's probability of being good, and a document's score is
their mean weighted by line length.

The field is fitted by gradient steps, summed in tasks, on at most ``SAMPLE_ROWS`` labelled training documents, those that come first by hash of
doc_id, in which every line takes its document's label with ``TRUST``, as a bad document may hold good lines. Nothing
else is learned, so predictions do not depend on other rows.

Nulls: a null text is empty: one line without characters. Rows without doc_id or label are not learned from. Labels that
repeat a doc_id with different values count as the smaller one. Without labelled rows every score is 0.5. Repeated rows
give a row each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.tasks import map_batches, texts
from corpusloom.session import store

SAMPLE_ROWS = 6_000
THRESHOLD = 0.7
TRUST = 0.95
STEPS, RATE, SHRINK = 60, 0.15, 1e-3
#: Tasks that add up the slopes of the sample.
FIT_TASKS = 8
#: Longer chains are worked on in segments side by side, with exact messages between them.
SEGMENT = 512

#: Byte classes counted per line.
_CLASSES = ("letter", "upper", "digit", "blank", "stop", "mark", "wide")
_TABLE = np.zeros(256, np.uint8)
for _k, _bytes in enumerate(
    (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\v\f", b".,;:?!'\"-()", b"#$%&*+/<=>@[\\]^_`{|}~", bytes(range(0x80, 0x100)))
):
    _TABLE[list(_bytes)] = _k + 1
#: Own features of a line; those of both neighbours, and a bias, are added.
OWN = 12


def line_features(parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features per line, bytes per line, lines per document) of whole texts."""
    lines, counts = [], []
    for text in parts:
        own = text.encode("utf-8", "surrogatepass").split(b"\n")
        lines += own
        counts.append(len(own))
    sizes = np.array([len(x) for x in lines], np.int64)
    ends = np.cumsum(sizes + 1)
    starts = ends - sizes - 1
    kinds = _TABLE[np.frombuffer(b"\n".join([*lines, b""]), np.uint8)]
    per = np.stack([np.add.reduceat(kinds == k + 1, starts, dtype=np.int64) for k in range(len(_CLASSES))], axis=1)
    words = np.zeros((len(lines), 3))
    for k, line in enumerate(lines):
        found = line.split()
        words[k] = len(found), len(set(found)), len(found[-1]) if found else 0
    size, n = np.maximum(sizes, 1), np.maximum(words[:, 0], 1)
    starts_ok = np.minimum(starts, len(kinds) - 1)
    last = kinds[np.maximum(ends - 2, starts_ok)]
    features = np.empty((len(lines), OWN))
    features[:, 0] = np.log1p(sizes) / 6
    features[:, 1] = sizes == 0
    features[:, 2] = per[:, 1] / size
    features[:, 3] = per[:, 2] / size
    features[:, 4] = per[:, 3] / size
    features[:, 5] = per[:, 4] / size
    features[:, 6] = per[:, 5] / size
    features[:, 7] = per[:, 6] / size
    features[:, 8] = 1 - words[:, 1] / n
    features[:, 9] = np.minimum((sizes - per[:, 3]) / n, 40) / 20
    features[:, 10] = last == 5
    features[:, 11] = np.minimum(per[:, 5] / n, 3)
    counts = np.array(counts, np.int64)
    first = np.zeros(len(lines), bool)
    first[np.cumsum(counts) - counts] = True
    final = np.roll(first, -1)
    before, after = np.roll(features, 1, axis=0), np.roll(features, -1, axis=0)
    before[first], after[final] = 0, 0
    return np.hstack([features, before, after, first[:, None], final[:, None], np.ones((len(lines), 1))]), sizes, counts


N_FEATURES = 3 * OWN + 3


def _transfers(unary: np.ndarray, step: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The matrix of every segment from the label of its first line to that of its last, up to a factor."""
    out = np.zeros((len(starts), 2, 2))
    out[:, [0, 1], [0, 1]] = unary[starts]
    for t in range(1, int(lengths.max(initial=0))):
        on = np.flatnonzero(lengths > t)
        out[on] = (out[on] @ step) * unary[starts[on] + t][:, None, :]
        out[on] /= out[on].sum(axis=(1, 2), keepdims=True)
    return out


def _segments(unary: np.ndarray, step: np.ndarray, counts: np.ndarray):
    """Starts, lengths and chains of the segments, with what enters each from before and comes back from behind."""
    chain = np.repeat(np.arange(len(counts)), -(-counts // SEGMENT))
    own = np.arange(len(chain)) - np.searchsorted(chain, chain)
    starts = (np.cumsum(counts) - counts)[chain] + own * SEGMENT
    lengths = np.minimum(counts[chain] - own * SEGMENT, SEGMENT)
    enter, leave = np.ones((len(chain), 2)), np.ones((len(chain), 2))
    joined = np.flatnonzero(np.diff(chain) == 0)  # segments with another one of their chain behind
    if len(joined):
        part = np.union1d(joined, joined + 1)
        matrices = dict(zip(part.tolist(), _transfers(unary, step, starts[part], lengths[part])))
        for k in joined.tolist():
            message = enter[k] @ matrices[k] @ step
            enter[k + 1] = message / message.sum()
        for k in joined[::-1].tolist():
            message = step @ (matrices[k + 1] @ leave[k + 1])
            leave[k] = message / message.sum()
    return starts, lengths, chain, enter, leave, joined


def marginals(odds: np.ndarray, change: np.ndarray, counts: np.ndarray, weights=None) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of every line, and the expected transitions (2 x 2) summed over all chains, each with its weight.

    ``odds`` are the lines' scores for good over bad, ``change`` the log weights from label to label. All chains, long
    ones as segments, go one step at a time, the longest first, so each step is one vector operation.
    """
    weights = np.ones(len(counts)) if weights is None else weights
    unary = np.stack([np.zeros_like(odds), odds], axis=1)
    unary -= unary.max(axis=1, keepdims=True)
    unary, step = np.exp(unary), np.exp(change - change.max())
    starts, lengths, chain, enter, leave, joined = _segments(unary, step, counts)
    order = np.argsort(-lengths, kind="stable")
    begins, sizes, shares = starts[order], lengths[order], weights[chain[order]]
    ahead, back = unary.copy(), np.ones_like(unary)
    ahead[starts] *= enter
    back[starts + lengths - 1] = leave
    longest = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(longest + 1), side="left")  # segments longer than t
    for t in range(longest):
        rows = begins[: active[t]] + t
        if t:
            ahead[rows] = (ahead[rows - 1] @ step) * unary[rows]
        ahead[rows] /= ahead[rows].sum(axis=1, keepdims=True)

    def expected(rows: np.ndarray, shares: np.ndarray) -> np.ndarray:
        joint = ahead[rows][:, :, None] * step * (unary[rows + 1] * back[rows + 1])[:, None, :]
        return (joint / joint.sum(axis=(1, 2), keepdims=True) * shares[:, None, None]).sum(axis=0)

    pairs = np.zeros((2, 2))
    for t in range(longest - 2, -1, -1):
        rows = begins[: active[t + 1]] + t
        back[rows] = (unary[rows + 1] * back[rows + 1]) @ step.T
        pairs += expected(rows, shares[: active[t + 1]])
        back[rows] /= back[rows].sum(axis=1, keepdims=True)
    pairs += expected(starts[joined] + lengths[joined] - 1, weights[chain[joined]])
    both = ahead * back
    return both[:, 1] / both.sum(axis=1), pairs


def totals(features: np.ndarray, counts: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """What a fit has to know of all chains before its first step, as sums that add up over parts.

    Lines, sums and squares of their features; then for each label documents, the sum of one over their lines, and
    documents that have a transition.
    """
    per = [np.bincount(labels, of, 2) for of in (np.ones(len(counts)), 1.0 / counts, (counts > 1).astype(float))]
    return np.concatenate([[len(features)], features.sum(axis=0), (features**2).sum(axis=0), *per])


def slopes(features: np.ndarray, counts: np.ndarray, labels: np.ndarray, theta, change, line, link) -> np.ndarray:
    """Sums over chains of a step: of the weights of the features, then the expected transitions.

    ``line`` and ``link`` are the weights that documents of each label give to their lines and to their transitions.
    """
    good, pairs = marginals(features @ theta, change, counts, link[labels] / np.maximum(counts - 1, 1))
    target = np.where(labels == 1, TRUST, 1 - TRUST)
    missing = (np.repeat(target, counts) - good) * np.repeat(line[labels] / counts, counts)
    return np.concatenate([features.T @ missing, pairs.ravel()])


def descend(sums: np.ndarray, slopes_of) -> dict:
    """Weights of the field by gradient steps with momentum scaling, from totals and a function that adds up slopes.

    A line's target is its document's label with ``TRUST``; the target of a transition is the product of its lines'.
    Documents weigh the same whatever their length, and both labels weigh the same.
    """
    mean, square = sums[1:-6].reshape(2, -1) / sums[0]
    spread = np.sqrt(np.maximum(square - mean**2, 0))
    scale = np.where(spread > 1e-3, spread, 1.0)  # constants stay: scaled up, the rounding of their slopes would grow
    documents, inverse, linked = sums[-6:].reshape(3, 2)
    share = 1.0 / np.maximum(documents, 1)
    line = share / (share @ inverse)
    link = share / max(share @ linked, 1e-12)
    sides = np.array([[TRUST, 1 - TRUST], [1 - TRUST, TRUST]])  # of labels 0 and 1: bad, good
    wanted = np.einsum("k,ki,kj->ij", link * linked, sides, sides)
    theta, change = np.zeros(len(scale)), np.zeros((2, 2))
    pace = [np.zeros_like(theta), np.zeros_like(change)]
    size = [np.zeros_like(theta), np.zeros_like(change)]
    for t in range(1, STEPS + 1):
        found = slopes_of(theta / scale, change, line, link)
        steps = [found[:-4] / scale - SHRINK * theta, wanted - found[-4:].reshape(2, 2) - SHRINK * change]
        for k, (value, slope) in enumerate(zip((theta, change), steps)):
            pace[k] = 0.9 * pace[k] + 0.1 * slope
            size[k] = 0.999 * size[k] + 0.001 * slope**2
            value += RATE * (pace[k] / (1 - 0.9**t)) / (np.sqrt(size[k] / (1 - 0.999**t)) + 1e-8)
    return {"theta": theta / scale, "change": change}


def fit_chains(features: np.ndarray, counts: np.ndarray, labels: np.ndarray) -> dict:
    """The field of chains held in memory; labels are per document."""
    return descend(totals(features, counts, labels), lambda *state: slopes(features, counts, labels, *state))


def quality(parts: list[str], model: dict) -> np.ndarray:
    """The length-weighted share of good lines of each text."""
    if model["theta"] is None:
        return np.full(len(parts), 0.5)
    features, sizes, counts = line_features(parts)
    good, _ = marginals(features @ model["theta"], model["change"], counts)
    starts = np.cumsum(counts) - counts
    weight = sizes + 1.0
    return np.clip(np.add.reduceat(good * weight, starts) / np.add.reduceat(weight, starts), 0.0, 1.0)


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> dict:
    """The model, fitted on a bounded sample of labelled rows.

    Features of the sample's lines are stored; each step is a job over them that adds up slopes in tasks, so the driver
    holds the weights and a vector per batch, whatever the length of the texts.
    """
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").where(~held_out())
    known = known.groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    chosen = store(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows), "crf-sample")
    sample = docs.select("doc_id", "text").join(chosen, "doc_id").select("doc_id", "text", "quality")
    # A fixed order of rows, so that sums do not depend on how the tables were read.
    dealt = sample.repartition(FIT_TASKS, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    chains = store(map_batches(dealt, _sampled, "doc_id long, quality int, features binary"), "crf-chains")

    def added(kernel, *state) -> np.ndarray | None:
        parts = map_batches(chains, _summed, "first long, sums array<double>", kernel, state).toArrow().sort_by("first")
        return np.sum(parts.column("sums").to_pylist(), axis=0) if parts.num_rows else None

    sums = added(totals)
    return {"theta": None, "change": None} if sums is None else descend(sums, lambda *state: added(slopes, *state))


def _sampled(batch) -> dict:
    features, _, counts = line_features(texts(batch))
    cut = np.split(features.astype(np.float32), np.cumsum(counts)[:-1])
    own = {c: batch.column(c) for c in ("doc_id", "quality")}
    return own | {"features": pa.array([c.tobytes() for c in cut], pa.binary())}


def _summed(batch, kernel, state) -> dict:
    chains = [np.frombuffer(raw, np.float32).reshape(-1, N_FEATURES) for raw in batch.column("features").to_pylist()]
    counts = np.array([len(c) for c in chains], np.int64)
    labels = (batch.column("quality").to_numpy(zero_copy_only=False) == 1).astype(np.int64)
    sums = kernel(np.concatenate(chains).astype(float), counts, labels, *state)
    return {"first": batch.column("doc_id").slice(0, 1), "sums": [sums.tolist()]}


def _scored(batch, model) -> dict:
    score = quality(texts(batch), model.value)
    own = {c: batch.column(c) for c in ("doc_id", "held_out")}
    return own | {"score": score, "predicted": (score >= THRESHOLD).astype(np.int32)}


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; a map without shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    chosen = docs.select("doc_id", held_out().alias("held_out"), "text")
    return map_batches(chosen, _scored, "doc_id long, held_out boolean, score double, predicted int", shared)
