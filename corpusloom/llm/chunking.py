"""Content-defined chunking: shift-resistant document fingerprints.

A gear hash rolls over the UTF-8 bytes and its low bits are the last bytes seen, so a boundary depends on
content alone and edits move only the chunks they touch. Chunking is normalised: up to the usual
size a stricter mask has to match, beyond it a looser one, which keeps sizes close together. A fingerprint is
the set of (digest, length) of its chunks; the containment of one text in another is the share of its chunk
weight, length by length, found in the other.

Nulls: a null text is empty, its fingerprint is the empty string and two empty fingerprints are alike
(1.0). Rows come in order of (doc_id, text), null ids first; repeated rows follow one another. The only row of a
table is its own next document. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.llm.tasks import map_batches, per_task, texts
from corpusloom.session import store

SMALLEST, USUAL, LARGEST = 16, 32, 128
STRICT, LOOSE = np.uint32(0x7F << 25), np.uint32(0x0F << 25)
#: One 32-bit gear per byte value, drawn by rule.
GEAR = np.array([xxhash.xxh32_intdigest(bytes([b]), 7) for b in range(256)], np.uint32)
_RUN = 1 << 20
_WINDOW = 32


def _rolled(data: np.ndarray) -> np.ndarray:
    """The gear hash at every byte: sum of gear[byte j back] << j over the last 32 bytes."""
    rolled = GEAR[data]
    for step in (1, 2, 4, 8, 16):
        rolled[step:] += rolled[:-step] << np.uint32(step)
    return rolled


def boundaries(data: bytes) -> list[int]:
    """Ends of the chunks, the length of the text included."""
    size, whole = len(data), np.frombuffer(data, np.uint8)
    strict, loose = [], []
    for at in range(0, size, _RUN):
        lead = min(at, _WINDOW)
        rolled = _rolled(whole[at - lead : at + _RUN])[lead:]
        found = np.flatnonzero(rolled & LOOSE == 0)
        loose += (found + at + 1).tolist()
        strict += (found[rolled[found] & STRICT == 0] + at + 1).tolist()
    ends, start, s, n = [], 0, 0, 0
    while size - start > SMALLEST:
        while s < len(strict) and strict[s] < start + SMALLEST:
            s += 1
        end = strict[s] if s < len(strict) and strict[s] <= start + USUAL else 0
        if not end:
            while n < len(loose) and loose[n] <= start + USUAL:
                n += 1
            end = loose[n] if n < len(loose) else size
            end = min(end, start + LARGEST, size)
        ends.append(end)
        start = end
    if start < size:
        ends.append(size)
    return ends


def chunk_set(text: str) -> dict[str, int]:
    """Digest -> length for the distinct chunks of a text; a digest is 8 hex digits."""
    data = text.encode("utf-8", "surrogatepass")
    chunks, start = {}, 0
    for end in boundaries(data):
        chunks[xxhash.xxh32_hexdigest(data[start:end])] = end - start
        start = end
    return chunks


def as_fingerprint(chunks: dict[str, int]) -> str:
    """The set as text: sorted digests, each with its chunk's length as two hex digits."""
    return "".join([f"{digest}{length:02x}" for digest, length in sorted(chunks.items())])


def containment(of: dict[str, int], in_: dict[str, int]) -> float:
    """Share of the chunk weight of ``of`` that ``in_`` has too."""
    total = sum(of.values())
    if not total:
        return 0.0 if in_ else 1.0
    return sum([of[digest] for digest in of.keys() & in_.keys()]) / total


def edited(text: str, following: str) -> str:
    """The last quarter of ``text`` gives way to as many first characters of ``following``."""
    swap = len(text) // 4
    return text[: len(text) - swap] + following[:swap]


RESULT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)
_COLUMNS = [c.split()[0] for c in RESULT.split(", ")]


def compare(doc_id, text: str, chunks: dict, following: str, next_chunks: dict) -> list:
    """The result columns of one document, given the next one."""
    changed = edited(text, following)
    changed_chunks = chunk_set(changed)
    digest = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
    return [
        doc_id, len(text), digest, as_fingerprint(chunks), as_fingerprint(changed_chunks),
        containment(chunks, changed_chunks), containment(chunks, next_chunks),
    ]


@per_task
class _Sorted:
    """Goes along sorted ranges; every row meets its successor, the last one the head of the next range."""

    def __init__(self):
        self.before = None

    def __call__(self, batch) -> dict:
        rows, names = [], ("range", "head", "doc_id")
        for range_, head, doc_id, text in zip(*[batch.column(c).to_pylist() for c in names], texts(batch)):
            chunks = chunk_set(text)
            if self.before is not None and self.before[0] == range_:
                rows.append(compare(*self.before[1:], text, chunks))
            self.before = None if head else (range_, doc_id, text, chunks)
        return dict(zip(_COLUMNS, map(list, zip(*rows)))) if rows else {}


def _range_of(bounds: list[int]) -> Column:
    """Number of the range of ``doc_id``; null ids come before all others."""
    inside = F.size(F.filter(F.array(*[F.lit(b).cast("long") for b in bounds]), lambda b: F.col("doc_id") >= b))
    return F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(inside)


def shift_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how alike they are.

    Ranges of doc_id come from its quantiles, one bound per partition. The first text of each range is sent to the end
    of the range before it as well, so texts are shuffled once and no range needs another one's rows.
    """
    spark = docs.sparkSession
    chosen = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = F.array(*[F.lit(k / parts) for k in range(1, parts)]) if parts > 1 else F.array(F.lit(0.5))
    bounds = sorted(set(docs.agg(F.percentile_approx("doc_id", cuts, 50 * parts)).first()[0] or []))
    ranged = chosen.withColumn("range", _range_of(bounds))
    # One row per range and only one of its texts: what is ordered in a single task here.
    lowest = store(ranged.groupBy("range").agg(F.min("doc_id").alias("lowest")), "ranges")
    first = ranged.withColumnRenamed("range", "_range").join(lowest, F.col("doc_id").eqNullSafe(F.col("lowest")))
    first = store(first.where("range = _range").groupBy("range").agg(F.min("text").alias("text")), "range-heads")
    in_order = Window.orderBy("range")
    before = first.select("range", F.lag("range").over(in_order).alias("before"), F.max("range").over(Window.partitionBy()).alias("last"))
    heads = first.join(before, "range").select(
        F.lit(None).cast("long").alias("doc_id"), "text", F.coalesce("before", "last").alias("range"), F.lit(True).alias("head")
    )
    dealt = (
        ranged.withColumn("head", F.lit(False))
        .unionByName(heads)
        .repartitionByRange(parts, "range")
        .sortWithinPartitions("range", "head", "doc_id", "text")
    )
    return map_batches(dealt, _Sorted, RESULT)
