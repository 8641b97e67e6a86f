"""Harmonic packing of tokenised documents into sequences of fixed capacity.

A piece of length n belongs to reciprocal class k when n lies in (capacity / (k + 1), capacity / k];
a bin of class k takes exactly k pieces. Documents are cut so that pieces nearly fill their share of a
bin: a rest that would leave more than ``1 - MIN_FILL`` of its bin open gives up a head as long as the
next class's share. Pieces below capacity / CLASSES form the last class, whose bins take what fits.

Pieces are range-partitioned by class, so each worker fills its own bins and nothing is counted
across workers; a class as large as a third of all pieces is split over many ranges. A range leaves at
most one open bin per class it meets.

Nulls: a null text is empty and packs its closing id alone; rows with a null doc_id are packed as
well. Repeated rows are packed once per row. An empty table gives no pieces. Other columns are ignored.
"""

from __future__ import annotations

import base64
import zlib
from functools import cache

import numpy as np
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.tasks import map_batches, per_task, texts
from corpusloom.session import store

CAPACITY = 1024
END_ID = 0
CLASSES = 32
MIN_FILL = 63 / 64
VOCABULARY = "byte_bpe_50k"
_SEQUENCE_BITS = 40
#: Beyond these characters the two tokenizer libraries might follow different Unicode versions.
_UNUSUAL = regex.compile(r"[^\x00-ɏ]|<\|endoftext\|>")


@cache
def _encoders(vocabulary: str):
    """The vocabulary's tokenizer, and a faster library's encoder over the same ranks."""
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding(
        vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )
    return Tokenizer.from_file(public_tokenizers.path(f"{vocabulary}.json")), fast


def encode(text: str, vocabulary: str = VOCABULARY) -> np.ndarray:
    """The ids of one text, as ``tokenizers`` gives them without added special tokens.

    Plain Latin text goes through the faster encoder with the same ranks and split pattern, all
    other text through ``tokenizers`` itself; a test holds both to the same ids. The faster one gives
    up on white-space runs of about a million characters, which then go to ``tokenizers`` as well.
    """
    slow, fast = _encoders(vocabulary)
    if not _UNUSUAL.search(text):
        try:
            return fast.encode_to_numpy(text)
        except ValueError:
            pass
    return np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)


def cut(length: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths of the pieces of one document, in order."""
    pieces = [capacity] * (length // capacity)
    rest = length % capacity
    while rest:
        k = capacity // rest
        if k >= CLASSES or k * rest >= MIN_FILL * capacity:
            pieces.append(rest)
            break
        head = capacity // (k + 1)
        pieces.append(head)
        rest -= head
    return pieces


def reciprocal_class(length: int, capacity: int = CAPACITY) -> int:
    return min(capacity // length, CLASSES)


def _pieces(batch, capacity: int, keep_ids: bool, vocabulary: str) -> dict:
    names = ["doc_id", "start", "length", "class", "ids_crc32", "doc_tokens", *(["ids"] if keep_ids else [])]
    rows: dict[str, list] = {name: [] for name in names}
    for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts(batch)):
        ids = np.append(encode(text, vocabulary), np.uint32(END_ID)).astype("<u4")
        start = 0
        for length in cut(len(ids), capacity):
            piece = ids[start : start + length]
            values = [doc_id, start, length, reciprocal_class(length, capacity), zlib.crc32(piece.tobytes()), len(ids)]
            for name, value in zip(names, [*values, piece]):
                rows[name].append(value)
            start += length
    return rows


@per_task
class _Bins:
    """Fills bins along one range of pieces that come sorted by class."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.next = TaskContext.get().partitionId() << _SEQUENCE_BITS
        self.kind, self.count, self.filled = None, 0, 0

    def __call__(self, batch) -> dict:
        kinds, lengths = batch.column("class").to_pylist(), batch.column("length").to_pylist()
        sequence, offset = [], []
        for kind, length in zip(kinds, lengths):
            full = self.count == kind if kind < CLASSES else self.filled + length > self.capacity
            if kind != self.kind or full:
                self.next += self.kind is not None
                self.kind, self.count, self.filled = kind, 0, 0
            sequence.append(self.next)
            offset.append(self.filled)
            self.count += 1
            self.filled += length
        rest = {name: batch.column(name) for name in batch.schema.names}
        return rest | {"sequence_id": sequence, "offset": offset}


def pack(
    docs: DataFrame, capacity: int = CAPACITY, keep_ids: bool = False, vocabulary: str = VOCABULARY
) -> DataFrame:
    """A row per piece: where it lies in its document, and in which sequence it lies where.

    ``keep_ids`` adds the token ids themselves, for ``sequences``.
    """
    schema = "doc_id long, start long, length long, class int, ids_crc32 long, doc_tokens long"
    schema += ", ids array<int>" if keep_ids else ""
    cuts = map_batches(docs.select("doc_id", "text"), _pieces, schema, capacity, keep_ids, vocabulary)
    cuts = store(cuts, "pieces")
    order = ["class", "_spread", "doc_id", "start"]
    ranged = (
        cuts.withColumn("_spread", F.xxhash64("doc_id", "start"))
        .repartitionByRange(*order)
        .sortWithinPartitions(*order, "length", "ids_crc32")
        .drop("_spread")
    )
    return map_batches(ranged, _Bins, f"{schema}, sequence_id long, offset long", capacity)


def sequences(pieces: DataFrame, capacity: int = CAPACITY, pad_id: int = END_ID) -> DataFrame:
    """sequence_id and its ids, padded to ``capacity`` unless its length is a power of two.

    A group holds at most ``capacity`` ids.
    """
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = pieces.groupBy("sequence_id").agg(F.flatten(F.transform(ordered, lambda p: p["ids"])).alias("ids"))
    size = F.size("ids")
    power = size.bitwiseAND(size - 1) == 0
    padded = F.concat("ids", F.array_repeat(F.lit(pad_id), capacity - size))
    return joined.select("sequence_id", F.when(power, F.col("ids")).otherwise(padded).alias("ids"))
