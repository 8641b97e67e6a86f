"""Token ids in binary files of patched frame-of-reference blocks.

Documents are range-partitioned by doc_id and sorted; each task encodes its texts, closes every document with an
id and writes one file. The ids of a file are one stream cut into blocks of 128. A block keeps its minimum, and
every id less the minimum in as many bits as the 90th percentile of the block needs; of larger ones the low
bits stay in place while position and high bits go to an exception list. An index gives the start of every
block, so any document can be read alone.

File, little-endian:
    "PFR1"
    blocks    minimum u32, width u8, exceptions u8, packed low bits (16 x width bytes), positions u8 each, high bits u32 each
    index     start of every block, u64 each
    documents has an id u8 each, doc_id i64 each, ids u64 each
    footer    ids u64, blocks u64, documents u64, start of the index u64, "PFR1"

A task names its file after a number of its own, and only files in the manifest count: the manifest is a table
that Spark commits with one row per finished task, so files of failed or repeated attempts are never read.
Files are opened through pyarrow, which knows local and shared folders, HDFS and object stores.

Nulls: a null text is empty, its document is the closing id alone; null doc_ids come first. Rows that share a
doc_id are documents of their own, ordered by a digest and by text. An empty table gives no file and no row.
Other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.llm.packing import END_ID, VOCABULARY, encode
from corpusloom.llm.tasks import map_batches, per_task, small_batches, texts

BLOCK = 128
PERCENTILE = 0.9
MAGIC = b"PFR1"
_HEAD = np.dtype([("minimum", "<u4"), ("width", "u1"), ("exceptions", "u1")])
_FOOTER = struct.Struct("<4Q4s")
#: Ids held before blocks are written, and ids decoded at a time.
_RUN = BLOCK << 13
MANIFEST = "part int, file string, documents long, ids long, bytes long"
DOCUMENTS = "doc_id long, start long, n_tokens long, ids binary"


def _bits(values: np.ndarray) -> np.ndarray:
    """Bit length of every unsigned value."""
    return np.frexp(values.astype(np.float64))[1].astype(np.uint8)


def _layout(widths: np.ndarray, exceptions: np.ndarray) -> np.ndarray:
    """Where every block starts, and after the last of them the end."""
    sizes = _HEAD.itemsize + BLOCK // 8 * widths.astype(np.int64) + 5 * exceptions.astype(np.int64)
    return np.concatenate(([0], np.cumsum(sizes)))


def _exceptions(starts: np.ndarray, widths: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every exception: its block, the byte of its position, the first byte of its high bits."""
    block = np.repeat(np.arange(len(counts)), counts)
    rank = np.arange(len(block)) - np.repeat(np.cumsum(counts) - counts, counts)
    first = starts[block] + _HEAD.itemsize + BLOCK // 8 * widths[block].astype(np.int64)
    return block, first + rank, first + counts[block] + 4 * rank


def pack_blocks(ids: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The blocks of ``ids`` and the start of each; the last one is filled up with its minimum."""
    count = -(-len(ids) // BLOCK)
    rows = np.full(count * BLOCK, ids[(count - 1) * BLOCK :].min(), np.uint32)
    rows[: len(ids)] = ids
    rows = rows.reshape(count, BLOCK)
    heads = np.empty(count, _HEAD)
    heads["minimum"] = rows.min(axis=1)
    over = rows - heads["minimum"][:, None]
    rank = int(np.ceil(PERCENTILE * BLOCK)) - 1
    widths = heads["width"] = _bits(np.partition(over, rank, axis=1)[:, rank])
    high = (over.astype(np.uint64) >> widths[:, None].astype(np.uint64)).astype(np.uint32)
    counts = np.count_nonzero(high, axis=1)
    heads["exceptions"] = counts
    starts = _layout(widths, counts)
    out = np.empty(starts[-1], np.uint8)
    out[starts[:-1, None] + np.arange(_HEAD.itemsize)] = heads.view(np.uint8).reshape(count, -1)
    for width in np.unique(widths).tolist():
        mine = np.flatnonzero(widths == width)
        bits = np.unpackbits(over[mine].astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, count=width, bitorder="little")
        packed = np.packbits(bits.reshape(len(mine), BLOCK * width), axis=1, bitorder="little")
        out[starts[mine, None] + _HEAD.itemsize + np.arange(packed.shape[1])] = packed
    block, places, values = _exceptions(starts, widths, counts)
    _, out[places] = at = np.nonzero(high)
    out[values[:, None] + np.arange(4)] = high[at].astype("<u4").view(np.uint8).reshape(-1, 4)
    return out.tobytes(), starts[:-1]


def unpack_blocks(data: bytes, starts: np.ndarray) -> np.ndarray:
    """The ids of the blocks at ``starts`` in ``data``, whole blocks."""
    raw = np.frombuffer(data, np.uint8)
    heads = raw[starts[:, None] + np.arange(_HEAD.itemsize)].view(_HEAD).ravel()
    out = np.empty((len(starts), BLOCK), np.uint32)
    widths, counts = heads["width"], heads["exceptions"].astype(np.int64)
    for width in np.unique(widths).tolist():
        mine = np.flatnonzero(widths == width)
        packed = raw[starts[mine, None] + _HEAD.itemsize + np.arange(BLOCK // 8 * width)]
        bits = np.unpackbits(packed, axis=1, bitorder="little").reshape(len(mine) * BLOCK, width)
        low = np.zeros((len(bits), 4), np.uint8)
        low[:, : -(-width // 8)] = np.packbits(bits, axis=1, bitorder="little")
        out[mine] = low.view("<u4").reshape(-1, BLOCK)
    block, places, values = _exceptions(starts, widths, counts)
    high = raw[values[:, None] + np.arange(4)].view("<u4").ravel()
    out[block, raw[places]] |= high << widths[block].astype(np.uint32)
    return (out + heads["minimum"][:, None].astype(np.uint32)).ravel()


class Writer:
    """One file: ids go in document by document, the index and the documents' table follow at the end."""

    def __init__(self, stream):
        self.stream, self.at = stream, len(MAGIC)
        self.starts, self.named, self.doc_ids, self.lengths = [], [], [], []
        self.held, self.waiting, self.ids = [], 0, 0
        stream.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.named.append(doc_id is not None)
        self.doc_ids.append(doc_id or 0)
        self.lengths.append(len(ids))
        self.held.append(ids)
        self.waiting += len(ids)
        self.ids += len(ids)
        if self.waiting >= _RUN:
            self._flush(self.waiting // BLOCK * BLOCK)

    def _flush(self, upto: int) -> None:
        ids = np.concatenate(self.held)
        self.held, self.waiting = [ids[upto:]], len(ids) - upto
        for at in range(0, upto, _RUN):
            data, starts = pack_blocks(ids[at : min(at + _RUN, upto)])
            self.starts.append(self.at + starts)
            self.stream.write(data)
            self.at += len(data)

    def close(self) -> int:
        """Write what is left and the tables; the size of the file."""
        if self.waiting:
            self._flush(self.waiting)
        starts = np.concatenate([np.zeros(0, np.int64), *self.starts])
        tables = [(starts, "<u8"), (self.named, "u1"), (self.doc_ids, "<i8"), (self.lengths, "<u8")]
        tail = b"".join(np.array(values, kind).tobytes() for values, kind in tables)
        tail += _FOOTER.pack(self.ids, len(starts), len(self.lengths), self.at, MAGIC)
        self.stream.write(tail)
        self.stream.close()
        return self.at + len(tail)


class Reader:
    """One file; documents by their position in it."""

    def __init__(self, stream):
        self.stream, size = stream, stream.size()
        self.ids, blocks, documents, index, magic = _FOOTER.unpack(stream.read_at(_FOOTER.size, size - _FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a file of patched blocks")
        tail, at = stream.read_at(size - _FOOTER.size - index, index), 0
        tables = []
        for kind, count in (("<u8", blocks), ("u1", documents), ("<i8", documents), ("<u8", documents)):
            tables.append(np.frombuffer(tail, kind, count, at))
            at += tables[-1].nbytes
        starts, self.named, self.doc_ids, lengths = tables
        self.starts = np.append(starts, index).astype(np.int64)
        self.ends = np.cumsum(lengths.astype(np.int64))

    def range(self, first: int, last: int) -> np.ndarray:
        """The ids from ``first`` to before ``last``; reads their blocks only."""
        low, high = first // BLOCK, -(-last // BLOCK)
        data = self.stream.read_at(int(self.starts[high] - self.starts[low]), int(self.starts[low]))
        ids = unpack_blocks(data, self.starts[low:high] - self.starts[low])
        return ids[first - low * BLOCK : last - low * BLOCK]

    def document(self, position: int) -> np.ndarray:
        first = int(self.ends[position - 1]) if position else 0
        return self.range(first, int(self.ends[position]))

    def runs(self, limit: int = _RUN):
        """(first document, ends, ids) of successive documents with about ``limit`` ids together, one at least."""
        first = begin = 0
        while first < len(self.ends):
            last = max(first + 1, int(np.searchsorted(self.ends, begin + limit, "right")))
            end = int(self.ends[last - 1])
            yield first, self.ends[first:last] - begin, self.range(begin, end)
            first, begin = last, end


def _uri(folder: str) -> str:
    """The folder as pyarrow wants it: Hadoop also writes file:/path."""
    folder = folder.rstrip("/")
    return folder.replace("file:/", "file:///", 1) if folder.startswith("file:/") and folder[6:7] != "/" else folder


@per_task
class _Files:
    """Encodes the texts of one partition into one file; a row for the manifest at the end."""

    def __init__(self, folder: str, vocabulary: str, end_id: int):
        self.part = TaskContext.get().partitionId()
        self.name = f"{folder}/ids-{self.part:06d}-{uuid.uuid4().hex}.pfr"
        self.vocabulary, self.end, self.writer = vocabulary, np.uint32(end_id), None

    def __call__(self, batch) -> dict:
        if self.writer is None:
            system, path = fs.FileSystem.from_uri(self.name)
            system.create_dir(path.rpartition("/")[0], recursive=True)
            self.writer = Writer(system.open_output_stream(path))
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts(batch)):
            self.writer.add(doc_id, np.append(encode(text, self.vocabulary), self.end).astype(np.uint32))
        return {}

    def finish(self):
        if self.writer is not None:
            size, w = self.writer.close(), self.writer
            yield {"part": [self.part], "file": [self.name], "documents": [len(w.lengths)], "ids": [w.ids], "bytes": [size]}


def write_ids(docs: DataFrame, folder: str, vocabulary: str = VOCABULARY, end_id: int = END_ID) -> None:
    """Write the ids of all texts in ascending doc_id order below ``folder``, which is an URI or a path.

    The files and their manifest stay there for ``read_ids``.
    """
    folder = _uri(folder)
    spread = F.xxhash64("text")
    ranged = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", spread.alias("_spread"))
        .repartitionByRange("doc_id", "_spread")
        .sortWithinPartitions("doc_id", "_spread", "text")
        .drop("_spread")
    )
    with small_batches(docs.sparkSession):
        map_batches(ranged, _Files, MANIFEST, f"{folder}/ids", vocabulary, end_id).write.parquet(f"{folder}/manifest")


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and the ids (four bytes each, little-endian) of every document, in any order."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{_uri(folder)}/manifest")
    # One row per file meets in one place, to add up what precedes each.
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.select("file", F.coalesce(F.sum("ids").over(earlier), F.lit(0)).alias("before"))
    # A task per file; the number keeps adaptive execution from reading all files in one task for their short names.
    return placed.repartition(max(1, manifest.count())).mapInArrow(_read, DOCUMENTS)


def _read(batches):
    for batch in batches:
        for name, before in zip(batch.column("file").to_pylist(), batch.column("before").to_pylist()):
            system, path = fs.FileSystem.from_uri(name)
            with system.open_input_file(path) as stream:
                reader = Reader(stream)
                for first, ends, ids in reader.runs():
                    yield _record(reader, first, ends, ids, before)
                    before += len(ids)


def _record(reader: Reader, first: int, ends: np.ndarray, ids: np.ndarray, before: int):
    last = first + len(ends)
    begins = np.concatenate(([0], ends[:-1]))
    offsets = pa.array(np.concatenate(([0], ends)) * 4, pa.int32())
    data = pa.Array.from_buffers(pa.binary(), len(ends), [None, offsets.buffers()[1], pa.py_buffer(ids.astype("<u4").tobytes())])
    return pa.RecordBatch.from_arrays(
        [
            pa.array(reader.doc_ids[first:last], mask=reader.named[first:last] == 0),
            pa.array(before + begins),
            pa.array(ends - begins),
            data,
        ],
        names=["doc_id", "start", "n_tokens", "ids"],
    )
