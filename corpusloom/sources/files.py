"""A data source that writes one object per file, put together from pieces that tasks have written.

Spark's own text writer names objects itself. Here a row names an object and the pieces it consists of, ranges of what
tasks have staged; a task copies them in order, a buffer at a time, under a passing name and then moves the object into place, so a reader never sees
half of one and a repeated task replaces an object by the same bytes. The commit of the job writes ``_SUCCESS``.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from pathlib import PurePosixPath

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT = "corpusloom_files"
SUCCESS = "_SUCCESS"
_BUFFER = 4 << 20


@cache
def file_system(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder and the folder's path on it (plain paths are local, as are ``file:`` ones)."""
    if folder.startswith("file:/") and not folder.startswith("file://"):
        folder = folder.removeprefix("file:")
    return fs.FileSystem.from_uri(folder)


def checked_name(name: str) -> str:
    """A relative path that stays below its folder."""
    path = PurePosixPath(name)
    if not name or path.is_absolute() or ".." in path.parts:
        raise ValueError(f"not a file name below the output folder: {name!r}")
    return str(path)


def stage_pieces(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """Write the lines of a task to one object below ``folder``; yields file, part, bytes, and where each piece stands.

    Batches hold ``file``, ``text`` and the number of the partition, ``part``; rows of a file follow each other, so a
    piece, the lines of one file, is ``bytes`` from ``start`` of the object ``piece``.
    """
    system, base = file_system(folder)
    system.create_dir(base, recursive=True)
    piece, out, name, start, at, number = uuid.uuid4().hex, None, None, 0, 0, 0
    ended: list[tuple[str, int, int, int]] = []

    def pieces() -> pa.RecordBatch:
        files, parts, starts, sizes = zip(*ended)
        columns = {"file": files, "part": pa.array(parts, pa.int32()), "start": starts, "bytes": sizes, "piece": [piece] * len(files)}
        ended.clear()
        return pa.RecordBatch.from_pydict(columns)

    for batch in batches:
        rows = zip(batch.column("file").to_pylist(), batch.column("text").to_pylist(), batch.column("part").to_pylist())
        for file, text, part in rows:
            if out is None or file != name:
                checked_name(file)
                if out is None:
                    out = system.open_output_stream(f"{base}/{piece}", buffer_size=1 << 16)
                else:
                    ended.append((name, number, start, at - start))
                name, start, number = file, at, part
            line = f"{text or ''}\n".encode("utf-8", "surrogatepass")
            out.write(line)
            at += len(line)
        if ended:
            yield pieces()
    if out is not None:
        out.close()
        ended.append((name, number, start, at - start))
        yield pieces()


@dataclass
class Written(WriterCommitMessage):
    """What one task has put into place."""

    objects: int
    bytes: int


class Staged:
    """Staged pieces; the object read last stays open, as the next piece most often follows there."""

    def __init__(self, folder: str):
        self.system, self.base = file_system(folder)
        self.name, self.data = None, None

    def copy(self, piece: Row, out) -> None:
        if piece.piece != self.name:
            self.close()
            self.name, self.data = piece.piece, self.system.open_input_file(f"{self.base}/{piece.piece}")
        self.data.seek(piece.start)
        left = piece.bytes
        while left:
            block = self.data.read(min(left, _BUFFER))
            if not block:
                raise EOFError(f"{piece.piece} ends within a piece")
            out.write(block)
            left -= len(block)

    def close(self) -> None:
        if self.data is not None:
            self.data.close()
        self.name, self.data = None, None

    def __enter__(self) -> Staged:
        return self

    def __exit__(self, *_) -> None:
        self.close()


class FilesWriter(DataSourceWriter):
    """Rows ``(target, pieces)`` become objects below the folder."""

    def __init__(self, folder: str, staged: str):
        self.folder, self.staged = folder, staged

    def write(self, iterator: Iterator[Row]) -> Written:
        system, base = file_system(self.folder)
        objects = size = 0
        system.create_dir(f"{base}/_passing", recursive=True)
        with Staged(self.staged) as staged:
            for row in iterator:
                target = f"{base}/{checked_name(row.target)}"
                passing = f"{base}/_passing/{uuid.uuid4().hex}"
                system.create_dir(target.rsplit("/", 1)[0], recursive=True)
                with system.open_output_stream(passing) as out:
                    for piece in row.pieces:
                        staged.copy(piece, out)
                    size += out.tell()
                system.move(passing, target)
                objects += 1
        return Written(objects, size)

    def commit(self, messages: list[Written | None]) -> None:
        self._clear()
        system, base = file_system(self.folder)
        done = [m for m in messages if m is not None]
        system.create_dir(base, recursive=True)
        with system.open_output_stream(f"{base}/{SUCCESS}") as out:
            out.write(json.dumps({"objects": sum(m.objects for m in done), "bytes": sum(m.bytes for m in done)}).encode())

    def abort(self, messages: list[Written | None]) -> None:
        """Objects already in place stay, without ``_SUCCESS``; a second run replaces them."""
        self._clear()

    def _clear(self) -> None:
        system, base = file_system(self.folder)
        if system.get_file_info(f"{base}/_passing").type == fs.FileType.Directory:
            system.delete_dir(f"{base}/_passing")


class FilesSource(DataSource):
    """``df.write.format(FORMAT).option("staged", folder).mode("append").save(path)``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> FilesWriter:
        return FilesWriter(self.options["path"], self.options["staged"])
