"""Log files that grow, as a stream of complete lines: ``spark.readStream.format("growing_logs")``.

Spark's file source reads a file once. Here the offset of the stream is the number of complete bytes of every file, so lines
that are appended to a known file arrive with the next micro-batch and a restarted query goes on where it stopped. A line
without its newline waits until it is complete. A file is read in pieces of ``pieceBytes``, from its old offset on; what was
read is not read again. A task reads many pieces, of many files if these are small: there are about ``tasks`` of them, or more
once each has ``TASK_BYTES``, where opening a file counts as ``OPEN_BYTES``. Files are opened through ``pyarrow.fs``, so ``path``
may be a folder of any store it knows. A file that became shorter stops the query: its lines are not what was read.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "file string, at bigint, value string"
PIECE_BYTES = 32 << 20
TASK_BYTES = 32 << 20
OPEN_BYTES = 1 << 16
_LOOK_BACK = 1 << 16


@dataclass
class Piece:
    """The lines of ``file`` that begin in ``first .. last``; ``whole`` if a line begins at ``first``; lines end by ``end``."""

    file: str
    first: int
    last: int
    end: int
    whole: bool


@dataclass
class Pieces(InputPartition):
    """What a task reads; pieces of a file follow each other."""

    pieces: list[Piece]


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    """File system and place of a URI (also ``file:/path``) or a local path."""
    if "://" not in path and path.startswith("file:"):
        path = path.removeprefix("file:")
    return fs.FileSystem.from_uri(path if "://" in path else os.path.abspath(path))


def complete_bytes(file, size: int) -> int:
    """The bytes up to the last newline."""
    end = size
    while end > 0:
        start = max(0, end - _LOOK_BACK)
        file.seek(start)
        at = file.read(end - start).rfind(b"\n")
        if at >= 0:
            return start + at + 1
        end = start
    return 0


class GrowingLogReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.piece = int(options.get("piecebytes", PIECE_BYTES))
        self.tasks = int(options.get("tasks", 1))
        self.known: dict[str, tuple[int, int]] = {}  # file -> size and complete bytes when last looked at

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        store, root = open_store(self.path)
        out = {}
        for info in store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
            if info.type != fs.FileType.File or info.base_name.startswith(("_", ".")):
                continue
            size, done = self.known.get(info.path, (-1, 0))
            if info.size != size:
                with store.open_input_file(info.path) as file:
                    done = complete_bytes(file, info.size)
                self.known[info.path] = info.size, done
            out[info.path] = done
        return out

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        grown = []
        for file, stop in sorted(end.items()):
            first = start.get(file, 0)
            if stop < first:
                raise ValueError(f"{file} became shorter")
            if stop > first:
                grown.append((file, first, stop))
        room = min(TASK_BYTES, sum(OPEN_BYTES + stop - first for _, first, stop in grown) / self.tasks)
        out, left = [], 0
        for file, first, stop in grown:
            opened = False
            for at in range(first, stop, self.piece):
                last = min(at + self.piece, stop)
                if left <= 0:
                    out.append(Pieces([]))
                    left, opened = room, False
                out[-1].pieces.append(Piece(file, at, last, stop, at == first))
                left -= last - at + (0 if opened else OPEN_BYTES)
                opened = True
        return out

    def read(self, partition: Pieces) -> Iterator[pa.RecordBatch]:
        store, _ = open_store(self.path)
        for name, pieces in groupby(partition.pieces, key=lambda p: p.file):
            with store.open_input_file(name) as file:
                for piece in pieces:
                    yield from piece_lines(file, piece)


def piece_lines(file, piece: Piece) -> Iterator[pa.RecordBatch]:
    """One batch, or none if no line begins in the piece."""
    file.seek(piece.first if piece.whole else piece.first - 1)
    raw = file.read(piece.last - file.tell())
    begin = piece.first
    if not piece.whole:  # the line that begins before belongs to the piece before
        cut = raw.find(b"\n") + 1
        if not cut:
            return
        begin += cut - 1
        raw = raw[cut:]
    while raw and not raw.endswith(b"\n"):  # the last line may end in a later piece
        more = file.read(min(_LOOK_BACK, piece.end - file.tell()))
        cut = more.find(b"\n") + 1
        raw += more[:cut] if cut else more
    if not raw:
        return
    lines = raw[:-1].split(b"\n")
    at, places = begin, []
    for line in lines:
        places.append(at)
        at += len(line) + 1
    values = [line.rstrip(b"\r").decode("utf-8", "replace") for line in lines]
    yield pa.RecordBatch.from_arrays(
        [pa.array([piece.file] * len(lines)), pa.array(places, pa.int64()), pa.array(values)], ["file", "at", "value"])


class GrowingLogs(DataSource):
    @classmethod
    def name(cls) -> str:
        return "growing_logs"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> GrowingLogReader:
        return GrowingLogReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GrowingLogs)
