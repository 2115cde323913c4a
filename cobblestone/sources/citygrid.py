"""Segmented v1 grid files as a Spark data source, for reading by segment and writing segments.

``spark.read.format("citygrid").load(folder_or_file)`` gives one row per cell; a filter
on seg_row / seg_col / file, or a range of row / col, reads only those byte ranges. Files may lie in any store ``pyarrow.fs`` knows.
``tiles.write.format("citygrid").option("rows", ...)...`` writes one file; every task
writes its own segments' byte ranges, so tasks never wait for each other.
"""

from __future__ import annotations

import math
import operator
import os
import uuid
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual,
    WriterCommitMessage,
)

from cobblestone.sources.growing_logs import open_store

# Fixed values of the v1 format: separator, fields, value type, channel names in file order.
SEPARATOR = ";"
VALUE_BYTES = 4
CHANNELS = ("is_street", "altitude", "is_residential")
SHARE_BYTES = 64 << 20


def header_fields(line: bytes) -> dict:
    parts = line.decode("latin1").rstrip("\n").split(SEPARATOR)
    if len(parts) != 10:
        raise ValueError(f"a grid header has 10 fields, found {len(parts)}: {parts}")
    if int(parts[0]) != 1:
        raise ValueError(f"unsupported grid file version {parts[0]}")
    return {
        "rows": int(parts[1]), "cols": int(parts[2]), "segment_h": int(parts[6]), "segment_w": int(parts[7]),
        "byteorder": parts[8], "channels": int(parts[9]), "start": len(line),
    }


def segment_range(meta: dict, seg_row: int, seg_col: int) -> tuple[int, int, int]:
    """Byte position, height and width of a segment."""
    top, left = seg_row * meta["segment_h"], seg_col * meta["segment_w"]
    if not (0 <= top < meta["rows"] and 0 <= left < meta["cols"]):
        raise ValueError(f"segment ({seg_row}, {seg_col}) is out of bounds")
    h, w = min(meta["segment_h"], meta["rows"] - top), min(meta["segment_w"], meta["cols"] - left)
    return meta["start"] + VALUE_BYTES * meta["channels"] * (top * meta["cols"] + h * left), h, w


@dataclass
class Share(InputPartition):
    """The segments of ``file`` whose number leaves the remainder ``part`` when divided by ``parts``."""

    file: str
    part: int
    parts: int


_TESTS = {EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le}


class CityGridReader(DataSourceReader):
    """Files are listed in the driver, opened by tasks only; a large one is dealt out by its size.

    Equality, ranges and lists on file, seg_row and seg_col are taken over; on row and col they leave out segments that
    hold no such cell, and Spark still tests the cells.
    """

    def __init__(self, path: str, share_bytes: int = SHARE_BYTES):
        self.path, self.share_bytes = path, share_bytes
        self.wanted: list[tuple[str, Callable, object]] = []

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if isinstance(f, In) and name in ("file", "seg_row", "seg_col"):
                self.wanted.append((name, lambda a, b: a in b, tuple(f.value)))
            elif type(f) in _TESTS and name in ("file", "seg_row", "seg_col", "row", "col"):
                self.wanted.append((name, _TESTS[type(f)], f.value))
                if name in ("row", "col"):
                    yield f
            else:
                yield f

    def _passes(self, name: str, value) -> bool:
        return all(test(value, bound) for n, test, bound in self.wanted if n == name)

    def _may_hold(self, name: str, first: int, last: int) -> bool:
        """Whether some cell of first .. last can pass the ranges on row or col."""
        own = [(test, bound) for n, test, bound in self.wanted if n == name]
        return all(test(first, bound) or test(last, bound) or test is operator.eq and first <= bound <= last for test, bound in own)

    def partitions(self):
        store, root = open_store(self.path)
        info = store.get_file_info(root)
        infos = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(root))
        out = []
        for info in sorted(infos, key=lambda i: i.path):
            if info.type == fs.FileType.File and not info.base_name.startswith(("_", ".")) and self._passes("file", info.base_name):
                parts = max(1, -(-info.size // self.share_bytes))
                out += [Share(info.path, k, parts) for k in range(parts)]
        return out

    def read(self, partition):
        import pyarrow as pa

        if partition is None:  # Spark's stand-in where no file is left to read
            return
        store, _ = open_store(self.path)
        with store.open_input_file(partition.file) as handle:
            head = b""
            while b"\n" not in head:
                more = handle.read(256)
                if not more:
                    break
                head += more
            meta = header_fields(head[: head.find(b"\n") + 1])
            n, wide = meta["channels"], math.ceil(meta["cols"] / meta["segment_w"])
            kind = np.dtype("<f4" if meta["byteorder"] == "little" else ">f4")
            for number in range(partition.part, math.ceil(meta["rows"] / meta["segment_h"]) * wide, partition.parts):
                seg_row, seg_col = divmod(number, wide)
                if not (self._passes("seg_row", seg_row) and self._passes("seg_col", seg_col)):
                    continue
                start, h, w = segment_range(meta, seg_row, seg_col)
                top, left = seg_row * meta["segment_h"], seg_col * meta["segment_w"]
                if not (self._may_hold("row", top, top + h - 1) and self._may_hold("col", left, left + w - 1)):
                    continue
                handle.seek(start)
                values = np.frombuffer(handle.read(h * w * n * VALUE_BYTES), dtype=kind).astype(np.float32).reshape(h * w, n)
                row, col = np.divmod(np.arange(h * w, dtype=np.int32), np.int32(w))
                zeros = np.zeros(h * w, dtype=np.float32)
                columns = [
                    pa.array([partition.file.rsplit("/", 1)[-1]] * (h * w), pa.string()),
                    pa.array(np.full(h * w, seg_row, np.int32)), pa.array(np.full(h * w, seg_col, np.int32)),
                    pa.array((row + top).astype(np.int32)), pa.array((col + left).astype(np.int32)),
                    *[pa.array(values[:, k] if k < n else zeros) for k in range(len(CHANNELS))],
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["file", "seg_row", "seg_col", "row", "col", *CHANNELS])


class SegmentsWritten(WriterCommitMessage):
    def __init__(self, count):
        self.count = count


class CityGridWriter(DataSourceArrowWriter):
    """Tiles (seg_row, seg_col, h, w, channels, data) into one new v1 file; it appears under its name when the job commits.

    Tiles come as Arrow batches of bounded bytes and go to the file from there; their values never become Python numbers.

    An existing file is never touched unless the mode is overwrite: segments are rewritten in the tile store.
    """

    def __init__(self, path: str, options, overwrite: bool):
        fields = [options.get(k, d) for k, d in (
            ("rows", None), ("cols", None), ("origin_x", "0.0"), ("origin_y", "0.0"), ("density", "1.0"),
            ("segment_h", "5000"), ("segment_w", "5000"), ("byteorder", "little"), ("channels", "3"))]
        header = (SEPARATOR.join(["1", *map(str, fields)]) + "\n").encode("latin1")
        if os.path.exists(path) and not overwrite:
            raise FileExistsError(f"{path} exists; grid files are written once")
        self.target, self.path, self.meta = path, f"{path}.{uuid.uuid4().hex}.part", header_fields(header)
        size = len(header) + VALUE_BYTES * self.meta["rows"] * self.meta["cols"] * self.meta["channels"]
        os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
        with open(self.path, "wb") as handle:
            handle.write(header)
            handle.truncate(size)

    def commit(self, messages):
        os.replace(self.path, self.target)

    def abort(self, messages):
        if os.path.exists(self.path):
            os.remove(self.path)

    def write(self, iterator):
        kind = np.dtype("<f4" if self.meta["byteorder"] == "little" else ">f4")
        count = 0
        with open(self.path, "r+b") as handle:
            for batch in iterator:
                places = zip(*(batch.column(c).to_pylist() for c in ("seg_row", "seg_col", "h", "w")))
                for (seg_row, seg_col, tile_h, tile_w), values in zip(places, batch.column("data")):
                    start, h, w = segment_range(self.meta, seg_row, seg_col)
                    data = values.values.to_numpy(zero_copy_only=False)
                    if (tile_h, tile_w) != (h, w) or len(data) != h * w * self.meta["channels"]:
                        raise ValueError(f"segment ({seg_row}, {seg_col}) must be {h} x {w} x {self.meta['channels']}")
                    handle.seek(start)
                    handle.write(data.astype(kind).tobytes())
                    count += 1
        return SegmentsWritten(count)


class CityGridSource(DataSource):
    @classmethod
    def name(cls):
        return "citygrid"

    def schema(self):
        return "file string, seg_row int, seg_col int, row int, col int, is_street float, altitude float, is_residential float"

    def reader(self, schema):
        return CityGridReader(self.options["path"], int(self.options.get("shareBytes", SHARE_BYTES)))

    def writer(self, schema, overwrite):
        return CityGridWriter(self.options["path"].removeprefix("file:"), self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Makes ``format("citygrid")`` known to the session, with filter pushdown on and batches of tiles bounded by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CityGridSource)
