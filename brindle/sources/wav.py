"""WAV files as frames: a source that splits files by ranges of bytes, and a sink that commits whole files.

    spark.dataSource.register(WavSource)
    frames = spark.read.format("wav").load(folder)            # path, rate, channel, frame, samples
    frames.repartition("path").sortWithinPartitions("path", "frame").write.format("wav").mode("append").save(folder)

A file's bytes are never one value: a task reads a range, a frame at a time. Files are opened through ``pyarrow.fs``, so a
path may be local or of any store that it knows.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from brindle.operators.frames import FRAME

SCHEMA = "path string, rate int, channel int, frame long, samples array<double>"
#: Frames of one task's range.
RANGE = 64
UNKNOWN_SIZE = 0xFFFFFFFF


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path within it of a path or address."""
    path = path.removeprefix("file:") if path.startswith("file:/") else path
    if "://" in path and not path.startswith("/"):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), "/" + path.lstrip("/") if path.startswith("/") else path


@dataclass(frozen=True)
class Header:
    rate: int
    channels: int
    width: int
    begin: int  # of the samples
    size: int  # of the samples in bytes


def read_header(file, length: int) -> Header | None:
    """The header of PCM audio of 8, 16, 24 or 32 bits; None for anything else.

    A size of the data that is unknown or beyond the file's end means that they go on to it, as in files over 4 GB.
    """
    head = file.read(12)
    if len(head) < 12 or head[:4] not in (b"RIFF", b"RF64") or head[8:] != b"WAVE":
        return None
    form, at = None, 12
    while at + 8 <= length:
        file.seek(at)
        name, size = struct.unpack("<4sI", file.read(8))
        at += 8
        if name == b"fmt ":
            found = file.read(16)
            if len(found) < 16:
                return None
            kind, channels, rate, _, _, bits = struct.unpack("<HHIIHH", found)
            if kind not in (1, 0xFFFE) or bits not in (8, 16, 24, 32) or not channels or not rate:
                return None
            form = rate, channels, bits // 8
        elif name == b"data":
            if form is None:
                return None
            size = length - at if size == UNKNOWN_SIZE else min(size, length - at)
            step = form[1] * form[2]
            return Header(*form, at, size - size % step)
        at += size + size % 2
    return None


def decode(raw: bytes, width: int, channels: int) -> np.ndarray:
    """(channel, sample) in -1 to 1."""
    if width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(float) - 128) / 128
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) << 8 >> 8) / float(1 << 23)
    else:
        x = np.frombuffer(raw, f"<i{width}").astype(float) / float(1 << (8 * width - 1))
    return x.reshape(-1, channels).T


@dataclass
class Range(InputPartition):
    """Frames of a file, or a file that can't be read (no header)."""

    path: str
    header: Header | None
    first: int
    last: int


class WavSource(DataSource):
    """``load(path)``: a file, or a folder with all files below it. Files that aren't PCM audio are one row of nulls."""

    @classmethod
    def name(cls) -> str:
        return "wav"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WavReader(self.options["path"], int(self.options.get("frame", FRAME)))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("files are appended to a folder: write with mode('append')")
        return WavWriter(self.options["path"])


class WavReader(DataSourceReader):
    def __init__(self, path: str, frame: int) -> None:
        self.path, self.frame = path, frame

    def partitions(self) -> list[Range]:
        store, path = _opened(self.path)
        info = store.get_file_info(path)
        files = [info] if info.is_file else store.get_file_info(pafs.FileSelector(path, recursive=True))
        out = []
        for f in sorted((f for f in files if f.is_file and not f.base_name.startswith((".", "_"))), key=lambda f: f.path):
            with store.open_input_file(f.path) as file:
                header = read_header(file, f.size)
            if header is None:
                out.append(Range(f.path, None, 0, 0))
                continue
            samples = header.size // (header.width * header.channels)
            frames = max(1, -(-samples // self.frame))
            out += [Range(f.path, header, k, min(k + RANGE, frames)) for k in range(0, frames, RANGE)]
        return out or [Range("", None, 0, -1)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        names, kinds = ["path", "rate", "channel", "frame", "samples"], [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.float64())]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        h = partition.header
        if h is None:
            if partition.last >= 0:
                yield batch([(partition.path, None, None, None, None)])
            return
        step = h.width * h.channels
        store, _ = _opened(self.path)
        with store.open_input_file(partition.path) as file:
            for k in range(partition.first, partition.last):
                begin = k * self.frame * step
                file.seek(h.begin + begin)
                raw = file.read(max(0, min(self.frame * step, h.size - begin)))
                found = decode(raw[: len(raw) - len(raw) % step], h.width, h.channels)
                yield batch([(partition.path, h.rate, c, k, x.tolist()) for c, x in enumerate(found)])


@dataclass
class Written(WriterCommitMessage):
    drafts: list[tuple[str, str]]


class WavWriter(DataSourceArrowWriter):
    """Writes mono 16-bit files ``<folder>/<name of path>`` of rows sorted by path and frame within a task.

    A task writes drafts; the job's commit renames them, and its abort deletes them, so no reader meets half a file.
    """

    def __init__(self, path: str) -> None:
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        store, folder = _opened(self.path)
        store.create_dir(folder, recursive=True)
        mark = TaskContext.get().taskAttemptId()
        drafts, now, out, rate, size, last = [], None, None, 0, 0, -1

        def finish() -> None:
            out.close()
            self._header(store, drafts[-1][0], rate, size)

        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    if row["path"] != now:
                        if out is not None:
                            finish()
                        now, rate, size, last = row["path"], row["rate"], 0, -1
                        name = now.rsplit("/", 1)[-1]
                        drafts.append((f"{folder}/_{name}.{mark}", f"{folder}/{name}"))
                        out = store.open_output_stream(drafts[-1][0])
                        out.write(_wav_header(rate, UNKNOWN_SIZE))
                    if row["frame"] != last + 1 or row["channel"] not in (None, 0):
                        raise ValueError(f"{now}: frames of one channel must come in order, without gaps, in one task")
                    last = row["frame"]
                    raw = (np.clip(np.array(row["samples"], float), -1, 1) * 32767).round().astype("<i2").tobytes()
                    out.write(raw)
                    size += len(raw)
            if out is not None:
                finish()
        except BaseException:
            self._drop(drafts)
            raise
        return Written(drafts)

    def _header(self, store: pafs.FileSystem, draft: str, rate: int, size: int) -> None:
        """Write the true size where the store can; a file that says that it is unknown is read to its end."""
        if isinstance(store, pafs.LocalFileSystem) and size + 36 < UNKNOWN_SIZE:
            with open(draft, "r+b") as f:
                f.write(_wav_header(rate, size))

    def _drop(self, drafts: list[tuple[str, str]]) -> None:
        store, _ = _opened(self.path)
        for draft, _ in drafts:
            if store.get_file_info(draft).is_file:
                store.delete_file(draft)

    def commit(self, messages: list[Written | None]) -> None:
        store, _ = _opened(self.path)
        for m in messages:
            for draft, final in m.drafts if m else []:
                store.move(draft, final)

    def abort(self, messages: list[Written | None]) -> None:
        for m in messages:
            self._drop(m.drafts if m else [])


def _wav_header(rate: int, size: int) -> bytes:
    riff = size if size == UNKNOWN_SIZE else size + 36
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", riff, b"WAVE", b"fmt ", 16, 1, 1, rate, 2 * rate, 2, 16, b"data", size)
