"""Sample files as a data source: PCM16 WAV and raw little-endian floats, read in blocks by as many tasks.

    spark.dataSource.register(Samples)
    spark.read.format("samples").option("path", folder).option("block", 65536).load()

A file's blocks follow from its size alone, so the driver lists names and sizes and reads no file. Each task reads the
chunk headers at the front of its file and then its own stretch. With "samples" set to "false" the column of samples is left
out and one row a file comes from the headers alone. Files that are no WAV, or broken in their headers, give no rows.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FRONT = 65_536


@dataclass(frozen=True)
class Format:
    """Where the samples lie: rate, channels, first byte and bytes."""

    rate: int
    channels: int
    start: int
    size: int


def wav(pcm: np.ndarray, rate: int, channels: int = 1) -> bytes:
    """A WAV file of 16-bit samples."""
    data = np.asarray(pcm).astype("<i2").tobytes()
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(data), b"WAVE", b"fmt ", 16, 1, channels, rate, 2 * rate * channels, 2 * channels, 16, b"data", len(data)) + data


def wav_format(front: bytes, length: int) -> Format | None:
    """The format of a file of `length` bytes by its chunk headers; None if it is no 16-bit PCM."""
    if front[:4] != b"RIFF" or front[8:12] != b"WAVE":
        return None
    at, rate, channels = 12, 0, 0
    while at + 8 <= len(front):
        name, size = struct.unpack_from("<4sI", front, at)
        if name == b"fmt " and at + 24 <= len(front):
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", front, at + 8)
            if kind not in (1, 0xFFFE) or bits != 16 or not channels:
                return None
        elif name == b"data":
            return Format(rate, channels, at + 8, max(0, min(size, length - at - 8))) if rate else None
        at += 8 + size + size % 2  # chunks begin at even places
    return None


@dataclass
class Block(InputPartition):
    path: str
    length: int
    block: int


class Samples(DataSource):
    @classmethod
    def name(cls) -> str:
        return "samples"

    def schema(self) -> str:
        values = ", samples array<float>" if self.options.get("samples", "true") == "true" else ""
        return f"path string, block long, first long, n long, rate int, channels int{values}"

    def reader(self, schema) -> DataSourceReader:
        return SampleReader(self.options)


class SampleReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.block = options["path"], int(options.get("block", 65_536))
        self.rate, self.values = int(options.get("rate", 0)), options.get("samples", "true") == "true"

    def partitions(self) -> list[InputPartition]:
        fs, root = pafs.FileSystem.from_uri(self.path)
        found = fs.get_file_info(pafs.FileSelector(root, recursive=True)) if fs.get_file_info(root).type == pafs.FileType.Directory else [fs.get_file_info(root)]
        out = []
        for f in sorted((f for f in found if f.is_file and f.base_name.rsplit(".", 1)[-1] in ("wav", "f32")), key=lambda f: f.path):
            width = 2 if f.path.endswith(".wav") else 4
            blocks = max(1, -(-f.size // (width * self.block))) if self.values else 1
            out += [Block(f.path, f.size, k) for k in range(blocks)]
        return out

    def read(self, partition: Block) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(self.path)
        with fs.open_input_file(partition.path) as f:
            if partition.path.endswith(".wav"):
                kind, own = "<i2", wav_format(f.read_at(min(FRONT, partition.length), 0), partition.length)
            else:
                kind, own = "<f4", Format(self.rate, 1, 0, partition.length - partition.length % 4)
            if own is None:
                return
            width = np.dtype(kind).itemsize
            total, first = own.size // width, partition.block * self.block if self.values else 0
            n = max(0, min(self.block, total - first)) if self.values else total
            if not n and partition.block:  # the header's bytes may make one block too many
                return
            columns = [pa.array([partition.path]), pa.array([partition.block], pa.int64()), pa.array([first], pa.int64()), pa.array([n], pa.int64()), pa.array([own.rate], pa.int32()), pa.array([own.channels], pa.int32())]
            names = ["path", "block", "first", "n", "rate", "channels"]
            if self.values:
                values = np.frombuffer(f.read_at(n * width, own.start + first * width), kind).astype(np.float32)
                values = values / np.float32(32768) if width == 2 else values
                columns.append(pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), pa.array(values, pa.float32())))
                names.append("samples")
            yield pa.RecordBatch.from_arrays(columns, names=names)


def write(rows: DataFrame, folder: str) -> DataFrame:
    """Writes a file for each row (name, rate, samples array<double>) under folder, '.wav' as PCM16 and '.f32' as floats, and
    returns name and bytes. A file is written under another name and renamed, so a task that runs again leaves one file."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        for batch in batches:
            names, sizes = [], []
            for name, rate, samples in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                values = np.array(samples or [], np.float64)
                body = values.astype("<f4").tobytes() if name.endswith(".f32") else wav(np.clip(np.floor(values * 32768 + 0.5), -32768, 32767), rate)
                draft = f"{root}/.{uuid.uuid4().hex}"
                with fs.open_output_stream(draft) as f:
                    f.write(body)
                fs.move(draft, f"{root}/{name}")
                names.append(name)
                sizes.append(len(body))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64())], names=["name", "bytes"])

    return rows.select("name", "rate", "samples").mapInArrow(put, "name string, bytes long")
