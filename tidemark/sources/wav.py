"""PCM WAV files as tables of sample blocks, and back."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.spectral import resample

BLOCK, HEAD = 8_000, 1 << 16
_TYPES = {8: np.int8, 16: np.int16, 32: np.int32}
BLOCK_SCHEMA = "file_id string, blk int, samples array<float>"
HEADER_SCHEMA = "file_id string, sample_rate int, channels int, bits int, num_samples bigint, seconds double"


def parse(content: bytes) -> tuple[dict, np.ndarray]:
    """Header fields, and the samples of all channels interleaved, as stored.

    Chunks before the data chunk are skipped.  Depths other than 8, 16 and 32 bits,
    and files that aren't PCM WAV, raise.
    """
    if len(content) < 12 or content[:4] != b"RIFF" or content[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at, header = 12, {}
    while at + 8 <= len(content):
        name, size = struct.unpack_from("<4sI", content, at)
        at += 8
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", content, at)
            if kind not in (1, 0xFFFE) or bits not in _TYPES or channels < 1:
                raise ValueError(f"unsupported format {kind}, {bits} bits, {channels} channels")
            header = {"sample_rate": rate, "channels": channels, "bits": bits}
        elif name == b"data":
            if not header:
                raise ValueError("no format before the data")
            width = header["bits"] // 8 * header["channels"]
            data = content[at : at + size]
            data = data[: len(data) // width * width]
            return header | {"num_samples": len(data) // width}, np.frombuffer(data, np.dtype(_TYPES[header["bits"]]).newbyteorder("<"))
        at += size + size % 2
    raise ValueError("no data in the file")


def probe(head: bytes, length: int) -> dict:
    """Header fields from the first bytes of a file of so many."""
    at = 12
    while at + 8 <= len(head):
        name, size = struct.unpack_from("<4sI", head, at)
        if name == b"data":
            # the format and an empty data chunk make a file of their own
            h, _ = parse(head[:at] + struct.pack("<4sI", b"data", 0))
            width = h["bits"] // 8 * h["channels"]
            return h | {"num_samples": min(size, length - at - 8) // width}
        at += 8 + size + size % 2
    return parse(head)[0]


def encode(samples: np.ndarray, rate: int = 16_000, channels: int = 1, bits: int = 16) -> bytes:
    """A WAV file of samples that are in the range of the depth."""
    data = np.asarray(samples).astype(np.dtype(_TYPES[bits]).newbyteorder("<")).tobytes()
    return header_bytes(len(data), rate, channels, bits) + data


def header_bytes(size: int, rate: int, channels: int, bits: int) -> bytes:
    width = channels * bits // 8
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + size, b"WAVE", b"fmt ", 16, 1, channels, rate, rate * width, width, bits, b"data", size)


def mono(header: dict, stored: np.ndarray, rate: int | None) -> np.ndarray:
    """Samples in [-1, 1), scaled by depth, channels averaged, at the wanted rate."""
    x = stored.reshape(-1, header["channels"]).astype(np.float64).mean(1) / float(1 << (header["bits"] - 1))
    return x if rate in (None, header["sample_rate"]) else resample(x, header["sample_rate"], rate)


def files(spark: SparkSession, path: str) -> DataFrame:
    """``path, content`` of the WAV files under a path, each one a row."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").option("recursiveFileLookup", "true").load(path).select("path", "content")


def headers(found: DataFrame) -> DataFrame:
    """A row of header fields for each file; only its first ``HEAD`` bytes go to Python,
    and the data chunk must begin within them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, head, length in zip(batch.column("path"), batch.column("head"), batch.column("length")):
                h = probe(head.as_py(), length.as_py())
                yield pa.RecordBatch.from_pylist([{"file_id": path.as_py(), **h, "seconds": h["num_samples"] / h["sample_rate"]}], schema=pa.schema([("file_id", pa.string()), ("sample_rate", pa.int32()), ("channels", pa.int32()), ("bits", pa.int32()), ("num_samples", pa.int64()), ("seconds", pa.float64())]))

    return found.select("path", F.substring("content", 1, HEAD).alias("head"), F.length("content").cast("bigint").alias("length")).mapInArrow(run, HEADER_SCHEMA)


def read_wav(found: DataFrame, rate: int | None = 16_000, block: int = BLOCK) -> DataFrame:
    """``file_id, blk, samples``: blocks of mono samples; the last may be short."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content")):
                x = mono(*parse(content.as_py()), rate).astype(np.float32)
                for s in range(0, len(x), block * 64):
                    part = x[s : s + block * 64]
                    cuts = np.append(np.arange(0, len(part), block), len(part)).astype(np.int32)
                    n = len(cuts) - 1
                    yield pa.RecordBatch.from_arrays([pa.array([path.as_py()] * n), pa.array(s // block + np.arange(n), pa.int32()), pa.ListArray.from_arrays(pa.array(cuts), pa.array(part))], names=["file_id", "blk", "samples"])

    return found.select("path", "content").mapInArrow(run, BLOCK_SCHEMA)


def write_wav(blocks: DataFrame, folder: str, rate: int = 16_000, bits: int = 16) -> DataFrame:
    """Writes each file_id's blocks as ``<folder>/<file_id's last part>.wav`` and returns
    ``file_id, path, num_samples``.

    A file is written under another name first and then moved, so a task that runs
    again replaces it whole.  ``folder`` must be one that all executors share.  Two
    file_ids that would share a file are an error, and nothing is written.
    """
    stem = F.regexp_replace(F.regexp_extract("file_id", r"([^/]*)/*$", 1), r"(?<=.)\.[^.]*$", "")
    shared = blocks.select("file_id", stem.alias("stem")).distinct().groupBy("stem").agg(F.count(F.lit(1)).alias("n"), F.min("file_id").alias("a"), F.max("file_id").alias("b")).where("n > 1").take(1)
    if shared:
        raise ValueError(f"{shared[0].a} and {shared[0].b} would both be written to {shared[0].stem}.wav")
    top = float((1 << (bits - 1)) - 1)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("blk")
        x = np.concatenate([np.asarray(v.as_py(), np.float64) for v in table.column("samples")]) if table.num_rows else np.zeros(0)
        name = table.column("file_id")[0].as_py()
        target = Path(folder) / (Path(name).stem + ".wav")
        target.parent.mkdir(parents=True, exist_ok=True)
        part = target.with_name(f".{target.name}.{id(table)}")
        part.write_bytes(encode(np.clip(np.rint(x * float(1 << (bits - 1))), -top - 1, top), rate, 1, bits))
        part.replace(target)
        return pa.table({"file_id": [name], "path": [str(target)], "num_samples": [len(x)]})

    return blocks.select("file_id", "blk", "samples").groupBy("file_id").applyInArrow(run, "file_id string, path string, num_samples bigint")


class StreamWriter:
    """A 16-bit WAV file written piece by piece; the sizes are set when it is closed."""

    def __init__(self, path: str, rate: int = 16_000, channels: int = 1) -> None:
        self.path, self.rate, self.channels, self.size = path, rate, channels, 0
        self.file = open(path, "wb")
        self.file.write(header_bytes(0, rate, channels, 16))

    def write(self, samples: np.ndarray) -> None:
        data = np.asarray(samples).astype("<i2").tobytes()
        self.file.write(data)
        self.size += len(data)

    def close(self) -> None:
        self.file.seek(0)
        self.file.write(header_bytes(self.size, self.rate, self.channels, 16))
        self.file.close()

    def __enter__(self) -> StreamWriter:
        return self

    def __exit__(self, *_) -> None:
        self.close()


def resample_blocks(blocks: DataFrame, from_rate: int, to_rate: int, block: int = BLOCK) -> DataFrame:
    """Blocks of another rate; a file is converted in one task."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("blk")
        x = resample(np.concatenate([np.asarray(v.as_py(), np.float64) for v in table.column("samples")]), from_rate, to_rate).astype(np.float32)
        cuts = np.append(np.arange(0, len(x), block), len(x)).astype(np.int32)
        n = len(cuts) - 1
        return pa.table([pa.array(table.column("file_id").slice(0, 1).to_pylist() * n, pa.string()), pa.array(range(n), pa.int32()), pa.ListArray.from_arrays(pa.array(cuts), pa.array(x))], names=["file_id", "blk", "samples"])

    return blocks.select("file_id", "blk", "samples").groupBy("file_id").applyInArrow(run, BLOCK_SCHEMA)


def downmix(blocks: DataFrame, channels: str) -> DataFrame:
    """The element-wise mean of an array of channels, as ``samples``."""
    total = F.reduce(channels, F.transform(F.get(F.col(channels), F.lit(0)), lambda _: F.lit(0.0)), lambda a, c: F.zip_with(a, c, lambda x, y: x + y))
    return blocks.withColumn("samples", F.transform(total, lambda x: (x / F.size(channels)).cast("float")))
