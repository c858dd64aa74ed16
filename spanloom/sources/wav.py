"""RIFF wave files as rows, and back: float32 or int16, one channel."""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "path string, rate int, samples long, pcm binary"


def parse(data: bytes, strict: bool = False) -> tuple[int, bytes]:
    """(rate, little-endian float32 samples).

    Unknown chunks are skipped with their padding; truncation, repeated data
    and other formats are errors.  ``strict`` also wants the exact RIFF size,
    one format chunk, 16 kHz and finite samples.
    """
    if len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a RIFF wave file")
    if strict and struct.unpack_from("<I", data, 4)[0] + 8 != len(data):
        raise ValueError("the RIFF size is not the file's")
    at, form, pcm = 12, None, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        body = data[at + 8 : at + 8 + size]
        if len(body) != size:
            raise ValueError("truncated chunk")
        if name == b"fmt ":
            if size < 16 or strict and form is not None:
                raise ValueError("invalid format chunk")
            form = struct.unpack_from("<HHIIHH", body)
        elif name == b"data":
            if pcm is not None:
                raise ValueError("more than one data chunk")
            pcm = body
        at += 8 + size + size % 2
    if form is None or pcm is None:
        raise ValueError("no format or no data")
    kind, channels, rate, _, _, bits = form
    if channels != 1 or (kind, bits) not in ((3, 32), (1, 16)):
        raise ValueError("only mono float32 or int16 is read")
    if len(pcm) % (bits // 8):
        raise ValueError("truncated sample")
    x = np.frombuffer(pcm, "<f4") if kind == 3 else (np.frombuffer(pcm, "<i2") / 32768).astype("<f4")
    if strict and (rate != 16000 or not len(x) or not np.isfinite(x).all()):
        raise ValueError("not 16 kHz, empty or not finite")
    return rate, x.tobytes()


def build(pcm: bytes, rate: int) -> bytes:
    """A float32 mono wave file."""
    if len(pcm) % 4 or len(pcm) + 36 > 0xFFFFFFFF:
        raise ValueError("the samples do not fit a wave file")
    form = struct.pack("<HHIIHH", 3, 1, rate, rate * 4, 4, 32)
    return b"RIFF" + struct.pack("<I", 36 + len(pcm)) + b"WAVEfmt " + struct.pack("<I", 16) + form + b"data" + struct.pack("<I", len(pcm)) + pcm


def read(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """(path, rate, samples, pcm), one row per file."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    # Spark bounds the bytes of the batches that come in; each file goes out by itself
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rate, x = parse(content.as_py(), strict)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([rate], pa.int32()), pa.array([len(x) // 4], pa.int64()), pa.array([x], pa.binary())], names=["path", "rate", "samples", "pcm"])

    return files.mapInArrow(run, SCHEMA)


def samples(signals: DataFrame, block: int = 65_536) -> DataFrame:
    """(path, first, x array<float>): blocks of samples."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in it:
            for name, pcm in zip(p["path"], p["pcm"]):
                x = np.frombuffer(pcm, "<f4")
                yield pd.DataFrame([(name, i, x[i : i + block]) for i in range(0, len(x), block)], columns=["path", "first", "x"])

    return signals.select("path", "pcm").mapInPandas(run, "path string, first long, x array<float>")


def write(signals: DataFrame, directory: str) -> None:
    """One new file ``name``.wav per row (name, rate, pcm), written by the
    executors to a folder that they share; existing files are an error."""

    def run(rows) -> None:
        os.makedirs(directory, exist_ok=True)
        for r in rows:
            with open(os.path.join(directory, f"{r['name']}.wav"), "xb") as f:
                f.write(build(bytes(r["pcm"]), r["rate"]))

    signals.select("name", "rate", "pcm").foreachPartition(run)
