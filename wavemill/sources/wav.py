"""WAV files as rows: RIFF decoding in NumPy over Spark's binary file source."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import SIGNALS

PCM, FLOAT, EXTENSIBLE = 1, 3, 0xFFFE


def decode(content: bytes) -> tuple[np.ndarray, int]:
    """Samples as float32, the mean of all channels, and the sampling rate."""
    if content[:4] != b"RIFF" or content[8:12] != b"WAVE":
        raise ValueError("not a RIFF WAVE file")
    at, form, data = 12, None, None
    while at + 8 <= len(content):
        name, size = content[at : at + 4], struct.unpack_from("<I", content, at + 4)[0]
        body = content[at + 8 : at + 8 + size]
        if name == b"fmt ":
            form = struct.unpack_from("<HHIIHH", body)
            if form[0] == EXTENSIBLE and len(body) >= 26:
                form = (struct.unpack_from("<H", body, 24)[0], *form[1:])
        elif name == b"data":
            data = body
        at += 8 + size + size % 2
    if form is None or data is None:
        raise ValueError("a WAVE file needs fmt and data chunks")
    kind, channels, sr, _, _, bits = form
    width = bits // 8
    data = data[: len(data) // (width * channels) * width * channels]
    if kind == PCM and bits == 8:
        x = (np.frombuffer(data, np.uint8).astype(np.float32) - 128) / 128
    elif kind == PCM and bits == 16:
        x = np.frombuffer(data, "<i2").astype(np.float32) / 32768
    elif kind == PCM and bits == 24:
        b = np.frombuffer(data, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) / 2147483648).astype(np.float32)
    elif kind == PCM and bits == 32:
        x = (np.frombuffer(data, "<i4") / 2147483648).astype(np.float32)
    elif kind == FLOAT and bits in (32, 64):
        x = np.frombuffer(data, f"<f{width}").astype(np.float32)
    else:
        raise ValueError(f"WAVE format {kind} with {bits} bits is not supported")
    return (x.reshape(-1, channels).mean(axis=1) if channels > 1 else x), sr


def encode(x: np.ndarray, sr: int) -> bytes:
    """PCM of 16 bits, mono, or (samples, channels)."""
    pcm = np.clip(np.round(np.asarray(x) * 32768), -32768, 32767).astype("<i2")
    channels = 1 if pcm.ndim == 1 else pcm.shape[1]
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + pcm.nbytes, b"WAVE", b"fmt ", 16, PCM, channels, sr, sr * channels * 2, channels * 2, 16, b"data", pcm.nbytes)
    return head + pcm.tobytes()


def decode_files(files: DataFrame) -> DataFrame:
    """``files`` (path, content) as signals, one file at a time; a file that does not decode ends the query."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, content in zip(part.path, part.content):
                x, sr = decode(bytes(content))
                yield pd.DataFrame({"file_id": [path], "sr": [sr], "n_samples": [len(x)], "samples": [x]})

    return files.select("path", "content").mapInPandas(run, SIGNALS)


def read_wav(spark: SparkSession, path: str, glob: str = "*.wav", names: DataFrame | None = None) -> DataFrame:
    """file_id, sr, n_samples, samples of the WAV files under ``path``; with ``names`` only of their paths.

    Paths are filtered before anything is decoded.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    files = files.withColumn("path", F.regexp_replace("path", r"^file:/+", "/"))
    if names is not None:
        files = files.join(names.select("path").distinct(), "path", "left_semi")
    return decode_files(files)
