"""RIFF/WAVE bytes to frames and back: spark.read.format('binaryFile') plus one Arrow pass per file."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from callweave.functions.signal import agent_channel, resample

PCM, FLOAT, ALAW, MULAW, EXTENSIBLE = 1, 3, 6, 7, 0xFFFE


@cache
def mulaw_table() -> np.ndarray:
    """The 256 mu-law codes as floats."""
    u = ~np.arange(256) & 0xFF
    sign, exponent, mantissa = u & 0x80, (u >> 4) & 7, u & 0x0F
    magnitude = (((mantissa << 3) + 0x84) << exponent) - 0x84
    return (np.where(sign, -magnitude, magnitude) / 32768.0).astype(np.float32)


@cache
def alaw_table() -> np.ndarray:
    """The 256 A-law codes as floats."""
    a = np.arange(256) ^ 0x55
    exponent, mantissa = (a >> 4) & 7, a & 0x0F
    magnitude = np.where(exponent == 0, (mantissa << 4) + 8, ((mantissa << 4) + 0x108) << np.maximum(exponent - 1, 0))
    return (np.where(a & 0x80, magnitude, -magnitude) / 32768.0).astype(np.float32)


def chunks(data: bytes) -> dict[bytes, bytes]:
    """The first fmt and data chunks of a RIFF file (chunks are padded to even length)."""
    if len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    out: dict[bytes, bytes] = {}
    at = 12
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        out.setdefault(name, data[at + 8 : at + 8 + size])
        at += 8 + size + size % 2
    for need in (b"fmt ", b"data"):
        if need not in out:
            raise ValueError(f"chunk {need!r} is missing")
    return out


def decode(data: bytes) -> tuple[np.ndarray, int]:
    """(samples as float32 of shape (n, channels), rate); an incomplete last frame is dropped."""
    got = chunks(data)
    kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", got[b"fmt "])
    if kind == EXTENSIBLE and len(got[b"fmt "]) >= 26:
        kind = struct.unpack_from("<H", got[b"fmt "], 24)[0]
    raw = got[b"data"]
    raw = raw[: len(raw) // max(1, bits // 8 * channels) * (bits // 8 * channels)]
    if kind == MULAW:
        x = mulaw_table()[np.frombuffer(raw, np.uint8)]
    elif kind == ALAW:
        x = alaw_table()[np.frombuffer(raw, np.uint8)]
    elif kind == PCM and bits == 8:
        x = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
    elif kind == PCM and bits in (16, 32):
        x = np.frombuffer(raw, f"<i{bits // 8}").astype(np.float32) / float(1 << (bits - 1))
    elif kind == FLOAT and bits == 32:
        x = np.frombuffer(raw, "<f4")
    else:
        raise ValueError(f"WAVE format {kind} with {bits} bits is not supported")
    return x.reshape(-1, channels), rate


def encode_pcm16(samples: np.ndarray, rate: int) -> bytes:
    """A PCM16 file of samples in -1..1."""
    x = np.atleast_2d(samples.T).T
    body = (np.clip(x, -1, 1) * 32767).round().astype("<i2").tobytes()
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(body), b"WAVE", b"fmt ", 16, PCM, x.shape[1], rate, rate * 2 * x.shape[1], 2 * x.shape[1], 16, b"data", len(body))
    return head + body


FRAME_SCHEMA = "call_id string, frame int, t_s double, remote array<float>, agent array<float>"


def file_frames(call: str, data: bytes, rate: int = 8000, frame_ms: int = 20, agent: int | None = None, most_s: float | None = None) -> pd.DataFrame:
    """Whole frames of a file; mono is all remote. t_s is the frame's start."""
    x, sr = decode(data)
    a = agent if agent is not None else agent_channel(x, sr)
    remote = resample(x[:, 0] if a < 0 else x[:, 1 - a if x.shape[1] == 2 else (a + 1) % x.shape[1]], sr, rate)
    own = resample(x[:, a], sr, rate) if a >= 0 else np.zeros(len(remote), np.float32)
    n = rate * frame_ms // 1000
    k = min(len(remote), int(most_s * rate) if most_s is not None else len(remote)) // n
    return pd.DataFrame({"call_id": call, "frame": np.arange(k, dtype=np.int32), "t_s": np.arange(k) * frame_ms / 1000, "remote": list(remote[: k * n].reshape(k, n)), "agent": list(own[: k * n].reshape(k, n))})


def read_frames(spark: SparkSession, path: str, **options) -> DataFrame:
    """Frames of all WAV files under a path; the call is the file's name without ending."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p, content in zip(batch["path"], batch["content"]):
                yield file_frames(p.rsplit("/", 1)[-1].rsplit(".", 1)[0], content, **options)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(run, FRAME_SCHEMA)


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """(path, channels, samplerate, bits, frames, duration_s) of WAV files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for p, content in zip(batch["path"], batch["content"]):
                got = chunks(content)
                _, ch, sr, _, _, bits = struct.unpack_from("<HHIIHH", got[b"fmt "])
                n = len(got[b"data"]) // max(1, bits // 8 * ch)
                rows.append((p, ch, sr, bits, n, n / sr))
            yield pd.DataFrame(rows, columns=["path", "channels", "samplerate", "bits", "frames", "duration_s"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(run, "path string, channels int, samplerate int, bits int, frames bigint, duration_s double")
