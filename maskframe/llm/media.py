"""Media columns: texts as 8-bit WAV bytes, read back, with spectral-peak pair fingerprints.

Each text's UTF-8 bytes, padded with zeros to a positive multiple of 64, become the samples of a mono 8-bit WAV. The
reader takes the samples from the stored bytes, computes short-time Fourier transforms (Hann frames of 128 every 64
samples), keeps the strongest bin of each frame that tops its neighbours in time, and pairs each peak with the next
three: code = (bin 1, bin 2, frames between), stored with the time of the first peak.

Edge cases: a null text is empty (64 zero bytes, no peak of any strength); payloads shorter than a frame are analysed
with zeros behind them; very long texts are transformed block by block; equal texts give equal values; an empty table gives an empty result;
further columns are carried along (the added one replaces one of its name).
"""

from __future__ import annotations

import io
import wave
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_of

UNIT, RATE, FRAME, HOP, NEAR, FAN, BLOCK = 64, 8000, 128, 64, 2, 3, 8192
WINDOW = np.hanning(FRAME).astype(np.float32)


def to_wav(raw: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(raw + bytes(-len(raw) % UNIT if raw else UNIT))
    return out.getvalue()


def from_wav(stored: bytes) -> bytes:
    with wave.open(io.BytesIO(stored), "rb") as w:
        return w.readframes(w.getnframes())


def peaks(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Times (frames) and bins of the spectral peaks."""
    x = np.frombuffer(samples, dtype=np.uint8).astype(np.float32) - 128
    if len(x) < FRAME:
        x = np.pad(x, (0, FRAME - len(x)))
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    bins, power = np.empty(len(frames), dtype=np.int64), np.empty(len(frames))
    for lo in range(0, len(frames), BLOCK):
        part = frames[lo : lo + BLOCK]
        spectrum = np.abs(np.fft.rfft((part - part.mean(axis=1, keepdims=True)) * WINDOW, axis=1))[:, 1:]
        best = spectrum.argmax(axis=1)
        bins[lo : lo + BLOCK], power[lo : lo + BLOCK] = best + 1, spectrum[np.arange(len(part)), best]
    padded = np.pad(power, NEAR, constant_values=-1.0)
    top = power > 1e-6
    for d in range(1, NEAR + 1):  # of equal neighbours the first counts
        top &= (power > padded[NEAR - d : len(padded) - NEAR - d]) & (power >= padded[NEAR + d : len(padded) - NEAR + d])
    return np.flatnonzero(top), bins[top]


def pairs(times: np.ndarray, bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(time, code) of each peak with each of the FAN peaks behind it, sorted by time."""
    at, code = [], []
    for d in range(1, FAN + 1):
        gap = times[d:] - times[:-d]
        at.append(times[:-d])
        code.append((bins[:-d] << 16) | (bins[d:] << 8) | np.minimum(gap, 255))
    at, code = np.concatenate(at), np.concatenate(code)
    order = np.lexsort((code, at))
    return at[order].astype(np.int32), code[order].astype(np.int32)


def wav(text: pd.Series) -> pd.Series:
    return pd.Series([to_wav(t.encode() if t else b"") for t in text], dtype=object)


ANALYSED = "payload_bytes long, payload_sha256 string, tail_crc32 long, times array<int>, codes array<int>, feature string"


def analysed(media: pd.Series) -> pd.DataFrame:
    import hashlib

    rows = []
    for m in media:
        raw = from_wav(m)
        at, bins = peaks(raw)
        times, codes = pairs(at, bins)
        digest = zlib.crc32(codes.astype("<i4").tobytes(), zlib.crc32(times.astype("<i4").tobytes()))
        rows.append((len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-UNIT:]), times, codes, f"{len(at)}:{len(codes)}:{digest:08x}"))
    return pd.DataFrame(rows, columns=["payload_bytes", "payload_sha256", "tail_crc32", "times", "codes", "feature"])


def with_media(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds media, the stored WAV bytes."""
    return df.withColumn("media", F.pandas_udf(wav, "binary")(text_of(text_col)))


def with_fingerprints(df: DataFrame, media_col: str = "media") -> DataFrame:
    """Adds fingerprint: what reading the stored bytes back gives, with times and codes as aligned arrays."""
    return df.withColumn("fingerprint", F.pandas_udf(analysed, ANALYSED)(media_col))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_fingerprints(with_media(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return docs.select("doc_id", F.octet_length(text_of()).cast("long").alias("n_bytes"), "fingerprint.payload_bytes", "fingerprint.payload_sha256", "fingerprint.tail_crc32", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "fingerprint.feature", "fingerprint.times", "fingerprint.codes")
