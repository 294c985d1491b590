"""Media columns: texts stored as sound, read back, and fingerprinted.

A text's UTF-8 bytes become the 8-bit samples of a mono WAV stream. The samples
that the wave module reads back go through a short-time Fourier transform; local
maxima of the spectrogram are paired with the next maxima in time, and each pair
is a fingerprint code with its time.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNIT = 64
RATE = 8000
FRAME = 256
HOP = 128
#: A peak is the largest of this many frames and frequencies to each side.
AROUND_T = 3
AROUND_F = 8
#: Frames within which a peak is paired, and partners for each peak.
REACH = 32
PARTNERS = 2
#: Frames transformed at once, so that a very long text needs no more memory than this.
BLOCK = 4096


def to_wav(payload: bytes) -> bytes:
    """The payload as unsigned 8-bit mono samples."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(stored: bytes) -> bytes:
    with wave.open(io.BytesIO(stored), "rb") as w:
        return w.readframes(w.getnframes())


_WINDOW = np.hanning(FRAME).astype(np.float32)


def spectrogram(samples: np.ndarray) -> np.ndarray:
    """Magnitudes, frames by frequencies; a last part of a frame is filled with silence (128)."""
    n = max(1, -(-max(0, len(samples) - FRAME) // HOP) + 1)
    padded = np.full((n - 1) * HOP + FRAME, 128, np.uint8)
    padded[: len(samples)] = samples
    frames = np.lib.stride_tricks.sliding_window_view(padded, FRAME)[::HOP]
    return np.abs(np.fft.rfft((frames.astype(np.float32) - 128) * _WINDOW, axis=1)).astype(np.float32)


def _largest_around(x: np.ndarray, reach: int, axis: int) -> np.ndarray:
    out = x.copy()
    n = x.shape[axis]
    cut = lambda a, b: (slice(a, b), slice(None)) if axis == 0 else (slice(None), slice(a, b))
    for d in range(1, min(reach, n - 1) + 1):
        np.maximum(out[cut(d, n)], x[cut(0, n - d)], out=out[cut(d, n)])
        np.maximum(out[cut(0, n - d)], x[cut(d, n)], out=out[cut(0, n - d)])
    return out


def peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frame and frequency of the local maxima above the mean level, by time."""
    at_t, at_f = [], []
    frames = max(1, -(-max(0, len(samples) - FRAME) // HOP) + 1)
    for lo in range(0, frames, BLOCK):  # each block with what its maxima are compared with
        a = max(0, lo - AROUND_T)
        b = min(frames, lo + BLOCK + AROUND_T)
        level = spectrogram(samples[a * HOP : (b - 1) * HOP + FRAME])[: b - a]
        level[:, 0] = 0
        top = (level >= _largest_around(_largest_around(level, AROUND_F, 1), AROUND_T, 0)) & (level > level.mean(axis=1, keepdims=True)) & (level > 1e-3)
        t, f = np.nonzero(top[lo - a : min(frames, lo + BLOCK) - a])
        at_t.append(t + lo)
        at_f.append(f)
    return np.concatenate(at_t), np.concatenate(at_f)


def fingerprint(samples: np.ndarray) -> np.ndarray:
    """Codes time << 32 | frequency << 16 | partner's frequency << 8 | frames between, by time."""
    t, f = peaks(samples)
    codes = []
    for d in range(1, PARTNERS + 1):
        gap = t[d:] - t[:-d]
        near = gap <= REACH
        codes.append((t[:-d][near] << 32) | (f[:-d][near] << 16) | (f[d:][near] << 8) | gap[near])
    return np.sort(np.concatenate(codes)).astype(np.int64)


OUT = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
    "media_sha256 string, feature string, n_peaks_paired long, fingerprint array<long>, media binary"
)


def store_as_media(docs: DataFrame, with_media: bool = True) -> DataFrame:
    """Each row's text as a WAV stream with its digests and fingerprint.

    Returned: doc_id, n_bytes (of the text), payload_bytes (padded with bytes 0 to a positive multiple
    of 64), payload_sha256, tail_crc32 (last 64 bytes) - both of the bytes read back -, media_bytes,
    media_sha256, feature (digest of the fingerprint, after the number of codes), n_peaks_paired,
    fingerprint (time-coded) and, with ``with_media``, the WAV bytes.

    Null and empty texts give 64 bytes 0, so one constant form. Equal texts give equal values. Rows
    are independent of each other: repeated ids and null ids are kept; other columns are ignored.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                rows = []
                for text in part["text"].to_pylist():
                    raw = text.encode()
                    payload = raw.ljust(max(UNIT, -(-len(raw) // UNIT) * UNIT), b"\0")
                    stored = to_wav(payload)
                    back = from_wav(stored)
                    codes = fingerprint(np.frombuffer(back, np.uint8))
                    feature = f"{len(codes)}:{hashlib.sha256(codes.tobytes()).hexdigest()[:32]}"
                    rows.append((len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(stored), hashlib.sha256(stored).hexdigest(), feature, len(codes), codes, stored if with_media else None))
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([part["doc_id"], *[pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)]], names=_NAMES)

    out = texts.mapInArrow(run, OUT)
    return out if with_media else out.drop("media")


_NAMES = [x.split()[0] for x in OUT.split(", ")]
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
