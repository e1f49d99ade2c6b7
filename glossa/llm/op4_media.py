"""Media columns: payloads as WAV sound, short-time Fourier transforms and spectral-peak pair fingerprints."""

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

from glossa.llm.common import read

RATE, WINDOW, HOP, REACH = 8000, 256, 128, 3
_HANN = np.hanning(WINDOW)


def write_wav(payload: bytes) -> bytes:
    """One channel of 8-bit samples."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def read_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as r:
        if (r.getnchannels(), r.getsampwidth()) != (1, 1):
            raise ValueError("one channel of 8-bit samples is expected")
        return r.readframes(r.getnframes())


def peaks(samples: np.ndarray, frames_at_once: int = 2048) -> Iterator[np.ndarray]:
    """The loudest bin (1 to WINDOW / 2) of each frame of the short-time Fourier transform, in blocks of bounded memory; silence (128) fills the last frame."""
    if missing := WINDOW - len(samples) if len(samples) < WINDOW else (WINDOW - len(samples)) % HOP:
        samples = np.concatenate([samples, np.full(missing, 128, np.uint8)])
    frames = np.lib.stride_tricks.sliding_window_view(samples, WINDOW)[::HOP]
    for i in range(0, len(frames), frames_at_once):
        block = frames[i : i + frames_at_once].astype(np.float64)
        block -= block.mean(axis=1, keepdims=True)
        power = np.abs(np.fft.rfft(block * _HANN, axis=1))[:, 1:]
        yield np.round(power, 6).argmax(axis=1) + 1


def fingerprint(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of each frame's peak with those of the next REACH frames: (frame, first bin << 16 | second bin << 8 | distance)."""
    bins = np.concatenate(list(peaks(samples))).astype(np.int64)
    times, codes = [], []
    for d in range(1, min(REACH, len(bins) - 1) + 1):
        times.append(np.arange(len(bins) - d))
        codes.append(bins[:-d] << 16 | bins[d:] << 8 | d)
    if not times:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    t, c = np.concatenate(times), np.concatenate(codes)
    order = np.argsort(t, kind="stable")
    return t[order], c[order]


SCHEMA = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
    "media_sha256 string, feature string, frame_times array<int>, pair_codes array<int>"
)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            ids, texts = (batch.column(i).slice(at, 256) for i in (0, 1))
            rows: list[tuple] = []
            for text in texts:
                data = (text.as_py() or "").encode()
                media = write_wav(data + bytes(-len(data) % 64 or (64 if not data else 0)))
                payload = read_wav(media)
                t, c = fingerprint(np.frombuffer(payload, np.uint8))
                code = hashlib.sha256(t.astype("<i8").tobytes() + c.astype("<i8").tobytes()).hexdigest()
                rows.append((len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), f"pairs={len(c)};sha256={code}", t, c))
            longs, kinds = pa.int64(), (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            lists = [pa.array([r[i].astype(np.int32) for r in rows], pa.list_(pa.int32())) for i in (7, 8)]
            yield pa.RecordBatch.from_arrays([ids.cast(longs), *columns, *lists], names=[x.split()[0] for x in SCHEMA.split(", ")])


def media_columns(docs: DataFrame) -> DataFrame:
    """A row for each of docs (doc_id, text): the text's bytes as a sound, its sizes and digests, and its fingerprint.

    The payload (UTF-8, bytes 0 up to a positive multiple of 64) is written as 8-bit WAV and read again. The feature
    digests the time-coded arrays frame_times and pair_codes, which hold every pair. Null texts are as empty ones
    (64 bytes 0, one silent frame, no pairs); equal texts have equal values; ties between bins take the lower bin;
    rows are independent, so repeated rows and rows without an id stay.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_features, SCHEMA)


def op4_media(spark, sf_dir: str) -> DataFrame:
    """Sound and fingerprints of all documents."""
    return media_columns(read(spark, sf_dir, "documents"))
