"""Operator 2: media columns as WAV, with spectral-peak pair fingerprints.

A payload is kept losslessly as the samples of an 8-bit mono WAV file, read back
by the wave module, cut into 576-sample frames (hop 288) and transformed by a
windowed Fourier transform. In each of BANDS bands the strongest bin of a frame
is a peak if no frame within REACH is stronger there. Each peak is paired with
the FAN peaks that follow within SPAN frames; a pair is stored as one long
(frame, both bins, distance): the time-coded array.

Defined cases: null and empty texts give one block of padding; equal texts and
repeated rows give equal rows; a null doc_id stays null, and rows that share one
are described each by its own text; of equally strong bins the lowest is the
peak, and equally strong frames are peaks both; a text of any length is
transformed block by block; an empty table gives an empty result; other columns
of docs are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.common import map_texts, table

BLOCK = 576
HOP = 288
RATE = 8000
BANDS = ((2, 24), (24, 72), (72, 144), (144, 289))
REACH = 3
FAN = 3
SPAN = 31
#: Frames transformed at once.
FRAMES = 2048


def payload_of(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + b"\xff" * (-len(raw) % BLOCK if raw else BLOCK)


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(frames, bins) of the spectral peaks, in time order."""
    window = np.hanning(BLOCK).astype(np.float32)
    frames = np.lib.stride_tricks.sliding_window_view(samples, BLOCK)[::HOP]
    best, where = [], []
    for at in range(0, len(frames), FRAMES):
        x = (frames[at : at + FRAMES].astype(np.float32) - 128) * window
        power = np.abs(np.fft.rfft(x, axis=1))
        best.append(np.stack([power[:, a:b].max(axis=1) for a, b in BANDS], axis=1))
        where.append(np.stack([power[:, a:b].argmax(axis=1) + a for a, b in BANDS], axis=1))
    best, where = np.concatenate(best), np.concatenate(where)
    n = len(best)
    padded = np.pad(best, ((REACH, REACH), (0, 0)), constant_values=-1)
    around = np.maximum.reduce([padded[k : k + n] for k in range(2 * REACH + 1)])
    t, band = np.nonzero((best >= around) & (best > 1e-3))
    return t, where[t, band]


def pair_codes(t: np.ndarray, bins: np.ndarray) -> np.ndarray:
    """Time-coded pairs: frame << 24 | first bin << 14 | second bin << 5 | distance."""
    out = []
    for k in range(1, FAN + 1):
        dt = t[k:] - t[:-k]
        ok = dt <= SPAN
        out.append((t[:-k][ok] << 24) | (bins[:-k][ok] << 14) | (bins[k:][ok] << 5) | dt[ok])
    return np.sort(np.concatenate(out)) if out else np.zeros(0, np.int64)


def describe(text: str | None) -> tuple:
    n, payload = payload_of(text)
    media = to_wav(payload)
    back = from_wav(media)
    t, bins = peaks(np.frombuffer(back, np.uint8))
    codes = pair_codes(t.astype(np.int64), bins.astype(np.int64))
    feature = f"{len(t)}:{len(codes)}:{hashlib.md5(codes.astype('<i8').tobytes()).hexdigest()}"
    return n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature, media, codes


def media_columns(docs: DataFrame, keep_media: bool = False, keep_codes: bool = False) -> DataFrame:
    """Per document the stored payload's digests and its fingerprint.

    keep_media adds the WAV bytes, keep_codes the time-coded array.
    """
    made = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    made += ", media binary" * keep_media + ", codes array<long>" * keep_codes
    places = [*range(7), *[7] * keep_media, *[8] * keep_codes]

    def prepare() -> Callable:
        def work(texts: list[str | None]) -> tuple[None, list]:
            rows = [describe(t) for t in texts]
            return None, [[r[k] for r in rows] for k in places]

        return work

    return map_texts(docs, ["doc_id"], prepare, made)


def op2_wav_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = media_columns(table(spark, sf_dir, "documents"), keep_codes=True)
    return out.withColumn("n_pairs", F.size("codes").cast("long"))
