"""Media columns: texts as WAV samples, short-time Fourier transforms, spectral-peak pair fingerprints.

A payload is stored as the 8-bit samples of a mono WAV file (module ``wave``), so storing loses
nothing. Features are computed from the samples read back: per frame the strongest peaks of the
magnitude spectrum, and pairs of peaks in nearby frames as (bin, bin, frame distance) hashes, kept as
a time-coded array (the frame in the upper, the hash in the lower bits).

Cases: a null text is an empty payload, stored as one block of padding; equal payloads give equal
values in every column but the id; a text of any length is worked on in runs of frames, so memory
beyond the payload itself stays bounded; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinlake.llm.common import bounded_batches

BLOCK = 576
PAD = 255
RATE = 8000
FRAME = 512
HOP = 288
PEAKS = 3
FAN = 3
RUN = 2048
_WINDOW = np.hanning(FRAME).astype(np.float32)


def to_wav(payload: bytes) -> bytes:
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


def padded(text: bytes) -> bytes:
    n = max(1, -(-len(text) // BLOCK)) * BLOCK
    return text + bytes([PAD]) * (n - len(text))


def spectrogram(samples: np.ndarray, first: int, last: int) -> np.ndarray:
    """Magnitudes of frames first..last (short tails are filled with silence, 128)."""
    need = (last - 1) * HOP + FRAME
    part = samples[first * HOP : need].astype(np.float32)
    if (short := need - first * HOP - len(part)) > 0:
        part = np.concatenate([part, np.full(short, 128, np.float32)])
    frames = np.lib.stride_tricks.sliding_window_view(part - 128, FRAME)[::HOP][: last - first]
    return np.abs(np.fft.rfft(frames * _WINDOW, axis=1)).astype(np.float32)


def peaks(samples: np.ndarray) -> np.ndarray:
    """The bins of the PEAKS strongest local maxima of each frame, strongest first (ties: lower bin)."""
    n = max(1, 1 + -(-max(0, len(samples) - FRAME) // HOP))
    out = np.zeros((n, PEAKS), np.int64)
    for first in range(0, n, RUN):
        last = min(n, first + RUN)
        m = np.round(spectrogram(samples, first, last), 2)
        inner = m[:, 1:-1]
        top = np.where((inner >= m[:, :-2]) & (inner > m[:, 2:]), inner, 0)
        for k in range(PEAKS):
            at = top.argmax(axis=1)
            out[first:last, k] = at + 1
            top[np.arange(last - first), at] = -1
    return out


def fingerprint(samples: np.ndarray) -> np.ndarray:
    """Time-coded pairs: frame << 24 | bin << 15 | partner's bin << 6 | distance, ordered by time."""
    p = peaks(samples)
    n = len(p)
    found = []
    for d in range(1, FAN + 1):
        if n > d:
            t = np.arange(n - d)
            for k in range(PEAKS):
                found.append(t << 24 | p[:-d, k] << 15 | p[d:, 0] << 6 | d)
    if not found:
        return p[:, 0] << 15
    return np.sort(np.concatenate(found))


def media_of(text: bytes) -> dict:
    """The stored file and the features of the samples read back from it."""
    stored = to_wav(padded(text))
    back = from_wav(stored)
    codes = fingerprint(np.frombuffer(back, np.uint8))
    return {"wav": stored, "payload": back, "codes": codes}


_FULL = "doc_id {0}, n_bytes long, payload_bytes long, wav binary, codes array<long>"
_DIGEST = "doc_id {0}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_pairs long, codes array<long>"


def media_columns(df: DataFrame, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, payload_bytes, wav (the stored file) and codes (its time-coded fingerprint)."""
    return _run(df, id, text, digest=False)


def media_digests(df: DataFrame, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """As media_columns, with digests of the payload and in place of the file, which does not leave its task.

    ``feature`` is the digest of ``codes``.
    """
    return _run(df, id, text, digest=True)


def _row(text: bytes, digest: bool) -> tuple:
    m = media_of(text)
    back, stored, codes = m["payload"], m["wav"], m["codes"]
    if not digest:
        return len(text), len(back), stored, codes
    feature = hashlib.sha256(codes.astype("<i8").tobytes()).hexdigest()
    return len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), feature, len(codes), codes


def _run(df: DataFrame, id: str, text: str, digest: bool) -> DataFrame:
    bounded_batches(df.sparkSession)
    rows = df.select(F.col(id).alias("doc_id"), F.col(text).alias("text"))
    schema = (_DIGEST if digest else _FULL).format(dict(rows.dtypes)["doc_id"])
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    types = [kinds[c.split()[1]] for c in schema.split(", ")[1:]]

    def build(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out = [_row((t or "").encode(), digest) for t in part.column(1).to_pylist()]
                columns = [pa.array(list(c), k) for c, k in zip(zip(*out), types)] if out else [pa.array([], k) for k in types]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names)

    return rows.mapInArrow(build, schema)
