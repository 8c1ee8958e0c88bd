"""Media columns: texts stored as 8-bit WAV, read back, transformed and fingerprinted.

store_media writes each text's UTF-8 bytes, with bytes 0 up to a positive multiple of 64, as one
channel of unsigned 8-bit samples by the wave module. media_features reads the stored bytes, takes a
short-time Fourier transform and pairs spectral peaks; fingerprints are two parallel arrays, the
frame of each pair's first peak (times) and the pair's code (codes). Null and empty texts are 64
zero samples. Samples are padded with silence to whole hops, so that all of them are in a frame. A text is
transformed FRAMES_AT_ONCE frames at a time, so long texts need no more memory than short ones, and
frames depend on their own samples alone. Equal texts have equal values; columns other than the key and
the text are not read.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbgrid.llm.common import map_rows, only, written

RATE = 8000
FRAME, HOP = 512, 256
#: Edges of the bands, in bins; each frame has at most one peak in each.
BANDS = (2, 16, 48, 112, 257)
#: Peaks that follow a peak, with which it is paired; frames that a pair may span at most.
FAN, SPAN = 3, 63
FRAMES_AT_ONCE = 256


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as r:
        return r.readframes(r.getnframes())


def peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(frames, bins) of spectral peaks, by frame and band: the largest bin of its band, over the
    band's mean in its frame, and no smaller than the band's largest in the frames beside it."""
    x = samples.astype(np.float32) - 128
    x = np.pad(x, (0, FRAME - len(x) if len(x) < FRAME else (FRAME - len(x)) % HOP))  # the last samples are in a frame too
    n = 1 + (len(x) - FRAME) // HOP
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    window = np.hanning(FRAME).astype(np.float32)
    best, size, over = (np.empty((n, len(BANDS) - 1), t) for t in (np.int64, np.float32, bool))
    for at in range(0, n, FRAMES_AT_ONCE):
        power = np.abs(np.fft.rfft(frames[at : at + FRAMES_AT_ONCE] * window, axis=1)).astype(np.float32)
        for k, (low, high) in enumerate(zip(BANDS, BANDS[1:])):
            band = power[:, low:high]
            top = band.argmax(1)
            best[at : at + len(band), k] = top + low
            size[at : at + len(band), k] = big = band[np.arange(len(band)), top]
            over[at : at + len(band), k] = big > 1.5 * band.mean(1)
    edge = np.full((1, size.shape[1]), -1, np.float32)
    is_peak = over & (size >= np.vstack([edge, size[:-1]])) & (size >= np.vstack([size[1:], edge]))
    frame, band = np.nonzero(is_peak)
    return frame, best[frame, band]


def pair_codes(frame: np.ndarray, bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Times and codes of each peak with the FAN peaks that follow it, within SPAN frames."""
    times, codes = [], []
    for k in range(1, FAN + 1):
        gap = frame[k:] - frame[:-k]
        near = gap <= SPAN
        times.append(frame[:-k][near])
        codes.append(((bins[:-k] << 15) | (bins[k:] << 6) | gap)[near])
    t, c = np.concatenate(times), np.concatenate(codes)
    order = np.lexsort((c, t))
    return t[order].astype(np.int32), c[order].astype(np.int32)


def store_media(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes (without padding), media (a WAV file's bytes)."""

    def store(columns):
        for k, t in zip(*columns):
            data = (t or "").encode("utf-8")
            yield k, len(data), to_wav(data + bytes(-len(data) % 64 if data else 64))

    return map_rows(only(docs, **{key: "long", text: "string"}), f"{key} long, n_bytes long, media binary", lambda: store)


def media_features(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """What the stored bytes hold: payload and media digests, and the fingerprint arrays."""

    def make() -> Callable:
        def features(columns):
            for k, n, stored in zip(*columns):
                payload = from_wav(stored)
                t, c = pair_codes(*peaks(np.frombuffer(payload, np.uint8)))
                yield k, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), t, c

        return features

    schema = f"{key} long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, times array<int>, codes array<int>"
    return map_rows(only(media, **{key: "long", "n_bytes": "long", "media": "binary"}), schema, make)


def media_report(docs: DataFrame) -> DataFrame:
    """The features of all texts, read back from a written media table; feature: number of pairs and
    a hash of the time-coded arrays, which follow as times and codes."""
    found = media_features(written(store_media(docs), "media"))
    feature = F.concat_ws(":", F.size("codes").cast("string"), F.lower(F.hex(F.xxhash64("times", "codes"))))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"), "times", "codes")
