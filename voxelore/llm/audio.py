"""Audio features of byte payloads kept as 8-bit PCM.

A payload is stored as a WAV file of unsigned 8-bit samples and read back from it. Features: polyphase resampling from RATE to
OUT_RATE, overlapped log-mel filterbanks, and segments found by hysteresis on the frames' energy: one begins where the
energy passes the upper threshold and ends where it falls below the lower one. Log-mel frames are stored in patches of a
fixed shape as an Arrow fixed-shape tensor column with the time span of each patch.

Defined cases: a null text is the empty text, whose payload is 192 blanks. Equal payloads give equal values: every
document is computed alone, in blocks whose sizes depend on its length only, so memory does not grow beyond some copies of
the payload. Null ids and repeated rows are computed like any other. An empty table gives an empty result.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RATE, OUT_RATE, UP, DOWN, TAPS = 24_000, 16_000, 2, 3, 16
FRAME, HOP, FFT, MELS, PATCH = 400, 160, 512, 40, 64
UNIT, PAD = 192, b"\x20"
#: Thresholds of the segments in dB above the clip's mean energy.
ON_DB, OFF_DB = 0.5, -0.5
BLOCK = 1 << 18


def to_wav(payload: bytes) -> bytes:
    n = len(payload)
    head = b"RIFF" + struct.pack("<I", 36 + n) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8)
    return head + b"data" + struct.pack("<I", n) + payload


def from_wav(media: bytes) -> bytes:
    """The samples of a WAV file, found by walking its chunks."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at = 12
    while at + 8 <= len(media):
        kind, n = media[at : at + 4], struct.unpack("<I", media[at + 4 : at + 8])[0]
        if kind == b"data":
            return media[at + 8 : at + 8 + n]
        at += 8 + n + n % 2
    raise ValueError("no data chunk")


@lru_cache(maxsize=1)
def _phases() -> list[np.ndarray]:
    """The branches of the low-pass prototype: a Hann-windowed sinc, TAPS taps for each of UP phases."""
    n = np.arange(TAPS * UP) - (TAPS * UP - 1) / 2
    h = np.sinc(n / max(UP, DOWN)) * np.hanning(TAPS * UP + 2)[1:-1]
    h *= UP / h.sum()
    return [h[p::UP][::-1].astype(np.float32) for p in range(UP)]


def resample(x: np.ndarray) -> np.ndarray:
    """Polyphase resampling by UP / DOWN; output n needs one branch of TAPS taps at input n * DOWN // UP."""
    m = -(-len(x) * UP // DOWN)
    padded = np.concatenate([np.zeros(TAPS - 1, np.float32), x, np.zeros(DOWN + TAPS, np.float32)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, TAPS)
    y = np.empty(-(-m // UP) * UP, np.float32)
    for r in range(UP):
        branch, count = _phases()[r * DOWN % UP], len(y) // UP
        for at in range(0, count, BLOCK):
            n = min(BLOCK, count - at)
            y[r + at * UP : r + (at + n) * UP : UP] = windows[r * DOWN // UP + at * DOWN :: DOWN][:n] @ branch
    return y[:m]


@lru_cache(maxsize=1)
def _mel() -> tuple[np.ndarray, np.ndarray]:
    """The window and the triangular filters, evenly spaced on the mel scale."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(20.0), mel(OUT_RATE / 2), MELS + 2) / 2595) - 1)
    f = np.arange(FFT // 2 + 1) * OUT_RATE / FFT
    rise = (f[:, None] - edges[None, :-2]) / (edges[1:-1] - edges[:-2])
    fall = (edges[None, 2:] - f[:, None]) / (edges[2:] - edges[1:-1])
    return np.hanning(FRAME).astype(np.float32), np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


def log_mel(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(frames x MELS log energies, frame energies in dB); the last frame is padded with zeros."""
    n = max(1, 1 + -(-(len(y) - FRAME) // HOP))
    y = np.concatenate([y, np.zeros(max(0, (n - 1) * HOP + FRAME - len(y)), np.float32)])
    frames = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP][:n]
    window, filters = _mel()
    mels, energy = np.empty((n, MELS), np.float32), np.empty(n, np.float32)
    for at in range(0, n, 1024):
        part = frames[at : at + 1024] * window
        spectrum = np.fft.rfft(part, FFT, axis=1)
        power = spectrum.real**2 + spectrum.imag**2
        mels[at : at + 1024] = np.log(power @ filters + np.float32(1e-6))
        energy[at : at + 1024] = 10 * np.log10((part * part).mean(axis=1) + np.float32(1e-9))
    return mels, energy


def segments(energy: np.ndarray) -> list[tuple[float, float]]:
    """Time spans in seconds where the energy is on."""
    level = float(energy.mean())
    mark = np.where(energy >= level + ON_DB, 1, np.where(energy < level + OFF_DB, -1, 0))
    last = np.maximum.accumulate(np.where(mark != 0, np.arange(len(mark)), -1))
    on = np.where(last >= 0, mark[np.maximum(last, 0)] == 1, False)
    turns = np.flatnonzero(np.diff(np.concatenate([[0], on.astype(np.int8), [0]])))
    return [(float(a * HOP / OUT_RATE), float(((b - 1) * HOP + FRAME) / OUT_RATE)) for a, b in turns.reshape(-1, 2)]


def patches(mels: np.ndarray) -> pa.RecordBatch:
    """The frames in patches of PATCH x MELS as an Arrow fixed-shape tensor column, with start and end in seconds."""
    n = -(-len(mels) // PATCH)
    full = np.zeros((n * PATCH, MELS), np.float32)
    full[: len(mels)] = mels
    kind = pa.fixed_shape_tensor(pa.float32(), (PATCH, MELS), dim_names=("frame", "mel"))
    storage = pa.FixedSizeListArray.from_arrays(pa.array(full.ravel()), PATCH * MELS)
    first = np.arange(n) * PATCH
    last = np.minimum(first + PATCH, len(mels)) - 1
    spans = [pa.array(first * HOP / OUT_RATE), pa.array((last * HOP + FRAME) / OUT_RATE)]
    return pa.RecordBatch.from_arrays([pa.ExtensionArray.from_storage(kind, storage), *spans], ["log_mel", "start_s", "end_s"])


def ipc(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def payload_of(text: bytes) -> bytes:
    """The text with blanks appended up to a positive multiple of UNIT bytes."""
    return text + PAD * (max(UNIT, -(-len(text) // UNIT) * UNIT) - len(text))


BASE = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames int, segments array<struct<start_s: double, end_s: double>>"


def _features(stored: bool):
    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                media = to_wav(payload_of(text or b""))
                back = from_wav(media)
                x = (np.frombuffer(back, np.uint8).astype(np.float32) - 128) / 128
                mels, energy = log_mel(resample(x))
                spans, tensor = segments(energy), patches(mels)
                rounded = np.rint(tensor.column(0).storage.values.to_numpy() * 16).astype("<i2")
                on = sum(b - a for a, b in spans)
                row = {
                    "doc_id": doc, "n_bytes": len(text or b""), "payload_bytes": len(back), "payload_sha256": sha256(back).hexdigest(),
                    "tail_crc32": zlib.crc32(back[-16:]), "media_bytes": len(media), "media_sha256": sha256(media).hexdigest(),
                    "feature": f"frames={len(mels)} patches={tensor.num_rows} segments={len(spans)} on_s={on:.3f} mel_crc32={zlib.crc32(rounded.tobytes()):08x}",
                    "n_frames": len(mels), "segments": [{"start_s": a, "end_s": b} for a, b in spans],
                }
                rows.append(row | ({"media": media, "log_mel_ipc": ipc(tensor)} if stored else {}))
                if len(rows) >= 64:
                    yield pa.RecordBatch.from_pylist(rows, schema=_schema(stored))
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=_schema(stored))

    return features


@lru_cache(maxsize=2)
def _schema(stored: bool) -> pa.Schema:
    span = pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    fields = [(x.split()[0], kinds[x.split()[1]]) for x in BASE.split(", segments")[0].split(", ")]
    return pa.schema([*fields, ("segments", span), *([("media", pa.binary()), ("log_mel_ipc", pa.binary())] if stored else [])])


def audio_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stored: bool = True) -> DataFrame:
    """One row a document; with `stored` also the WAV file and the tensors with their time spans as an Arrow IPC stream."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return docs.mapInArrow(_features(stored), BASE + (", media binary, log_mel_ipc binary" if stored else ""))
