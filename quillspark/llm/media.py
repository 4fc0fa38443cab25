"""Media columns: texts' bytes as 8-bit audio, with features as fixed-shape Arrow tensors.

`store` puts each payload into a WAV container of unsigned 8-bit mono samples, without loss.
`audio_features` reads the container back, resamples polyphase (UP/DOWN, windowed-sinc filter, one
phase per output residue), takes log-mel energies of overlapped Hann frames, and cuts the sound
into segments by a two-threshold rule: a segment opens where a frame's level reaches OPEN_DB above
the median and closes where it falls under CLOSE_DB. Features come as an Arrow stream whose rows
are windows of WINDOW frames: start and end in milliseconds, the number of real frames, and a
fixed-shape tensor [WINDOW, MELS]; the last window is padded with zeros.

Everything is per row; the frames of a long sound are transformed in blocks, so memory beyond the
sound itself is bounded. Defined results: null and empty texts are one unit of blanks; equal texts
give equal values; silence has no segments; extra columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import documents, map_texts, slices, text_of

#: Payloads are padded with blanks to a positive multiple of this.
UNIT = 192
RATE, UP, DOWN = 16_000, 5, 8
TAPS = 12  # of each phase
FRAME, HOP, MELS, WINDOW = 256, 128, 24, 32
OPEN_DB, CLOSE_DB = 1.0, 0.0
HEADER = struct.Struct("<4sI4s4sIHHIIHH4sI")

_FEATURES = "doc_id long, n_bytes long, media binary, tensors binary, frames int, segments array<struct<start_ms:double,end_ms:double>>, mean_mel array<double>"


def payload_of(text):
    """The text's bytes as a Column, padded."""
    raw = F.encode(text, "UTF-8")
    n = F.octet_length(raw)
    full = F.greatest(F.lit(1), F.ceil(n / UNIT)) * UNIT
    return F.concat(raw, F.encode(F.repeat(F.lit(" "), (full - n).cast("int")), "UTF-8"))


def write_wav(samples: bytes, rate: int = RATE) -> bytes:
    odd = len(samples) & 1
    head = HEADER.pack(b"RIFF", HEADER.size - 8 + len(samples) + odd, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples))
    return head + samples + b"\0" * odd


def read_wav(media: bytes) -> tuple[int, bytes]:
    """Rate and samples of an 8-bit mono container; chunks that aren't known are passed over."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV container")
    at, rate = 12, 0
    while at + 8 <= len(media):
        kind, size = struct.unpack_from("<4sI", media, at)
        if kind == b"fmt ":
            coding, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (coding, channels, bits) != (1, 1, 8):
                raise ValueError("not 8-bit mono")
        if kind == b"data":
            return rate, media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no samples")


@lru_cache(maxsize=4)
def phases(up: int, down: int, taps: int) -> np.ndarray:
    """The filter by phase, latest sample last."""
    n = np.arange(up * taps) - (up * taps - 1) / 2
    h = np.sinc(n / max(up, down)) * np.hamming(len(n))
    return np.ascontiguousarray((h * up / h.sum()).reshape(taps, up).T[:, ::-1]).astype(np.float32)


def resample(x: np.ndarray, up: int = UP, down: int = DOWN, taps: int = TAPS) -> np.ndarray:
    bank, n = phases(up, down, taps), -(-len(x) * up // down)
    views = sliding_window_view(np.concatenate([np.zeros(taps - 1, np.float32), x]), taps)
    out = np.empty(n, np.float32)
    for first in range(min(up, n)):  # outputs first, first + up, ... share a phase
        at, phase = divmod(first * down, up)
        m = len(out[first::up])
        out[first::up] = views[at : at + down * (m - 1) + 1 : down] @ bank[phase]
    return out


@lru_cache(maxsize=4)
def mel_bank(rate: float, frame: int = FRAME, mels: int = MELS) -> np.ndarray:
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(60.0), mel(rate / 2), mels + 2) / 2595) - 1)
    f = np.fft.rfftfreq(frame, 1 / rate)[:, None]
    rise, fall = (f - edges[:-2]) / np.diff(edges)[:-1], (edges[2:] - f) / np.diff(edges)[1:]
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


def log_mel(y: np.ndarray, rate: float, block: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel energies [frames, MELS] and the frames' levels in dB."""
    if len(y) < FRAME:
        y = np.pad(y, (0, FRAME - len(y)))
    frames, window, bank = sliding_window_view(y, FRAME)[::HOP], np.hanning(FRAME).astype(np.float32), mel_bank(rate)
    mel, level = np.empty((len(frames), MELS), np.float32), np.empty(len(frames), np.float32)
    for i in range(0, len(frames), block):
        f = frames[i : i + block] * window
        power = np.abs(np.fft.rfft(f, axis=1)).astype(np.float32) ** 2
        mel[i : i + block] = np.log(power @ bank + 1e-6)
        level[i : i + block] = 10 * np.log10((f * f).mean(axis=1) + 1e-9)
    return mel, level


def hysteresis(level: np.ndarray, high: float, low: float) -> list[tuple[int, int]]:
    """Frame ranges: each opens at `high` and lasts until under `low`."""
    state = np.where(level >= high, 1, np.where(level < low, -1, 0))
    known = np.flatnonzero(state)
    if not len(known):
        return []
    last = np.maximum.accumulate(np.where(state != 0, np.arange(len(state)), -1))
    on = (last >= 0) & (state[np.maximum(last, 0)] == 1)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], on.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def tensors(mel: np.ndarray, ms: float) -> bytes:
    """The windows of one sound as an Arrow stream."""
    n = -(-len(mel) // WINDOW)
    padded = np.zeros((n, WINDOW, MELS), np.float32)
    padded.reshape(-1, MELS)[: len(mel)] = mel
    starts = np.arange(n) * WINDOW
    real = np.minimum(WINDOW, len(mel) - starts)
    cells = pa.FixedShapeTensorArray.from_numpy_ndarray(padded)
    batch = pa.RecordBatch.from_arrays([pa.array(starts * ms), pa.array((starts + real) * ms), pa.array(real, pa.int32()), cells], names=["start_ms", "end_ms", "frames", "mel"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def read_tensors(stream: bytes) -> pa.Table:
    return pa.ipc.open_stream(stream).read_all()


def features(media: bytes) -> tuple[bytes, int, list[dict], list[float]]:
    rate, samples = read_wav(media)
    x = (np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128
    mel, level = log_mel(resample(x), rate * UP / DOWN)
    ms = 1000 * HOP / (rate * UP / DOWN)
    middle = float(np.median(level))
    spans = hysteresis(level, middle + OPEN_DB, middle + CLOSE_DB) if np.ptp(level) > OPEN_DB else []
    return tensors(mel, ms), len(mel), [{"start_ms": a * ms, "end_ms": b * ms} for a, b in spans], np.round(mel.mean(axis=0), 3).tolist()


def audio_features(payloads: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload -> doc_id, n_bytes, media (WAV), tensors (Arrow stream), frames, segments, mean_mel."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start_ms", pa.float64()), ("end_ms", pa.float64())]))
        for batch in batches:
            for piece in slices(batch, 2):
                media = [write_wav(x.as_py()) for x in piece.column(2)]
                made = [features(m) for m in media]
                columns = [piece.column(0), piece.column(1), pa.array(media, pa.binary()), pa.array([m[0] for m in made], pa.binary()), pa.array([m[1] for m in made], pa.int32()), pa.array([m[2] for m in made], kind), pa.array([m[3] for m in made], pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "media", "tensors", "frames", "segments", "mean_mel"])

    return map_texts(payloads.select(F.col("doc_id").cast("long").alias("doc_id"), "n_bytes", "payload"), step, _FEATURES)


def digests(docs: DataFrame) -> DataFrame:
    """What the stored forms hold, read back from them."""
    made = audio_features(docs.select("doc_id", F.octet_length(text_of()).cast("long").alias("n_bytes"), payload_of(text_of()).alias("payload")))
    payload = F.expr(f"substring(media, {HEADER.size + 1}, length(media) - {HEADER.size})")
    parts = made.withColumn("payload", payload)
    spans = F.array_join(F.transform("segments", lambda s: F.concat_ws("-", F.round(s["start_ms"], 1).cast("string"), F.round(s["end_ms"], 1).cast("string"))), ",")
    feature = F.concat_ws(";", F.concat(F.col("frames").cast("string"), F.lit(f"x{MELS}")), F.concat(F.lit("mel="), F.array_join(F.transform("mean_mel", lambda v: v.cast("string")), ",")), F.concat(F.lit("segments="), spans), F.concat(F.lit("tensors="), F.sha2("tensors", 256)))
    return parts.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -16, 16)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        feature.alias("feature"),
    )


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir))
