"""Media columns: audio features of 8-bit mono PCM in WAVE files.

A stored file is read back, resampled by a rational factor with a polyphase filter, cut
into overlapped frames and turned into log-mel bands. Frame energies open a segment at or
above the upper threshold and close it below the lower one (hysteresis). Frames go into
Arrow tensors of one fixed shape (FRAMES x MELS, the last padded with the floor), each with
its time span. Samples are read in blocks, so what a task holds beside one row's file is
bounded.

Null text is empty. An empty payload is one unit of padding, hence one frame. Equal
payloads give equal features. Every row gives one row, whatever its doc_id.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow import map_rows
from .common import table

RATE, UP, DOWN, TAPS = 16_000, 5, 8, 16  # stored rate; resampled to RATE * UP / DOWN
WINDOW, HOP, MELS, FRAMES = 256, 128, 32, 64
UPPER_DB, LOWER_DB, FLOOR = 1.0, -1.0, 1e-10  # thresholds relative to the file's median energy
UNIT, PAD = 192, b"\x20"
BLOCK = 1 << 16  # frames of DOWN samples at a time

SCHEMA = "doc_id long, n_bytes long, payload binary, media binary, frames int, segments array<struct<start_s: double, end_s: double>>, mean_mel array<float>, tensors binary"


def to_wave(payload: bytes, rate: int = RATE) -> bytes:
    """A RIFF WAVE file with one channel of unsigned 8-bit samples."""
    odd = len(payload) % 2
    return b"".join((b"RIFF", struct.pack("<I", 36 + len(payload) + odd), b"WAVEfmt ", struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8), b"data", struct.pack("<I", len(payload)), payload, b"\0" * odd))


def from_wave(media: bytes) -> tuple[bytes, int]:
    """Samples and rate of a file that to_wave() made, chunk by chunk."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, rate = 12, 0
    while at + 8 <= len(media):
        name, n = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (kind, channels, bits) != (1, 1, 8):
                raise ValueError("not 8-bit mono PCM")
        elif name == b"data":
            return media[at + 8 : at + 8 + n], rate
        at += 8 + n + n % 2
    raise ValueError("no samples")


def polyphase() -> np.ndarray:
    """(inputs, UP): the UP outputs that DOWN new samples give, as sums over the last TAPS - 1 + DOWN inputs."""
    n = TAPS * UP
    t = np.arange(n) - (n - 1) / 2
    h = np.sinc(t / DOWN) * np.hamming(n)
    h *= UP / h.sum()
    out = np.zeros((TAPS - 1 + DOWN, UP), np.float32)
    for r in range(UP):
        shift, phase = divmod(r * DOWN, UP)
        for k in range(TAPS):
            out[TAPS - 1 + shift - k, r] = h[phase + k * UP]
    return out


def mel_bank(rate: float) -> np.ndarray:
    """(WINDOW // 2 + 1, MELS) triangles, evenly spaced in mel."""
    top = 2595 * np.log10(1 + rate / 2 / 700)
    edges = 700 * (10 ** (np.linspace(0, top, MELS + 2) / 2595) - 1)
    f = np.arange(WINDOW // 2 + 1) * rate / WINDOW
    up = (f[:, None] - edges[:-2]) / (edges[1:-1] - edges[:-2])
    down = (edges[2:] - f[:, None]) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(up, down)).astype(np.float32)


def resample(samples: np.ndarray, bank: np.ndarray) -> np.ndarray:
    """8-bit samples at the stored rate -> floats at RATE * UP / DOWN, block by block."""
    blocks = -(-len(samples) // DOWN)
    out = np.empty((blocks, UP), np.float32)
    for i in range(0, blocks, BLOCK):
        n = min(BLOCK, blocks - i)
        x = np.zeros(TAPS - 1 + n * DOWN, np.float32)
        lo = i * DOWN - (TAPS - 1)
        part = samples[max(0, lo) : (i + n) * DOWN].astype(np.float32)
        at = max(0, -lo)
        x[at : at + len(part)] = (part - 128) / 128
        out[i : i + n] = np.lib.stride_tricks.sliding_window_view(x, TAPS - 1 + DOWN)[::DOWN] @ bank
    return out.reshape(-1)


def log_mel(x: np.ndarray, bank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(frames, MELS) log10 mel energies and each frame's energy in dB."""
    frames = 1 + max(0, -(-(len(x) - WINDOW) // HOP))
    x = np.pad(x, (0, WINDOW + (frames - 1) * HOP - len(x)))
    taper, mel, energy = np.hanning(WINDOW).astype(np.float32), np.empty((frames, MELS), np.float32), np.empty(frames, np.float32)
    view = np.lib.stride_tricks.sliding_window_view(x, WINDOW)[::HOP]
    for i in range(0, frames, 4096):
        part = view[i : i + 4096]
        power = np.abs(np.fft.rfft(part * taper)) ** 2
        mel[i : i + 4096] = np.log10(np.maximum(power @ bank, FLOOR))
        energy[i : i + 4096] = 10 * np.log10(np.maximum((part * part).mean(1), FLOOR))
    return mel, energy


def hysteresis(energy: np.ndarray) -> list[tuple[int, int]]:
    """Runs of frames [first, last]: opened at the upper threshold, kept while not below the lower one."""
    level = energy - np.median(energy)
    mark = np.where(level >= UPPER_DB, 1, np.where(level < LOWER_DB, -1, 0))
    last = np.maximum.accumulate(np.where(mark != 0, np.arange(len(mark)), -1))
    on = np.where(last >= 0, mark[last] == 1, False)
    edge = np.flatnonzero(np.diff(np.concatenate(([0], on.astype(np.int8), [0]))))
    return [(int(a), int(b) - 1) for a, b in zip(edge[::2], edge[1::2], strict=True)]


def tensors(mel: np.ndarray, step_s: float, span_s: float) -> bytes:
    """An Arrow stream with columns start_s, end_s and a fixed-shape tensor of FRAMES x MELS."""
    clips = -(-len(mel) // FRAMES)
    full = np.full((clips * FRAMES, MELS), np.log10(FLOOR), np.float32)
    full[: len(mel)] = mel
    ends = np.minimum(np.arange(1, clips + 1) * FRAMES, len(mel)) - 1
    kind = pa.fixed_shape_tensor(pa.float32(), (FRAMES, MELS))
    flat = pa.FixedSizeListArray.from_arrays(pa.array(full.reshape(-1)), FRAMES * MELS)
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(clips) * FRAMES * step_s), pa.array(ends * step_s + span_s), pa.ExtensionArray.from_storage(kind, flat)], names=["start_s", "end_s", "log_mel"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def read_tensors(stream: bytes) -> pa.Table:
    return pa.ipc.open_stream(stream).read_all()


def extractor() -> Callable[..., Iterator[tuple]]:
    poly, rate = polyphase(), RATE * UP / DOWN
    bank = mel_bank(rate)

    def row(doc_id, text) -> Iterator[tuple]:
        raw = (text or "").encode()
        media = to_wave(raw + PAD * ((-len(raw)) % UNIT if raw else UNIT))
        payload, stored = from_wave(media)
        mel, energy = log_mel(resample(np.frombuffer(payload, np.uint8), poly), bank)
        step, span = HOP / (stored * UP / DOWN), WINDOW / (stored * UP / DOWN)
        spans = [{"start_s": a * step, "end_s": b * step + span} for a, b in hysteresis(energy)]
        yield doc_id, len(raw), payload, media, len(mel), spans, mel.mean(0, dtype=np.float64).astype(np.float32).tolist(), tensors(mel, step, span)

    return row


def audio_features(docs: DataFrame) -> DataFrame:
    """doc_id, text -> SCHEMA: the stored file, the payload read back from it, segments and tensors."""
    return map_rows(docs.select(F.col("doc_id").cast("long"), "text"), SCHEMA, extractor)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = audio_features(table(spark, sf_dir, "documents"))
    active = F.expr("aggregate(segments, 0D, (a, s) -> a + s.end_s - s.start_s)")
    feature = F.concat_ws(";", F.format_string("frames=%d", "frames"), F.format_string("segments=%d", F.size("segments")), F.format_string("active=%.3f", active), F.concat(F.lit("mel="), F.concat_ws(",", F.transform("mean_mel", lambda x: F.format_string("%.2f", x)))), F.concat(F.lit("tensors="), F.sha1("tensors")))
    return made.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(F.expr("substring(payload, -16, 16)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"),
    )
