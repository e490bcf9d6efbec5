"""Documents as stored audio, and features of what is read back.

A payload is stored as an 8-bit PCM WAV file in a binary column of a Parquet table. Features come from
the stored bytes: the samples are resampled by a polyphase filter, cut into overlapped Hann frames,
turned into log-mel energies, and segmented by energy with hysteresis (a segment opens above the upper
and closes below the lower threshold). Log-mel blocks of a fixed shape carry the time span they cover
and are written as Arrow fixed-shape tensors.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

RATE = 8000
UNIT = 192
UP, DOWN = 1, 2
TAPS = 32
FRAME, HOP = 128, 64
MELS = 16
BLOCK = 32
OPEN_DB, CLOSE_DB = 1.5, 0.5


def payload(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes padded with spaces to a positive multiple of ``UNIT``, and the unpadded size."""
    raw = (text or "").encode()
    whole = max(1, -(-len(raw) // UNIT)) * UNIT
    return raw + b" " * (whole - len(raw)), len(raw)


def to_wav(samples: bytes, rate: int = RATE) -> bytes:
    """A mono 8-bit PCM WAV file; an odd number of samples is followed by the format's pad byte."""
    n = len(samples)
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n + n % 2, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", n)
    return head + samples + b"\0" * (n % 2)


def from_wav(media: bytes) -> tuple[bytes, int]:
    """The samples and rate of a mono 8-bit PCM WAV file."""
    riff, _, wave = struct.unpack_from("<4sI4s", media)
    if (riff, wave) != (b"RIFF", b"WAVE"):
        raise ValueError("not a WAV file")
    at, rate = 12, None
    while at + 8 <= len(media):
        kind, size = struct.unpack_from("<4sI", media, at)
        if kind == b"fmt ":
            coding, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (coding, channels, bits) != (1, 1, 8):
                raise ValueError("not mono 8-bit PCM")
        elif kind == b"data":
            return media[at + 8 : at + 8 + size], rate
        at += 8 + size + size % 2
    raise ValueError("no samples")


def _lowpass(up: int, down: int, taps: int) -> np.ndarray:
    """A windowed-sinc filter of ``taps * up`` coefficients, cut at the lower of both rates."""
    n = taps * up
    t = np.arange(n) - (n - 1) / 2
    cut = 1.0 / max(up, down)
    h = cut * np.sinc(cut * t) * np.hamming(n)
    return (h / h.sum() * up).astype(np.float32)


def _mel_filters(rate: float, frame: int, mels: int) -> np.ndarray:
    top = 2595 * np.log10(1 + rate / 2 / 700)
    edges = 700 * (10 ** (np.linspace(0, top, mels + 2) / 2595) - 1)
    f = np.arange(frame // 2 + 1) * rate / frame
    low, mid, high = edges[:-2, None], edges[1:-1, None], edges[2:, None]
    return np.maximum(0, np.minimum((f - low) / (mid - low), (high - f) / (high - mid))).astype(np.float32)


_FILTER = _lowpass(UP, DOWN, TAPS)
_MEL = _mel_filters(RATE * UP / DOWN, FRAME, MELS).T.copy()
_WINDOW = np.hanning(FRAME).astype(np.float32)


def resample(x: np.ndarray, up: int = UP, down: int = DOWN, h: np.ndarray = _FILTER) -> np.ndarray:
    """Polyphase resampling: each output is the dot product of one filter phase with its inputs."""
    n_out = -(-len(x) * up // down)
    per_phase = len(h) // up
    centre = len(h) // 2
    pad = np.concatenate((np.zeros(per_phase, x.dtype), x, np.zeros(per_phase + down, x.dtype)))
    out = np.empty(n_out, dtype=np.float32)
    view = np.lib.stride_tricks.sliding_window_view(pad, per_phase)
    for r in range(up):  # outputs r, r + up, ... all use one phase
        where = np.arange(r, n_out, up) * down + centre
        phase = int(where[0] % up) if len(where) else 0
        first = where // up - per_phase + 1 + per_phase
        if len(where):
            step = down
            taps = h[phase::up][::-1]
            block = view[int(first[0]) : int(first[-1]) + 1 : step]
            out[r::up] = np.einsum("ij,j->i", block, taps, optimize=False)
    return out


def log_mel(x: np.ndarray) -> np.ndarray:
    """Log-mel energies of overlapped frames; a short signal is padded to one frame."""
    if len(x) < FRAME:
        x = np.concatenate((x, np.zeros(FRAME - len(x), np.float32)))
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP] * _WINDOW
    spectrum = np.fft.rfft(frames, axis=1)
    power = (spectrum.real**2 + spectrum.imag**2).astype(np.float32)
    return np.log10(power @ _MEL + 1e-6).astype(np.float32)


def segments(energy_db: np.ndarray, up_db: float = OPEN_DB, down_db: float = CLOSE_DB) -> np.ndarray:
    """Frame spans (first, after last) above the thresholds, which stand over the median energy."""
    level = energy_db - np.median(energy_db)
    mark = np.zeros(len(level), dtype=np.int8)
    mark[level >= up_db] = 1
    mark[level < down_db] = -1
    # Each frame takes the last decided mark before it.
    at = np.maximum.accumulate(np.where(mark != 0, np.arange(len(mark)), -1))
    active = np.where(at >= 0, mark[np.maximum(at, 0)], -1) > 0
    edge = np.diff(np.concatenate(([0], active.astype(np.int8), [0])))
    return np.stack((np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)), axis=1)


def features(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel frames and active spans of 8-bit samples."""
    x = (np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128
    mel = log_mel(resample(x))
    return mel, segments(10 * mel.mean(axis=1))


def blocks(mel: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fixed-shape blocks (n, BLOCK, MELS), the last padded with its lowest value, and frame spans."""
    n = -(-len(mel) // BLOCK)
    out = np.full((n * BLOCK, MELS), mel.min(initial=0), dtype=np.float32)
    out[: len(mel)] = mel
    first = np.arange(n) * BLOCK
    return out.reshape(n, BLOCK, MELS), np.stack((first, np.minimum(first + BLOCK, len(mel))), axis=1)


def as_tensors(block: np.ndarray) -> pa.FixedShapeTensorArray:
    """Blocks as an Arrow array of fixed-shape tensors (BLOCK, MELS)."""
    return pa.FixedShapeTensorArray.from_numpy_ndarray(np.ascontiguousarray(block))


def from_tensors(tensors: pa.FixedShapeTensorArray, frames: np.ndarray) -> np.ndarray:
    """The log-mel frames that fixed-shape tensors hold, without the padding that their frame spans leave out."""
    held = tensors.to_numpy_ndarray()
    return np.concatenate([block[: b - a] for block, (a, b) in zip(held, frames)])


def spans_ms(spans: np.ndarray, rate: int) -> str:
    """Frame spans as times in milliseconds, "start-end" joined by commas."""
    at = spans * (HOP * DOWN * 1000) // (UP * rate)
    return ",".join(f"{a}-{b}" for a, b in at.tolist())


def feature_text(mel: np.ndarray, spans: np.ndarray) -> str:
    """A short exact account: frames, active spans, and mean log-mel in hundredths."""
    mean = np.floor(mel.mean(axis=0, dtype=np.float64) * 100 + 0.5).astype(int)
    active = int((spans[:, 1] - spans[:, 0]).sum())
    return f"{len(mel)};{len(spans)}:{active};" + ",".join(map(str, mean))


def store(documents: DataFrame) -> DataFrame:
    """Write every text of ``documents`` (doc_id, text) as a WAV file in a table, and read it back.

    Returns doc_id, n_bytes and media (binary). A null text is an empty one; null ids and repeated
    rows are stored each; other columns are ignored.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                made = [payload(t) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([n for _, n in made], pa.int64()), pa.array([to_wav(p) for p, _ in made], pa.binary())],
                    names=["doc_id", "n_bytes", "media"],
                )

    return materialize(docs.mapInArrow(run, "doc_id long, n_bytes long, media binary"), "media")


def tensors(media: DataFrame) -> DataFrame:
    """Log-mel blocks of stored media: doc_id, block, start_s, end_s, active share, and the block's
    values as a list of BLOCK * MELS floats (row-major), which `write_tensors` types as tensors."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        second = HOP * DOWN / UP
        for batch in batches:
            for doc_id, file in zip(batch.column("doc_id").to_pylist(), batch.column("media").to_pylist()):
                samples, rate = from_wav(file)
                mel, spans = features(samples)
                block, frames = blocks(mel)
                active = np.zeros(len(mel) + 1)
                for a, b in spans:
                    active[a] += 1
                    active[b] -= 1
                on = np.concatenate(([0], np.cumsum(np.cumsum(active)[:-1])))
                n = len(block)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([doc_id] * n, pa.int64()),
                        pa.array(np.arange(n, dtype=np.int64)),
                        pa.array(frames[:, 0] * second / rate),
                        pa.array(frames[:, 1] * second / rate),
                        pa.array((on[frames[:, 1]] - on[frames[:, 0]]) / (frames[:, 1] - frames[:, 0])),
                        pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * BLOCK * MELS, pa.array(block.reshape(-1))),
                    ],
                    names=["doc_id", "block", "start_s", "end_s", "active", "log_mel"],
                )

    return media.select("doc_id", "media").mapInArrow(
        run, "doc_id long, block long, start_s double, end_s double, active double, log_mel array<float>"
    )


def tensor_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    """A batch of `tensors` rows with log_mel as an Arrow fixed-shape tensor column."""
    kind = pa.fixed_shape_tensor(pa.float32(), (BLOCK, MELS))
    values = batch.column("log_mel").flatten()
    fixed = pa.FixedSizeListArray.from_arrays(values, BLOCK * MELS)
    at = batch.schema.get_field_index("log_mel")
    return batch.set_column(at, pa.field("log_mel", kind), pa.ExtensionArray.from_storage(kind, fixed))


def write_tensors(rows: DataFrame, folder: str) -> DataFrame:
    """Write `tensors` rows as Arrow files with fixed-shape tensors in a shared folder; returns path and rows.

    A task writes under the name of its attempt and renames at the end.
    """
    from pyspark import TaskContext

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        context = TaskContext.get()
        system, base = fs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        draft = f"{base}/.draft-{context.partitionId()}-{context.taskAttemptId()}"
        name = f"part-{context.partitionId():06d}.arrow"
        writer, n = None, 0
        for batch in batches:
            typed = tensor_batch(batch)
            if writer is None:
                sink = system.open_output_stream(draft)
                writer = pa.ipc.new_file(sink, typed.schema)
            writer.write_batch(typed)
            n += typed.num_rows
        if writer is not None:
            writer.close()
            sink.close()
            system.move(draft, f"{base}/{name}")
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "n": [n]})

    return rows.mapInArrow(run, "path string, n long")


_DIGEST = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
    "media_sha256 string, feature string, tensors long, active_ms string"
)


def digests(media: DataFrame) -> DataFrame:
    """Checksums and features of stored media, all from the stored bytes.

    Log-mel frames pass through fixed-shape tensors, from which the feature is taken; ``tensors`` is their number
    and ``active_ms`` the time spans of the active segments (empty where there is none). Null and empty texts are
    one unit of spaces; long texts are worked on whole; repeated rows and null ids give a row each; equal media give
    equal values; an empty table gives no rows; other columns are ignored.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for file in batch.column("media"):
                data = file.as_py()
                samples, rate = from_wav(data)
                mel, spans = features(samples)
                block, frames = blocks(mel)
                stored = as_tensors(block)
                row = (
                    len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-16:]), len(data),
                    hashlib.sha256(data).hexdigest(), feature_text(from_tensors(stored, frames), spans), len(stored), spans_ms(spans, rate),
                )
                for column, value in zip(out, row):
                    column.append(value)
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(c, t) for c, t in zip(out, types))],
                names=[f.split()[0] for f in _DIGEST.split(", ")],
            )

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, _DIGEST)
