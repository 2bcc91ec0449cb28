"""Media columns: payloads as 8-bit mono WAV, and audio features of what is read back.

Features of a recording: polyphase resampling by UP / DOWN, log-mel energies of overlapped Hann frames, pooled to a
tensor of fixed shape FRAMES x MELS, and segments by hysteresis on frame energy (begun above the upper threshold,
ended below the lower one) with their time spans in seconds.

MediaStore.write() runs a task for each partition: it writes the recordings to an Arrow file, closes it, reads it back, computes features
of what it read, and writes them to a second Arrow file: a fixed-shape tensor column (16-bit floats) and a list of time spans for each
recording. Which files count is a Parquet table that Spark commits, so files of failed or doubled attempts are never
read; names have the attempt's own part. read() takes columns and features from these files only.

Every recording is computed by itself, so equal payloads have equal features in any batch.

Defined results: null and empty texts are 64 zero bytes; a recording shorter than a frame is padded to one; a silent
one has no segments; repeated rows, ties and extra columns change nothing; an empty table gives an empty table; a null key stays null.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, new_path, small_batches, spare, stage, trim

RATE, UP, DOWN = 12_000, 2, 3
OUT_RATE = RATE * UP // DOWN
FRAME, HOP, FFT, MELS, FRAMES, TAPS = 200, 80, 256, 20, 16, 12
PAD = 64
_HEADER = struct.Struct("<4sI4s4sIHHIIHH4sI")


def _filter() -> np.ndarray:
    """A windowed sinc at the lower of the two rates, one row of taps for each phase."""
    n = UP * TAPS
    at = np.arange(n) - (n - 1) / 2
    h = np.sinc(at / max(UP, DOWN)) * np.hanning(n + 2)[1:-1]
    return (h / h.sum() * UP).astype(np.float32).reshape(TAPS, UP).T[:, ::-1].copy()


def _mel_bank() -> np.ndarray:
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(40), mel(OUT_RATE / 2), MELS + 2) / 2595) - 1)
    f = np.fft.rfftfreq(FFT, 1 / OUT_RATE)[:, None]
    lo, mid, hi = edges[:-2], edges[1:-1], edges[2:]
    return np.maximum(0, np.minimum((f - lo) / (mid - lo), (hi - f) / (hi - mid))).astype(np.float32)


_PHASES, _BANK, _WINDOW = _filter(), _mel_bank(), np.hanning(FRAME + 2)[1:-1].astype(np.float32)


def pad(data: bytes) -> bytes:
    """data with zero bytes up to a positive multiple of PAD."""
    return data + bytes(-len(data) % PAD if data else PAD)


def to_wav(payload: bytes) -> bytes:
    """8-bit mono PCM; one sample a byte."""
    n = len(payload)
    return _HEADER.pack(b"RIFF", 36 + n, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", n) + payload


def from_wav(media: bytes) -> bytes:
    riff, _, wave, *_, bits, mark, n = _HEADER.unpack_from(media)
    if (riff, wave, bits, mark) != (b"RIFF", b"WAVE", 8, b"data"):
        raise ValueError("no 8-bit PCM file")
    return media[_HEADER.size : _HEADER.size + n]


def resample(x: np.ndarray) -> np.ndarray:
    """Polyphase: output m is one phase of the filter at input m * DOWN // UP."""
    n = len(x) * UP // DOWN
    held = np.concatenate([np.zeros(TAPS - 1, np.float32), x, np.zeros(DOWN, np.float32)])
    around = np.lib.stride_tricks.sliding_window_view(held, TAPS)
    out = np.empty(n, np.float32)
    for j in range(UP):  # outputs j, j + UP, ...: same phase, inputs DOWN apart
        first, phase = j * DOWN // UP, j * DOWN % UP
        out[j::UP] = around[first::DOWN][: len(out[j::UP])] @ _PHASES[phase]
    return out


def log_mel(y: np.ndarray) -> np.ndarray:
    """A row of MELS log energies for each frame."""
    if len(y) < FRAME:
        y = np.concatenate([y, np.zeros(FRAME - len(y), np.float32)])
    framed = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP]
    out = np.empty((len(framed), MELS), np.float32)
    for at in range(0, len(framed), 2048):
        power = np.abs(np.fft.rfft(framed[at : at + 2048] * _WINDOW, FFT)) ** 2
        out[at : at + 2048] = np.log(power.astype(np.float32) @ _BANK + 1e-6)
    return out


def segments(mel: np.ndarray) -> np.ndarray:
    """Frames [begin, end) of each segment, by hysteresis on the mean log energy."""
    energy = mel.mean(axis=1)
    upper, lower = energy.mean() + 0.5 * energy.std(), energy.mean()
    said = np.where(energy > upper, 1, np.where(energy < lower, -1, 0))
    last = np.maximum.accumulate(np.where(said != 0, np.arange(len(said)), -1))
    on = np.where(last >= 0, said[last], -1) > 0
    edge = np.diff(np.concatenate([[0], on.astype(np.int8), [0]]))
    return np.stack([np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)], axis=1)


def pooled(mel: np.ndarray) -> np.ndarray:
    """FRAMES x MELS: means over equal parts of the time (frames repeat where there are fewer)."""
    if len(mel) < FRAMES:
        return mel[np.arange(FRAMES) * len(mel) // FRAMES]
    cuts = np.arange(FRAMES) * len(mel) // FRAMES
    return np.add.reduceat(mel, cuts, axis=0) / np.diff(np.append(cuts, len(mel)))[:, None].astype(np.float32)


def features(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The tensor, and the segments' time spans in seconds."""
    mel = log_mel(resample((np.frombuffer(payload, np.uint8).astype(np.float32) - 128) / 128))
    return pooled(mel), segments(mel) * (HOP / OUT_RATE)


def feature_text(tensor: np.ndarray, spans: np.ndarray) -> str:
    """The tensor's mean over time in steps of 1/8, number and total length of the segments, and a checksum of the whole tensor and all spans."""
    level = np.clip(np.rint(tensor.astype(np.float32).mean(axis=0) * 8), -128, 127).astype(np.int8)
    whole = zlib.crc32(np.rint(spans * 1000).astype("<i8").tobytes(), zlib.crc32(tensor.astype("<f2").tobytes()))
    return f"{level.tobytes().hex()}:{len(spans)}:{(spans[:, 1] - spans[:, 0]).sum():.2f}:{whole:08x}"


def store(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, n_bytes and media: the text's UTF-8, padded, as a WAV file's bytes."""
    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 200):
                part = b.slice(at, 200)
                raw = [x.encode() if x else b"" for x in part.column(len(keep)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), pa.array([len(x) for x in raw], pa.int64()), pa.array([to_wav(pad(x)) for x in raw], pa.binary())], [*keep, "n_bytes", "media"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, F.col(text).alias(spare(keep, "_text"))).mapInArrow(run, f"{kinds}, n_bytes long, media binary")


_TENSOR = pa.fixed_shape_tensor(pa.float16(), [FRAMES, MELS], dim_names=["time", "mel"])
_MEDIA_FIELDS = pa.schema([("key", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])
_FEATURE_FIELDS = pa.schema([("tensor", _TENSOR), ("spans", pa.list_(pa.list_(pa.float64(), 2)))])
#: Recordings in a batch of a file.
BATCH = 200


def _create(fs, path: str, schema: pa.Schema):
    return pa.ipc.new_file(fs.open_output_stream(path), schema, options=pa.ipc.IpcWriteOptions(compression="zstd"))


def _batches(fs, path: str):
    """The record batches of an Arrow file, one after the other."""
    with fs.open_input_file(path) as at, pa.ipc.open_file(at) as file:
        for i in range(file.num_record_batches):
            yield file.get_batch(i)


class MediaStore:
    """Recordings and their features in Arrow files of a folder that all executors see; `files` says which: part, media, tensors, rows."""

    def __init__(self, folder: str, files: DataFrame):
        self.folder, self.files = folder, files

    @classmethod
    def write(cls, stored: DataFrame, folder: str | None = None, key: str = "doc_id") -> MediaStore:
        """stored has key, n_bytes and media, as from store(); nothing but committed rows of `files` says what is there."""
        folder = folder or new_path(stored.sparkSession, "media")
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)

        def run(batches):
            fs, root = pafs.FileSystem.from_uri(folder)
            part = TaskContext.get().partitionId()
            name = f"{part:07d}-{uuid.uuid4().hex}"
            media, tensors, rows = f"{name}.media.arrow", f"{name}.tensors.arrow", 0
            with _create(fs, f"{root}/{media}", _MEDIA_FIELDS) as to:
                for b in batches:
                    for at in range(0, b.num_rows, BATCH):
                        some = b.slice(at, BATCH)
                        to.write_batch(pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(some.columns, _MEDIA_FIELDS, strict=True)], schema=_MEDIA_FIELDS))
                        rows += some.num_rows
            with _create(fs, f"{root}/{tensors}", _FEATURE_FIELDS) as to:
                for b in _batches(fs, f"{root}/{media}"):
                    made = [features(from_wav(x)) for x in b.column("media").to_pylist()]
                    tensor = pa.FixedShapeTensorArray.from_numpy_ndarray(np.stack([x[0] for x in made]).astype(np.float16), dim_names=["time", "mel"])
                    to.write_batch(pa.RecordBatch.from_arrays([tensor, pa.array([x[1].tolist() for x in made], _FEATURE_FIELDS.field("spans").type)], schema=_FEATURE_FIELDS))
            trim()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([media]), pa.array([tensors]), pa.array([rows], pa.int64())], ["part", "media", "tensors", "rows"])

        files = stored.select(key, "n_bytes", "media").mapInArrow(run, "part int, media string, tensors string, rows long")
        return cls(folder, stage(files, "media-files"))

    def _read(self, columns: pa.Schema, of, kinds: str) -> DataFrame:
        """One task for each file of the folder; of(media batch, tensor batch) gives the columns."""
        folder = self.folder

        def run(batches):
            fs, root = pafs.FileSystem.from_uri(folder)
            for b in batches:
                for media, tensors in zip(b.column("media").to_pylist(), b.column("tensors").to_pylist(), strict=True):
                    for m, t in zip(_batches(fs, f"{root}/{media}"), _batches(fs, f"{root}/{tensors}"), strict=True):
                        yield pa.RecordBatch.from_arrays(of(m, t), columns)
            trim()

        # one row for each task that wrote
        parts = max(1, (self.files.agg(F.max("part")).head()[0] or 0) + 1)
        return self.files.select("part", "media", "tensors").repartitionById(parts, F.col("part")).mapInArrow(run, kinds)

    def read(self, key: str = "doc_id") -> DataFrame:
        """key, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature of every recording."""

        def of(m: pa.RecordBatch, t: pa.RecordBatch) -> list[pa.Array]:
            media = m.column("media").to_pylist()
            payload = list(map(from_wav, media))
            sha = lambda xs: pa.array([hashlib.sha256(x).hexdigest() for x in xs], pa.string())
            long = lambda xs: pa.array(list(xs), pa.int64())
            feature = [feature_text(x, np.array(y).reshape(-1, 2)) for x, y in zip(t.column("tensor").to_numpy_ndarray(), t.column("spans").to_pylist(), strict=True)]
            return [m.column("key"), m.column("n_bytes"), long(map(len, payload)), sha(payload), long(zlib.crc32(x[-PAD:]) for x in payload), long(map(len, media)), sha(media), pa.array(feature, pa.string())]

        names = [key, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        return self._read(names, of, f"`{key}` long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")

    def tensors(self, key: str = "doc_id") -> DataFrame:
        """key, tensor (FRAMES * MELS numbers, time by time) and spans (begin and end in seconds) of every recording."""

        def of(m: pa.RecordBatch, t: pa.RecordBatch) -> list[pa.Array]:
            flat = t.column("tensor").to_numpy_ndarray().reshape(m.num_rows, -1).astype(np.float32)
            return [m.column("key"), pa.array(list(flat), pa.list_(pa.float32())), t.column("spans").cast(pa.list_(pa.list_(pa.float64())))]

        return self._read([key, "tensor", "spans"], of, f"`{key}` long, tensor array<float>, spans array<array<double>>")


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return MediaStore.write(store(documents(spark, sf_dir))).read()
