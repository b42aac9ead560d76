"""Media columns: bytes as 8-bit audio, and features of the audio as fixed-shape tensors with time spans (operator 5).

A payload is stored losslessly as unsigned 8-bit mono PCM in a WAV container, in a column of Arrow files in the shared
folder. The features are computed from the bytes read back: polyphase resampling by a rational factor and overlapped
log-mel filterbank frames, stored in turn as blocks of a fixed-shape tensor column with their time spans. Segments of
energy, found with two thresholds (hysteresis), and the digests are made from both files read back.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph import runtime
from loomgraph.llm.tokens import filesystem

BLOCK = 64


def payload_of(text: str | None) -> bytes:
    """UTF-8 of the text (null: none), with bytes 0 appended up to a positive multiple of 64."""
    raw = (text or "").encode()
    return raw + bytes(max(BLOCK, -(-len(raw) // BLOCK) * BLOCK) - len(raw))


def to_wav(samples: bytes, rate: int) -> bytes:
    """Unsigned 8-bit mono PCM in a RIFF/WAVE container, padded to an even size as the format asks."""
    chunk = struct.pack("<4sIHHIIHH4sI", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples))
    body = b"WAVE" + chunk + samples + b"\0" * (len(samples) % 2)
    return struct.pack("<4sI", b"RIFF", len(body)) + body


def from_wav(wav: bytes) -> tuple[bytes, int]:
    """Samples and rate of an unsigned 8-bit mono PCM file; walks the chunks and fails on any other form."""
    if wav[:4] != b"RIFF" or wav[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at, rate = 12, None
    while at + 8 <= len(wav):
        name, size = struct.unpack_from("<4sI", wav, at)
        if name == b"fmt ":
            form, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", wav, at + 8)
            if (form, channels, bits) != (1, 1, 8):
                raise ValueError("not unsigned 8-bit mono PCM")
        elif name == b"data":
            if rate is None or at + 8 + size > len(wav):
                raise ValueError("data without a format, or cut short")
            return wav[at + 8 : at + 8 + size], rate
        at += 8 + size + size % 2
    raise ValueError("no data")


@dataclass(frozen=True)
class Analyser:
    """Parameters of the features; the default hears 8 kHz input at 6.4 kHz in 24 mel bands."""

    rate: int = 8000
    up: int = 4
    down: int = 5
    taps: int = 16  # of each phase
    window: int = 256
    hop: int = 128
    bands: int = 24
    enter_db: float = -3.0  # a segment starts above this, against the mean level
    leave_db: float = -6.0  # and goes on above this

    @cached_property
    def phases(self) -> np.ndarray:
        """The low-pass filter split into `up` phases of `taps` taps; each phase sums to one."""
        n = self.up * self.taps
        t = np.arange(n) - (n - 1) / 2
        cut = 1 / max(self.up, self.down)
        h = (np.sinc(cut * t) * np.hamming(n)).reshape(self.taps, self.up).T[:, ::-1]
        return h / h.sum(axis=1, keepdims=True)

    @cached_property
    def filters(self) -> np.ndarray:
        """Triangular mel filters [bin, band] over the power spectrum."""
        top = 2595 * np.log10(1 + self.rate * self.up / self.down / 2 / 700)
        edges = 700 * (10 ** (np.linspace(0, top, self.bands + 2) / 2595) - 1)
        f = np.fft.rfftfreq(self.window, self.down / self.up / self.rate)[:, None]
        low, mid, high = edges[:-2], edges[1:-1], edges[2:]
        return np.maximum(0, np.minimum((f - low) / (mid - low), (high - f) / (high - mid)))

    @cached_property
    def taper(self) -> np.ndarray:
        return np.hanning(self.window + 1)[:-1]

    def resampled(self, n: int) -> int:
        """How many samples n become."""
        return -(-n * self.up // self.down)

    def resample(self, samples: np.ndarray, first: int, stop: int) -> np.ndarray:
        """The samples [first, stop) at up/down times the rate, from unsigned 8-bit ones; `first` is a multiple of `up`.

        Output m is phase (m * down) % up at input (m * down) // up; beyond both ends there is silence.
        """
        low = first * self.down // self.up - self.taps + 1
        high = (stop - 1) * self.down // self.up + 1
        x = (samples[max(0, low) : high].astype(float) - 128) / 128
        x = np.pad(x, (max(0, -low), max(0, high - samples.size)))
        seen = np.lib.stride_tricks.sliding_window_view(x, self.taps)
        out = np.zeros(stop - first)
        for k in range(min(self.up, out.size)):
            n = -(-(out.size - k) // self.up)
            out[k :: self.up] = seen[k * self.down // self.up :: self.down][:n] @ self.phases[k * self.down % self.up]
        return out

    def log_mel(self, samples: bytes, at_once: int = 2048) -> np.ndarray:
        """Frames [time, band] of log power, overlapping by window - hop; the last frame is padded with silence.

        Works through strips of frames in 64-bit floats: memory beside the frames is bounded, and the last bits of sums,
        which may differ between machines, are far below what is kept.
        """
        x = np.frombuffer(samples, np.uint8)
        size = self.resampled(x.size)
        frames = max(1, 1 + -(-(size - self.window) // self.hop))
        out = np.empty((frames, self.bands), np.float32)
        for first in range(0, frames, at_once):
            stop = min(frames, first + at_once)
            begin, end = first * self.hop, (stop - 1) * self.hop + self.window
            y = np.zeros(end - begin)
            there = min(end, size) - begin
            y[:there] = self.resample(x, begin, begin + there)
            seen = np.lib.stride_tricks.sliding_window_view(y, self.window)[:: self.hop]
            spectrum = np.fft.rfft(seen * self.taper, axis=1)
            out[first:stop] = np.log((spectrum.real**2 + spectrum.imag**2) @ self.filters + 1e-6)
        return out

    def segments(self, mel: np.ndarray) -> list[tuple[int, int]]:
        """Runs of frames [start, stop) that hold the lower threshold and somewhere reach the upper one."""
        level = 10 / np.log(10) * np.logaddexp.reduce(mel.astype(np.float64), axis=1)
        level -= level.mean()
        held = np.concatenate([[False], level >= self.leave_db, [False]])
        edges = np.flatnonzero(held[1:] != held[:-1])
        loud = np.concatenate([[0], np.cumsum(level >= self.enter_db)])
        return [(int(a), int(b)) for a, b in zip(edges[::2], edges[1::2], strict=True) if loud[b] > loud[a]]

    def span(self, start: int, stop: int) -> tuple[float, float]:
        """Seconds of the frames [start, stop)."""
        second = self.rate * self.up / self.down
        return start * self.hop / second, ((stop - 1) * self.hop + self.window) / second


#: Tensors are stored in 16-bit floats: their log powers lie between -14 and 12, with an error below 0.005.
STORED = pa.float16()


def tensor_type(frames: int, bands: int) -> pa.DataType:
    return pa.fixed_shape_tensor(STORED, (frames, bands), dim_names=["time", "mel"])


def tensor_blocks(mel: np.ndarray, frames: int) -> pa.Array:
    """Log-mel frames as an Arrow fixed-shape tensor array of blocks [frames, bands]; the last block is padded with zeros."""
    blocks = -(-len(mel) // frames)
    full = np.zeros((blocks * frames, mel.shape[1]), np.float16)
    full[: len(mel)] = mel
    return pa.ExtensionArray.from_storage(tensor_type(frames, mel.shape[1]), pa.FixedSizeListArray.from_arrays(pa.array(full.ravel()), frames * mel.shape[1]))


MANIFEST = "shard int, media_uri string, tensors_uri string, n_docs long"
MEDIA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.large_binary())])


def _manifest_row(**row) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([row], pa.schema([("shard", pa.int32()), ("media_uri", pa.string()), ("tensors_uri", pa.string()), ("n_docs", pa.int64())]))


def _arrow_file(sink, schema: pa.Schema):
    return pa.ipc.new_file(sink, schema, options=pa.ipc.IpcWriteOptions(compression="zstd"))


def _batches(uri: str):
    """The record batches of an Arrow file, one at a time."""
    files, path = filesystem(uri)
    with files.open_input_file(path) as f:
        reader = pa.ipc.open_file(f)
        for k in range(reader.num_record_batches):
            yield reader.get_batch(k)


def write_media(docs: DataFrame, folder: str, analyser: Analyser = Analyser(), at_once: int = 1 << 23) -> DataFrame:
    """Store the text of each row of docs(doc_id, text) as a WAV value of the column `media` in Arrow files.

    Returns the manifest, a row for each file. Every attempt of a task writes names of its own, and only those of
    attempts that succeed reach the manifest. Null texts are empty; other columns are not read; an empty table gives
    an empty manifest. Batches hold about `at_once` bytes, and one text at least.
    """

    def write(batches):
        files, top = filesystem(folder)
        out, name, n_docs, rows, size = None, f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}", 0, [], 0

        def flush():
            ids, sizes, media = zip(*rows, strict=True)
            out.write_batch(pa.record_batch([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(media, pa.large_binary())], schema=MEDIA))
            rows.clear()

        for batch in batches:
            for d, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if out is None:
                    files.create_dir(top, recursive=True)
                    sink = files.open_output_stream(f"{top}/{name}.media.arrow")
                    out = _arrow_file(sink, MEDIA)
                payload = payload_of(text := text.as_py())
                rows.append((d, len((text or "").encode()), to_wav(payload, analyser.rate)))
                n_docs += 1
                size += len(payload)
                if size >= at_once:
                    flush()
                    size = 0
        if out is None:
            return
        if rows:
            flush()
        out.close()
        sink.close()
        yield _manifest_row(shard=TaskContext.get().partitionId(), media_uri=f"{folder}/{name}.media.arrow", tensors_uri=None, n_docs=n_docs)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return runtime.materialise(rows.mapInArrow(write, MANIFEST), "media_manifest")


def _by_shard(manifest: DataFrame) -> DataFrame:
    """One small row stands for one file: deal them out so that each is a task of its own."""
    return manifest.repartitionByRange(max(1, manifest.count()), "shard")


def write_tensors(manifest: DataFrame, folder: str, analyser: Analyser = Analyser(), frames: int = 16) -> DataFrame:
    """Read the media files of a manifest and store their log-mel frames as fixed-shape tensors [frames, bands].

    A row of a tensor file is a block: `row` (the place of its document in the media file), `block`, `n_frames` (real
    ones; the rest are zeros), `start_s` and `end_s`, and `mel`, of Arrow's fixed-shape tensor type. Every document
    has a block at least. Returns the manifest with the files' URIs.
    """
    schema = pa.schema([("row", pa.int64()), ("block", pa.int32()), ("n_frames", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64()), ("mel", tensor_type(frames, analyser.bands))])

    def write(batches):
        for given in batches:
            for shard in given.to_pylist():
                files, top = filesystem(folder)
                files.create_dir(top, recursive=True)
                name, row = f"{shard['shard']:06d}-{uuid.uuid4().hex}.tensors.arrow", 0
                with files.open_output_stream(f"{top}/{name}") as sink, _arrow_file(sink, schema) as out:
                    for batch in _batches(shard["media_uri"]):
                        mels = [analyser.log_mel(from_wav(wav.as_py())[0]) for wav in batch.column("media")]
                        tensors = [tensor_blocks(m, frames) for m in mels]
                        counts = np.array([len(t) for t in tensors])
                        owner = np.repeat(np.arange(counts.size), counts)
                        block = np.arange(owner.size) - np.repeat(np.cumsum(counts) - counts, counts)
                        real = np.minimum(frames, np.array([len(m) for m in mels])[owner] - frames * block)
                        start, end = analyser.span(frames * block, frames * block + real)
                        # All blocks of a document are in one batch.
                        out.write_batch(pa.record_batch([pa.array(row + owner), pa.array(block, pa.int32()), pa.array(real, pa.int32()), pa.array(start), pa.array(end), pa.concat_arrays(tensors)], schema=schema))
                        row += counts.size
                yield _manifest_row(**(shard | {"tensors_uri": f"{folder}/{name}"}))

    return runtime.materialise(_by_shard(manifest).mapInArrow(write, MANIFEST), "tensor_manifest")


def frames_of(batch: pa.RecordBatch) -> list[np.ndarray]:
    """The log-mel frames of each document of a batch of a tensor file."""
    row, real = batch.column("row").to_numpy(), batch.column("n_frames").to_numpy()
    mel = batch.column("mel").to_numpy_ndarray()
    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1], [True]]))
    flat = mel.reshape(-1, mel.shape[2])
    kept = np.arange(mel.shape[1])[None, :] < real[:, None]
    return [flat[a * mel.shape[1] : b * mel.shape[1]][kept[a:b].ravel()] for a, b in zip(first[:-1], first[1:], strict=True)]


DIGESTS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, n_frames long, n_segments long, feature string"


def describe_media(manifest: DataFrame, analyser: Analyser = Analyser()) -> DataFrame:
    """Sizes and digests of the stored media and features of the stored tensors, a row for each document.

    `feature` is the mean of each mel band to one decimal, then all segments as start-stop in seconds. Equal media
    give equal values.
    """
    names = [c.split()[0] for c in DIGESTS.split(", ")]

    def describe(n_bytes: int, wav: bytes, mel: np.ndarray) -> tuple:
        samples, _ = from_wav(wav)
        found = analyser.segments(mel)
        spans = " ".join("{:.3f}-{:.3f}".format(*analyser.span(*s)) for s in found)
        feature = ",".join(f"{v:.1f}" for v in mel.mean(axis=0, dtype=np.float64)) + "|" + spans
        return n_bytes, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-BLOCK:]), len(wav), hashlib.sha256(wav).hexdigest(), len(mel), len(found), feature

    def read(batches):
        for given in batches:
            for shard in given.to_pylist():
                for media, tensors in zip(_batches(shard["media_uri"]), _batches(shard["tensors_uri"]), strict=True):
                    rows = [describe(n, w.as_py(), m) for n, w, m in zip(media.column("n_bytes").to_pylist(), media.column("media"), frames_of(tensors), strict=True)]
                    kinds = [pa.string() if n in ("payload_sha256", "media_sha256", "feature") else pa.int64() for n in names[1:]]
                    yield pa.record_batch([media.column("doc_id"), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names=names)

    return _by_shard(manifest).mapInArrow(read, DIGESTS)


def audio_features(docs: DataFrame, folder: str | None = None, analyser: Analyser = Analyser()) -> DataFrame:
    """Store the text of each row of docs(doc_id, text) as audio, store its feature tensors, and describe both read back.

    A row for each input row, repeated rows and null ids included; see write_media(), write_tensors() and
    describe_media(). `folder` is where the files go, a new one in the shared folder if it is not given. Null texts
    are empty; equal texts give equal values; other columns are not read; texts are never cut.
    """
    folder = folder or runtime.fresh_path(docs.sparkSession, "media")
    return describe_media(write_tensors(write_media(docs, folder, analyser), folder, analyser), analyser)
