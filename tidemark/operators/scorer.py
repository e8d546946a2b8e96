"""Pluggable models: samples to activity scores, and masked samples to vectors."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.config import Chunks
from tidemark.functions.spectral import log_mel, mean_normalise, power, stft


class Segmenter(Protocol):
    """Scores (batch, frames, classes) of waveforms (batch, samples)."""

    def __call__(self, waves: np.ndarray) -> np.ndarray: ...


class Embedder(Protocol):
    """Vectors (batch, dims) of waveforms (batch, samples) and their used share (batch)."""

    def __call__(self, waves: np.ndarray, lengths: np.ndarray) -> np.ndarray: ...


class BandSegmenter:
    """A stub: the energy of each frame in equal frequency bands, squashed to 0..1."""

    def __init__(self, frames: int = 293, classes: int = 3, gain: float = 50.0) -> None:
        self.frames, self.classes, self.gain = frames, classes, gain

    def __call__(self, waves: np.ndarray) -> np.ndarray:
        out = np.zeros((len(waves), self.frames, self.classes))
        for i, x in enumerate(waves):
            spectrum = power(stft(x))[:, 1:]
            bands = np.stack([b.sum(1) for b in np.array_split(spectrum[:, : len(spectrum[0]) // 4], self.classes, axis=1)], 1) / 400
            at = np.minimum(np.arange(self.frames) * len(bands) // self.frames, len(bands) - 1)
            out[i] = 1 - np.exp(-self.gain * bands[at] / 10)
        return out


class SpectrumEmbedder:
    """A stub: the unit mean log-mel spectrum of the used part."""

    def __init__(self, bands: int = 40) -> None:
        self.bands = bands

    def __call__(self, waves: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        out = np.zeros((len(waves), self.bands))
        for i, (x, share) in enumerate(zip(waves, lengths)):
            features = log_mel(x[: max(1, int(round(share * len(x))))], self.bands)
            v = features.mean(0) - features.mean()
            out[i] = v / max(np.linalg.norm(v), 1e-12)
        return out


class OnnxSegmenter:
    """An ONNX network from waveforms (B, 1, samples) to scores (B, frames, classes)."""

    def __init__(self, path: str) -> None:
        self.path, self._session = path, None

    def session(self):
        if self._session is None:
            import onnxruntime

            options = onnxruntime.SessionOptions()
            options.intra_op_num_threads = 1
            wanted = [p for p in ("CUDAExecutionProvider", "CPUExecutionProvider") if p in onnxruntime.get_available_providers()]
            self._session = onnxruntime.InferenceSession(self.path, options, providers=wanted)
        return self._session

    def __getstate__(self) -> dict:
        return {"path": self.path, "_session": None}

    def __call__(self, waves: np.ndarray) -> np.ndarray:
        session = self.session()
        return session.run(None, {session.get_inputs()[0].name: waves[:, None].astype(np.float32)})[0].astype(np.float64)


class OnnxEmbedder(OnnxSegmenter):
    """An ONNX network from spectra (B, frames, bins, 2) and used shares to vectors."""

    def __call__(self, waves: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        session = self.session()
        spectra = np.stack([stft(x) for x in waves])
        feed = np.stack([spectra.real, spectra.imag], -1).astype(np.float32)
        names = [i.name for i in session.get_inputs()]
        return session.run(None, {names[0]: feed, names[1]: lengths.astype(np.float32)})[0].astype(np.float64).reshape(len(waves), -1)


def score_chunks(chunks: DataFrame, model: Segmenter, shape: Chunks, batch: int = 32) -> DataFrame:
    """``file_id, chunk_idx, frames array<array<double>>``: samples are padded to the
    window for the model; frames beyond the end of a short chunk are silent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in batches:
            for at in range(0, got.num_rows, batch):
                part = got.slice(at, batch)
                waves = [np.asarray(x.values.to_numpy(zero_copy_only=False), np.float32) for x in part.column("samples")]
                padded = np.stack([np.pad(x, (0, shape.window - len(x))) for x in waves])
                scores = np.asarray(model(padded), np.float64)
                for i, x in enumerate(waves):
                    scores[i, -(-len(x) * shape.frames // shape.window) :] = 0
                inner = pa.ListArray.from_arrays(pa.array(np.arange(0, scores.size + 1, shape.classes, dtype=np.int32)), pa.array(scores.reshape(-1)))
                frames = pa.ListArray.from_arrays(pa.array(np.arange(0, len(inner) + 1, shape.frames, dtype=np.int32)), inner)
                yield pa.RecordBatch.from_arrays([part.column("file_id"), part.column("chunk_idx"), frames], names=["file_id", "chunk_idx", "frames"])

    return chunks.select("file_id", "chunk_idx", "samples").mapInArrow(run, "file_id string, chunk_idx int, frames array<array<double>>")


def embed_chunks(masked: DataFrame, model: Embedder, shape: Chunks, min_samples: int = 640, batch32: bool = False) -> DataFrame:
    """``file_id, chunk_idx, spk, v``: a vector for each class of a chunk from the samples
    under its mask, NULL under ``min_samples``.

    masked: ``file_id, chunk_idx, samples, masks array<array<int>>`` (class, frame).
    Used shares are relative to the own length; with ``batch32`` to the longest of the
    chunk's batch of 32 classes in the order of arrival.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in batches:
            keys, waves, active = [], [], []
            for f, c, x, masks in zip(got.column("file_id"), got.column("chunk_idx"), got.column("samples"), got.column("masks")):
                x = np.pad(np.asarray(x.values.to_numpy(zero_copy_only=False), np.float32), (0, shape.window))[: shape.window]
                for spk, mask in enumerate(masks.as_py()):
                    m = np.asarray(mask)[np.arange(shape.window) * len(mask) // shape.window] > 0.5
                    kept = x[m]
                    keys.append((f.as_py(), c.as_py(), spk))
                    waves.append(np.pad(kept, (0, shape.window - len(kept))))
                    active.append(len(kept))
            vectors: list = [None] * len(keys)
            for s in range(0, len(keys), 32):
                use = [i for i in range(s, min(len(keys), s + 32)) if active[i] >= min_samples]
                if use:
                    longest = max(active[i] for i in use)
                    shares = np.array([active[i] / longest if batch32 else active[i] / shape.window for i in use])
                    for i, v in zip(use, model(np.stack([waves[i] for i in use]), shares)):
                        vectors[i] = v
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([k[2] for k in keys], pa.int32()), pa.array([None if v is None else v.tolist() for v in vectors], pa.list_(pa.float64()))], names=["file_id", "chunk_idx", "spk", "v"])

    return masked.select("file_id", "chunk_idx", "samples", "masks").mapInArrow(run, "file_id string, chunk_idx int, spk int, v array<double>")


def normalised_features(x: np.ndarray, share: float = 1.0) -> np.ndarray:
    """Log-mel features less their mean over the used share."""
    return mean_normalise(log_mel(x), share)
