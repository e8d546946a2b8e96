"""Short-time spectra of sample arrays, in numpy, for kernels."""

from __future__ import annotations

from functools import lru_cache

import numpy as np


def hamming(n: int) -> np.ndarray:
    """The periodic Hamming window."""
    return 0.54 - 0.46 * np.cos(2 * np.pi * np.arange(n) / n)


def stft(x: np.ndarray, n_fft: int = 400, hop: int = 160) -> np.ndarray:
    """Complex spectra (frames, bins) of windows centred on multiples of hop, zeros beyond the ends."""
    padded = np.pad(np.asarray(x, np.float64), (n_fft // 2, n_fft // 2))
    count = 1 + (len(padded) - n_fft) // hop
    at = np.arange(n_fft)[None] + hop * np.arange(count)[:, None]
    return np.fft.rfft(padded[at] * hamming(n_fft), axis=1)


def power(spectra: np.ndarray) -> np.ndarray:
    return spectra.real**2 + spectra.imag**2


@lru_cache(maxsize=8)
def mel_filters(bins: int = 201, bands: int = 80, rate: int = 16_000, low: float = 0.0, high: float | None = None) -> np.ndarray:
    """Triangular filters (bins, bands) at equal steps of the mel scale."""
    high = rate / 2 if high is None else high
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(low), mel(high), bands + 2) / 2595) - 1)
    f = np.linspace(0, rate / 2, bins)[:, None]
    left, centre, right = edges[:-2], edges[1:-1], edges[2:]
    return np.maximum(0, np.minimum((f - left) / (centre - left), (right - f) / (right - centre)))


def log_mel(x: np.ndarray, bands: int = 80, rate: int = 16_000, n_fft: int = 400, hop: int = 160, floor: float = 1e-10) -> np.ndarray:
    """Decibels (frames, bands)."""
    spectrum = power(stft(x, n_fft, hop))
    return 10 * np.log10(np.maximum(spectrum @ mel_filters(spectrum.shape[1], bands, rate), floor))


def mean_normalise(features: np.ndarray, share: float = 1.0) -> np.ndarray:
    """Features less the mean of the first round(frames * share) of them."""
    n = max(1, int(round(len(features) * share)))
    return features - features[:n].mean(0)


def resample(x: np.ndarray, from_rate: int, to_rate: int, zeros: int = 32) -> np.ndarray:
    """Windowed-sinc conversion of the sample rate; the length is ceil(n * to / from)."""
    x = np.asarray(x, np.float64)
    if from_rate == to_rate or not len(x):
        return x.copy()
    n = -(-len(x) * to_rate // from_rate)
    cutoff = min(1.0, to_rate / from_rate)
    half = int(np.ceil(zeros / cutoff))
    out = np.empty(n)
    padded = np.pad(x, (half, half + 1))
    for s in range(0, n, 1 << 14):
        t = np.arange(s, min(n, s + (1 << 14))) * (from_rate / to_rate)
        whole = np.floor(t).astype(np.int64)
        k = np.arange(-half, half + 1)
        distance = (t - whole)[:, None] - k[None]
        kernel = cutoff * np.sinc(cutoff * distance) * np.cos(np.pi * np.clip(distance / (2 * (half + 1)), -0.5, 0.5)) ** 2
        out[s : s + len(t)] = (padded[whole[:, None] + k[None] + half] * kernel).sum(1)
    return out
