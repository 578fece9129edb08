"""Signal filters on numpy arrays: second-order Butterworth, causal and zero-phase, median, STFT."""

from __future__ import annotations

import math

import numpy as np


def butterworth(cutoff: float, rate: float) -> tuple[np.ndarray, np.ndarray] | None:
    """(b, a) of a second-order low-pass by the bilinear transform; None if it would do nothing."""
    if cutoff <= 0 or cutoff >= rate / 2:
        return None
    w = math.tan(math.pi * cutoff / rate)
    scale = 1 + math.sqrt(2) * w + w * w
    b = w * w / scale
    return np.array([b, 2 * b, b]), np.array([1.0, 2 * (w * w - 1) / scale, (1 - math.sqrt(2) * w + w * w) / scale])


def biquad(x: np.ndarray, b: np.ndarray, a: np.ndarray, state: tuple[float, float] = (0.0, 0.0)) -> np.ndarray:
    """Transposed direct form II."""
    z1, z2 = state
    out = np.empty(len(x))
    for i, v in enumerate(x.tolist()):
        y = b[0] * v + z1
        z1, z2 = b[1] * v - a[1] * y + z2, b[2] * v - a[2] * y
        out[i] = y
    return out


def steady_state(b: np.ndarray, a: np.ndarray) -> tuple[float, float]:
    """State in which a constant 1 comes out as its gain."""
    gain = b.sum() / a.sum()
    z2 = b[2] - a[2] * gain
    return b[1] - a[1] * gain + z2, z2


def lowpass(x: np.ndarray, cutoff: float, rate: float, both: bool = True) -> np.ndarray:
    """Low-pass; with ``both`` forward and backward over oddly extended ends, so without phase."""
    x = np.nan_to_num(np.asarray(x, float))
    made = butterworth(cutoff, rate)
    if made is None or not len(x):
        return x
    b, a = made
    if not both:
        return biquad(x, b, a)
    pad = min(9, len(x) - 1)
    wide = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    z = steady_state(b, a)
    forward = biquad(wide, b, a, (z[0] * wide[0], z[1] * wide[0]))[::-1]
    back = biquad(forward, b, a, (z[0] * forward[0], z[1] * forward[0]))[::-1]
    return back[pad : len(back) - pad] if pad else back


def stft_bands(x: np.ndarray, rate: float, hop: int = 16, bands: tuple[tuple[float, float], ...] = ((0, 2), (2, 30), (30, 2000))) -> np.ndarray:
    """Magnitudes by (window, band) with Blackman windows of about a second's rows."""
    n = max(round(rate), 64)
    if len(x) < n:
        return np.zeros((0, len(bands)))
    frames = np.lib.stride_tricks.sliding_window_view(np.asarray(x, np.float32), n)[::hop] * np.blackman(n)
    f = np.abs(np.fft.fft(frames, axis=1))
    folded = f[:, : n // 2] + f[:, ::-1][:, : n // 2]
    hz = np.arange(n // 2) * rate / n
    return np.stack([folded[:, (hz >= lo) & (hz < hi)].sum(axis=1) for lo, hi in bands], axis=1)


def sync_rank(bands: np.ndarray) -> np.ndarray:
    """How well a window serves to synchronise: middle frequencies, with too much of the others damping it."""
    if not len(bands):
        return np.zeros(0)
    low, mid, high = bands.T
    damp_high = 1 + 0.003 * np.maximum(0, high - 450)
    rank = (low + mid) / damp_high if mid.max() < 50 else mid / damp_high / (1 + 0.003 * np.maximum(0, low - 650))
    return np.where(rank < 50, 0, rank)
