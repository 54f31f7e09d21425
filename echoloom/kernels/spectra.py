"""Envelopes, short-time spectra and their inverses, Welch spectra, peaks, wavelet packets, ridges."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

from .filters import resample_poly


def moving_average(x: np.ndarray, width: int) -> np.ndarray:
    """Centred, samples outside are zero."""
    if width <= 1:
        return x.copy()
    c = np.concatenate([np.zeros(x.shape[:-1] + (1,)), np.cumsum(x, axis=-1)], axis=-1)
    n = x.shape[-1]
    first = np.arange(n) - width // 2
    return (c[..., np.clip(first + width, 0, n)] - c[..., np.clip(first, 0, n)]) / width


def analytic(x: np.ndarray) -> np.ndarray:
    """The analytic signal: x and its quadrature as one complex signal."""
    n = x.shape[-1]
    gain = np.zeros(n)
    gain[0] = 1
    gain[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        gain[n // 2] = 1
    return np.fft.ifft(np.fft.fft(x, axis=-1) * gain, axis=-1)


def envelope(x: np.ndarray, rate: float, smooth_ms: float) -> np.ndarray:
    """Magnitude of the analytic signal, averaged over smooth_ms."""
    return moving_average(np.abs(analytic(x)), max(1, int(round(rate * smooth_ms / 1000))))


def estimate_arrival(x: np.ndarray, rate: float) -> int:
    """First sample whose energy, averaged over half a millisecond, reaches mean + 6 deviations of the signal's first part (a
    fifth of it, at most 10 ms and at least 10 samples); the strongest sample if none does."""
    e = moving_average(np.abs(analytic(np.asarray(x, float))) ** 2, max(1, int(round(rate * 0.0005))))
    base = e[: max(10, min(len(e) // 5, int(round(rate * 0.01))))]
    over = np.flatnonzero(e >= base.mean() + 6.0 * base.std())
    return int(over[0]) if len(over) else int(np.argmax(e))


@lru_cache(maxsize=64)
def hann(n: int) -> np.ndarray:
    return 0.5 - 0.5 * np.cos(2 * math.pi * np.arange(n) / n)


def frame_sizes(rate: float, window_ms: float, overlap: float, nfft: int | None) -> tuple[int, int, int]:
    """(samples, hop, transform length)."""
    size = max(16, int(round(rate * window_ms / 1000)))
    shared = min(size - 1, int(round(size * overlap)))
    return size, size - shared, nfft or 1 << math.ceil(math.log2(size))


def stft(x: np.ndarray, rate: float, window_ms: float, overlap: float, nfft: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(frequencies, times, spectrum (..., frequency, frame)); zeros at both ends, scaled by the window's sum."""
    size, hop, length = frame_sizes(rate, window_ms, overlap, nfft)
    length = max(length, size)
    wide = np.concatenate([np.zeros(x.shape[:-1] + (size // 2,)), x, np.zeros(x.shape[:-1] + (size // 2,))], axis=-1)
    wide = np.concatenate([wide, np.zeros(x.shape[:-1] + (-(wide.shape[-1] - size) % hop,))], axis=-1)
    frames = np.lib.stride_tricks.sliding_window_view(wide, size, axis=-1)[..., ::hop, :]
    w = hann(size)
    spectrum = np.fft.rfft(frames * w, n=length, axis=-1) / w.sum()
    return np.fft.rfftfreq(length, 1 / rate), np.arange(frames.shape[-2]) * hop / rate, np.swapaxes(spectrum, -1, -2)


def fast_power(x: np.ndarray, rate: float, window_ms: float = 0.64, overlap: float = 0.875) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(frequencies, times, power) of rows together: stft()'s frames under the symmetric window, squared without its scale."""
    size, hop, length = frame_sizes(rate, window_ms, overlap, None)
    wide = np.pad(x, [(0, 0)] * (x.ndim - 1) + [(size // 2, size // 2)])
    wide = np.pad(wide, [(0, 0)] * (x.ndim - 1) + [(0, -(wide.shape[-1] - size) % hop)])
    frames = np.lib.stride_tricks.sliding_window_view(wide, size, axis=-1)[..., ::hop, :]
    spectrum = np.fft.rfft(frames * np.hanning(size), n=length, axis=-1)
    power = spectrum.real**2 + spectrum.imag**2
    return np.fft.rfftfreq(length, 1 / rate), (np.arange(frames.shape[-2]) * hop - size // 2) / rate, np.swapaxes(power, -1, -2)


def istft(spectrum: np.ndarray, rate: float, window_ms: float, overlap: float, length: int) -> np.ndarray:
    """Weighted overlap-add inverse of stft(), cut or filled to the length."""
    size, hop, _ = frame_sizes(rate, window_ms, overlap, None)
    w = hann(size)
    frames = np.fft.irfft(np.swapaxes(spectrum, -1, -2), axis=-1)[..., :size] * w * w.sum()
    count = frames.shape[-2]
    out, weight = np.zeros(frames.shape[:-2] + ((count - 1) * hop + size,)), np.zeros((count - 1) * hop + size)
    for k in range(count):
        out[..., k * hop : k * hop + size] += frames[..., k, :]
        weight[k * hop : k * hop + size] += w * w
    out = (out / np.where(weight > 1e-10, weight, 1.0))[..., size // 2 :][..., :length]
    return out if out.shape[-1] == length else np.concatenate([out, np.zeros(out.shape[:-1] + (length - out.shape[-1],))], axis=-1)


def welch(x: np.ndarray, rate: float, most: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """Power spectral density: Hann segments of at most `most` samples, half overlapped, means removed."""
    size = min(most, len(x))
    hop = max(1, size - size // 2)
    w = hann(size)
    frames = np.lib.stride_tricks.sliding_window_view(x, size)[::hop]
    p = np.abs(np.fft.rfft((frames - frames.mean(axis=1, keepdims=True)) * w, axis=1)) ** 2 / (rate * (w @ w))
    p[:, 1 : (-1 if size % 2 == 0 else None)] *= 2
    return np.fft.rfftfreq(size, 1 / rate), p.mean(axis=0)


def welch_map(x: np.ndarray, rate: float, frame: int, hop: int, most: int = 2048) -> np.ndarray:
    """dB spectra of outer frames (frame, frequency), the last one partly filled."""
    rows = []
    for s in range(0, max(1, len(x) - 1), hop):
        part = np.pad(x[s : s + frame], (0, max(0, s + frame - len(x))))
        rows.append(10 * np.log10(np.maximum(welch(part, rate, most)[1], 1e-20)))
        if s + frame >= len(x):
            break
    return np.array(rows)


def find_peaks(x: np.ndarray, height: float | None = None, distance: int = 1, prominence: float | None = None) -> np.ndarray:
    """Local maxima (the middle of a plateau), then height, then distance with higher peaks first, then prominence."""
    n = len(x)
    if n < 3:
        return np.zeros(0, int)
    change = np.flatnonzero(np.diff(x) != 0)
    starts, ends = np.concatenate([[0], change + 1]), np.concatenate([change, [n - 1]])
    level = x[starts]
    top = np.flatnonzero((level[1:-1] > level[:-2]) & (level[1:-1] > level[2:])) + 1
    peaks = (starts[top] + ends[top]) // 2
    if height is not None:
        peaks = peaks[x[peaks] >= height]
    if distance > 1 and len(peaks):
        keep = np.ones(len(peaks), bool)
        for k in np.argsort(x[peaks], kind="stable")[::-1]:
            if keep[k]:
                near = np.abs(peaks - peaks[k]) < distance
                near[k] = False
                keep &= ~near
        peaks = peaks[keep]
    if prominence is not None:
        def base(p: int, side: np.ndarray) -> float:
            higher = np.flatnonzero(side > x[p])
            return side[: higher[0]].min() if len(higher) else side.min()

        peaks = np.array([p for p in peaks if x[p] - max(base(p, x[p::-1]), base(p, x[p:])) >= prominence], int)
    return peaks


#: The published low-pass decomposition taps of the Daubechies wavelet with four vanishing moments.
DB4 = np.array([-0.010597401785069032, 0.0328830116668852, 0.030841381835560764, -0.18703481171909309, -0.027983769416859854, 0.6308807679298589, 0.7148465705529157, 0.2303778133088965])


def _halve(x: np.ndarray, taps: np.ndarray) -> np.ndarray:
    """Convolution of the half-sample symmetric extension, every second value."""
    k = len(taps)
    n = len(x)
    at = np.arange(-(k - 1), n + k - 1) % (2 * n)
    wide = x[np.where(at < n, at, 2 * n - 1 - at)]
    full = np.convolve(wide, taps, mode="valid")
    return full[1::2][: (n + k - 1) // 2]


def wavelet_packet(x: np.ndarray, level: int) -> list[tuple[str, np.ndarray]]:
    """Nodes (path, coefficients) of the full packet tree at a level, in order of frequency (Gray code of the path)."""
    high = DB4[::-1] * np.where(np.arange(len(DB4)) % 2, 1.0, -1.0)
    nodes = {"": np.asarray(x, float)}
    for _ in range(level):
        nodes = {p + c: _halve(v, t) for p, v in nodes.items() for c, t in (("a", DB4), ("d", high))}
    paths = ["".join("d" if (i ^ (i >> 1)) >> b & 1 else "a" for b in range(level - 1, -1, -1)) for i in range(1 << level)]
    return [(p, nodes[p]) for p in paths]


def packet_level(rate: float, width_hz: float = 8000.0, least: int = 2, most: int = 8) -> int:
    """Depth at which a node is about width_hz wide."""
    return max(least, min(most, math.ceil(math.log2(rate / (2 * width_hz))) if rate > 2 * width_hz else least))


def packet_energies(x: np.ndarray, rate: float, band: tuple[float, float], level: int = 0) -> tuple[list[tuple[str, float]], float]:
    """Node energies at about three times the band's upper edge (4 kHz at least), and that rate."""
    from fractions import Fraction

    target = min(rate, max(4000.0, 3 * band[1]))
    if target < 0.95 * rate:
        f = Fraction(target / rate).limit_denominator(10_000)
        x, rate = resample_poly(x, f.numerator, f.denominator), rate * f.numerator / f.denominator
    return [(p, float(v @ v)) for p, v in wavelet_packet(x, level or packet_level(rate))], rate


def ridge(freqs: np.ndarray, power: np.ndarray, search: tuple[float, float], jump_hz: float, prior: np.ndarray | None = None) -> np.ndarray:
    """Best path through log power with a linear cost of frequency jumps; zeros where no bin lies in the range.

    The best predecessor of every bin comes from one running maximum up and one down the axis, so a frame costs its
    number of bins, not its square. power is (frequency, frame) or, for many windows at once, (window, frequency, frame).
    """
    if power.ndim == 2:
        return ridge(freqs, power[None], search, jump_hz, prior)[0]
    rows = np.flatnonzero((freqs >= search[0]) & (freqs <= search[1]))
    count, _, frames = power.shape
    if not len(rows) or not frames:
        return np.zeros((count, frames))
    f, unit = freqs[rows], max(jump_hz, 1.0)
    gain = np.log(power[:, rows] + 1e-12)
    if prior is not None:
        gain = gain - np.abs(f[:, None] - prior[None, :]) / unit
    gain = np.ascontiguousarray(np.moveaxis(gain, 2, 0))
    slope, index, last = f / unit, np.arange(len(f)), len(f) - 1
    best, came = gain[0].copy(), np.zeros((frames, count, len(f)), np.int32)
    fresh = np.ones((count, len(f)), bool)
    for t in range(1, frames):
        up = best + slope
        reach = np.maximum.accumulate(up, axis=1)
        np.greater(up[:, 1:], reach[:, :-1], out=fresh[:, 1:])
        below, a = np.maximum.accumulate(np.where(fresh, index, 0), axis=1), reach - slope
        down = (best - slope)[:, ::-1]
        reach = np.maximum.accumulate(down, axis=1)
        np.greater_equal(down[:, 1:], reach[:, :-1], out=fresh[:, 1:])
        above, b = last - np.maximum.accumulate(np.where(fresh, index, 0), axis=1)[:, ::-1], reach[:, ::-1] + slope
        np.copyto(came[t], np.where(a >= b, below, above))
        best = gain[t] + np.maximum(a, b)
    path, each = np.empty((count, frames), int), np.arange(count)
    path[:, -1] = best.argmax(axis=1)
    for t in range(frames - 1, 0, -1):
        path[:, t - 1] = came[t, each, path[:, t]]
    return f[path]


def harmonic_sum_ridge(freqs: np.ndarray, power: np.ndarray, search: tuple[float, float], jump_hz: float, weights: tuple[float, ...] = (1.0, 1.35, 0.55)) -> np.ndarray:
    """Ridge of the weighted log power at a frequency and its multiples."""
    logp = np.log(power + 1e-12)
    score = np.zeros_like(logp)
    for k, w in enumerate(weights, 1):
        nearest = np.clip(np.searchsorted((freqs[1:] + freqs[:-1]) / 2, k * freqs), 0, len(freqs) - 1)
        score += w * np.where((k * freqs <= freqs[-1])[:, None], logp[nearest], logp.min())
    return ridge(freqs, np.exp(np.clip(score, -700, 700)), search, jump_hz)


def track_harmonic(freqs: np.ndarray, times: np.ndarray, power: np.ndarray, f0: np.ndarray, k: int, least: float, jump_hz: float, relative: float = 0.08) -> dict:
    """The k-th multiple of a ridge: its track, which frames hold it, and total and longest duration."""
    step = freqs[1] - freqs[0]
    track = ridge(freqs, power, (float(freqs[0]), float(freqs[-1])), jump_hz, prior=k * f0)
    at, base = np.searchsorted(freqs, track), np.searchsorted(freqs, f0)
    frames = np.arange(len(times))
    share = power[np.clip(at, 0, len(freqs) - 1), frames] / (power[np.clip(base, 0, len(freqs) - 1), frames] + 1e-12)
    valid = (np.abs(track - k * f0) <= np.maximum(2 * step, relative * k * f0)) & (share >= least)
    hop = float(np.median(np.diff(times))) if len(times) > 1 else 0.0
    edges = np.flatnonzero(np.diff(np.concatenate([[0], valid.astype(int), [0]])))
    runs = edges[1::2] - edges[::2]
    return {"track": track, "valid": valid, "total_s": float(valid.sum() * hop), "longest_s": float(runs.max() * hop) if len(runs) else 0.0, "median_share": float(np.median(share))}
