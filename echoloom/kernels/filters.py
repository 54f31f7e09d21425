"""Butterworth design, zero-phase filtering and resampling.

A second-order section runs as a block state-space system: the samples of a block come from two matrix products, the
states of a group of blocks from two more, and only the two-number state passes from group to group.
"""

from __future__ import annotations

import math
from fractions import Fraction
from functools import lru_cache

import numpy as np

BLOCK = 64


def butterworth_sos(order: int, edges: tuple[float, ...], kind: str) -> np.ndarray:
    """Digital sections (n, 6) by the bilinear transform; edges are fractions of the Nyquist frequency."""
    k = np.arange(1, order + 1)
    poles = np.exp(1j * math.pi * (2 * k + order - 1) / (2 * order))
    warped = 4 * np.tan(math.pi * np.asarray(edges, float) / 2)  # rate 2, so z = (4 + s) / (4 - s)
    if kind == "lowpass":
        p, z, gain = warped[0] * poles, np.zeros(0, complex), warped[0] ** order
    elif kind == "highpass":
        p, z, gain = warped[0] / poles, np.zeros(order, complex), float(np.real(1 / np.prod(-poles)))
    else:
        width, centre = warped[1] - warped[0], math.sqrt(warped[0] * warped[1])
        half = poles * width / 2
        root = np.sqrt(half**2 - centre**2)
        p, z, gain = np.concatenate([half + root, half - root]), np.zeros(order, complex), width**order
    gain *= float(np.real(np.prod(4 - z) / np.prod(4 - p)))
    zeros = np.concatenate([(4 + z) / (4 - z), -np.ones(len(p) - len(z))])
    return _sections(zeros, (4 + p) / (4 - p), gain)


def _sections(zeros: np.ndarray, poles: np.ndarray, gain: float) -> np.ndarray:
    """Pairs conjugate poles with the nearest zeros, the pair closest to the unit circle last; the gain goes first."""
    upper = [p for p in poles if p.imag > 1e-12]
    real = sorted((p.real for p in poles if abs(p.imag) <= 1e-12), key=abs)
    pairs = [(p, p.conjugate()) for p in upper] + [tuple(real[i : i + 2]) for i in range(0, len(real), 2)]
    pairs.sort(key=lambda q: abs(abs(q[0]) - 1), reverse=False)
    left = [z.real for z in zeros]
    rows = []
    for q in pairs:
        take = []
        for _ in range(len(q)):
            j = min(range(len(left)), key=lambda i: abs(left[i] - q[0]))
            take.append(left.pop(j))
        b, a = np.poly(take).real, np.poly(q).real
        rows.append(np.concatenate([np.pad(b, (0, 3 - len(b))), np.pad(a, (0, 3 - len(a)))]))
    rows.reverse()
    out = np.array(rows)
    out[0, :3] *= gain
    return out


@lru_cache(maxsize=256)
def _block_system(section: tuple[float, ...]) -> tuple[np.ndarray, ...]:
    """Matrices of one section over a block: state -> output, input -> output (Toeplitz), input -> next state; and over
    BLOCK blocks: first state -> all states, what the blocks push -> all states. The last states belong to the next group."""
    b0, b1, b2, _, a1, a2 = section
    step, drive = np.array([[-a1, 1.0], [-a2, 0.0]]), np.array([b1 - a1 * b0, b2 - a2 * b0])
    powers = [np.eye(2)]
    for _ in range(BLOCK):
        powers.append(step @ powers[-1])
    see = np.array([p[0] for p in powers[:BLOCK]])
    impulse = np.concatenate([[b0], [p[0] @ drive for p in powers[: BLOCK - 1]]])
    lag = np.arange(BLOCK)[:, None] - np.arange(BLOCK)[None, :]
    toeplitz = np.where(lag >= 0, impulse[np.maximum(lag, 0)], 0.0)
    reach = np.stack([powers[BLOCK - 1 - i] @ drive for i in range(BLOCK)], axis=1)
    hops = [np.eye(2)]
    for _ in range(BLOCK):
        hops.append(powers[BLOCK] @ hops[-1])
    carry = np.concatenate(hops)
    spread = np.zeros((2 * (BLOCK + 1), 2 * BLOCK))
    for k in range(1, BLOCK + 1):
        for j in range(k):
            spread[2 * k : 2 * k + 2, 2 * j : 2 * j + 2] = hops[k - 1 - j]
    return see, toeplitz, reach, carry, spread


def _run_section(section: np.ndarray, x: np.ndarray, state: np.ndarray) -> np.ndarray:
    """x (rows, n), state (rows, 2) -> filtered rows."""
    rows, n = x.shape
    see, toeplitz, reach, carry, spread = _block_system(tuple(section))
    groups = -(-n // (BLOCK * BLOCK))
    blocks = np.pad(x, ((0, 0), (0, groups * BLOCK * BLOCK - n))).reshape(rows, groups * BLOCK, BLOCK)
    pushed = (blocks @ reach.T).reshape(rows, groups, 2 * BLOCK)
    own = pushed @ spread.T
    states = np.empty((rows, groups, 2 * (BLOCK + 1)))
    for k in range(groups):
        states[:, k] = own[:, k] + state @ carry.T
        state = states[:, k, -2:]
    before = states[:, :, :-2].reshape(rows, groups * BLOCK, 2)
    return (blocks @ toeplitz.T + before @ see.T).reshape(rows, -1)[:, :n]


def _steady_state(sos: np.ndarray) -> np.ndarray:
    """Section states that a constant input of one settles to."""
    out, level = [], 1.0
    for b0, b1, b2, _, a1, a2 in sos:
        gain = (b0 + b1 + b2) / (1 + a1 + a2)
        s2 = b2 - a2 * gain
        out.append([level * (b1 - a1 * gain + s2), level * s2])
        level *= gain
    return np.array(out)


def sosfilt(sos: np.ndarray, x: np.ndarray, initial: np.ndarray | None = None) -> np.ndarray:
    for k, section in enumerate(sos):
        state = np.zeros((len(x), 2)) if initial is None else initial[k]
        x = _run_section(section, x, state)
    return x


def sosfiltfilt(sos: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Forward and backward over an odd extension, each pass from the steady state of its first sample."""
    x = np.atleast_2d(np.asarray(x, float))
    taps = 2 * len(sos) + 1 - min(int((sos[:, 2] == 0).sum()), int((sos[:, 5] == 0).sum()))
    edge = min(3 * taps, x.shape[1] - 1)
    head, tail = 2 * x[:, :1] - x[:, edge:0:-1], 2 * x[:, -1:] - x[:, -2 : -edge - 2 : -1]
    wide = np.concatenate([head, x, tail], axis=1)
    rest = _steady_state(sos)
    for _ in range(2):
        wide = sosfilt(sos, wide, [r[None, :] * wide[:, :1] for r in rest])[:, ::-1]
    return wide[:, edge : wide.shape[1] - edge]


@lru_cache(maxsize=128)
def _band_sos(low: float, high: float, order: int) -> np.ndarray:
    if low <= 0:
        return butterworth_sos(order, (high,), "lowpass")
    if high >= 0.999:
        return butterworth_sos(order, (low,), "highpass")
    return butterworth_sos(order, (low, high), "bandpass")


def band_filter(x: np.ndarray, rate: float, band: tuple[float, float], order: int = 4) -> np.ndarray:
    """Zero-phase band of rows; the upper edge stops at 0.999 Nyquist, a lower edge of 0 makes a low-pass."""
    nyquist = rate / 2
    low, high = max(0.0, band[0]) / nyquist, min(band[1], 0.999 * nyquist) / nyquist
    one = np.ndim(x) == 1
    out = sosfiltfilt(_band_sos(low, high, order), x)
    return out[0] if one else out


@lru_cache(maxsize=128)
def reach(rate: float, band: tuple[float, float], order: int = 4) -> int:
    """Samples after which what band_filter() remembers has fallen below 1e-16: from the pole nearest to the circle."""
    nyquist = rate / 2
    low, high = max(0.0, band[0]) / nyquist, min(band[1], 0.999 * nyquist) / nyquist
    slowest = max(float(np.abs(np.roots(s[3:])).max()) for s in _band_sos(low, high, order))
    return math.ceil(math.log(1e-16) / math.log(min(slowest, 1 - 1e-9)))


def high_pass(x: np.ndarray, rate: float, edge: float, order: int = 2) -> np.ndarray:
    if not 0 < edge < rate / 2:
        raise ValueError("the edge must lie between 0 and half the rate")
    one = np.ndim(x) == 1
    out = sosfiltfilt(butterworth_sos(order, (2 * edge / rate,), "highpass"), x)
    return out[0] if one else out


def detrend(x: np.ndarray) -> np.ndarray:
    n = x.shape[-1]
    t = np.arange(n) - (n - 1) / 2
    c = x - x.mean(axis=-1, keepdims=True)
    return c - (c @ t / max(float(t @ t), 1e-300))[..., None] * t


def quality_band(x: np.ndarray, rate: float, band: tuple[float, float] = (5_000.0, 100_000.0)) -> np.ndarray:
    """Detrended band for quality measures; without room for the band, only detrended."""
    d = detrend(np.asarray(x, float))
    high = min(band[1], 0.49 * rate)
    return band_filter(d, rate, (band[0], high)) if high > band[0] and d.shape[-1] > 33 else d


def _low_pass_taps(up: int, down: int) -> np.ndarray:
    """Windowed sinc with a Kaiser window of 5, cut at the lower of both rates, gain `up`."""
    most = max(up, down)
    half = 10 * most
    m = np.arange(-half, half + 1)
    h = np.sinc(m / most) / most * np.kaiser(2 * half + 1, 5.0)
    return up * h / h.sum()


@lru_cache(maxsize=16)
def _gather_plan(n: int, up: int, down: int, most: int = 2_000_000) -> tuple[np.ndarray, np.ndarray] | None:
    """Which samples and taps make each output, for windows of one length; None where the table would be large."""
    h = _low_pass_taps(up, down)
    n_out, count = -(-n * up // down), -(-len(h) // up)
    if n_out * count > most:
        return None
    at = np.arange(n_out) * down + (len(h) - 1) // 2
    tap, source = (at % up)[:, None] + np.arange(count) * up, (at // up)[:, None] - np.arange(count)
    ok = (tap < len(h)) & (source >= 0) & (source < n)
    return np.where(ok, source, n), np.where(ok, h[np.minimum(tap, len(h) - 1)], 0.0)


def resample_poly(x: np.ndarray, up: int, down: int) -> np.ndarray:
    """Rational resampling: each output is the sum over the taps of its phase only."""
    g = math.gcd(up, down)
    up, down = up // g, down // g
    x = np.asarray(x, float)
    if up == down:
        return x.copy()
    if x.ndim == 1 and (plan := _gather_plan(len(x), up, down)) is not None:
        at, taps = plan
        return np.einsum("ij,ij->i", np.concatenate([x, [0.0]])[at], taps)
    h = _low_pass_taps(up, down)
    centre = (len(h) - 1) // 2
    n_out = -(-x.shape[-1] * up // down)
    at = np.arange(n_out) * down + centre
    phase, newest = at % up, at // up
    out = np.zeros(x.shape[:-1] + (n_out,))
    for k in range(-(-len(h) // up)):
        tap, source = phase + k * up, newest - k
        ok = (tap < len(h)) & (source >= 0) & (source < x.shape[-1])
        out[..., ok] += h[tap[ok]] * x[..., source[ok]]
    return out


def resample_to(x: np.ndarray, rate: float, target: float) -> tuple[np.ndarray, str]:
    """Equal: as it is; down: detrended, polyphase; up: linear interpolation. Returns the action too."""
    if abs(rate - target) < 1e-9:
        return np.asarray(x, float), "none"
    if target < rate:
        f = Fraction(target / rate).limit_denominator(2000)
        return resample_poly(detrend(np.asarray(x, float)), f.numerator, f.denominator), "downsample"
    n = int(round(len(x) * target / rate))
    return np.interp(np.clip(np.arange(n) / target, 0, (len(x) - 1) / rate), np.arange(len(x)) / rate, x), "upsample"


def upsample_to(x: np.ndarray, rate: float, target: float = 500_000.0) -> tuple[np.ndarray, float]:
    if rate >= target:
        return np.asarray(x, float), rate
    g = math.gcd(int(round(target)), int(round(rate)))
    return resample_poly(x, int(round(target)) // g, int(round(rate)) // g), target
