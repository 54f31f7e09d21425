"""Arrival-time differences over channels and source location by hyperbolas."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np


def correlations(data: np.ndarray, reference: int, method: str) -> tuple[np.ndarray, np.ndarray]:
    """(lags, correlations): a column a channel, all against the reference channel by one transform; phase transform
    (gcc_phat), plain (fft_xcorr) or normalised by both norms (ncc)."""
    m = len(data)
    spectrum = np.fft.rfft(data, 2 * m, axis=0)
    cross = spectrum * np.conj(spectrum[:, [reference]])
    if method == "gcc_phat":
        lags, scale = np.arange(-m, m), np.ones(data.shape[1])
        cross /= np.maximum(np.abs(cross), 1e-12)
    elif method in ("fft_xcorr", "ncc"):
        norms = np.linalg.norm(data, axis=0)
        lags, scale = np.arange(1 - m, m), norms * norms[reference] + 1e-12 if method == "ncc" else np.ones(data.shape[1])
    else:
        raise ValueError(f"unknown method: {method}")
    return lags, np.fft.irfft(cross, 2 * m, axis=0)[lags % (2 * m)] / scale


def estimate_delays(data: np.ndarray, rate: float, reference: int, method: str = "gcc_phat", max_tau: float | None = None, least_psr: float = 6.0, guard: int = 3) -> dict[str, np.ndarray]:
    """Delay, peak and peak-to-sidelobe ratio of every channel (column) against the reference channel.

    Each column's greatest magnitude within the physical lags, moved to the top of the parabola through its neighbours;
    sidelobes are the lags more than `guard` away from it.
    """
    lags, found = correlations(data, reference, method)
    physical = slice(None) if max_tau is None else np.abs(lags) <= int(max_tau * rate)
    lags, size = lags[physical], np.abs(found[physical])
    top = size.argmax(axis=0)
    columns = np.arange(size.shape[1])
    peak = size[top, columns]
    before, after = size[np.maximum(top - 1, 0), columns], size[np.minimum(top + 1, len(size) - 1), columns]
    bend = before - 2 * peak + after
    curved = (top > 0) & (top < len(size) - 1) & (np.abs(bend) > 1e-12)
    shift = np.where(curved, 0.5 * (before - after) / np.where(curved, bend, 1.0), 0.0)
    aside = np.abs(np.arange(len(size))[:, None] - top) > guard
    count = aside.sum(axis=0)
    psr = np.where(count > 0, (peak + 1e-12) / ((size * aside).sum(axis=0) / np.maximum(count, 1) + 1e-12), 0.0)
    own = columns == reference
    return {"delay": np.where(own, 0.0, (lags[top] + shift) / rate), "psr": psr, "peak": peak, "valid": own | (psr >= least_psr)}


def snr_proxy(data: np.ndarray) -> np.ndarray:
    p = data**2
    q = np.quantile(p, [0.2, 0.8], axis=0)
    return q[1] / (q[0] + 1e-12)


def hyperbola(x: np.ndarray, xs: float, z: float, v: float, xr: float) -> np.ndarray:
    return (np.hypot(x - xs, z) - math.hypot(xr - xs, z)) / v


@lru_cache(maxsize=16)
def _grid(x: tuple[float, ...], xr: float, v: float, xb: tuple[float, float], zb: tuple[float, float], nx: int, nz: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sources of a grid and the delays they give at the channels: the same for all windows with the same channels."""
    gx, gz = (g.ravel() for g in np.meshgrid(np.linspace(*xb, nx), np.linspace(*zb, nz), indexing="ij"))
    return gx, gz, (np.hypot(np.array(x) - gx[:, None], gz[:, None]) - np.hypot(xr - gx, gz)[:, None]) / v


def coarse_start(x, t, xr, v, xb, zb, nx: int = 120, nz: int = 80) -> tuple[float, float]:
    """Best of a grid of sources, all at once."""
    gx, gz, pred = _grid(tuple(map(float, x)), float(xr), v, tuple(xb), tuple(zb), nx, nz)
    k = int(np.argmin(((pred - t) ** 2).mean(axis=-1)))
    return float(gx[k]), float(gz[k])


def _weights(r: np.ndarray, loss: str) -> np.ndarray:
    """Derivatives of the losses by the squared residual, for reweighted steps."""
    s = r * r
    if loss == "linear":
        return np.ones_like(r)
    if loss == "huber":
        return np.where(s <= 1, 1.0, 1 / np.sqrt(np.maximum(s, 1e-300)))
    if loss == "soft_l1":
        return 1 / np.sqrt(1 + s)
    if loss == "cauchy":
        return 1 / (1 + s)
    raise ValueError(f"unknown loss: {loss}")


def _losses(r: np.ndarray, loss: str) -> float:
    """The loss whose derivatives _weights() gives."""
    s = r * r
    if loss == "linear":
        return float(s.sum())
    if loss == "huber":
        return float(np.where(s <= 1, s, 2 * np.sqrt(s) - 1).sum())
    return float((2 * np.sqrt(1 + s) - 2).sum() if loss == "soft_l1" else np.log1p(s).sum())


def fit_hyperbola(x, t, xr, v, xb, zb, loss: str = "linear", start: tuple[float, float] | None = None, steps: int = 100) -> dict:
    """Bounded damped least squares of (xs, z) from the best grid point; bounds hold by clipping each step."""
    p = np.array(start or coarse_start(x, t, xr, v, xb, zb))
    low, high = np.array([xb[0], zb[0]]), np.array([xb[1], zb[1]])

    def cost(q):
        r = hyperbola(x, q[0], q[1], v, xr) - t
        return r, _losses(r, loss)

    r, now = cost(p)
    damp, done = 1e-3, False
    for _ in range(steps):
        dx, dr = np.hypot(x - p[0], p[1]), math.hypot(xr - p[0], p[1])
        jac = np.column_stack([(-(x - p[0]) / np.maximum(dx, 1e-12) + (xr - p[0]) / max(dr, 1e-12)) / v, (p[1] / np.maximum(dx, 1e-12) - p[1] / max(dr, 1e-12)) / v])
        w = _weights(r, loss)
        a, g = jac.T @ (w[:, None] * jac), jac.T @ (w * r)
        for _ in range(12):
            step = np.linalg.lstsq(a + damp * np.diag(np.maximum(np.diag(a), 1e-30)), -g, rcond=None)[0]
            q = np.clip(p + step, low, high)
            r2, then = cost(q)
            if then <= now:
                damp = max(damp / 5, 1e-12)
                break
            damp *= 5
        else:
            done = True
            break
        moved = np.abs(q - p).max()
        p, r, now = q, r2, then
        if moved < 1e-9 * (1 + np.abs(p).max()):
            done = True
            break
    pred = hyperbola(x, p[0], p[1], v, xr)
    return {"model": "hyperbola", "xs": float(p[0]), "z": float(p[1]), "rmse": float(np.sqrt(((pred - t) ** 2).mean())), "success": done, "loss": loss}


def consensus(x, t, xr, v, xb, zb, rounds: int, limit: float, seed: int, grid: tuple[int, int] = (120, 80), steps: int = 20) -> np.ndarray:
    """The channels that agree, within `limit`, with the source that most channels agree with, among the sources of
    `rounds` random samples of four channels. All samples go through the grid and the damped steps together."""
    picks = np.argsort(np.random.default_rng(seed).random((rounds, len(x))), axis=1)[:, :4]
    gx, gz, pred = _grid(tuple(map(float, x)), float(xr), v, tuple(xb), tuple(zb), *grid)
    # a channel's misfits lie together, and a sample's are added in place
    off, total = np.ascontiguousarray(((pred - t) ** 2).T), np.empty(len(gx))

    def nearest(pick: np.ndarray) -> int:
        np.add(off[pick[0]], off[pick[1]], out=total)
        for k in pick[2:]:
            np.add(total, off[k], out=total)
        return int(total.argmin())

    start = np.array([nearest(pick) for pick in picks])
    place = np.column_stack([gx[start], gz[start]])
    low, high = np.array([xb[0], zb[0]]), np.array([xb[1], zb[1]])
    px, pt = x[picks], t[picks]

    def misfit(at: np.ndarray, cx: np.ndarray, ct: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Residuals of every sample's source at its channels, and the distances to the channels and to the reference."""
        far, near = np.hypot(cx - at[:, :1], at[:, 1:]), np.hypot(xr - at[:, :1], at[:, 1:])
        return (far - near) / v - ct, np.maximum(far, 1e-12), np.maximum(near, 1e-12)

    damp = np.full(rounds, 1e-3)
    r, far, near = misfit(place, px, pt)
    for _ in range(steps):
        slope = np.stack([(place[:, :1] - px) / far - (place[:, :1] - xr) / near, place[:, 1:] / far - place[:, 1:] / near], axis=2) / v
        normal = np.einsum("rci,rcj->rij", slope, slope)
        diagonal = np.maximum(np.einsum("rii->ri", normal), 1e-30)
        normal = normal + np.einsum("ri,ij->rij", (damp[:, None] + 1e-9) * diagonal, np.eye(2))
        move = np.linalg.solve(normal, -np.einsum("rci,rc->ri", slope, r)[..., None])[..., 0]
        tried = np.clip(place + move, low, high)
        there = misfit(tried, px, pt)
        better = (there[0] ** 2).sum(axis=1) <= (r**2).sum(axis=1)
        place, r, far, near = (np.where(better[:, None], a, b) for a, b in zip((tried, *there), (place, r, far, near), strict=True))
        damp = np.where(better, np.maximum(damp / 5, 1e-12), damp * 5)
    r = np.abs(misfit(place, x[None, :], t[None, :])[0])
    agree = r <= limit
    # among equal votes, the smaller misfit of those who agree
    best = np.lexsort(((r * agree).sum(axis=1), -agree.sum(axis=1)))[0]
    return agree[best]


def fit_consensus(x, t, xr, v, xb, zb, rounds: int = 200, limit: float = 8e-4, loss: str = "linear", seed: int = 97) -> dict:
    """The hyperbola through the channels that agree; through all of them where fewer than four do."""
    agree = consensus(x, t, xr, v, xb, zb, rounds, limit, seed) if len(x) >= 4 else np.zeros(len(x), bool)
    enough = int(agree.sum()) >= 4
    used = agree if enough else np.ones(len(x), bool)
    return {**fit_hyperbola(x[used], t[used], xr, v, xb, zb, loss), "used_ransac": enough, "inliers": int(used.sum())}


def fit_parabola(x: np.ndarray, t: np.ndarray) -> dict:
    c = np.polyfit(x, t, 2)
    return {"model": "parabola", "coef": c, "rmse": float(np.sqrt(((np.polyval(c, x) - t) ** 2).mean()))}
