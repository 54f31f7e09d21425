"""Kernels against closed forms, naive recursions and invariants."""

import math

import numpy as np
import pytest

from echoloom.kernels import arrays, features, filters, spectra
from echoloom.operators.windows import window_ranges

RATE = 200_000.0


def two_tone(rate=RATE, seconds=0.02):
    t = np.arange(int(rate * seconds)) / rate
    return (np.sin(2 * math.pi * 6000 * t) + 0.3 * np.sin(2 * math.pi * 12000 * t + 0.7)) * np.exp(-np.maximum(t - 0.004, 0) / 0.006)


def slow_sections(sos, x):
    for b0, b1, b2, _, a1, a2 in sos:
        u = v = 0.0
        out = []
        for s in x:
            y = b0 * s + u
            u, v = b1 * s - a1 * y + v, b2 * s - a2 * y
            out.append(y)
        x = np.array(out)
    return x


@pytest.mark.parametrize("kind,edges", [("lowpass", (0.2,)), ("highpass", (0.3,)), ("bandpass", (0.1, 0.4))])
def test_sections_equal_the_recursion(kind, edges):
    sos = filters.butterworth_sos(4, edges, kind)
    x = np.random.default_rng(0).normal(size=1500)
    assert np.abs(slow_sections(sos, x) - filters.sosfilt(sos, x[None])[0]).max() < 1e-10


@pytest.mark.parametrize("kind,edges,at", [("lowpass", (0.2,), 0.2), ("highpass", (0.3,), 0.3), ("bandpass", (0.1, 0.4), 0.1), ("bandpass", (0.1, 0.4), 0.4)])
def test_gain_at_the_edges_is_half_power(kind, edges, at):
    e = np.exp(-1j * math.pi * at)
    gain = 1
    for b0, b1, b2, _, a1, a2 in filters.butterworth_sos(4, edges, kind):
        gain *= (b0 + b1 * e + b2 * e * e) / (1 + a1 * e + a2 * e * e)
    assert abs(abs(gain) - math.sqrt(0.5)) < 1e-6


def test_zero_phase_filter_keeps_a_tone_in_place():
    t = np.arange(8000) / RATE
    x = np.sin(2 * math.pi * 10_000 * t)
    y = filters.band_filter(x, RATE, (5_000, 20_000))
    assert np.abs(y[1000:-1000] - x[1000:-1000]).max() < 5e-3
    assert np.abs(filters.band_filter(x, RATE, (30_000, 60_000))[1000:-1000]).max() < 1e-3


def test_filter_rows_are_independent():
    x = np.random.default_rng(1).normal(size=(3, 700))
    both = filters.band_filter(x, RATE, (5_000, 20_000))
    for i in range(3):
        assert np.allclose(both[i], filters.band_filter(x[i], RATE, (5_000, 20_000)))


def test_stft_round_trip():
    x = two_tone()
    _, t, s = spectra.stft(x, RATE, 0.64, 0.875)
    assert t[0] == 0
    assert np.linalg.norm(x - spectra.istft(s, RATE, 0.64, 0.875, len(x))) < 1e-10 * np.linalg.norm(x)


def test_energy_splits_into_harmonic_and_residual():
    a = features.Analysis(filters.band_filter(two_tone(), RATE, (100, 60_000)), RATE, features.plan_band((100, 60_000), RATE))
    assert np.isclose(a.power.sum(), a.power[a.mask].sum() + a.res_power.sum(), rtol=1e-12)
    assert np.linalg.norm(a.rebuilt + a.residual - a.x) < 1e-9 * np.linalg.norm(a.x)


def test_harmonics_come_from_one_band_only():
    plans = features.plan_bands({"wide": (100, 60_000), "low": (5_000, 15_000)}, RATE)
    assert "harmonic" in plans["wide"].families and "harmonic" not in plans["low"].families
    with pytest.raises(ValueError):
        features.plan_bands({"wide": (100, 60_000), "low": (5_000, 15_000)}, RATE, {"low": ("harmonic",)})
    with pytest.raises(ValueError):
        features.plan_bands({"wide": (100, 60_000)}, RATE, {"wide": ("nonsense",)})


def test_features_have_exactly_the_planned_columns():
    plans = features.plan_bands({"wide": (100, 60_000), "low": (5_000, 15_000)}, RATE)
    row = features.record_features(two_tone(), RATE, plans)
    assert set(row) == set(features.output_columns(plans))
    assert sum(len(v) for v in features.FAMILIES.values()) == 95


def test_families_alone_equal_families_together():
    x = two_tone()
    whole = features.window_features(x, RATE, features.plan_band((100, 60_000), RATE))
    for family in features.FAMILIES:
        part = features.window_features(x, RATE, features.plan_band((100, 60_000), RATE, (family,)))
        for k, v in part.items():
            assert np.isclose(v, whole[k], rtol=1e-8, atol=1e-10, equal_nan=True), k


def test_entropies_and_cepstrum_are_in_range():
    x = two_tone()
    assert 0 <= features.permutation_entropy(x) <= 1
    assert 0 <= features.singular_entropy(x) <= 1
    assert 0 <= features.energy_entropy(x) <= 1
    f, _, s = spectra.stft(x, RATE, 0.64, 0.875)
    assert np.isfinite(features.mel_cepstrum(f, np.abs(s) ** 2, (1000, 60_000))).all()


def test_dimensionless_features_do_not_depend_on_scale():
    x = two_tone()
    a, b = (features.window_features(k * x, RATE, features.plan_band((100, 60_000), RATE, ("classic", "entropy"))) for k in (1.0, 7.5))
    for k in ("skewness", "kurtosis", "crest_factor", "permutation_entropy", "energy_entropy"):
        assert np.isclose(a[k], b[k], rtol=1e-6)


def test_packet_order_rate_and_energy():
    nodes, rate = spectra.packet_energies(two_tone(1e6, 0.01), 1e6, (100, 1000), 4)
    assert len(nodes) == 16 and np.isclose(rate, 4000, rtol=1e-3)
    tone = np.sin(2 * math.pi * np.arange(4096) * 0.47)
    e = [float(v @ v) for _, v in spectra.wavelet_packet(tone, 3)]
    assert int(np.argmax(e)) == int(0.47 * 2 * 8)
    x = np.random.default_rng(2).normal(size=4096)
    assert abs(sum(float(v @ v) for _, v in spectra.wavelet_packet(x, 2)) / (x @ x) - 1) < 0.02


def test_damped_match_is_free_of_phase_and_place():
    scores = []
    for start, phase in ((200, 0.0), (1500, math.pi / 2)):
        t = np.maximum(np.arange(3000) - start, 0) / 1e5
        x = (np.arange(3000) >= start) * np.exp(-t / 0.002) * np.cos(2 * math.pi * 8000 * t + phase)
        score, atom = features.damped_match(x, 1e5, (8000.0,), (2.0,), (start,))
        assert abs(np.linalg.norm(atom) - 1) < 1e-8
        scores.append(score)
    assert min(scores) > 0.999 and abs(scores[0] - scores[1]) < 1e-6


def test_ridge_equals_the_full_search():
    rng = np.random.default_rng(3)
    f, p = np.arange(40) * 100.0, rng.random((40, 30))
    score = np.log(p + 1e-12)
    gap = np.abs(f[:, None] - f[None, :]) / 300.0
    best, back = score[:, 0], []
    for t in range(1, 30):
        c = best[None, :] - gap
        back.append(c.argmax(1))
        best = score[:, t] + c.max(1)
    path = [int(best.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    assert np.array_equal(spectra.ridge(f, p, (0, 4000), 300.0), f[path[::-1]])
    many = rng.random((5, 40, 30))
    together = spectra.ridge(f, many, (500, 3000), 300.0)
    assert all(np.array_equal(together[i], spectra.ridge(f, many[i], (500, 3000), 300.0)) for i in range(5))


def test_resampling_keeps_a_tone():
    x = np.sin(2 * math.pi * 0.01 * np.arange(2000))
    y = filters.resample_poly(x, 3, 2)
    assert len(y) == 3000
    assert np.abs(y[300:-300] - np.sin(2 * math.pi * 0.01 * np.arange(3000) * 2 / 3)[300:-300]).max() < 2e-3
    assert np.allclose(filters.resample_poly(x, 9, 25), filters.resample_poly(np.vstack([x, x]), 9, 25)[1])
    assert filters.resample_to(x, 1000, 1000)[1] == "none"
    assert filters.resample_to(x, 1000, 2000)[1] == "upsample"
    assert filters.resample_to(x, 1000, 500)[1] == "downsample"


def test_peaks_plateaus_distance_and_prominence():
    x = np.array([0, 1, 1, 1, 0, 3, 0, 2, 0, 5, 0], float)
    assert spectra.find_peaks(x).tolist() == [2, 5, 7, 9]
    assert spectra.find_peaks(x, height=2).tolist() == [5, 7, 9]
    assert spectra.find_peaks(x, distance=3).tolist() == [2, 5, 9]
    assert spectra.find_peaks(x, prominence=3).tolist() == [5, 9]


def test_locations_from_exact_delays_and_outliers():
    x = np.linspace(0, 100, 21)
    t = arrays.hyperbola(x, 37.0, 8.0, 1500.0, x[5])
    f = arrays.fit_hyperbola(x, t, x[5], 1500.0, (0, 100), (0.5, 40))
    assert abs(f["xs"] - 37) < 1e-3 and abs(f["z"] - 8) < 1e-3
    bad = t + np.where(np.arange(21) % 7 == 3, 0.01, 0)
    f = arrays.fit_consensus(x, bad, x[5], 1500.0, (0, 100), (0.5, 40), rounds=40)
    assert f["used_ransac"] and f["inliers"] == 18 and abs(f["xs"] - 37) < 0.1


@pytest.mark.parametrize("method", ["gcc_phat", "fft_xcorr", "ncc"])
def test_delays_by_every_method(method):
    rng = np.random.default_rng(4)
    base = rng.normal(size=600)
    data = np.column_stack([np.roll(base, k) for k in (0, 5, -3)])
    d = arrays.estimate_delays(data, 1000.0, 0, method)
    assert np.allclose(d["delay"], [0, 0.005, -0.003], atol=6e-4)
    assert d["valid"].all()


def test_window_geometry():
    assert window_ranges(100, 1000, 0.2, 0.5) == []
    w = window_ranges(5_000_000, 500_000, 0.02, 0.5)
    assert len(w) == 999 and w[1][1] == 5000 and w[-1][2] <= 5_000_000


def test_recording_windows_skip_nothing_and_batch_alike():
    x = np.tile(two_tone(), 3)
    plans = features.plan_bands({"wide": (100, 60_000)}, RATE, {"wide": tuple(features.FAMILIES)})
    windows = [(g[1], g[2]) for g in window_ranges(len(x), RATE, 0.02, 0.5)]
    rows = list(features.recording_windows(x, RATE, plans, windows))
    alone = list(features.recording_windows(x, RATE, plans, windows[2:3]))
    assert len(rows) == len(windows)
    for k, v in alone[0].items():
        assert np.isclose(v, rows[2][k], rtol=1e-8, atol=1e-10, equal_nan=True)


def test_filters_forget_what_lies_beyond_their_reach():
    x = np.random.default_rng(3).normal(size=400_000)
    for band in ((100.0, 60_000.0), (5_000.0, 15_000.0), (1_000.0, 5_000.0)):
        around = filters.reach(RATE, band)
        a, b = 150_000, 160_000
        assert around < a
        part = filters.band_filter(x[a - around : b + around], RATE, band)[around:-around]
        assert np.abs(part - filters.band_filter(x, RATE, band)[a:b]).max() < 1e-9


def test_first_definitions_differ_where_they_should():
    from dataclasses import replace

    plan = features.plan_band((100, 60_000), RATE)
    new, old = features.window_features(two_tone(), RATE, plan), features.window_features(two_tone(), RATE, replace(plan, formulas="first"))
    assert set(new) == set(old)
    assert old["R_h"] == old["R_2_1"] and old["rho_r"] == 1.0
    for k in (*features.FAMILIES["classic"], *features.FAMILIES["time"], "energy_entropy", "MFCC_01"):
        assert old[k] == new[k]


def test_local_kurtosis_equals_the_direct_one():
    rng = np.random.default_rng(6)
    x = rng.normal(size=900) * np.exp(-np.arange(900) / 60)
    views = np.lib.stride_tricks.sliding_window_view(x, 40)
    assert np.allclose(features.sliding_sums(x, 40), views.sum(axis=1), rtol=1e-9)
    assert features.largest_local_kurtosis(x, 40) == pytest.approx(float(features.moments(views)[1].max()), rel=1e-6)
    assert features.largest_local_kurtosis(np.zeros(100), 10) == 0.0


def test_stacked_records_are_those_alone(monkeypatch):
    """Records of equal length share their filters and transforms; one that fails leaves the others."""
    rng = np.random.default_rng(6)
    plans = features.plan_bands({"b": (100.0, 30_000.0)}, 64_000.0, {"b": ("classic", "time", "background", "ridge", "residual")})
    signals = [rng.normal(size=n) for n in (300, 256, 300, 300, 256, 1)]
    signals[2] = np.array(["x"] * 300)
    want = []
    for x in signals:
        try:
            want.append(features.record_features(x, 64_000.0, plans))
        except Exception as e:
            want.append(repr(e))
    for samples in (1 << 16, 600):
        monkeypatch.setattr(features, "TOGETHER_SAMPLES", samples)
        got = features.stacked_records(signals, [64_000.0] * 6, plans)
        for a, b in zip(got, want, strict=True):
            if isinstance(b, str):
                assert repr(a) == b
            else:
                assert list(a) == list(b) and np.allclose(list(a.values()), list(b.values()), rtol=1e-8, atol=1e-9, equal_nan=True)
    assert isinstance(want[2], str)
    filtered, plain = [], features.filters.band_filter
    monkeypatch.setattr(features.filters, "band_filter", lambda x, *a: filtered.append(np.ndim(x)) or plain(x, *a))
    features.stacked_records(signals[:2] + signals[3:5], [64_000.0] * 4, {"b": plans["b"]})
    assert filtered and set(filtered) == {2}
