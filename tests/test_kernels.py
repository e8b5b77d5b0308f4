"""Kernels against analytic signals and slow direct formulas."""
import numpy as np
import pytest

from pulsegrid.functions import kernels as kn


def tone(hz, fs=30, seconds=20, phase=0.0):
    return np.sin(2 * np.pi * hz * np.arange(int(fs * seconds)) / fs + phase)


def test_bandpass_gain_phase_and_constant():
    fs = 30
    y = kn.bandpass(np.stack([tone(1.2), tone(.1), tone(9.0), np.full(600, 5.0)]), fs)
    inner = slice(90, -90)
    assert np.abs(y[0][inner] - tone(1.2)[inner]).max() < .01
    assert np.abs(y[1][inner]).max() < .02 and np.abs(y[2][inner]).max() < .02 and np.abs(y[3]).max() < 1e-9
    for f in (.7, 4.0):
        z = np.exp(2j * np.pi * f / fs)
        assert abs(np.prod([np.polyval(b, z) / np.polyval(a, z) for b, a in kn.bandpass_sections(.7, 4.0, fs)])) == pytest.approx(2 ** -.5, abs=1e-9)


def test_block_filter_equals_sample_loop():
    system = kn._state_space(kn.bandpass_sections(.7, 4.0, 30))
    a, b, c, d = system
    x = np.random.default_rng(0).normal(size=(2, 333))
    s = np.linalg.solve(np.eye(len(a)) - a, b).ravel() * x[0, 0]
    want = []
    for v in x[0]:
        want.append((c @ s).item() + d.item() * v)
        s = a @ s + b.ravel() * v
    np.testing.assert_allclose(kn._filter(x, system)[0], want, atol=1e-10)


@pytest.mark.parametrize("n", [10, 50, 600])
def test_lenient_filter_on_short_input(n):
    x = np.random.default_rng(n).normal(size=(1, n))
    y = kn.legacy_bandpass(x, 30)
    assert y.shape == x.shape
    if n == 10:
        np.testing.assert_allclose(y, x - x.mean())
    assert (kn.bandpass(x, 30)[0] is None) == (n <= 21)


def test_welch_finds_the_tone_and_keeps_power():
    f, p = kn.welch(tone(1.2)[None], 30, 600, 2048)
    assert f[p[0].argmax()] == pytest.approx(1.2, abs=.01)
    x = np.random.default_rng(0).normal(size=(1, 60000))
    f, p = kn.welch(x, 30, 256, 256)
    assert p[0].sum() * (f[1] - f[0]) == pytest.approx(1, rel=.05)


@pytest.mark.parametrize("delay", [-.12, 0.0, .12])
def test_lag_curve_sign(delay):
    fs, t = 60, np.arange(1200) / 60
    pulse = lambda t: np.sin(2 * np.pi * 1.2 * t) + .2 * np.sin(2 * np.pi * 2.4 * t)
    c = kn.lag_xcorr(pulse(t)[None], pulse(t - delay)[None], 18)[0]
    assert (c.argmax() - 18) / fs == pytest.approx(delay, abs=1 / fs) and c.max() > .9


def test_peaks_distance_prominence_and_plateau():
    x = np.array([0, 1, 0, 3, 3, 3, 0, 2, 0, .5, 0], float)
    assert kn.find_peaks(x).tolist() == [1, 4, 7, 9]
    assert kn.find_peaks(x, 4).tolist() == [4, 9]
    assert kn.find_peaks(x, 1, 1.0).tolist() == [1, 4, 7]
    assert kn.find_peaks(x, 1, None, 2.0).tolist() == [4, 7]


def test_spline_is_exact_on_lines_and_smooth_between():
    t = np.sort(np.random.default_rng(0).random(30)) * 10
    at = np.linspace(t[0], t[-1], 200)
    np.testing.assert_allclose(kn.natural_cubic(t, 3 * t - 1, at), 3 * at - 1, atol=1e-9)
    dense = np.linspace(0, 6, 400)
    np.testing.assert_allclose(kn.natural_cubic(dense, np.sin(dense), at[(at > 1) & (at < 5)]), np.sin(at[(at > 1) & (at < 5)]), atol=1e-6)


def test_lowpass_taps():
    h = kn.kaiser_lowpass(60, 8, 15, 80)
    assert len(h) % 2 == 1 and np.allclose(h, h[::-1]) and h.sum() == pytest.approx(1)
    f = np.linspace(0, 30, 4000)
    gain = np.abs(np.exp(-2j * np.pi * f[:, None] / 60 * np.arange(len(h))) @ h)
    assert np.abs(gain[f <= 8] - 1).max() < 2e-4 and gain[f >= 15].max() < 2e-4


def test_colour_methods_recover_the_pulse():
    t = np.arange(600) / 30
    x = np.sin(2 * np.pi * 1.2 * t)
    r, g, b = [v[None] for v in (130 + .8 * x, 110 + x, 90 + .3 * x + .2 * np.sin(2 * np.pi * .23 * t))]
    for kernel in (kn.chrom_windowed, kn.pos_windowed, kn.pca_component, kn.ica_component):
        y = np.asarray(kernel(r, g, b, 30))
        assert y.shape == (1, 600) and np.isfinite(y).all()
        f, p = kn.welch(y, 30, 600, 2048)
        band = (f > .7) & (f < 4)
        assert f[band][p[0][band].argmax()] == pytest.approx(1.2, abs=.05)


def test_sliding_projection_matches_the_slow_sum():
    rng = np.random.default_rng(0)
    r, g, b = rng.random((3, 1, 64)) + 1
    out, cnt = np.zeros(64), np.zeros(64)
    for s in range(64 - 26 + 1):
        out[s:s + 26] += kn._chrom(r[:, s:s + 26], g[:, s:s + 26], b[:, s:s + 26])[0]
        cnt[s:s + 26] += 1
    want = out / cnt
    np.testing.assert_allclose(kn.chrom_windowed(r, g, b, 16)[0], want - want.mean(), atol=1e-12)


def test_coherence_of_a_copy_is_one():
    x = np.random.default_rng(0).normal(size=(3, 600))
    np.testing.assert_allclose(kn.coherence_at(x, 2 * x, 30, 120, [1.2, 2.0, 3.0]), 1, atol=1e-12)


def test_component_windows_are_separated_together():
    """Each window had its own rounds, step by step in Python; together they give what each gives alone."""
    rng = np.random.default_rng(4)
    r, g, b = (rng.uniform(20, 200, (300, 64)) for _ in range(3))
    g[7] = b[7] = r[7]                                      # rank-deficient: the principal component
    calls, once = [], kn._decorrelate
    try:
        kn._decorrelate = lambda w: calls.append(1) or once(w)
        together = kn.ica_component(r, g, b, 16.0, rounds=200)
    finally:
        kn._decorrelate = once
    assert len(calls) <= 201
    for k in range(0, 300, 7):
        np.testing.assert_allclose(together[k], kn.ica_component(r[k:k + 1], g[k:k + 1], b[k:k + 1], 16.0, rounds=200)[0], atol=1e-9)


def test_a_kernel_sees_a_bounded_part_of_a_batch(spark):
    """A whole batch of ten thousand rows went through every kernel at once."""
    from pyspark.sql import functions as F
    from pulsegrid.functions.batch import ROWS, apply_kernel
    df = spark.range(5000, numPartitions=1).select("id", F.array(F.col("id").cast("double"), F.lit(1.0)).alias("x"))
    out = apply_kernel(df, ["x"], lambda m: [[len(m)] * len(m), m[:, 0]], "seen long, same double").collect()
    assert max(r.seen for r in out) <= ROWS
    assert [r.id for r in out] == list(range(5000)) and all(r.same == r.id for r in out)
