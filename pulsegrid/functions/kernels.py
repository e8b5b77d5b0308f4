"""Small vectorised signal kernels on [windows, samples] matrices.

Each runs inside one Arrow batch on whole windows at once; Spark partitions and
shuffles the work. Nothing here keeps state between batches.
"""
from __future__ import annotations

import numpy as np

EPS = 1e-8


# ---- colour -----------------------------------------------------------------

def _normalize(x):
    return x / (x.mean(-1, keepdims=True) + EPS) - 1


def _combine(x1, x2, sign):
    y = x1 + sign * (x1.std(-1, keepdims=True) / (x2.std(-1, keepdims=True) + EPS)) * x2
    return y - y.mean(-1, keepdims=True)


def _chrom(r, g, b):
    r, g, b = _normalize(r), _normalize(g), _normalize(b)
    return _combine(3 * r - 2 * g, 1.5 * r + g - 1.5 * b, -1)


def _pos(r, g, b):
    r, g, b = _normalize(r), _normalize(g), _normalize(b)
    return _combine(r - g, r + g - 2 * b, 1)


def _sliding_mean(project, r, g, b, fs, seconds=1.6):
    """Mean at each sample of the projections of all short windows that hold it; rows shorter than four samples give nothing.

    All short windows are one view; place k of every projection is added to a shifted slice of the result.
    """
    rows, n = r.shape
    size = max(8, int(round(seconds * fs)))
    if n < 4:
        return [None] * rows
    if n <= size:
        return project(r, g, b)
    total = np.zeros((rows, n))
    for part in np.array_split(np.arange(rows), max(1, rows * n * size // 4_000_000)):          # bounded memory
        views = (np.lib.stride_tricks.sliding_window_view(c[part], size, axis=1) for c in (r, g, b))
        shapes = project(*views)
        for k in range(size):
            total[part, k:k + shapes.shape[1]] += shapes[:, :, k]
    held = np.minimum(np.minimum(np.arange(1, n + 1), np.arange(n, 0, -1)), min(size, n - size + 1))
    mean = total / held
    return mean - mean.mean(1, keepdims=True)


def chrom_windowed(r, g, b, fs):
    return _sliding_mean(_chrom, r, g, b, fs)


def pos_windowed(r, g, b, fs):
    return _sliding_mean(_pos, r, g, b, fs)


def _standard(r, g, b):
    x = np.stack([r, g, b], axis=2)
    return (x - x.mean(1, keepdims=True)) / (x.std(1, keepdims=True) + EPS)


def _lead_positive(vectors):
    """Flip each direction so its largest loading is positive."""
    lead = np.take_along_axis(vectors, np.abs(vectors).argmax(-1)[..., None], -1)
    return vectors * np.where(lead < 0, -1.0, 1.0)


def _strongest(components, fs):
    """Per window the component with most power between 0.7 and 4 Hz."""
    w, n, c = components.shape
    flat = components.transpose(0, 2, 1).reshape(w * c, n)
    size = min(n, max(16, int(fs * 8)))
    f, p = welch(flat, fs, size, size)
    band = (f >= .7) & (f <= 4.0)
    power = p[:, band].sum(1).reshape(w, c)
    best = np.take_along_axis(components, power.argmax(1)[:, None, None], 2)[:, :, 0]
    return best - best.mean(1, keepdims=True)


def pca_component(r, g, b, fs):
    if r.shape[1] < 4:
        return [None] * len(r)
    x = _standard(r, g, b)
    _, vectors = np.linalg.eigh(np.einsum("wni,wnj->wij", x, x))
    directions = _lead_positive(vectors.transpose(0, 2, 1)[:, ::-1])
    return _strongest(np.einsum("wni,wci->wnc", x, directions), fs)


def ica_component(r, g, b, fs, rounds=1000, tolerance=1e-4):
    """Symmetric fixed-point ICA (log-cosh) per window; rank-deficient windows use the principal components."""
    if r.shape[1] < 4:
        return [None] * len(r)
    x = _standard(r, g, b)
    n = x.shape[1]
    values, vectors = np.linalg.eigh(np.einsum("wni,wnj->wij", x, x) / n)
    full = values[:, 0] > 1e-10
    out = np.array(pca_component(r, g, b, fs))
    start = np.random.default_rng(0).normal(size=(3, 3))
    full = np.flatnonzero(full)
    for at in range(0, len(full), 2048):
        k = full[at:at + 2048]
        z = x[k] @ (vectors[k] / np.sqrt(values[k])[:, None, :])
        w = np.repeat(_decorrelate(start)[None], len(k), 0)
        live, zl = np.arange(len(k)), z
        for _ in range(rounds):                          # all windows in step; one that has settled leaves
            v = w[live]
            t = np.tanh(zl @ _flip(v))
            new = _decorrelate(_flip(t) @ zl / n - (1 - t * t).mean(1)[:, :, None] * v)
            w[live] = new
            moving = ~(np.abs(np.abs((new * v).sum(2)) - 1).max(1) < tolerance)
            if not moving.all():
                live, zl = live[moving], zl[moving]
            if not len(live):
                break
        loading = w @ (np.sqrt(values[k])[:, :, None] * _flip(vectors[k]))
        sign = np.sign(np.take_along_axis(loading, np.abs(loading).argmax(2)[:, :, None], 2))
        out[k] = _strongest(z @ _flip(w) * _flip(sign), fs)
    return out


def _flip(m):
    return np.swapaxes(m, -1, -2)


def _decorrelate(w):
    s, u = np.linalg.eigh(w @ _flip(w))
    return u @ (np.eye(3) * (1 / np.sqrt(s))[..., None, :]) @ _flip(u) @ w


# ---- spectra ----------------------------------------------------------------

def hann(n):
    """Periodic Hann taper."""
    return .5 - .5 * np.cos(2 * np.pi * np.arange(n) / n)


def _segments(x, size):
    step = size - size // 2
    return [x[:, s:s + size] for s in range(0, x.shape[1] - size + 1, step)]


def welch(x, fs, size, nfft):
    """One-sided density: half-overlapping, mean-removed, tapered segments."""
    taper = hann(size)
    p = np.mean([np.abs(np.fft.rfft((s - s.mean(1, keepdims=True)) * taper, nfft, axis=1)) ** 2
                 for s in _segments(x, size)], axis=0) / (fs * (taper ** 2).sum())
    p[:, 1:-1 if nfft % 2 == 0 else None] *= 2
    return np.fft.rfftfreq(nfft, 1 / fs), p


def coherence_at(x, y, fs, size, hz):
    """Magnitude-squared coherence at the bin nearest to ``hz`` (one value per window)."""
    taper = hann(size)
    fx, fy = [[np.fft.rfft((s - s.mean(1, keepdims=True)) * taper, axis=1) for s in _segments(v, size)] for v in (x, y)]
    pxx, pyy = np.mean(np.abs(fx) ** 2, axis=0), np.mean(np.abs(fy) ** 2, axis=0)
    pxy = np.mean(np.conj(fx) * np.asarray(fy), axis=0)
    f = np.fft.rfftfreq(size, 1 / fs)
    k = np.abs(f[None] - np.asarray(hz)[:, None]).argmin(1)
    rows = np.arange(len(x))
    return np.abs(pxy[rows, k]) ** 2 / (pxx[rows, k] * pyy[rows, k])


# ---- lags -------------------------------------------------------------------

def overlap(x, y, lag):
    """Samples of x and y when y trails x by ``lag``."""
    if lag > 0:
        return x[:, :-lag], y[:, lag:]
    if lag < 0:
        return x[:, -lag:], y[:, :lag]
    return x, y


def pearson(x, y):
    x, y = x - x.mean(1, keepdims=True), y - y.mean(1, keepdims=True)
    den = np.sqrt((x * x).sum(1) * (y * y).sum(1))
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(den > 0, (x * y).sum(1) / den, np.nan)


def lag_pearson(x, y, lags):
    """[windows, lags] Pearson over the overlap."""
    return np.stack([pearson(*overlap(x, y, k)) for k in lags], axis=1)


def lag_xcorr(x, y, radius):
    """[windows, 2 radius + 1] full cross-correlation over the full energies."""
    x, y = x - x.mean(1, keepdims=True), y - y.mean(1, keepdims=True)
    den = np.sqrt((x * x).sum(1) * (y * y).sum(1))
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.stack([(a * b).sum(1) / den for a, b in (overlap(x, y, k) for k in range(-radius, radius + 1))], axis=1)


# ---- zero-phase band-pass ---------------------------------------------------

def bandpass_sections(low, high, fs, order=3):
    """Second-order sections of a Butterworth band-pass (bilinear transform)."""
    wl, wh = [2 * fs * np.tan(np.pi * f / fs) for f in (low, high)]
    k = np.arange(1, order + 1)
    proto = np.exp(1j * np.pi * (2 * k + order - 1) / (2 * order))
    centre, width = wl * wh, wh - wl
    half = proto * width / 2
    root = np.sqrt(half ** 2 - centre)
    poles = np.concatenate([half + root, half - root])
    z = (2 * fs + poles) / (2 * fs - poles)
    gain = np.real(width ** order * (2 * fs) ** order / np.prod(2 * fs - poles))
    real = np.sort(z[np.abs(z.imag) < 1e-12].real)
    pairs = [(p, np.conj(p)) for p in z[z.imag >= 1e-12]] + list(zip(real[::2], real[1::2]))
    sections = [(np.array([1.0, 0.0, -1.0]), np.real(np.poly(p))) for p in pairs]
    sections[0] = (sections[0][0] * gain, sections[0][1])
    return sections


def _state_space(sections):
    """Cascade of the sections as one (A, B, C, D) system."""
    a, b, c, d = np.zeros((0, 0)), np.zeros((0, 1)), np.zeros((1, 0)), np.ones((1, 1))
    for num, den in sections:
        a2 = np.array([[-den[1], 1.0], [-den[2], 0.0]])
        b2 = np.array([[num[1] - den[1] * num[0]], [num[2] - den[2] * num[0]]])
        c2, d2 = np.array([[1.0, 0.0]]), np.array([[num[0]]])
        a = np.block([[a, np.zeros((len(a), 2))], [b2 @ c, a2]])
        b, c, d = np.vstack([b, b2 @ d]), np.hstack([d2 @ c, c2]), d2 @ d
    return a, b, c, d


def _filter(x, system, block=64):
    """Causal filtering of all rows from the steady state of their first sample, block by block."""
    a, b, c, d = system
    powers = [np.eye(len(a))]
    for _ in range(block):
        powers.append(a @ powers[-1])
    impulse = np.concatenate([d.ravel(), [(c @ powers[k] @ b).item() for k in range(block - 1)]])
    toeplitz = np.array([[impulse[i - j] if i >= j else 0.0 for j in range(block)] for i in range(block)])
    observe = np.vstack([c @ powers[k] for k in range(block)])
    drive = np.hstack([powers[block - 1 - k] @ b for k in range(block)])
    n = x.shape[1]
    padded = np.pad(x, ((0, 0), (0, -n % block)))
    state = np.linalg.solve(np.eye(len(a)) - a, b).ravel()[None] * x[:, :1]
    out = np.empty_like(padded)
    for s in range(0, padded.shape[1], block):
        u = padded[:, s:s + block]
        out[:, s:s + block] = u @ toeplitz.T + state @ observe.T
        state = state @ powers[block].T + u @ drive.T
    return out[:, :n]


def zero_phase(x, system, edge=21):
    """Forward and backward filtering with odd extension of ``edge`` samples at both ends."""
    head = 2 * x[:, :1] - x[:, edge:0:-1]
    tail = 2 * x[:, -1:] - x[:, -2:-edge - 2:-1]
    y = _filter(np.hstack([head, x, tail]), system)
    y = _filter(y[:, ::-1], system)[:, ::-1]
    return y[:, edge:-edge]


def bandpass(x, fs, low=.7, high=4.0, order=3):
    """Strict variant: too short an input is an error for the row (NULL)."""
    edge = 3 * (2 * order + 1)
    if x.shape[1] <= edge or not 0 < low < high < fs / 2:
        return [None] * len(x)
    return zero_phase(x - x.mean(1, keepdims=True), _state_space(bandpass_sections(low, high, fs, order)), edge)


def legacy_bandpass(x, fs, low=.7, high=4.0, order=3):
    """Lenient variant: the band is moved inside the sampled range; what cannot be filtered is only centred."""
    centred = x - x.mean(1, keepdims=True)
    edge = 3 * (2 * order + 1)
    low, high = max(low, 1e-6 * fs / 2), min(high, .999 * fs / 2)
    long_enough = x.shape[1] > max(edge, 6 * order - 1, 11)
    if long_enough and low < high:
        return zero_phase(centred, _state_space(bandpass_sections(low, high, fs, order)), edge)
    return centred


# ---- peaks ------------------------------------------------------------------

def find_peaks(x, distance=1, prominence=None, height=None):
    """Local maxima (flat tops at their middle), thinned by height priority, then by prominence."""
    d = np.sign(np.diff(x))
    edges = np.flatnonzero(d)
    peaks = [(edges[i] + 1 + edges[i + 1]) // 2 for i in range(len(edges) - 1) if d[edges[i]] > 0 > d[edges[i + 1]]]
    peaks = np.array(peaks, dtype=int)
    if height is not None:
        peaks = peaks[x[peaks] >= (height[peaks] if np.ndim(height) else height)]
    if distance > 1 and len(peaks):
        keep = np.ones(len(peaks), bool)
        for i in np.argsort(x[peaks], kind="stable")[::-1]:
            if keep[i]:
                near = np.abs(peaks - peaks[i]) < distance
                near[i] = False
                keep &= ~near
        peaks = peaks[keep]
    if prominence is not None and len(peaks):
        peaks = peaks[np.array([_prominence(x, p) for p in peaks]) >= prominence]
    return peaks


def _prominence(x, p):
    higher = np.flatnonzero(x > x[p])
    left, right = higher[higher < p], higher[higher > p]
    lo = x[(left[-1] + 1 if len(left) else 0):p + 1].min()
    hi = x[p:(right[0] if len(right) else len(x))].min()
    return x[p] - max(lo, hi)


# ---- curves -----------------------------------------------------------------

def natural_cubic(t, x, at):
    """Natural cubic spline through (t, x), evaluated inside [t0, tn]."""
    n, h = len(t), np.diff(t)
    rhs = np.zeros(n)
    rhs[1:-1] = 6 * (np.diff(x[1:]) / h[1:] - np.diff(x[:-1]) / h[:-1])
    lower, main, upper = np.zeros(n), np.ones(n), np.zeros(n)
    lower[1:-1], main[1:-1], upper[1:-1] = h[:-1], 2 * (h[:-1] + h[1:]), h[1:]
    for i in range(1, n):
        f = lower[i] / main[i - 1]
        main[i] -= f * upper[i - 1]
        rhs[i] -= f * rhs[i - 1]
    m = np.zeros(n)
    for i in range(n - 2, 0, -1):
        m[i] = (rhs[i] - upper[i] * m[i + 1]) / main[i]
    k = np.clip(np.searchsorted(t, at, side="right") - 1, 0, n - 2)
    a, b = t[k + 1] - at, at - t[k]
    return (m[k] * a ** 3 + m[k + 1] * b ** 3) / (6 * h[k]) + (x[k] / h[k] - m[k] * h[k] / 6) * a \
        + (x[k + 1] / h[k] - m[k + 1] * h[k] / 6) * b


def kaiser_lowpass(fs, passband, stopband, attenuation):
    """Odd symmetric unit-gain Kaiser low-pass taps."""
    width = (stopband - passband) / (fs / 2)
    beta = .1102 * (attenuation - 8.7) if attenuation > 50 else \
        (.5842 * (attenuation - 21) ** .4 + .07886 * (attenuation - 21) if attenuation > 21 else 0.0)
    taps = int(np.ceil((attenuation - 7.95) / (2.285 * np.pi * width) + 1))
    taps += 1 - taps % 2
    k = np.arange(taps) - (taps - 1) / 2
    cut = (passband + stopband) / 2 / (fs / 2)
    h = cut * np.sinc(cut * k) * np.kaiser(taps, beta)
    return h / h.sum()
