"""Arrow kernels for FFT-class work on sample arrays.

Spark partitions the rows and hands over columnar batches; each kernel is a few numpy
lines per record. Everything else in the package stays in the JVM.
"""

from __future__ import annotations

import functools
import math
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

# workers get this module inside the task, so they need not have the package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

DOUBLES = T.ArrayType(T.DoubleType())
CHANNELS = T.ArrayType(DOUBLES)
FRAMES = T.ArrayType(CHANNELS)  # [channel][frame][bin]


def _rows(lists: pa.Array) -> list[np.ndarray]:
    """List array as float64 views, one per row; null rows become empty."""
    off = lists.offsets.to_numpy()
    flat = lists.values.to_numpy(zero_copy_only=False)
    return [np.asarray(flat[a:b], dtype=np.float64) for a, b in zip(off[:-1], off[1:])]


class _flat:
    """List array whose rows are float64 views, made when asked for; null rows are empty."""

    def __init__(self, lists: pa.Array):
        self.off, self.values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)

    def __getitem__(self, k: int) -> np.ndarray:
        return np.asarray(self.values[self.off[k]:self.off[k + 1]], dtype=np.float64)


def _lists(rows: list[np.ndarray]) -> pa.Array:
    off = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int32)
    flat = np.concatenate(rows) if rows else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(flat, pa.float64()))


def _nested(mats: list[np.ndarray]) -> pa.Array:
    """[row][frame][bin] from one matrix per row."""
    inner = _lists([r for m in mats for r in m])
    off = np.concatenate(([0], np.cumsum([len(m) for m in mats]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(off, pa.int32()), inner)


def _matrix(frames: pa.Array) -> np.ndarray:
    flat = frames.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(frames), -1) if len(frames) else np.zeros((0, 1))


def _regroup(outer: pa.Array, inner: pa.Array) -> pa.Array:
    """Give per-channel results the record grouping of ``outer``."""
    off = outer.offsets.to_numpy()
    return pa.ListArray.from_arrays(pa.array(off - off[0], pa.int32()), inner)


def _children(outer: pa.Array) -> pa.Array:
    off = outer.offsets.to_numpy()
    return outer.values.slice(off[0], off[-1] - off[0])


def once(kernel):
    """Keep the optimiser from copying a kernel call: a filter inferred below an explode or a
    merged projection would otherwise run the Python stage again."""
    return kernel.asNondeterministic()


def hann(size: int) -> np.ndarray:
    """Periodic Hann window."""
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)


def _next_fast(n: int) -> int:
    return 1 << max(0, (n - 1).bit_length())


def _fftconv_full(x: np.ndarray, h: np.ndarray) -> np.ndarray:
    n = len(x) + len(h) - 1
    size = _next_fast(n)
    return np.fft.irfft(np.fft.rfft(x, size) * np.fft.rfft(h, size), size)[:n]


def _fftconv(x: np.ndarray, h: np.ndarray) -> np.ndarray:
    return _fftconv_full(x, h)[:len(x)] if len(x) and len(h) else np.zeros(len(x))


@functools.cache
def convolve_channels():
    """(x, hs) -> channels: source with the response of every channel, cut to source length."""
    @F.arrow_udf(CHANNELS)
    def kernel(x: pa.Array, hs: pa.Array) -> pa.Array:
        # results go straight to their places: of a batch only its input and its output are held
        src, taps = _flat(x), _flat(_children(hs))
        owner = np.repeat(np.arange(len(hs)), np.diff(hs.offsets.to_numpy()))
        off = np.concatenate(([0], np.cumsum(np.diff(src.off)[owner])))
        out = np.empty(off[-1])
        for k, r in enumerate(owner):
            out[off[k]:off[k + 1]] = _fftconv(src[r], taps[k])
        return _regroup(hs, pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(out)))
    return once(kernel)


def resample_taps(up: int, down: int, half: int = 10, beta: float = 5.0) -> np.ndarray:
    """Kaiser-windowed sinc low-pass at the lower of the two rates, gain ``up``."""
    rate = max(up, down)
    m = np.arange(-half * rate, half * rate + 1)
    h = np.sinc(m / rate) / rate * np.kaiser(len(m), beta)
    return h / h.sum() * up


class PolyphaseBank:
    """One short filter per phase of a rational rate change.

    Output k stands at input position k * down / up; of the stuffed signal's taps only those that meet real samples
    are used, every ``up``-th from the output's phase on. ``before`` and ``after`` are the samples used on either side.
    """

    def __init__(self, up: int, down: int):
        taps = resample_taps(up, down)
        self.up, self.down, self.lead = up, down, (len(taps) - 1) // 2
        self.width = -(-len(taps) // up)
        padded = np.zeros(self.width * up)
        padded[:len(taps)] = taps
        self.filters = padded.reshape(self.width, up).T[:, ::-1]  # [phase][oldest sample first]
        self.after = self.lead // up + 1
        self.before = self.width

    def outputs(self, x: np.ndarray, t0: int, first: int, last: int) -> np.ndarray:
        """Outputs first..last-1 from the samples x that start at t0; zeros where there are none."""
        newest = (np.array([first, last - 1]) * self.down + self.lead) // self.up
        lo, hi = int(newest[0]) - self.width + 1, int(newest[1]) + 1
        held = np.zeros(hi - lo)
        a, b = max(lo, t0), min(hi, t0 + len(x))
        if b > a:
            held[a - lo:b - lo] = x[a - t0:b - t0]
        out = np.zeros(last - first)
        windows = np.lib.stride_tricks.sliding_window_view(held, self.width)
        for k in range(min(self.up, last - first)):  # outputs ``up`` apart share a phase and lie ``down`` samples apart
            end, phase = divmod((first + k) * self.down + self.lead, self.up)
            mine = out[k::self.up]
            mine[:] = windows[end - self.width + 1 - lo::self.down][:len(mine)] @ self.filters[phase]
        return out


@functools.cache
def resample(fs_in: int, fs_out: int):
    """Rational rate change; equal rates pass through."""
    g = math.gcd(fs_in, fs_out)
    up, down = fs_out // g, fs_in // g
    if up == down:
        return lambda x: x
    bank = PolyphaseBank(up, down)

    @F.arrow_udf(DOUBLES)
    def kernel(x: pa.Array) -> pa.Array:
        return _lists([bank.outputs(row, 0, 0, -(-len(row) * up // down)) if len(row) else row for row in _rows(x)])
    return once(kernel)


SPEC = T.StructType([T.StructField("re", FRAMES), T.StructField("im", FRAMES),
                     T.StructField("level", T.DoubleType())])


def _stft(x: np.ndarray, win: int, hop: int, w: np.ndarray) -> np.ndarray:
    if len(x) < win:
        return np.zeros((0, win // 2 + 1), complex)
    framed = np.lib.stride_tricks.sliding_window_view(x, win)[::hop]
    return np.fft.rfft(framed * w, axis=-1)


@functools.cache
def stft(win: int = 512, hop: int = 256):
    """channels -> {re, im: [channel][frame][bin], level: mean magnitude of channel 0}."""
    w = hann(win)

    @F.arrow_udf(SPEC)
    def kernel(xs: pa.Array) -> pa.Array:
        specs = [_stft(x, win, hop, w) for x in _rows(_children(xs))]
        off = xs.offsets.to_numpy()
        first = [specs[a - off[0]] if b > a else np.zeros((0, 1)) for a, b in zip(off[:-1], off[1:])]
        level = pa.array([float(np.abs(s).mean()) if s.size else None for s in first], pa.float64())
        return pa.StructArray.from_arrays(
            [_regroup(xs, _nested([s.real for s in specs])), _regroup(xs, _nested([s.imag for s in specs])), level],
            names=["re", "im", "level"])
    return once(kernel)


def _overlap_add(spec: np.ndarray, win: int, hop: int, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the windowed inverse frames [frame][bin] and of the window power.

    Frames are cut in steps of ``hop``: the k-th steps of all frames lie side by side and are added at once.
    """
    if not len(spec):
        return np.zeros(0), np.zeros(0)
    steps = -(-win // hop)
    rows = np.zeros((2, len(spec), steps * hop))
    rows[0, :, :win], rows[1, :, :win] = np.fft.irfft(spec, win, axis=-1) * w, w * w
    out = np.zeros((2, len(spec) + steps - 1, hop))
    for k in range(steps):
        out[:, k:k + len(spec)] += rows[:, :, k * hop:(k + 1) * hop]
    n = (len(spec) - 1) * hop + win
    return out[0].ravel()[:n], out[1].ravel()[:n]


@functools.cache
def istft(win: int = 512, hop: int = 256):
    """(re, im) -> channels: overlap-add of the windowed inverse frames over the window power."""
    w = hann(win)

    @F.arrow_udf(CHANNELS)
    def kernel(re: pa.Array, im: pa.Array) -> pa.Array:
        channels = []
        re_ch, im_ch = _children(re), _children(im)
        for k in range(len(re_ch)):
            spec = _matrix(re_ch[k].values) + 1j * _matrix(im_ch[k].values)
            y, p = _overlap_add(spec, win, hop, w)
            channels.append(y / np.where(p > 1e-10, p, 1.0))
        return _regroup(re, _lists(channels))
    return once(kernel)


@functools.cache
def envelope():
    """Magnitude of the analytic signal."""
    @F.arrow_udf(DOUBLES)
    def kernel(x: pa.Array) -> pa.Array:
        out = []
        for row in _rows(x):
            n = len(row)
            gain = np.zeros(n)
            if n:
                gain[0] = 1
                gain[1:(n + 1) // 2] = 2
                if n % 2 == 0:
                    gain[n // 2] = 1
            out.append(np.abs(np.fft.ifft(np.fft.fft(row) * gain)) if n else row)
        return _lists(out)
    return once(kernel)


# ---- running sums inside a record ----------------------------------------------------------

@F.arrow_udf(DOUBLES)
def suffix_sums(x: pa.Array) -> pa.Array:
    """Sum of each sample and all later ones, added from the end."""
    return _lists([np.cumsum(r[::-1])[::-1] for r in _rows(x)])


@functools.cache
def level_sums(levels: tuple[float, ...]):
    """Per level the first sample n nearest to it, and there the suffix sums of y, n*y and y*y: [level][n, sy, sny, syy]."""
    def sums(y):
        n = np.arange(len(y), dtype=np.float64)
        rows = np.stack([n] + [np.cumsum(v[::-1])[::-1] for v in (y, n * y, y * y)], axis=1)
        return rows[[int(np.argmin(np.abs(y - level))) for level in levels]] if len(y) else rows

    @F.arrow_udf(CHANNELS)
    def run(y: pa.Array) -> pa.Array:
        return _nested([sums(r) for r in _rows(y)])
    return run


def boxcar_energy(xs: list[np.ndarray], length: int) -> np.ndarray:
    """Causal mean square over ``length`` samples, averaged over channels, on the full convolution length."""
    if not xs or not len(xs[0]):
        return np.zeros(0)
    squares = np.mean([x * x for x in xs], axis=0)
    sums = np.concatenate(([0.0], np.cumsum(squares)))
    n = np.arange(1, len(squares) + length)
    return (sums[np.minimum(n, len(squares))] - sums[np.maximum(n - length, 0)]) / length


def _records(xs: pa.Array) -> list[list[np.ndarray]]:
    channels, off = _rows(_children(xs)), xs.offsets.to_numpy()
    return [channels[a - off[0]:b - off[0]] for a, b in zip(off[:-1], off[1:])]


@functools.cache
def moving_energy(length: int):
    """channels -> causal boxcar energy of the record."""
    @F.arrow_udf(DOUBLES)
    def kernel(xs: pa.Array) -> pa.Array:
        return _lists([boxcar_energy(x, length) for x in _records(xs)])
    return once(kernel)


SPAN = T.StructType([T.StructField("th", T.DoubleType()), T.StructField("st", T.LongType()), T.StructField("en", T.LongType())])


@functools.cache
def noise_span(length: int, boundary: int, silence: int, tail: float):
    """channels -> {th, st, en}: threshold between a silent head and a noisy middle of the moving energy, its first
    crossing before the boundary, and its first drop from there on, less the length of the boxcar."""
    def span(x):
        e = boxcar_energy(x, length)
        quiet, loud = e[length:silence], e[boundary:max(int(np.floor(len(e) - tail)), 0)]
        if not len(quiet) or not len(loud):
            return None, 0, boundary - length
        th = (quiet.mean() + loud.mean()) / 4 + (quiet.max() + loud.min()) / 4
        on = e > th
        st = int(np.argmax(on[:boundary]))
        drop = np.flatnonzero(~on[boundary:])
        return float(th), st, (int(drop[0]) if len(drop) else 0) + boundary - length

    @F.arrow_udf(SPAN)
    def kernel(xs: pa.Array) -> pa.Array:
        rows = [span(x) for x in _records(xs)]
        return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.float64(), pa.int64(), pa.int64()))],
                                          names=["th", "st", "en"])
    return once(kernel)
