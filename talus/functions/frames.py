"""Kernels over arrays of frames: numpy functions, and Arrow UDFs around those that no Catalyst expression can state."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

FRAMES = T.ArrayType(T.ArrayType(T.FloatType()))
DOUBLE_FRAMES = T.ArrayType(T.ArrayType(T.DoubleType()))


def mel_filters(rate: int, n_fft: int, bins: int, low: float, high: float) -> np.ndarray:
    """Triangular filters, evenly spaced on the mel scale 2595 log10(1 + f / 700)."""
    to_mel = lambda f: 2595 * np.log10(1 + np.asarray(f) / 700)
    edges = 700 * (10 ** (np.linspace(to_mel(low), to_mel(high), bins + 2) / 2595) - 1)
    freqs = np.linspace(0, rate / 2, n_fft // 2 + 1)
    up = (freqs[:, None] - edges[:-2]) / np.diff(edges)[:-1]
    down = (edges[2:] - freqs[:, None]) / np.diff(edges)[1:]
    return np.maximum(0, np.minimum(up, down))


def log_mel(wave: np.ndarray, rate: int = 16000, n_fft: int = 400, hop: int = 320, bins: int = 80, low: float = 20, high: float = 7600, floor: float = 1e-6) -> np.ndarray:
    """Log power mel spectrogram over centred, reflected, Hann-windowed frames."""
    wave = np.asarray(wave, float)
    padded = np.pad(wave, n_fft // 2, mode="reflect" if len(wave) > n_fft // 2 else "constant")
    frames = np.lib.stride_tricks.sliding_window_view(padded, n_fft)[::hop]
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n_fft) / n_fft)
    power = np.abs(np.fft.rfft(frames * window, axis=1)) ** 2
    return np.log(np.maximum(np.einsum("tf,fb->tb", power, mel_filters(rate, n_fft, bins, low, high)), floor)).astype(np.float32)


def zscore(x: np.ndarray, floor: float = 1e-5) -> np.ndarray:
    """Per bin over time, with the sample deviation."""
    x = np.asarray(x, float)
    std = x.std(axis=0, ddof=1) if len(x) > 1 else np.zeros(x.shape[1])
    return (x - x.mean(axis=0)) / np.maximum(std, floor)


def cosine_cost(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    unit = lambda a: a / np.maximum(np.sqrt((a * a).sum(axis=1, keepdims=True)), 1e-12)
    return 1 - np.einsum("if,jf->ij", unit(np.asarray(x, float)), unit(np.asarray(y, float)))


def dtw(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Warping path over cosine cost with steps of one in either or both, and the cost per step of the path.

    Anti-diagonals are filled at once. On equal costs the diagonal step is taken, then the step in ``x``.
    """
    cost = cosine_cost(x, y)
    n, m = cost.shape
    total = np.full((n + 1, m + 1), np.inf)
    total[0, 0] = 0
    for d in range(2, n + m + 1):
        i = np.arange(max(1, d - m), min(n, d - 1) + 1)
        j = d - i
        total[i, j] = cost[i - 1, j - 1] + np.minimum(np.minimum(total[i - 1, j - 1], total[i - 1, j]), total[i, j - 1])
    path, i, j = [], n, m
    while i > 0 and j > 0:
        path.append((i - 1, j - 1))
        options = (total[i - 1, j - 1], total[i - 1, j], total[i, j - 1])
        step = int(np.argmin(options))
        i, j = (i - 1, j - 1) if step == 0 else (i - 1, j) if step == 1 else (i, j - 1)
    return np.array(path[::-1], np.int32), float(total[n, m] / max(len(path), 1))


def align(seq: np.ndarray, path: np.ndarray, length: int, source: int = 1) -> np.ndarray:
    """``seq`` on the target's timeline: mean of the frames mapped to each slot.

    An empty slot repeats the slot before it; leading ones take the first frame.
    """
    seq, out, last = np.asarray(seq, float), [], None
    target, mapped = np.asarray(path)[:, 0], np.asarray(path)[:, source]
    ok = (target >= 0) & (target < length) & (mapped >= 0) & (mapped < len(seq))
    for t in range(length):
        hit = mapped[ok & (target == t)]
        last = seq[hit].mean(axis=0) if len(hit) else seq[0] if last is None else last
        out.append(last)
    return np.stack(out)


def interpolate(seq: np.ndarray, length: int) -> np.ndarray:
    """Linear over time, sampled at the centres of ``length`` equal cells."""
    seq = np.asarray(seq, float)
    at = np.clip((np.arange(length) + 0.5) * len(seq) / length - 0.5, 0, len(seq) - 1)
    low = np.floor(at).astype(int)
    high = np.minimum(low + 1, len(seq) - 1)
    return seq[low] + (at - low)[:, None] * (seq[high] - seq[low])


def resample(wave: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Linear resampling."""
    if rate == to or not len(wave):
        return np.asarray(wave, np.float32)
    at = np.arange(int(round(len(wave) * to / rate))) * rate / to
    return np.interp(at, np.arange(len(wave)), wave).astype(np.float32)


def loudness(wave: np.ndarray, target_dbfs: float = -23.0, peak: float = 0.99) -> np.ndarray:
    """Scaled to a loudness, then down to the peak where it is exceeded; silence stays."""
    wave = np.asarray(wave, float)
    rms = np.sqrt((wave**2).mean()) if len(wave) else 0.0
    out = wave if rms <= 1e-12 else wave * 10 ** ((target_dbfs - 20 * np.log10(rms)) / 20)
    top = np.abs(out).max() if len(out) else 0.0
    return (out * (peak / top) if top > peak else out).astype(np.float32)


def pad_and_mask(arrays: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Arrays of frames as one batch, and which frames are real."""
    length, width = max(map(len, arrays)), arrays[0].shape[1]
    out, mask = np.zeros((len(arrays), length, width), np.float32), np.zeros((len(arrays), length), bool)
    for i, a in enumerate(arrays):
        out[i, : len(a)], mask[i, : len(a)] = a, True
    return out, mask


def stack(value) -> np.ndarray:
    return np.stack([np.asarray(f, float) for f in value])


@F.pandas_udf(FRAMES)
def log_mel_udf(waves: pd.Series) -> pd.Series:
    return waves.map(lambda w: [f.tolist() for f in log_mel(w)])


@F.pandas_udf(T.StructType([T.StructField("path", T.ArrayType(T.StructType([T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType())]))), T.StructField("cost", T.DoubleType())]))
def dtw_udf(x: pd.Series, y: pd.Series) -> pd.DataFrame:
    found = [dtw(zscore(stack(a)), zscore(stack(b))) for a, b in zip(x, y, strict=True)]
    return pd.DataFrame({"path": [[{"i": int(i), "j": int(j)} for i, j in p] for p, _ in found], "cost": [c for _, c in found]})


@F.pandas_udf(DOUBLE_FRAMES)
def align_udf(seq: pd.Series, path: pd.Series, length: pd.Series) -> pd.Series:
    pairs = [np.array([(p["i"], p["j"]) for p in one]) for one in path]
    return pd.Series([align(stack(s), p, int(n)).tolist() for s, p, n in zip(seq, pairs, length, strict=True)])


@F.pandas_udf(DOUBLE_FRAMES)
def interpolate_udf(seq: pd.Series, length: pd.Series) -> pd.Series:
    return pd.Series([interpolate(stack(s), int(n)).tolist() for s, n in zip(seq, length, strict=True)])


def residual(aligned: Column, norm: Column) -> Column:
    return F.zip_with(aligned, norm, lambda a, n: a.cast("double") - n.cast("double"))


def mean_abs(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + F.abs(v)) / F.size(x)


def root_mean_square(x: Column) -> Column:
    return F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v) / F.size(x))


def masked_l1(x: Column, y: Column, mask: Column) -> Column:
    """Mean absolute difference over real frames; over at least one."""
    total = F.aggregate(F.zip_with(F.zip_with(x, y, lambda a, b: F.abs(a - b)), mask, lambda d, m: F.when(m, d).otherwise(0.0)), F.lit(0.0), lambda s, v: s + v)
    return total / F.greatest(F.aggregate(mask, F.lit(0), lambda s, m: s + m.cast("int")), F.lit(1))


def masked_smoothness(x: Column, mask: Column) -> Column:
    """Mean absolute step between neighbouring frames that are both real."""
    n = F.size(x)
    steps = F.zip_with(F.slice(x, 2, F.greatest(n - 1, F.lit(0))), F.slice(x, 1, F.greatest(n - 1, F.lit(0))), lambda a, b: F.abs(a - b))
    both = F.zip_with(F.slice(mask, 2, F.greatest(n - 1, F.lit(0))), F.slice(mask, 1, F.greatest(n - 1, F.lit(0))), lambda a, b: a & b)
    return F.aggregate(F.zip_with(steps, both, lambda d, m: F.when(m, d).otherwise(0.0)), F.lit(0.0), lambda s, v: s + v) / F.greatest(F.aggregate(both, F.lit(0), lambda s, m: s + m.cast("int")), F.lit(1))


@F.pandas_udf(DOUBLE_FRAMES)
def zscore_udf(x: pd.Series) -> pd.Series:
    return x.map(lambda f: zscore(stack(f)).tolist())
