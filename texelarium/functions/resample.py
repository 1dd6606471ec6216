"""Mip levels by separable filters, and alpha coverage, on NumPy lanes.

A filter is stretched by the ratio of the sizes, weighs source texels by the
distance of their centres from the target's, and is normalised over the texels
that exist. A level has half the texels of the one before, rounded down.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import lru_cache

import numpy as np

SUBSAMPLES = 4
#: Bins of the threshold histogram: a float's exponent and its ten upper mantissa bits, sixteen octaves from the cutoff up.
BIN_SHIFT, OCTAVES = 13, 16
BINS = OCTAVES << (23 - BIN_SHIFT)


def _catmull_rom(x: float) -> float:
    x = abs(x)
    return 1.5 * x**3 - 2.5 * x**2 + 1 if x < 1 else -0.5 * x**3 + 2.5 * x**2 - 4 * x + 2 if x < 2 else 0.0


def _sinc(x: float) -> float:
    return 1.0 if x == 0 else math.sin(math.pi * x) / (math.pi * x)


#: (support, weight at a distance)
FILTERS: dict[str, tuple[float, Callable[[float], float]]] = {
    "triangle": (1.0, lambda x: max(0.0, 1 - abs(x))),
    "catmull_rom": (2.0, _catmull_rom),
    "gaussian": (3.0, lambda x: math.exp(-2 * x * x)),
    "lanczos3": (3.0, lambda x: _sinc(x) * _sinc(x / 3) if abs(x) < 3 else 0.0),
}


@lru_cache(maxsize=256)
def taps(name: str, size: int, to: int) -> tuple[np.ndarray, np.ndarray]:
    """(source index, weight), each (to, taps), of every target texel along an axis; unused taps weigh nothing."""
    ratio = size / to
    if name == "nearest":
        return np.floor((np.arange(to) + 0.5) * ratio).astype(np.int64)[:, None], np.ones((to, 1))
    support, weight = FILTERS[name]
    stretch = max(ratio, 1.0)
    rows = []
    for i in range(to):
        centre = (i + 0.5) * ratio
        low, high = max(0, math.floor(centre - support * stretch)), min(size, math.ceil(centre + support * stretch))
        rows.append((low, np.array([weight((j + 0.5 - centre) / stretch) for j in range(low, high)])))
    most = max(len(w) for _, w in rows)
    index, weights = np.zeros((to, most), np.int64), np.zeros((to, most))
    for i, (low, w) in enumerate(rows):
        index[i, : len(w)] = np.arange(low, low + len(w))
        weights[i, : len(w)] = w / w.sum()
    return index, weights


def _axis(x: np.ndarray, name: str, to: int) -> np.ndarray:
    index, weights = taps(name, x.shape[0], to)
    out = np.zeros((to, *x.shape[1:]))
    for k in range(index.shape[1]):
        out += x[index[:, k]] * weights[:, k].reshape(-1, *[1] * (x.ndim - 1))
    return out


def resize(lanes: np.ndarray, width: int, height: int, name: str = "triangle") -> np.ndarray:
    wide = _axis(np.swapaxes(lanes.astype(np.float64), 0, 1), name, width)
    return _axis(np.swapaxes(wide, 0, 1), name, height).astype(lanes.dtype)


def full_count(width: int, height: int) -> int:
    return max(width, height, 1).bit_length()


def complete(levels: list[np.ndarray], name: str = "triangle", count: int | None = None) -> list[np.ndarray]:
    """The supplied levels, as far as asked for, and further ones, each from the level before it."""
    if count == 0:
        raise ValueError("a mip chain has at least one level")
    h, w = levels[0].shape[:2]
    want = min(count or 64, full_count(w, h))
    out = levels[:want]
    while len(out) < want:
        h, w = out[-1].shape[:2]
        out.append(resize(out[-1], max(1, w // 2), max(1, h // 2), name))
    return out


def _samples(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and second texel, and the second's weight, of each subsample along an axis; clamped to the edge."""
    at = (np.arange(size * SUBSAMPLES) + 0.5) / SUBSAMPLES - 0.5
    low = np.floor(at)
    return np.clip(low, 0, size - 1).astype(int), np.clip(low + 1, 0, size - 1).astype(int), (at - low).astype(np.float32)


def _alpha(lanes: np.ndarray) -> np.ndarray:
    return np.clip(np.nan_to_num(lanes[..., 3].astype(np.float32), nan=0.0), 0, 1)


def _corners(alpha: np.ndarray, rows: slice):
    """(weights, alphas), each (4, rows, columns), of the bilinear taps of the subsamples in some rows."""
    y0, y1, ty = (v[rows] for v in _samples(alpha.shape[0]))
    x0, x1, tx = _samples(alpha.shape[1])
    a = np.stack([alpha[np.ix_(y, x)] for y in (y0, y1) for x in (x0, x1)])
    w = np.stack([np.outer(v, u) for v in (1 - ty, ty) for u in (1 - tx, tx)]).astype(np.float32)
    return w, a


def _bands(alpha: np.ndarray):
    """Slices of subsample rows with about a million subsamples each."""
    n, step = alpha.shape[0] * SUBSAMPLES, max(1, (1 << 20) // (alpha.shape[1] * SUBSAMPLES))
    return (slice(k, min(n, k + step)) for k in range(0, n, step))


def passing_count(lanes: np.ndarray, cutoff: float) -> int:
    """Of the 16 bilinear subsamples a texel, those with alpha at or above the cutoff."""
    alpha = _alpha(lanes)
    return sum(int(((w * a).sum(0) >= np.float32(cutoff)).sum()) for w, a in (_corners(alpha, b) for b in _bands(alpha)))


def passing_share(lanes: np.ndarray, cutoff: float) -> float:
    return passing_count(lanes, cutoff) / (lanes.shape[0] * lanes.shape[1] * SUBSAMPLES**2)


def pass_thresholds(w: np.ndarray, a: np.ndarray, cutoff: float) -> np.ndarray:
    """The least scale at which each sum of w * min(a * scale, 1) reaches the cutoff; infinite if none does.

    The sum is piecewise linear in the scale: taps saturate in the order of
    falling alpha, and the crossing lies in the first piece whose end reaches it.
    """
    order = np.argsort(-a, axis=0, kind="stable")
    w, a = np.take_along_axis(w, order, 0), np.take_along_axis(a, order, 0)
    out, done, full = np.full(a.shape[1:], np.inf, np.float32), np.zeros(a.shape[1:], bool), np.zeros(a.shape[1:], np.float32)
    slope = (w * a).sum(0, dtype=np.float32)
    with np.errstate(divide="ignore", invalid="ignore"):
        for k in range(len(a)):
            here = ~done & (a[k] > 0) & (full + slope / a[k] >= np.float32(cutoff))
            out[here] = ((np.float32(cutoff) - full) / slope)[here]
            done |= here
            full, slope = full + w[k], slope - w[k] * a[k]
    return out


def _bits(x: np.ndarray | float) -> np.ndarray:
    return np.asarray(x, np.float32).view(np.uint32).astype(np.int64)


def bin_scale(k: int, cutoff: float) -> float:
    """The upper edge of a bin."""
    return float(np.uint32(int(_bits(cutoff)) + ((k + 1) << BIN_SHIFT)).view(np.float32))


def threshold_histogram(lanes: np.ndarray, cutoff: float) -> np.ndarray:
    """How many subsamples have their threshold in each bin."""
    alpha, out = _alpha(lanes), np.zeros(BINS, np.int64)
    for band in _bands(alpha):
        k = np.maximum(_bits(pass_thresholds(*_corners(alpha, band), cutoff)) - int(_bits(cutoff)), 0) >> BIN_SHIFT
        out += np.bincount(k[k < BINS], minlength=BINS)
    return out


def scale_for(histogram: np.ndarray, cutoff: float, wanted: float) -> float:
    """The scale at which the number that passes is nearest to ``wanted``; ties go to more, a flat stretch to the scale nearest one."""
    through = np.cumsum(histogram)
    k = int(np.searchsorted(through, wanted, "left"))
    if k >= BINS:
        return bin_scale(BINS - 1, cutoff)
    before = int(through[k] - histogram[k])
    if k > 0 and wanted - before < through[k] - wanted:
        return bin_scale(k - 1, cutoff)
    later = np.flatnonzero(histogram[k + 1 :])
    high = bin_scale(k + int(later[0]), cutoff) if len(later) else math.inf
    return min(max(1.0, bin_scale(k, cutoff)), high)


def apply_scale(lanes: np.ndarray, scale: float) -> np.ndarray:
    """Alpha times the scale, at most one; colours, which are premultiplied, in the same ratio."""
    a = lanes[..., 3:]
    to = np.minimum(a * np.float32(scale), 1)
    ratio = np.where(a > 0, to / np.where(a > 0, a, 1), 1)
    return np.concatenate((lanes[..., :3] * ratio, np.where(a > 0, to, a)), -1).astype(lanes.dtype)


def preserve(levels: list[np.ndarray], first: int, cutoff: float) -> list[np.ndarray]:
    """Scales the levels from ``first`` on (never the base) so that as much of them passes as of the base."""
    share = passing_share(levels[0], cutoff) if len(levels) > max(1, first) else 0.0
    if share == 0:
        return levels
    out = list(levels)
    for k in range(max(1, first), len(out)):
        wanted = share * out[k].shape[0] * out[k].shape[1] * SUBSAMPLES**2
        scale = scale_for(threshold_histogram(out[k], cutoff), cutoff, wanted)
        out[k] = out[k] if scale == 1 else apply_scale(out[k], scale)
    return out
