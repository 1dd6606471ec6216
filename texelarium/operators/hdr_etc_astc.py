"""Further block codecs on NumPy arrays: signed BC4, BC6H, ETC1 in ETC2, EAC and LDR ASTC.

Each encoder writes one kind of block of its format, valid for any decoder; the
decoders here read those kinds and refuse others.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np


class CodecError(ValueError):
    """Blocks of a kind that is not decoded, or pixels that an encoder does not take."""


# Tables of the public block formats.
WEIGHTS4 = np.array([0, 4, 9, 13, 17, 21, 26, 30, 34, 38, 43, 47, 51, 55, 60, 64])
ETC_STEPS = np.array([[2, 8], [5, 17], [9, 29], [13, 42], [18, 60], [24, 80], [33, 106], [47, 183]])
EAC_STEPS = np.array(
    [[-3, -6, -9, -15, 2, 5, 8, 14], [-3, -7, -10, -13, 2, 6, 9, 12], [-2, -5, -8, -13, 1, 4, 7, 12], [-2, -4, -6, -13, 1, 3, 5, 12], [-3, -6, -8, -12, 2, 5, 7, 11], [-3, -7, -9, -11, 2, 6, 8, 10], [-4, -7, -8, -11, 3, 6, 7, 10], [-3, -5, -8, -11, 2, 4, 7, 10],
     [-2, -6, -8, -10, 1, 5, 7, 9], [-2, -5, -8, -10, 1, 4, 7, 9], [-2, -4, -8, -10, 1, 3, 7, 9], [-2, -5, -7, -10, 1, 4, 6, 9], [-3, -4, -7, -10, 2, 3, 6, 9], [-1, -2, -3, -10, 0, 1, 2, 9], [-4, -6, -8, -9, 3, 5, 7, 8], [-3, -5, -7, -9, 2, 4, 6, 8]]
)
#: ASTC block mode of a 4x4 grid of two-bit weights in one plane, and the endpoint mode of direct RGBA.
ASTC_MODE, ASTC_DIRECT_RGBA = 66, 12
# End of the fixed values.


def _little(fields: list[tuple[np.ndarray, int]]) -> np.ndarray:
    """Fields (value, bits), lowest first, to little-endian bytes."""
    bits = np.concatenate([(np.asarray(v)[:, None] >> np.arange(n)) & 1 for v, n in fields], axis=1)
    return np.packbits(bits.astype(np.uint8), axis=1, bitorder="little")


def _big(fields: list[tuple[np.ndarray, int]]) -> np.ndarray:
    """Fields (value, bits), highest first, to big-endian bytes."""
    bits = np.concatenate([(np.asarray(v)[:, None] >> np.arange(n - 1, -1, -1)) & 1 for v, n in fields], axis=1)
    return np.packbits(bits.astype(np.uint8), axis=1)


def _take(bits: np.ndarray, at: int, n: int, high_first: bool = False) -> np.ndarray:
    part = bits[:, at : at + n].astype(np.int64)
    return (part << (np.arange(n)[::-1] if high_first else np.arange(n))).sum(axis=1)


def principal_ends(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texels furthest apart along the main axis of each block's values (n, texels, channels)."""
    d = c - c.mean(axis=1, keepdims=True)
    axis = np.linalg.eigh(np.einsum("nik,nil->nkl", d, d))[1][:, :, -1]
    t, rows = np.einsum("nik,nk->ni", d, axis), np.arange(len(c))
    return c[rows, t.argmin(axis=1)], c[rows, t.argmax(axis=1)]


# signed BC4: two endpoints in -127..127 and six values between them
def _bc4s_palette(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    hi, lo = np.maximum(hi, -127).astype(float), np.maximum(lo, -127).astype(float)
    eight = np.stack([hi, lo, *[((7 - k) * hi + k * lo) / 7 for k in range(1, 7)]], axis=1)
    six = np.stack([hi, lo, *[((5 - k) * hi + k * lo) / 5 for k in range(1, 5)], np.full(len(hi), -127.0), np.full(len(hi), 127.0)], axis=1)
    return np.where((hi > lo)[:, None], eight, six)


def encode_bc4s(px: np.ndarray) -> np.ndarray:
    """(n, 16) int8."""
    px = np.maximum(px.astype(np.int64), -127)
    hi, lo = px.max(axis=1), px.min(axis=1)
    pick = np.abs(px[:, :, None] - _bc4s_palette(hi, lo)[:, None, :]).argmin(axis=2)
    return _little([(hi & 255, 8), (lo & 255, 8), *[(pick[:, i], 3) for i in range(16)]])


def decode_bc4s(b: np.ndarray) -> np.ndarray:
    ends, bits = b[:, :2].view(np.int8), np.unpackbits(b, axis=1, bitorder="little")
    pick = np.stack([_take(bits, 16 + 3 * i, 3) for i in range(16)], axis=1)
    return np.take_along_axis(np.rint(_bc4s_palette(ends[:, 0], ends[:, 1])), pick, axis=1).astype(np.int8)


def encode_bc5s(px: np.ndarray) -> np.ndarray:
    return np.column_stack((encode_bc4s(px[:, :, 0]), encode_bc4s(px[:, :, 1])))


def decode_bc5s(b: np.ndarray) -> np.ndarray:
    return np.dstack((decode_bc4s(np.ascontiguousarray(b[:, :8])), decode_bc4s(np.ascontiguousarray(b[:, 8:]))))


# BC6H, the mode of one subset with ten-bit endpoints as they are
def _bc6h_open(x: np.ndarray, signed: bool) -> np.ndarray:
    """Endpoint codes to the sixteen-bit range that is interpolated in."""
    if not signed:
        return np.where(x == 0, 0, np.where(x == 1023, 0xFFFF, ((x << 16) + 0x8000) >> 10))
    a = np.abs(x)
    return np.sign(x) * np.where(a == 0, 0, np.where(a >= 511, 0x7FFF, ((a << 15) + 0x4000) >> 9))


def _bc6h_close(v: np.ndarray, signed: bool) -> np.ndarray:
    """Interpolated values to the bits of a half."""
    if not signed:
        return v * 31 >> 6
    return np.where(v < 0, 0x8000 | (-v * 31 >> 5), v * 31 >> 5)


def _bc6h_palette(e0: np.ndarray, e1: np.ndarray, signed: bool) -> np.ndarray:
    a, b = (_bc6h_open(e, signed)[:, None, :] for e in (e0, e1))
    w = WEIGHTS4[None, :, None]
    return (a * (64 - w) + b * w + 32) >> 6


def encode_bc6h(half: np.ndarray, signed: bool = False) -> np.ndarray:
    """(n, 16, 3 or 4) bits of halves. NaN counts as 0, infinity as the largest half; unsigned, negative values as 0."""
    h = half[:, :, :3].astype(np.int64)
    m = h & 0x7FFF
    m = np.where(m > 0x7C00, 0, np.minimum(m, 0x7BFF))
    value = np.where(h & 0x8000, -m if signed else 0, m)
    want = value * (32 if signed else 64) / 31
    top = 511 if signed else 1023
    scale = 0x7FFF if signed else 0xFFFF
    ends = [np.clip(np.rint(e * top / scale), -top if signed else 0, top).astype(np.int64) for e in principal_ends(want)]
    pal = _bc6h_palette(ends[0], ends[1], signed).astype(float)
    pick = ((want[:, :, None, :] - pal[:, None, :, :]) ** 2).sum(axis=3).argmin(axis=2)
    swap = pick[:, 0] >= 8  # the first index has three bits
    pick = np.where(swap[:, None], 15 - pick, pick)
    e0, e1 = np.where(swap[:, None], ends[1], ends[0]) & 1023, np.where(swap[:, None], ends[0], ends[1]) & 1023
    fields = [(np.full(len(h), 3), 5), *[(e[:, k], 10) for e in (e0, e1) for k in range(3)], (pick[:, 0], 3), *[(pick[:, i], 4) for i in range(1, 16)]]
    return _little(fields)


def decode_bc6h(b: np.ndarray, signed: bool = False) -> np.ndarray:
    """(n, 16, 3) bits of halves."""
    bits = np.unpackbits(b, axis=1, bitorder="little")
    if (_take(bits, 0, 5) != 3).any():
        raise CodecError("only BC6H blocks of one subset with plain ten-bit endpoints are decoded")
    e = [np.stack([_take(bits, 5 + 30 * s + 10 * k, 10) for k in range(3)], axis=1) for s in (0, 1)]
    e = [x - ((x >> 9) << 10) for x in e] if signed else e
    pick = np.stack([_take(bits, 65, 3), *[_take(bits, 68 + 4 * i, 4) for i in range(15)]], axis=1)
    return _bc6h_close(np.take_along_axis(_bc6h_palette(e[0], e[1], signed), pick[:, :, None], axis=1), signed).astype(np.uint16)


# ETC and EAC: texels run down the columns, bits from the top
_DOWN = np.array([4 * (i % 4) + i // 4 for i in range(16)])


def encode_etc1(px: np.ndarray) -> np.ndarray:
    """(n, 16, 3 or 4) uint8: two halves of four bits a channel, side by side or one above the other, as fits better."""
    c = px[:, _DOWN, :3].astype(float)
    x, y = np.arange(16) // 4, np.arange(16) % 4
    best = None
    for flip, second in ((0, x >= 2), (1, y >= 2)):
        error, index, bases, tables = np.zeros(len(c)), np.zeros((len(c), 16), int), [], []
        for half in (~second, second):
            base = np.clip(np.rint(c[:, half].mean(axis=1) / 17), 0, 15).astype(int)
            steps = np.concatenate((ETC_STEPS, -ETC_STEPS), axis=1)  # +small, +large, -small, -large
            value = np.clip(base[:, None, None, :] * 17 + steps[None, :, :, None], 0, 255)
            off = ((c[:, half][:, None, :, None, :] - value[:, :, None, :, :]) ** 2).sum(axis=4)
            pick, cost = off.argmin(axis=3), off.min(axis=3).sum(axis=2)
            t = cost.argmin(axis=1)
            rows = np.arange(len(c))
            error += cost[rows, t]
            index[:, half] = pick[rows, t]
            bases.append(base)
            tables.append(t)
        found = error, np.full(len(c), flip), index, *bases, *tables
        best = found if best is None else tuple(np.where((found[0] < best[0]).reshape(-1, *[1] * (np.ndim(b) - 1)), f, b) for f, b in zip(found, best))
    _, flip, index, b0, b1, t0, t1 = best
    n = len(c)
    fields = [(v[:, k], 4) for k in range(3) for v in (b0, b1)] + [(t0, 3), (t1, 3), (np.zeros(n, int), 1), (flip, 1)]
    fields += [(index[:, i] >> s & 1, 1) for s in (1, 0) for i in range(15, -1, -1)]
    return _big(fields)


def decode_etc1(b: np.ndarray) -> np.ndarray:
    """(n, 16, 4): halves of four bits, or of five with a difference that stays in range."""
    bits = np.unpackbits(b, axis=1)
    diff, flip = _take(bits, 30, 1, True) == 1, _take(bits, 31, 1, True)
    five, delta = (np.stack([_take(bits, 8 * k + s, n, True) for k in range(3)], axis=1) for s, n in ((0, 5), (5, 3)))
    other = five + delta - (delta >> 2 << 3)
    if (diff[:, None] & ((other < 0) | (other > 31))).any():
        raise CodecError("ETC2 blocks of the T, H and planar kinds are not decoded")
    four = [np.stack([_take(bits, 8 * k + 4 * s, 4, True) for k in range(3)], axis=1) * 17 for s in (0, 1)]
    wide = lambda v: v << 3 | v >> 2
    base = [np.where(diff[:, None], wide(f), q) for f, q in ((five, four[0]), (np.clip(other, 0, 31), four[1]))]
    table = [_take(bits, 24 + 3 * s, 3, True) for s in (0, 1)]
    x, y = np.arange(16) // 4, np.arange(16) % 4
    second = np.where(flip[:, None] == 1, y >= 2, x >= 2)
    index = np.stack([_take(bits, 63 - i, 1) + 2 * _take(bits, 47 - i, 1) for i in range(16)], axis=1)
    steps = np.concatenate((ETC_STEPS, -ETC_STEPS), axis=1)
    step = np.where(second, steps[table[1][:, None], index], steps[table[0][:, None], index])
    rgb = np.clip(np.where(second[:, :, None], base[1][:, None, :], base[0][:, None, :]) + step[:, :, None], 0, 255)
    return np.dstack((rgb, np.full((len(b), 16), 255))).astype(np.uint8)[:, _DOWN]  # the order is its own inverse


def encode_eac(px: np.ndarray, eleven: bool = False) -> np.ndarray:
    """(n, 16) uint8 as an alpha block, or as the eleven-bit red one."""
    v = px[:, _DOWN].astype(float)
    v, unit, shift = (v * 2047 / 255, 8, 4) if eleven else (v, 1, 0)
    top = 2047 if eleven else 255
    lo, hi, best = v.min(axis=1), v.max(axis=1), None
    for t, steps in enumerate(EAC_STEPS):
        mult = np.clip(np.rint((hi - lo) / ((steps.max() - steps.min()) * unit)), 1, 15).astype(int)
        middle = (hi + lo) / 2 - mult * unit * (steps.max() + steps.min()) / 2
        base = np.clip(np.rint((middle - shift) / unit), 0, 255).astype(int)
        value = np.clip(base[:, None] * unit + shift + steps[None, :] * mult[:, None] * unit, 0, top)
        off = (v[:, :, None] - value[:, None, :]) ** 2
        found = off.min(axis=2).sum(axis=1), base, mult, np.full(len(v), t), off.argmin(axis=2)
        best = found if best is None else tuple(np.where((found[0] < best[0]).reshape(-1, *[1] * (np.ndim(b) - 1)), f, b) for f, b in zip(found, best))
    _, base, mult, table, index = best
    return _big([(base, 8), (mult, 4), (table, 4), *[(index[:, i], 3) for i in range(16)]])


def decode_eac(b: np.ndarray, eleven: bool = False) -> np.ndarray:
    """(n, 16): eight-bit alpha, or eleven-bit red."""
    bits = np.unpackbits(b, axis=1)
    base, mult, table = (_take(bits, at, n, True) for at, n in ((0, 8), (8, 4), (12, 4)))
    step = EAC_STEPS[table[:, None], np.stack([_take(bits, 16 + 3 * i, 3, True) for i in range(16)], axis=1)]
    if eleven:
        out = np.clip(base[:, None] * 8 + 4 + np.where(mult[:, None] == 0, step, step * mult[:, None] * 8), 0, 2047)
    else:
        out = np.clip(base[:, None] + step * mult[:, None], 0, 255)
    return out.astype(np.int64)[:, _DOWN]


# ASTC: one partition, direct RGBA endpoints, a grid of 4x4 weights of two bits for every footprint
@lru_cache(maxsize=32)
def infill(width: int, height: int) -> np.ndarray:
    """(texels, 16): sixteenths of the grid weights in each texel's weight."""
    out = np.zeros((width * height, 16))
    step = [(1024 + n // 2) // (n - 1) for n in (width, height)]
    for y in range(height):
        for x in range(width):
            gs, gt = ((d * k * 3 + 32) >> 6 for d, k in zip(step, (x, y)))
            (js, fs), (jt, ft) = divmod(gs, 16), divmod(gt, 16)
            both = (fs * ft + 8) >> 4
            for dx, dy, w in ((0, 0, 16 - fs - ft + both), (1, 0, fs - both), (0, 1, ft - both), (1, 1, both)):
                if w:
                    out[y * width + x, min(js + dx, 3) + 4 * min(jt + dy, 3)] += w
    return out


def _astc_weights(grid: np.ndarray, width: int, height: int) -> np.ndarray:
    w = np.array([0, 21, 43, 64])[grid]
    return ((w @ infill(width, height).T).astype(np.int64) + 8) >> 4


def encode_astc(px: np.ndarray, width: int, height: int) -> np.ndarray:
    """(n, width * height, 4) uint8."""
    c = px.astype(float)
    e0, e1 = (np.rint(e).astype(np.int64) for e in principal_ends(c))
    turn = (e1[:, :3].sum(axis=1) < e0[:, :3].sum(axis=1))[:, None]  # the other order means something else
    e0, e1 = np.where(turn, e1, e0), np.where(turn, e0, e1)
    d = (e1 - e0).astype(float)
    t = np.einsum("nik,nk->ni", c - e0[:, None, :], d) / np.maximum((d * d).sum(axis=1), 1e-9)[:, None]
    grid = np.clip(t, 0, 1) @ np.linalg.pinv(infill(width, height) / 16).T
    grid = np.clip(np.rint(grid * 3), 0, 3).astype(np.int64)
    n = len(c)
    fields = [(np.full(n, ASTC_MODE), 11), (np.zeros(n, int), 2), (np.full(n, ASTC_DIRECT_RGBA), 4), *[(e[:, k], 8) for k in range(4) for e in (e0, e1)], (np.zeros(n, int), 15)]
    fields += [(grid[:, i] >> s & 1, 1) for i in range(15, -1, -1) for s in (1, 0)]  # weights run down from the top bit
    return _little(fields)


def decode_astc(b: np.ndarray, width: int, height: int) -> np.ndarray:
    bits = np.unpackbits(b, axis=1, bitorder="little")
    if (_take(bits, 0, 13) != ASTC_MODE).any() or (_take(bits, 13, 4) != ASTC_DIRECT_RGBA).any():
        raise CodecError("only ASTC blocks of one partition with direct RGBA endpoints and a 4x4 grid of two bits are decoded")
    v = np.stack([_take(bits, 17 + 8 * k, 8) for k in range(8)], axis=1)
    e0, e1 = v[:, 0::2], v[:, 1::2]
    if (e1[:, :3].sum(axis=1) < e0[:, :3].sum(axis=1)).any():
        raise CodecError("ASTC endpoints in the contracted order are not decoded")
    grid = np.stack([bits[:, 127 - 2 * i].astype(np.int64) + 2 * bits[:, 126 - 2 * i] for i in range(16)], axis=1)
    w = _astc_weights(grid, width, height)[:, :, None]
    return (((e0 * 257)[:, None, :] * (64 - w) + (e1 * 257)[:, None, :] * w + 32) >> 6 >> 8).astype(np.uint8)
