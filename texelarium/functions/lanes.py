"""Surface bytes to lanes and back, on NumPy arrays: every format that ``formats.classify`` knows.

Lanes are (height, width, 4): float32 or float64 on the float side, uint32 or
uint64 on the integer side, where signed values are sign-extended bit patterns.
Missing channels are 0 and missing alpha is 1.0 or the integer lane's maximum.
"""

from __future__ import annotations

import numpy as np

from ..plans import formats

DTYPE = {"f32": np.float32, "f64": np.float64, "u32": np.uint32, "u64": np.uint64}


class LaneError(ValueError):
    """Bytes that do not hold the surface they should, or a format without lanes."""


def eotf(x: np.ndarray) -> np.ndarray:
    x = np.clip(np.nan_to_num(x, nan=0.0), 0, 1)
    return np.where(x <= 0.04045, x / 12.92, ((x + 0.055) / 1.055) ** 2.4)


def oetf(x: np.ndarray) -> np.ndarray:
    x = np.clip(np.nan_to_num(x, nan=0.0), 0, 1)
    return np.where(x <= 0.0031308, x * 12.92, 1.055 * x ** (1 / 2.4) - 0.055)


def rows_of(data: bytes, width: int, height: int, size: int, stride: int | None = None) -> np.ndarray:
    """(height, width * size) bytes of a surface; its last row may lack the padding."""
    stride = stride or width * size
    need = stride * (height - 1) + width * size
    if width < 1 or height < 1 or stride < width * size or len(data) < need:
        raise LaneError(f"{len(data)} bytes do not hold {width}x{height} pixels of {size} bytes in rows of {stride}")
    flat = np.frombuffer(data, np.uint8)[:need]
    if stride == width * size:
        return flat.reshape(height, stride)
    return np.lib.stride_tricks.as_strided(flat, (height, width * size), (stride, 1))


def _scalars(name: str, kind: formats.Kind, raw: np.ndarray) -> np.ndarray:
    letter, bits = ("u", 8) if kind.family == "srgb" or kind.kind.startswith("bgr") else (kind.kind[0], int(kind.kind[1:]))
    px = np.ascontiguousarray(raw).view(f"<{letter}{bits // 8}").reshape(raw.shape[0], -1, kind.channels)
    return px[..., [2, 1, 0, 3][: kind.channels]] if kind.kind.startswith("bgr") else px


def _sign(v: np.ndarray, bits: int) -> np.ndarray:
    return v - ((v >> bits - 1) << bits)


def _small_float(code: np.ndarray, mantissa: int) -> np.ndarray:
    e, m = code >> mantissa, (code & (1 << mantissa) - 1).astype(np.float64)
    with np.errstate(divide="ignore", invalid="ignore"):
        top = np.where(m == 0, np.inf, np.nan)
    return np.where(e == 0, m * 2.0 ** (-14 - mantissa), np.where(e == 31, top, np.exp2(e - 15.0) * (1 + m / (1 << mantissa))))


def _to_small_float(x: np.ndarray, mantissa: int) -> np.ndarray:
    """Ties to even; negative values are 0, what is too large is infinity."""
    x = x.astype(np.float64)
    ok = np.isfinite(x) & (x > 0)
    safe = np.where(ok, x, 1.0)
    e = np.maximum(np.frexp(safe)[1] - 1, -14)
    m = np.rint(safe * np.exp2(mantissa - e.astype(np.float64))).astype(np.int64)
    code = ((e + 14).astype(np.int64) << mantissa) + m  # a carry, or a denormal, moves the exponent by itself
    code = np.where(ok, np.minimum(code, 31 << mantissa), 0)
    return np.where(np.isnan(x), (31 << mantissa) + 1, np.where(x == np.inf, 31 << mantissa, code))


def _words(kind: formats.Kind, w: np.ndarray) -> list[np.ndarray]:
    """Channel codes of packed words, red first."""
    w = w.astype(np.int64)
    if kind.kind.startswith("a2"):
        r, b = (0, 20) if kind.kind.startswith("a2b") else (20, 0)
        return [w >> r & 1023, w >> 10 & 1023, w >> b & 1023, w >> 30 & 3]
    if kind.kind.startswith("b10g11r11"):
        return [w & 2047, w >> 11 & 2047, w >> 22 & 1023]
    return [w & 511, w >> 9 & 511, w >> 18 & 511, w >> 27 & 31]


def _codes_to_float(kind: formats.Kind, codes: list[np.ndarray]) -> np.ndarray:
    if kind.kind.startswith("b10g11r11"):
        return np.stack([_small_float(codes[0], 6), _small_float(codes[1], 6), _small_float(codes[2], 5)], -1)
    if kind.kind.startswith("e5b9g9r9"):
        return np.stack([c * np.exp2(codes[3] - 24.0) for c in codes[:3]], -1)
    bits = (10, 10, 10, 2)
    if kind.family == "snorm":
        return np.stack([np.maximum(_sign(c, b) / ((1 << b - 1) - 1), -1.0) for c, b in zip(codes, bits)], -1)
    return np.stack([c / ((1 << b) - 1) for c, b in zip(codes, bits)], -1)


def load(data: bytes, width: int, height: int, vk_format: str, srgb: bool = False, alpha: str = "opaque", lane: str = "f32", stride: int | None = None) -> np.ndarray:
    """Lanes of a surface: linear, and premultiplied where ``alpha`` is straight (float side only)."""
    kind = formats.classify(vk_format, srgb)
    if kind is None:
        raise LaneError(f"{vk_format} is not loaded as pixels")
    size = formats.BY_NAME[vk_format][4]
    raw = rows_of(data, width, height, size, stride)
    packed = "PACK32" in vk_format
    integer = kind.family in ("uint", "sint")
    if integer != lane.startswith("u"):
        raise LaneError(f"{vk_format} has no {lane} lanes")
    out = np.zeros((height, width, 4), DTYPE[lane])
    out[..., 3] = np.iinfo(DTYPE[lane]).max if integer else 1
    if packed:
        codes = _words(kind, np.ascontiguousarray(raw).view("<u4").reshape(height, width))
        if integer:
            codes = [_sign(c, b) for c, b in zip(codes, (10, 10, 10, 2))] if kind.family == "sint" else codes
            px = np.stack(codes, -1)
        else:
            px = _codes_to_float(kind, codes)
    else:
        px = _scalars(vk_format, kind, raw)
        if kind.family in ("unorm", "srgb"):
            px = px / np.float64(np.iinfo(px.dtype).max)
        elif kind.family == "snorm":
            px = np.maximum(px / np.float64(np.iinfo(px.dtype).max), -1.0)
    with np.errstate(over="ignore"):
        # signed values go through the lane's own width, so that they are sign-extended
        out[..., : kind.channels] = px.astype(np.int64).astype(DTYPE[lane]) if integer and px.dtype.kind == "i" else px
    if integer:
        return out
    if srgb:
        out[..., :3] = eotf(out[..., :3].astype(np.float64))
    if alpha == "straight":
        out[..., :3] *= out[..., 3:]
    return out


def half_away(x: np.ndarray) -> np.ndarray:
    return np.where(x < 0, -np.floor(-x + 0.5), np.floor(x + 0.5))


def _unit(x: np.ndarray, low: float = 0.0) -> np.ndarray:
    return np.clip(np.where(np.isnan(x), low if low == 0 else 0, x), low, 1.0).astype(np.float64)


def _shared_exponent(rgb: np.ndarray) -> np.ndarray:
    x = np.clip(np.nan_to_num(rgb.astype(np.float64), nan=0.0, posinf=65408.0), 0, 65408)
    top = x.max(-1)
    e = np.where(top < 2.0**-15, 0, np.frexp(np.maximum(top, 2.0**-15))[1] + 15)
    e = e + (np.floor(top / np.exp2(e - 24.0) + 0.5) >= 512)
    m = np.floor(x / np.exp2(e - 24.0)[..., None] + 0.5).astype(np.int64)
    return m[..., 0] | m[..., 1] << 9 | m[..., 2] << 18 | e.astype(np.int64) << 27


def _clamp_int(lanes: np.ndarray, bits: int, signed: bool) -> np.ndarray:
    if signed:
        v = lanes.view(np.int32 if lanes.dtype == np.uint32 else np.int64)
        return np.clip(v, -(1 << bits - 1), (1 << bits - 1) - 1)
    return np.minimum(lanes, (1 << bits) - 1)


def store(lanes: np.ndarray, vk_format: str, srgb: bool = False, alpha: str = "opaque") -> bytes:
    """Tightly packed bytes of lanes; unpremultiplied first where ``alpha`` is straight (float side only)."""
    kind = formats.classify(vk_format, srgb)
    if kind is None:
        raise LaneError(f"{vk_format} is not stored as pixels")
    integer = kind.family in ("uint", "sint")
    if integer != (lanes.dtype.kind == "u"):
        raise LaneError(f"{vk_format} does not take {lanes.dtype} lanes")
    packed, n = "PACK32" in vk_format, kind.channels
    if integer:
        signed = kind.family == "sint"
        lanes = np.ascontiguousarray(lanes)
        if packed:
            c = [_clamp_int(np.ascontiguousarray(lanes[..., k]), b, signed).astype(np.int64) & (1 << b) - 1 for k, b in enumerate((10, 10, 10, 2))]
            return _pack_a2(kind, c)
        bits = int(kind.kind[1:])
        if bits >= lanes.dtype.itemsize * 8:
            return np.ascontiguousarray(lanes[..., :n]).view(f"<{'i' if signed else 'u'}{bits // 8}").tobytes()
        return _clamp_int(lanes, bits, signed)[..., :n].astype(f"<{'i' if signed else 'u'}{bits // 8}").tobytes()
    x = lanes.astype(lanes.dtype, copy=True)
    if alpha == "straight":
        with np.errstate(invalid="ignore", divide="ignore"):
            x[..., :3] /= np.where(x[..., 3:] > 0, x[..., 3:], 1)
    if srgb:
        x[..., :3] = oetf(x[..., :3].astype(np.float64))
    if packed:
        if kind.kind.startswith("e5"):
            return _shared_exponent(x[..., :3]).astype("<u4").tobytes()
        if kind.kind.startswith("b10"):
            c = [_to_small_float(x[..., k], m) for k, m in enumerate((6, 6, 5))]
            return (c[0] | c[1] << 11 | c[2] << 22).astype("<u4").tobytes()
        if kind.family == "snorm":
            c = [half_away(_unit(x[..., k], -1.0) * ((1 << b - 1) - 1)).astype(np.int64) & (1 << b) - 1 for k, b in enumerate((10, 10, 10, 2))]
        else:
            c = [half_away(_unit(x[..., k]) * ((1 << b) - 1)).astype(np.int64) for k, b in enumerate((10, 10, 10, 2))]
        return _pack_a2(kind, c)
    x = x[..., :n]
    if kind.kind[0] == "f":
        with np.errstate(over="ignore"):
            return x.astype(f"<f{int(kind.kind[1:]) // 8}").tobytes()
    if kind.family == "srgb":  # ties to even; alpha is no colour
        v = _unit(x) * 255
        v = np.where(np.arange(n) < 3, np.rint(v), half_away(v)).astype(np.uint8)
    elif kind.family == "snorm":
        bits = int(kind.kind[1:])
        v = half_away(_unit(x, -1.0) * ((1 << bits - 1) - 1)).astype(f"<i{bits // 8}")
    else:
        bits = 8 if kind.kind.startswith("bgr") else int(kind.kind[1:])
        v = half_away(_unit(x) * ((1 << bits) - 1)).astype(f"<u{bits // 8}")
    return (v[..., [2, 1, 0, 3][:n]] if kind.kind.startswith("bgr") else v).tobytes()


def _pack_a2(kind: formats.Kind, c: list[np.ndarray]) -> bytes:
    r, b = (0, 20) if kind.kind.startswith("a2b") else (20, 0)
    return (c[0] << r | c[1] << 10 | c[2] << b | c[3] << 30).astype("<u4").tobytes()


def swizzle(lanes: np.ndarray, pattern: str) -> np.ndarray:
    """Four of ``rgba01``; One is 1.0 or the integer lane's maximum."""
    pattern = pattern.lower()
    if len(pattern) != 4 or set(pattern) - set("rgba01"):
        raise LaneError(f"a swizzle is four of rgba01, not {pattern!r}")
    one = np.iinfo(lanes.dtype).max if lanes.dtype.kind == "u" else 1
    out = np.empty_like(lanes)
    for k, p in enumerate(pattern):
        out[..., k] = {"0": 0, "1": one}[p] if p in "01" else lanes[..., "rgba".index(p)]
    return out
