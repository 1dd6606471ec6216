"""Block codecs on NumPy arrays of blocks, and as Arrow-batched table functions.

Blocks are 4x4; encoders take (n, 16, channels) uint8 and give (n, bytes) uint8.
Blocks are valid and near their source (range fit); they are not meant to equal
any other encoder's bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..plans.formats import BY_NAME, normalize
from . import hdr_etc_astc as more
from .hdr_etc_astc import CodecError


def _bits(values: np.ndarray, width: int) -> np.ndarray:
    """(n, k) small integers to little-endian bit strings as bytes."""
    bits = (values[:, :, None] >> np.arange(width)) & 1
    return np.packbits(bits.reshape(len(values), -1).astype(np.uint8), axis=1, bitorder="little")


def _unbits(data: np.ndarray, width: int, count: int) -> np.ndarray:
    bits = np.unpackbits(data, axis=1, bitorder="little")[:, : width * count].reshape(len(data), count, width)
    return (bits.astype(np.int64) << np.arange(width)).sum(axis=2)


def _bc4_palette(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    hi, lo = hi.astype(np.int64), lo.astype(np.int64)
    eight = np.stack([hi, lo, *[((7 - k) * hi + k * lo) / 7 for k in range(1, 7)]], axis=1)
    six = np.stack([hi, lo, *[((5 - k) * hi + k * lo) / 5 for k in range(1, 5)], np.zeros(len(hi)), np.full(len(hi), 255)], axis=1)
    return np.floor(np.where((hi > lo)[:, None], eight, six) + 0.5)


def encode_bc4(px: np.ndarray) -> np.ndarray:
    """(n, 16) uint8; endpoints are the block's extremes."""
    hi, lo = px.max(axis=1), px.min(axis=1)
    pick = np.abs(px[:, :, None].astype(float) - _bc4_palette(hi, lo)[:, None, :]).argmin(axis=2)
    return np.column_stack((hi, lo, _bits(pick, 3)))


def decode_bc4(b: np.ndarray) -> np.ndarray:
    return np.take_along_axis(_bc4_palette(b[:, 0], b[:, 1]), _unbits(b[:, 2:8], 3, 16), axis=1).astype(np.uint8)


def _to565(c: np.ndarray) -> np.ndarray:
    q = np.floor(c / 255 * np.array([31, 63, 31]) + 0.5).astype(np.int64)
    return q[:, 0] << 11 | q[:, 1] << 5 | q[:, 2]


def _from565(v: np.ndarray) -> np.ndarray:
    r, g, b = v >> 11 & 31, v >> 5 & 63, v & 31
    return np.stack([r << 3 | r >> 2, g << 2 | g >> 4, b << 3 | b >> 2], axis=1).astype(float)


def _bc1_palette(c0: np.ndarray, c1: np.ndarray, opaque: bool) -> np.ndarray:
    a, b = _from565(c0), _from565(c1)
    four = np.stack([a, b, (2 * a + b) / 3, (a + 2 * b) / 3], axis=1)
    three = np.stack([a, b, (a + b) / 2, np.zeros_like(a)], axis=1)
    return four if opaque else np.where((c0 > c1)[:, None, None], four, three)


def encode_bc1(px: np.ndarray, opaque: bool = True) -> np.ndarray:
    """(n, 16, 3 or 4) uint8; endpoints at the extremes along the main axis, always in four-colour order."""
    c = px[:, :, :3].astype(float)
    d = c - c.mean(axis=1, keepdims=True)
    axis = np.linalg.eigh(np.einsum("nik,nil->nkl", d, d))[1][:, :, -1]
    t = np.einsum("nik,nk->ni", d, axis)
    rows = np.arange(len(c))
    c0, c1 = _to565(c[rows, t.argmax(axis=1)]), _to565(c[rows, t.argmin(axis=1)])
    c0, c1 = np.maximum(c0, c1), np.minimum(c0, c1)
    pal = _bc1_palette(c0, c1, True)
    pick = ((c[:, :, None, :] - pal[:, None, :, :]) ** 2).sum(axis=3).argmin(axis=2)
    pick[c0 == c1] = 0
    return np.column_stack((c0 & 255, c0 >> 8, c1 & 255, c1 >> 8, _bits(pick, 2))).astype(np.uint8)


def decode_bc1(b: np.ndarray, opaque: bool = False) -> np.ndarray:
    """(n, 16, 4); the transparent code of three-colour blocks has alpha 0."""
    v = b.astype(np.int64)
    c0, c1, pick = v[:, 0] | v[:, 1] << 8, v[:, 2] | v[:, 3] << 8, _unbits(b[:, 4:8], 2, 16)
    rgb = np.take_along_axis(_bc1_palette(c0, c1, opaque), pick[:, :, None], axis=1)
    clear = (pick == 3) & ((c0 <= c1)[:, None]) & (not opaque)
    return np.dstack((np.floor(rgb + 0.5), np.where(clear, 0, 255))).astype(np.uint8)


def encode_bc2(px: np.ndarray) -> np.ndarray:
    return np.column_stack((_bits(np.floor(px[:, :, 3] / 17 + 0.5).astype(np.int64), 4), encode_bc1(px)))


def decode_bc2(b: np.ndarray) -> np.ndarray:
    out = decode_bc1(b[:, 8:], opaque=True)
    out[:, :, 3] = _unbits(b[:, :8], 4, 16) * 17
    return out


def encode_bc3(px: np.ndarray) -> np.ndarray:
    return np.column_stack((encode_bc4(px[:, :, 3]), encode_bc1(px)))


def decode_bc3(b: np.ndarray) -> np.ndarray:
    out = decode_bc1(b[:, 8:], opaque=True)
    out[:, :, 3] = decode_bc4(b[:, :8])
    return out


def encode_bc5(px: np.ndarray) -> np.ndarray:
    return np.column_stack((encode_bc4(px[:, :, 0]), encode_bc4(px[:, :, 1])))


def decode_bc5(b: np.ndarray) -> np.ndarray:
    return np.dstack((decode_bc4(b[:, :8]), decode_bc4(b[:, 8:])))


#: Interpolation weights of four index bits.
WEIGHTS4 = np.array([0, 4, 9, 13, 17, 21, 26, 30, 34, 38, 43, 47, 51, 55, 60, 64])


def _bc7_palette(e0: np.ndarray, e1: np.ndarray) -> np.ndarray:
    return (e0[:, None, :] * (64 - WEIGHTS4)[None, :, None] + e1[:, None, :] * WEIGHTS4[None, :, None] + 32) >> 6


def encode_bc7(px: np.ndarray) -> np.ndarray:
    """Mode 6: one subset, RGBA endpoints of seven bits and a shared low bit, four-bit indices."""
    c = px.astype(float)
    d = c - c.mean(axis=1, keepdims=True)
    axis = np.linalg.eigh(np.einsum("nik,nil->nkl", d, d))[1][:, :, -1]
    t = np.einsum("nik,nk->ni", d, axis)
    rows = np.arange(len(c))
    ends, low = [], []
    for at in (t.argmin(axis=1), t.argmax(axis=1)):
        e = c[rows, at]
        q = [np.clip(np.floor((e - p) / 2 + 0.5), 0, 127).astype(np.int64) for p in (0, 1)]
        err = [((2 * x + p - e) ** 2).sum(axis=1) for p, x in enumerate(q)]
        p = (err[1] < err[0]).astype(np.int64)
        ends.append(np.where(p[:, None] == 1, q[1], q[0]))
        low.append(p)
    pal = _bc7_palette(2 * ends[0] + low[0][:, None], 2 * ends[1] + low[1][:, None])
    pick = ((c[:, :, None, :] - pal[:, None, :, :]) ** 2).sum(axis=3).argmin(axis=2)
    swap = pick[:, 0] >= 8  # the anchor's index has three bits
    pick = np.where(swap[:, None], 15 - pick, pick)
    e0, e1 = np.where(swap[:, None], ends[1], ends[0]), np.where(swap[:, None], ends[0], ends[1])
    p0, p1 = np.where(swap, low[1], low[0]), np.where(swap, low[0], low[1])
    bit = lambda v, w: ((v[:, None] >> np.arange(w)) & 1).astype(np.uint8)
    parts = [bit(np.full(len(c), 64), 7)]
    for k in range(4):
        parts += [bit(e0[:, k], 7), bit(e1[:, k], 7)]
    parts += [bit(p0, 1), bit(p1, 1), bit(pick[:, 0], 3), *[bit(pick[:, i], 4) for i in range(1, 16)]]
    return np.packbits(np.concatenate(parts, axis=1), axis=1, bitorder="little")


def decode_bc7(b: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(b, axis=1, bitorder="little").astype(np.int64)
    if (bits[:, :7] != [0, 0, 0, 0, 0, 0, 1]).any():
        raise CodecError("only mode 6 blocks are decoded")
    take = lambda at, w: (bits[:, at : at + w] << np.arange(w)).sum(axis=1)
    e = [np.stack([take(7 + 14 * k + 7 * s, 7) * 2 + bits[:, 63 + s] for k in range(4)], axis=1) for s in (0, 1)]
    pick = np.stack([take(65, 3), *[take(68 + 4 * i, 4) for i in range(15)]], axis=1)
    return np.take_along_axis(_bc7_palette(*e), pick[:, :, None], axis=1).astype(np.uint8)


CODECS = {"bc1": (encode_bc1, decode_bc1, 4), "bc2": (encode_bc2, decode_bc2, 4), "bc3": (encode_bc3, decode_bc3, 4), "bc4": (encode_bc4, decode_bc4, 1), "bc5": (encode_bc5, decode_bc5, 2), "bc7": (encode_bc7, decode_bc7, 4)}


#: Encoder, decoder, and the type and channels of the pixels, by format without its colour space.
BLOCKS = {
    **{f"{n.upper()}{k}_UNORM": (e, d, np.uint8, c) for n, (e, d, c) in CODECS.items() for k in ([""] if n != "bc1" else ["_RGBA"])},
    "BC1_RGB_UNORM": (encode_bc1, lambda b: decode_bc1(b, True), np.uint8, 4),
    "BC4_SNORM": (more.encode_bc4s, more.decode_bc4s, np.int8, 1),
    "BC5_SNORM": (more.encode_bc5s, more.decode_bc5s, np.int8, 2),
    "BC6H_UFLOAT": (more.encode_bc6h, more.decode_bc6h, np.uint16, 4),
    "BC6H_SFLOAT": (lambda px: more.encode_bc6h(px, True), lambda b: more.decode_bc6h(b, True), np.uint16, 4),
    "ETC2_R8G8B8_UNORM": (more.encode_etc1, more.decode_etc1, np.uint8, 4),
    "ETC2_R8G8B8A8_UNORM": (lambda px: np.column_stack((more.encode_eac(px[:, :, 3]), more.encode_etc1(px))), lambda b: np.dstack((more.decode_etc1(np.ascontiguousarray(b[:, 8:]))[:, :, :3], more.decode_eac(b[:, :8]))).astype(np.uint8), np.uint8, 4),
    "EAC_R11_UNORM": (lambda px: more.encode_eac(px, True), lambda b: more.decode_eac(b, True), np.uint8, 1),
    "EAC_R11G11_UNORM": (lambda px: np.column_stack([more.encode_eac(px[:, :, k], True) for k in (0, 1)]), lambda b: np.dstack([more.decode_eac(b[:, 8 * k : 8 * k + 8], True) for k in (0, 1)]), np.uint8, 2),
}


def tile_surface(data: bytes, width: int, height: int, channels: int, stride: int | None = None, dtype: type = np.uint8, block: tuple[int, int] = (4, 4)) -> np.ndarray:
    """Rows of a surface to (blocks, texels, channels), clamped to the edge; bytes that do not reach the last texel are an error."""
    tight = width * channels * np.dtype(dtype).itemsize
    stride = stride or tight
    if width < 1 or height < 1 or stride < tight or len(data) < stride * (height - 1) + tight:
        raise CodecError(f"{len(data)} bytes do not hold {width}x{height} pixels of {channels} channels")
    rows = np.lib.stride_tricks.as_strided(np.frombuffer(data, np.uint8), (height, tight), (stride, 1))
    rows = np.ascontiguousarray(rows).view(dtype).reshape(height, width, channels)
    bw, bh = block
    rows = np.pad(rows, ((0, -height % bh), (0, -width % bw), (0, 0)), mode="edge")
    h, w = rows.shape[0] // bh, rows.shape[1] // bw
    return rows.reshape(h, bh, w, bw, channels).transpose(0, 2, 1, 3, 4).reshape(h * w, bh * bw, channels)


def untile(px: np.ndarray, width: int, height: int, block: tuple[int, int] = (4, 4)) -> np.ndarray:
    """(blocks, texels, channels) back to (height, width, channels), without what was clamped."""
    bw, bh = block
    h, w = -(-height // bh), -(-width // bw)
    px = px.reshape(h, w, bh, bw, -1).transpose(0, 2, 1, 3, 4).reshape(h * bh, w * bw, -1)
    return px[:height, :width]


def _block(vk_format: str) -> tuple:
    base = normalize(vk_format)[0]
    if base.startswith("ASTC") and base.endswith("_UNORM"):
        w, h = BY_NAME[base][5:7]
        return (lambda px: more.encode_astc(px, w, h)), (lambda b: more.decode_astc(b, w, h)), np.uint8, 4
    if base not in BLOCKS:
        raise CodecError(f"no codec for {vk_format}")
    return BLOCKS[base]


def resolve_bc7_alpha(px: np.ndarray, mode: str = "auto") -> np.ndarray:
    """Opaque pixels where that is asked for; auto keeps alpha where any texel of the surface has some."""
    if mode not in ("auto", "opaque", "alpha"):
        raise CodecError(f"bc7_alpha is auto, opaque or alpha, not {mode!r}")
    if mode == "opaque" or mode == "auto" and (px[..., 3] == 255).all():
        px = px.copy()
        px[..., 3] = 255
    return px


def encode(data: bytes, width: int, height: int, vk_format: str, options: dict | None = None) -> bytes:
    """Pixels of the format that the encoder reads to blocks, row of blocks by row."""
    enc, _, dtype, channels = _block(vk_format)
    px = tile_surface(data, width, height, channels, dtype=dtype, block=BY_NAME[vk_format][5:7])
    if vk_format.startswith("BC7"):
        px = resolve_bc7_alpha(px, (options or {}).get("bc7_alpha", "auto"))
    return enc(px[:, :, 0] if channels == 1 else px).astype(np.uint8).tobytes()


def decode(data: bytes, width: int, height: int, vk_format: str) -> np.ndarray:
    """Blocks to (height, width, channels) codes: bytes, signed bytes, bits of halves, or eleven-bit values."""
    dec = _block(vk_format)[1]
    _, _, _, _, _, bw, bh, size, _ = BY_NAME[vk_format]
    n = -(-width // bw) * -(-height // bh)
    if len(data) != n * size:
        raise CodecError(f"{len(data)} bytes are not the {n} blocks of {width}x{height}")
    return untile(dec(np.frombuffer(data, np.uint8).reshape(n, size)).reshape(n, bw * bh, -1), width, height, (bw, bh))


def decode_surfaces(surfaces: DataFrame, vk_format: str) -> DataFrame:
    """(image_id, layer, mip, width, height, data): blocks to little-endian codes of all channels; a map."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(data=[(x := decode(d, w, h, vk_format)).astype(x.dtype.newbyteorder("<")).tobytes() for d, w, h in zip(pdf["data"], pdf["width"], pdf["height"])])

    cols = surfaces.select("image_id", "layer", "mip", "width", "height", "data")
    return cols.mapInPandas(run, cols.schema)


def encode_surfaces(surfaces: DataFrame, codec: str) -> DataFrame:
    """(image_id, layer, mip, width, height, data): pixel bytes to block bytes; a map over Arrow batches."""
    encode, _, channels = CODECS[codec]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for w, h, d in zip(pdf["width"], pdf["height"], pdf["data"]):
                px = tile_surface(d, w, h, channels)
                out.append(encode(px[:, :, 0] if channels == 1 else px).tobytes())
            yield pdf.assign(data=out)

    cols = surfaces.select("image_id", "layer", "mip", "width", "height", "data")
    return cols.mapInPandas(run, cols.schema)
