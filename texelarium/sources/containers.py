"""KTX2 and DDS containers: bytes to surfaces and back, and as Arrow-batched table functions.

A texture in memory is ``Texture``: format, kind, and surfaces[layer][mip] of
tightly packed bytes. Readers check sizes before they allocate: counts, offsets
and inflated lengths are bounded by what the header promises.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from math import lcm
from threading import get_ident

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.formats import _ASTC as ASTC_FOOTPRINTS
from ..plans.formats import BY_NAME, BY_VALUE, with_color_space
from .images import ImageError, read_image

KTX2 = bytes.fromhex("ab4b5458203230bb0d0a1a0a")
MOST_SURFACES, MOST_BYTES = 16384, 1 << 30
# DXGI numbers, and legacy pixel layouts of DDS files.
DXGI = {
    "R32G32B32A32_SFLOAT": 2, "R32G32B32A32_UINT": 3, "R32G32B32A32_SINT": 4, "R32G32B32_SFLOAT": 6, "R32G32B32_UINT": 7, "R32G32B32_SINT": 8, "R16G16B16A16_SFLOAT": 10, "R16G16B16A16_UNORM": 11, "R16G16B16A16_UINT": 12, "R16G16B16A16_SNORM": 13, "R16G16B16A16_SINT": 14,
    "R32G32_SFLOAT": 16, "R32G32_UINT": 17, "R32G32_SINT": 18, "A2B10G10R10_UNORM_PACK32": 24, "A2B10G10R10_UINT_PACK32": 25, "B10G11R11_UFLOAT_PACK32": 26, "R8G8B8A8_UNORM": 28, "R8G8B8A8_SRGB": 29, "R8G8B8A8_UINT": 30, "R8G8B8A8_SNORM": 31, "R8G8B8A8_SINT": 32,
    "R16G16_SFLOAT": 34, "R16G16_UNORM": 35, "R16G16_UINT": 36, "R16G16_SNORM": 37, "R16G16_SINT": 38, "R32_SFLOAT": 41, "R32_UINT": 42, "R32_SINT": 43, "R8G8_UNORM": 49, "R8G8_UINT": 50, "R8G8_SNORM": 51, "R8G8_SINT": 52, "R16_SFLOAT": 54, "R16_UNORM": 56, "R16_UINT": 57, "R16_SNORM": 58, "R16_SINT": 59,
    "R8_UNORM": 61, "R8_UINT": 62, "R8_SNORM": 63, "R8_SINT": 64, "E5B9G9R9_UFLOAT_PACK32": 67, "BC1_RGBA_UNORM": 71, "BC1_RGBA_SRGB": 72, "BC2_UNORM": 74, "BC2_SRGB": 75, "BC3_UNORM": 77, "BC3_SRGB": 78, "BC4_UNORM": 80, "BC4_SNORM": 81, "BC5_UNORM": 83, "BC5_SNORM": 84, "R5G6B5_UNORM_PACK16": 85, "A1R5G5B5_UNORM_PACK16": 86,
    "B8G8R8A8_UNORM": 87, "B8G8R8A8_SRGB": 91, "BC6H_UFLOAT": 95, "BC6H_SFLOAT": 96, "BC7_UNORM": 98, "BC7_SRGB": 99, "A4R4G4B4_UNORM_PACK16": 115,
}
#: ASTC's extension numbers: footprints in order, four apart, plain and sRGB next to each other.
DXGI_ASTC = 134
#: Four-character codes, and codes of float layouts.
FOURCC = {b"DXT1": "BC1_RGBA_SRGB", b"DXT2": "BC2_SRGB", b"DXT3": "BC2_SRGB", b"DXT4": "BC3_SRGB", b"DXT5": "BC3_SRGB", b"ATI1": "BC4_UNORM", b"BC4U": "BC4_UNORM", b"BC4S": "BC4_SNORM", b"ATI2": "BC5_UNORM", b"BC5U": "BC5_UNORM", b"BC5S": "BC5_SNORM"}
FOURCC_NUMBER = {36: "R16G16B16A16_UNORM", 110: "R16G16B16A16_SNORM", 111: "R16_SFLOAT", 112: "R16G16_SFLOAT", 113: "R16G16B16A16_SFLOAT", 114: "R32_SFLOAT", 115: "R32G32_SFLOAT", 116: "R32G32B32A32_SFLOAT"}
#: (bits, red, green, blue, alpha masks) of uncompressed layouts.
MASKS = {
    (32, 0xFF, 0xFF00, 0xFF0000, 0xFF000000): "R8G8B8A8_SRGB", (32, 0xFF, 0xFF00, 0xFF0000, 0): "R8G8B8A8_SRGB", (32, 0xFF0000, 0xFF00, 0xFF, 0xFF000000): "B8G8R8A8_SRGB", (32, 0xFF0000, 0xFF00, 0xFF, 0): "B8G8R8A8_SRGB", (32, 0x3FF, 0xFFC00, 0x3FF00000, 0xC0000000): "A2B10G10R10_UNORM_PACK32", (32, 0xFFFF, 0xFFFF0000, 0, 0): "R16G16_UNORM",
    (16, 0xF800, 0x7E0, 0x1F, 0): "R5G6B5_UNORM_PACK16", (16, 0x7C00, 0x3E0, 0x1F, 0x8000): "A1R5G5B5_UNORM_PACK16", (16, 0xF00, 0xF0, 0xF, 0xF000): "A4R4G4B4_UNORM_PACK16", (16, 0xFFFF, 0, 0, 0): "R16_UNORM", (16, 0xFF, 0, 0, 0xFF00): "R8G8_UNORM", (8, 0xFF, 0, 0, 0): "R8_UNORM", (8, 0, 0, 0, 0xFF): "R8_UNORM",
}
# End of the fixed values.
DXGI |= {f"ASTC_{w}x{h}_{k}": DXGI_ASTC + 4 * i + j for i, (w, h) in enumerate(ASTC_FOOTPRINTS) for j, k in enumerate(("UNORM", "SRGB"))}
_FROM_DXGI = {v: k for k, v in DXGI.items()}


class ContainerError(ValueError):
    """Bytes that are no container of the kind, or one that breaks a limit."""


@dataclass
class Texture:
    vk_format: str
    width: int
    height: int
    surfaces: list[list[bytes]] = field(default_factory=list)
    cube: bool = False
    premultiplied: bool = False
    #: Slices of a volume; its one layer has mips of all slices, each half as deep.
    depth: int = 1


@lru_cache(maxsize=65536)
def level_bytes(vk_format: str, width: int, height: int, mip: int, depth: int = 1) -> int:
    _, _, _, _, _, bw, bh, size, _ = BY_NAME[vk_format]
    return -(-max(1, width >> mip) // bw) * -(-max(1, height >> mip) // bh) * size * max(1, depth >> mip)


def detect(data: bytes) -> str | None:
    return "ktx2" if data[:12] == KTX2 else "dds" if data[:4] == b"DDS " else None


def validate(t: Texture) -> None:
    if t.vk_format not in BY_NAME:
        raise ContainerError(f"unknown format {t.vk_format}")
    if not t.surfaces or not t.surfaces[0]:
        raise ContainerError("a texture has at least one surface")
    if t.width < 1 or t.height < 1 or t.depth < 1:
        raise ContainerError("a texture has at least one texel")
    if t.cube and (len(t.surfaces) % 6 or t.width != t.height):
        raise ContainerError("a cubemap has six square faces a layer")
    if t.depth > 1 and (t.cube or len(t.surfaces) > 1):
        raise ContainerError("a volume is neither a cubemap nor an array")
    most = max(t.width, t.height, t.depth).bit_length()
    want = [level_bytes(t.vk_format, t.width, t.height, k, t.depth) for k in range(min(most, len(t.surfaces[0])))]
    for mips in t.surfaces:
        if len(mips) != len(t.surfaces[0]):
            raise ContainerError("all layers have the same number of mips")
        if len(mips) > most:
            raise ContainerError("more mips than a full chain has")
        have = list(map(len, mips))
        if have != want:
            k = next(k for k in range(len(want)) if have[k] != want[k])
            raise ContainerError(f"mip {k} has {have[k]} bytes, not {want[k]}")


@lru_cache(maxsize=32)
def _zstd(level: int | None, thread: int):
    """A thread's compressor of a level, or its decompressor; to make one costs more than to use it on a small texture."""
    import zstandard

    return zstandard.ZstdDecompressor() if level is None else zstandard.ZstdCompressor(level=level)


def _zstd_exact(data: bytes, size: int) -> bytes:
    """At most one byte more than ``size``, whatever the frame says of itself."""
    import zstandard

    try:
        with _zstd(None, get_ident()).stream_reader(data) as r:
            return r.read(size + 1)
    except zstandard.ZstdError as e:
        raise ContainerError(f"broken zstd data: {e}") from e


def _zlib_exact(data: bytes, size: int) -> bytes:
    try:
        z = zlib.decompressobj()
        out = z.decompress(data, size + 1)
        if len(out) == size and not z.eof:
            out += z.decompress(z.unconsumed_tail, 1)
        if len(out) <= size and not z.eof:
            raise ContainerError("zlib data is cut off")
        return out
    except zlib.error as e:
        raise ContainerError(f"broken zlib data: {e}") from e


def _zstd_pack(data: bytes, level: int) -> bytes:
    return _zstd(level, get_ident()).compress(data)


#: Colour models of the data format descriptor, and the channel numbers of a block's samples.
_MODELS = {"BC1": 128, "BC2": 129, "BC3": 130, "BC4": 131, "BC5": 132, "BC6H": 133, "BC7": 134, "ETC2": 161, "EAC": 161, "ASTC": 162}
_SAMPLES = {"BC2": (15, 0), "BC3": (15, 0), "BC5": (0, 1), "EAC_R11G11": (0, 1), "ETC2_R8G8B8A8": (15, 2), "ETC2_R8G8B8A1": (2,), "ETC2_R8G8B8": (2,)}


@lru_cache(maxsize=1024)
def descriptor(vk_format: str, premultiplied: bool, packed: bool) -> bytes:
    """The basic data format descriptor, with a sample for each channel or each part of a block."""
    _, _, family, channels, size, bw, bh, block, compressed = BY_NAME[vk_format]
    srgb, signed, is_float = family == "SRGB", family in ("SNORM", "SINT", "SFLOAT"), "FLOAT" in family
    stem = vk_format.rsplit("_", 1)[0]
    samples = []
    if compressed:
        model = next(v for k, v in _MODELS.items() if vk_format.startswith(k))
        parts = _SAMPLES.get(stem, _SAMPLES.get(stem.split("_")[0], (0,)))
        bits = block * 8 // len(parts)
        for k, c in enumerate(parts):
            samples.append((k * bits, bits, c | (0x40 if signed else 0) | (0x80 if is_float else 0), 0, 0xFFFFFFFF))
    else:
        model = 1
        ids = {"R": 0, "G": 1, "B": 2, "A": 15, "E": 0}
        names = [(c, int(n)) for c, n in re.findall(r"([RGBAE])(\d+)", vk_format.split("_")[0])]
        low_first = names if "PACK" not in vk_format else names[::-1]
        at = 0
        for c, n in low_first:
            kind = ids[c] | (0x40 if signed else 0) | (0x80 if is_float else 0) | (0x10 if srgb and c == "A" else 0)
            top = 0x3F800000 if is_float else (1 << min(32, n - (1 if family == "SNORM" else 0))) - 1 if family in ("UNORM", "SRGB", "SNORM") else 1
            samples.append((at, n, kind, 0, top))
            at += n
    head = struct.pack("<IHHBBBBBBBBBBBBBBBB", 0, 2, 24 + 16 * len(samples), model, 1, 2 if srgb else 1, int(premultiplied), bw - 1, bh - 1, 0, 0, block if packed else 0, *([0] * 7))
    body = b"".join(struct.pack("<HBBIII", a, n - 1, kind, 0, lo, hi) for a, n, kind, lo, hi in samples)
    return struct.pack("<I", 4 + len(head) + len(body)) + head + body


def write_ktx2(t: Texture, scheme: str | None = None, level: int = 6) -> bytes:
    """Levels stand smallest first, aligned to lcm(block, 4), or packed when supercompressed."""
    validate(t)
    mips = len(t.surfaces[0])
    raw = [b"".join(d) for d in zip(*t.surfaces)]
    pack = {None: lambda d: d, "zlib": lambda d: zlib.compress(d, level), "zstd": lambda d: _zstd_pack(d, level)}[scheme]
    stored = [pack(d) for d in raw]
    head, tail = _ktx2_head(t.vk_format, t.width, t.height, t.depth, len(t.surfaces), mips, t.cube, t.premultiplied, scheme)
    align = lcm(BY_NAME[t.vk_format][7], 4) if scheme is None else 1
    at, levels, parts = len(head) + 24 * mips + len(tail), [], []
    for k in reversed(range(mips)):
        gap = -at % align
        parts += b"\0" * gap, stored[k]
        levels.append(struct.pack("<3Q", at + gap, len(stored[k]), len(raw[k])))
        at += gap + len(stored[k])
    return b"".join((head, *reversed(levels), tail, *parts))


@lru_cache(maxsize=1024)
def _ktx2_head(vk_format: str, width: int, height: int, depth: int, surfaces: int, mips: int, cube: bool, premultiplied: bool, scheme: str | None) -> tuple[bytes, bytes]:
    """What stands before the index of levels and between it and the levels."""
    _, value, _, channels, size, _, _, _, compressed = BY_NAME[vk_format]
    faces = 6 if cube else 1
    layers = surfaces // faces
    dfd = descriptor(vk_format, premultiplied, scheme is None)
    unit = 1 if compressed else size if "PACK" in vk_format else max(1, size // channels)
    item = b"KTXwriter\0texelarium\0"
    kvd = struct.pack("<I", len(item)) + item + b"\0" * (-len(item) % 4)
    at = 80 + 24 * mips
    head = struct.pack("<9I", value, unit, width, height, depth if depth > 1 else 0, layers if layers > 1 else 0, faces, mips, {None: 0, "zstd": 2, "zlib": 3}[scheme])
    return KTX2 + head + struct.pack("<4I2Q", at, len(dfd), at + len(dfd), len(kvd), 0, 0), dfd + kvd


def read_ktx2(data: bytes) -> Texture:
    if data[:12] != KTX2 or len(data) < 80:
        raise ContainerError("not a KTX2 file")
    value, _, width, height, depth, layers, faces, mips, scheme = struct.unpack_from("<9I", data, 12)
    dfd_at, dfd_len = struct.unpack_from("<2I", data, 48)
    if value not in BY_VALUE:
        raise ContainerError(f"unsupported format {value}")
    if faces not in (1, 6) or faces == 6 and width != height or not width or not height or depth and (layers or faces == 6):
        raise ContainerError("unsupported shape")
    layers, mips, depth = max(1, layers), max(1, mips), max(1, depth)
    if mips > max(width, height, depth).bit_length() or layers * faces * mips > MOST_SURFACES or scheme not in (0, 2, 3):
        raise ContainerError("the header breaks a limit")
    name = BY_VALUE[value][0]
    sizes = [level_bytes(name, width, height, k, depth) for k in range(mips)]
    if sum(sizes) * layers * faces > MOST_BYTES or len(data) < 80 + 24 * mips:
        raise ContainerError("the texture is too large")
    out = Texture(name, width, height, [[] for _ in range(layers * faces)], faces == 6, depth=depth)
    if dfd_len >= 16 and dfd_at + 16 <= len(data):
        out.premultiplied = bool(data[dfd_at + 15] & 1)
    for k in range(mips):
        at, n, said = struct.unpack_from("<3Q", data, 80 + 24 * k)
        want = sizes[k] * layers * faces
        if at + n > len(data):
            raise ContainerError(f"level {k} lies outside the file")
        if said != want and (scheme or said):
            raise ContainerError(f"level {k} is said to have {said} bytes, not {want}")
        part = data[at : at + n]
        part = _zlib_exact(part, want) if scheme == 3 else _zstd_exact(part, want) if scheme == 2 else part
        if len(part) != want:
            raise ContainerError(f"level {k} has {'more' if len(part) > want else 'fewer'} bytes than {want}")
        for s, at in zip(out.surfaces, range(0, want, sizes[k])):
            s.append(part[at : at + sizes[k]])
    return out


def write_dds(t: Texture) -> bytes:
    """DX10 header; layers outside, mips inside; alpha mode unknown."""
    validate(t)
    if t.vk_format not in DXGI:
        raise ContainerError(f"DDS cannot hold {t.vk_format}")
    mips, compressed, volume = len(t.surfaces[0]), BY_NAME[t.vk_format][8], t.depth > 1
    flags = 0x1007 | (0x20000 if mips > 1 else 0) | (0x80000 if compressed else 0x8) | (0x800000 if volume else 0)
    pitch = level_bytes(t.vk_format, t.width, t.height, 0) if compressed else t.width * BY_NAME[t.vk_format][7]
    caps = 0x1000 | (0x400008 if mips > 1 or t.cube or volume else 0)
    caps2 = 0xFE00 if t.cube else 0x200000 if volume else 0
    head = struct.pack("<7I44x", 124, flags, t.height, t.width, pitch, t.depth if volume else 0, mips) + struct.pack("<2I4s5I", 32, 4, b"DX10", 0, 0, 0, 0, 0) + struct.pack("<5I", caps, caps2, 0, 0, 0)
    layers = len(t.surfaces) // (6 if t.cube else 1)
    return b"DDS " + head + struct.pack("<5I", DXGI[t.vk_format], 4 if volume else 3, 4 if t.cube else 0, layers, 0) + b"".join(d for s in t.surfaces for d in s)


def legacy_format(data: bytes) -> str:
    """The format of a header without the DX10 part: 8-bit colours count as sRGB, single channels and floats as linear."""
    flags, code, bits, *masks = struct.unpack_from("<I4s5I", data, 80)
    if flags & 4:
        found = FOURCC.get(code) or FOURCC_NUMBER.get(int.from_bytes(code, "little"))
    else:
        found = MASKS.get((bits, *masks[:3], masks[3] if flags & 3 else 0))
    if found is None:
        raise ContainerError("an unknown legacy pixel layout")
    return found


def read_dds(data: bytes) -> Texture:
    if data[:4] != b"DDS " or len(data) < 128:
        raise ContainerError("not a DDS file")
    height, width, depth, mips = (struct.unpack_from("<I", data, k)[0] for k in (12, 16, 24, 28))
    caps2, mips = struct.unpack_from("<I", data, 112)[0], max(1, mips)
    if data[84:88] == b"DX10" and struct.unpack_from("<I", data, 80)[0] & 4:
        if len(data) < 148:
            raise ContainerError("the header is cut off")
        dxgi, dim, misc, layers, _ = struct.unpack_from("<5I", data, 128)
        name, at, cube, volume = _FROM_DXGI.get(dxgi), 148, bool(caps2 & 0x200 or misc & 4), dim == 4
        if name is None or dim not in (3, 4):
            raise ContainerError(f"unsupported DXGI format {dxgi} or dimension {dim}")
    else:
        name, at, layers, cube, volume = legacy_format(data), 128, 1, bool(caps2 & 0x200), bool(caps2 & 0x200000)
    depth = max(1, depth) if volume else 1
    if not layers or not width or not height or volume and (cube or layers > 1) or cube and width != height:
        raise ContainerError("unsupported shape")
    if mips > max(width, height, depth).bit_length() or layers * 6 * mips > MOST_SURFACES * 6:
        raise ContainerError("the header breaks a limit")
    sizes = [level_bytes(name, width, height, k, depth) for k in range(mips)]
    if sum(sizes) * layers * (6 if cube else 1) > len(data) - at:
        raise ContainerError("the file is cut off")
    out = Texture(name, width, height, [], cube, depth=depth)
    for _ in range(layers * (6 if cube else 1)):
        mip_list = []
        for n in sizes:
            mip_list.append(data[at : at + n])
            at += n
        out.surfaces.append(mip_list)
    return out


@dataclass(frozen=True)
class Overrides:
    """What a caller knows better than the file; None keeps what the file says."""

    srgb: bool | None = None
    premultiplied: bool | None = None


def decode_as(data: bytes, kind: str, overrides: Overrides = Overrides()) -> Texture:
    """A container of a given kind; a colour space given rewrites the format's variant."""
    if kind not in ("ktx2", "dds"):
        raise ContainerError(f"no container is called {kind}")
    t = read_ktx2(data) if kind == "ktx2" else read_dds(data)
    if overrides.srgb is not None:
        t.vk_format = with_color_space(t.vk_format, overrides.srgb)
    if overrides.premultiplied is not None:
        t.premultiplied = overrides.premultiplied
    return t


def decode(data: bytes, overrides: Overrides = Overrides()) -> Texture | None:
    """A container or a standard image of any kind, known by its first bytes; None for other files."""
    kind = detect(data)
    if kind is not None:
        return decode_as(data, kind, overrides)
    try:
        found = read_image(data)
    except ImageError as e:
        raise ContainerError(str(e)) from e
    if found is None:
        return None
    name, w, h, pixels = found
    if overrides.srgb is not None:
        name = with_color_space(name, overrides.srgb)
    return Texture(name, w, h, [[pixels]], premultiplied=bool(overrides.premultiplied))


def encode(t: Texture, container: str = "ktx2", scheme: str | None = None, level: int | None = None) -> bytes:
    """``ktx2`` (plain, zstd 1 to 22, zlib 0 to 9), ``dds``, or ``raw``: the bytes of the first surface's chain as they are."""
    if container == "raw":
        validate(t)
        return b"".join(d for s in t.surfaces for d in s)
    if container == "dds":
        return write_dds(t)
    if container != "ktx2":
        raise ContainerError(f"no container is called {container}")
    return write_ktx2(t, scheme, 6 if level is None else level)


def resolve_container(path: str, given: str | None = None) -> str:
    """The container of a flag, or else of a path's extension."""
    found = (given or path.rsplit("/", 1)[-1].rpartition(".")[2]).lower()
    if found not in ("ktx2", "dds", "raw"):
        raise ContainerError(f"no container for {given or path!r}: name one of ktx2, dds, raw")
    return found


def check_output_not_input(output: str, inputs: list[str]) -> None:
    """An output may be none of the inputs, also not through a link."""
    import os

    for path in inputs:
        same = os.path.exists(output) and os.path.exists(path) and os.path.samefile(output, path)
        if same or os.path.realpath(output) == os.path.realpath(path):
            raise ContainerError(f"the output {output} is an input")


_KINDS = [("vk_format", pa.string()), ("layer", pa.int32()), ("mip", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("data", pa.binary()), ("error", pa.string()), ("depth", pa.int32())]
#: Bytes of files that are held before a batch is given on.
HELD = 16 << 20


@lru_cache(maxsize=256)
def _places(vk_format: str, width: int, height: int, depth: int, layers: int, mips: int) -> tuple[list, ...]:
    """Columns (vk_format, layer, mip, width, height, error, depth) of a texture's surfaces, layers outside."""
    at = [(s, k) for s in range(layers) for k in range(mips)]
    w, h, d = ([max(1, x >> k) for _, k in at] for x in (width, height, depth))
    return [vk_format] * len(at), [s for s, _ in at], [k for _, k in at], w, h, [None] * len(at), d


def read(files: DataFrame, overrides: Overrides = Overrides()) -> DataFrame:
    """(image_id, content) to one row per surface, slices of a volume together; a file that cannot be read, or a null, is one row with ``error``."""
    kind = files.schema["image_id"].dataType.simpleString()
    names = [n for n, _ in _KINDS]
    order = [names.index(n) for n in ("vk_format", "layer", "mip", "width", "height", "error", "depth", "data")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at: list[int] = []
            out: list[list] = [[] for _ in _KINDS]
            held = 0
            for n, data in enumerate(batch.column("content")):
                data = data.as_py()
                try:
                    t = None if data is None else decode(data, overrides)
                    if t is None:
                        raise ContainerError("no content" if data is None else "not a known container")
                    got = (*_places(t.vk_format, t.width, t.height, t.depth, len(t.surfaces), len(t.surfaces[0])), [d for mips in t.surfaces for d in mips])
                except (ContainerError, struct.error) as e:
                    got = (*[[None]] * 5, [str(e)], [None], [None])
                at += [n] * len(got[0])
                for k, values in zip(order, got):
                    out[k] += values
                held += len(data or b"")
                if held > HELD:
                    yield batch_of(batch, at, out)
                    at, out, held = [], [[] for _ in _KINDS], 0
            if at:
                yield batch_of(batch, at, out)

    def batch_of(batch: pa.RecordBatch, at: list[int], out: list[list]) -> pa.RecordBatch:
        ids = batch.column("image_id").take(pa.array(at))
        return pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, (_, t) in zip(out, _KINDS))], names=["image_id", *names])

    return files.select("image_id", "content").mapInArrow(run, f"image_id {kind}, vk_format string, layer int, mip int, width int, height int, data binary, error string, depth int")


def _images(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[int]]]:
    """Batches of whole images, of rows that come image by image, each with where its images begin and the last ends."""
    held: list[pa.RecordBatch] = []  # rows of the last image, which the next batch may go on with
    last = None
    for batch in batches:
        ids = batch.column("image_id")
        if not len(ids):
            continue
        if pa.types.is_integer(ids.type) and not ids.null_count:
            ids = ids.to_numpy()
            starts = [*([0] if ids[0] != last else []), *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist()]
        else:  # NaN is equal to itself here, as it is to Spark
            ids = ids.to_pylist()
            starts = [k for k, (a, b) in enumerate(zip([last, *ids], ids)) if a != b and (a == a or b == b)]
        if not held and (not starts or starts[0]):
            starts.insert(0, 0)
        last = ids[-1]
        if held and not starts:
            held.append(batch)
            continue
        cut = starts[-1]
        before = sum(b.num_rows for b in held)
        done = [*held, batch.slice(0, cut)] if cut else held
        if done:
            yield pa.concat_batches(done), [*([0] if held else []), *(before + k for k in starts)]
        held = [batch.slice(cut)]
    if held:
        yield pa.concat_batches(held), [0, sum(b.num_rows for b in held)]


def _bytes(column: pa.Array) -> list[bytes]:
    """The values of a binary column, nulls empty, cut from one copy of its buffer."""
    column = column.fill_null(b"")
    wide = pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    raw, low = (data.slice(int(at[0]), int(at[-1] - at[0])).to_pybytes(), int(at[0])) if data is not None and len(at) else (b"", 0)
    at = (at - low).tolist()
    return [raw[i:j] for i, j in zip(at, at[1:])]


def _layers(layer: np.ndarray, mip: np.ndarray, data: list[bytes]) -> list[list[bytes]]:
    """Surfaces of an image whose rows come by layer and mip."""
    layers: dict[int, list[bytes]] = {}
    for s, k, d in zip(layer.tolist(), mip.tolist(), data):
        if k != len(layers.setdefault(s, [])):
            raise ContainerError(f"layer {s} lacks a mip or has one twice")
        layers[s].append(d)
    if list(layers) != list(range(len(layers))):
        raise ContainerError("an image has one format and layers without gaps")
    return list(layers.values())


def write(surfaces: DataFrame, container: str = "ktx2", scheme: str | None = None, cube: bool = False, level: int | None = None, premultiplied: bool = False) -> DataFrame:
    """(image_id, vk_format, layer, mip, width, height, data[, depth]) to (image_id, content, error).

    The surfaces of a file, one image's, meet by one shuffle and a sort by image
    alone; files are then written as the rows pass, and many given on at once.
    """
    kind = surfaces.schema["image_id"].dataType.simpleString()
    depth = F.col("depth") if "depth" in surfaces.columns else F.lit(1)
    ints = [c.cast("int").alias(n) for n, c in (("layer", F.col("layer")), ("mip", F.col("mip")), ("width", F.col("width")), ("height", F.col("height")), ("depth", depth))]
    rows = surfaces.select("image_id", *ints, "vk_format", "data").repartition("image_id").sortWithinPartitions("image_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, content, errors, held = [], [], [], 0
        for batch, starts in _images(batches):
            layer, mip, width, height, deep = (batch.column(c).fill_null(missing).to_numpy() for c, missing in (("layer", -1), ("mip", -1), ("width", -1), ("height", -1), ("depth", 1)))
            begin, count = np.array(starts[:-1]), np.diff(starts)
            image = np.repeat(np.arange(len(begin)), count)
            order = np.lexsort((mip, layer, image))
            layer, mip, width, height, deep = (v[order] for v in (layer, mip, width, height, deep))
            format_of = batch.column("vk_format").dictionary_encode()
            names = [*format_of.dictionary.to_pylist(), None]
            code = format_of.indices.fill_null(len(names) - 1).to_numpy()[order]
            one_format = np.logical_and.reduceat(code == code[begin][image], begin).tolist()
            mips = np.add.reduceat((layer == 0).astype(np.int64), begin)
            # layers outside, each with as many mips; others are looked at one by one
            regular = np.logical_and.reduceat((layer >= 0) & (mip >= 0) & (mip < mips[image]) & (layer * mips[image] + mip == np.arange(len(image)) - begin[image]), begin) & (count % np.maximum(mips, 1) == 0)
            data_of = _bytes(batch.column("data"))
            data_of = [data_of[k] for k in order.tolist()]
            first = 0
            for n, (a, b, m, even, name, w, h, z) in enumerate(zip(starts, starts[1:], mips.tolist(), regular.tolist(), code[begin].tolist(), *(v[begin].tolist() for v in (width, height, deep)))):
                data, error = None, None
                try:
                    chain = [data_of[k : k + m] for k in range(a, b, m)] if even else _layers(layer[a:b], mip[a:b], data_of[a:b])
                    if not one_format[n]:
                        raise ContainerError("an image has one format and layers without gaps")
                    data = encode(Texture(names[name], w, h, chain, cube, premultiplied, z or 1), container, scheme, level)
                except ContainerError as e:
                    error = str(e)
                content.append(data)
                errors.append(error)
                held += len(data or b"")
                if held > HELD:
                    ids.append(batch.column("image_id").take(pa.array(starts[first : n + 1])))
                    yield batch_of(ids, content, errors)
                    first, ids, content, errors, held = n + 1, [], [], [], 0
            ids.append(batch.column("image_id").take(pa.array(starts[first:-1], pa.int64())))
        if content:
            yield batch_of(ids, content, errors)

    def batch_of(ids: list[pa.Array], content: list, errors: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.concat_arrays(ids), pa.array(content, pa.binary()), pa.array(errors, pa.string())], names=["image_id", "content", "error"])

    return rows.mapInArrow(run, f"image_id {kind}, content binary, error string")


def binary_files(spark, path: str) -> DataFrame:
    """Files of a folder that begin like a container: the magic is tested on the JVM side."""
    df = spark.read.format("binaryFile").load(path)
    magic = (F.substring("content", 1, 12) == F.lit(KTX2)) | (F.substring("content", 1, 4) == F.lit(b"DDS "))
    return df.filter(magic).select(F.col("path").alias("image_id"), "content")
