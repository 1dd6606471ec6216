"""Standard images without further libraries: PNG (all colour types, 8 and 16 bits, interlaced or not) and Radiance HDR.

The colour type decides the format: grey R8 or R16, grey with alpha R8G8 or R16G16
(a colour format: its second lane is no alpha), RGB R8G8B8, RGBA R8G8B8A8, with 16
bits R16G16B16 as RGBA; palettes become RGB or RGBA. Integers count as sRGB, floats as linear.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

PNG = bytes.fromhex("89504e470d0a1a0a")
MOST_PIXELS = 1 << 28
#: Channels of a PNG colour type, and the start and step (x, y) of the passes of an interlaced one.
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
PASSES = [(0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)]


class ImageError(ValueError):
    """Bytes that are no image, or a broken one."""


def _unfilter(raw: bytes, rows: int, row: int, size: int) -> np.ndarray:
    """Undoes the filters of rows of ``row`` bytes whose pixels take ``size``."""
    out, at = np.zeros((rows + 1, row), np.uint8), 0
    for y in range(1, rows + 1):
        kind, line, up = raw[at], np.frombuffer(raw, np.uint8, row, at + 1), out[y - 1]
        at += row + 1
        if kind == 0:
            out[y] = line
        elif kind == 2:
            out[y] = line + up
        elif kind == 1:
            pad = np.concatenate((line, np.zeros(-row % size, np.uint8))).reshape(-1, size)
            out[y] = np.cumsum(pad, axis=0, dtype=np.uint8).reshape(-1)[:row]
        elif kind in (3, 4):
            left, corner, cur = [0] * size, [0] * size, bytearray(row)
            for x, (v, b) in enumerate(zip(line.tolist(), up.tolist())):
                a, c = left[x % size], corner[x % size]
                if kind == 3:
                    p = (a + b) >> 1
                else:
                    da, db, dc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    p = a if da <= db and da <= dc else b if db <= dc else c
                cur[x] = left[x % size] = (v + p) & 255
                corner[x % size] = b
            out[y] = np.frombuffer(bytes(cur), np.uint8)
        else:
            raise ImageError(f"unknown PNG filter {kind}")
    return out[1:]


def read_png(data: bytes) -> tuple[str, int, int, bytes]:
    """(format, width, height, bytes), 16-bit samples little-endian."""
    if data[:8] != PNG:
        raise ImageError("not a PNG file")
    at, packed, head, palette, clear = 8, [], None, None, b""
    while at + 12 <= len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + n]
        if len(body) < n or at + 12 + n > len(data) or zlib.crc32(kind + body) != struct.unpack_from(">I", data, at + 8 + n)[0]:
            raise ImageError(f"the PNG chunk {kind!r} is broken")
        if kind == b"IHDR" and n == 13:
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body[: n // 3 * 3], np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            clear = body
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + n
        if kind == b"IEND":
            break
    if head is None:
        raise ImageError("the PNG file has no header")
    w, h, bits, colour, _, _, lace = head
    if colour not in CHANNELS or not w or not h or w * h > MOST_PIXELS or bits not in (1, 2, 4, 8, 16) or bits < 8 and colour not in (0, 3) or colour == 3 and (palette is None or bits == 16):
        raise ImageError("unsupported PNG header")
    ch = CHANNELS[colour]
    parts = [p for p in PASSES if w > p[0] and h > p[1]] if lace else [(0, 0, 1, 1)]
    shapes = [(-(-(w - x) // dx), -(-(h - y) // dy)) for x, y, dx, dy in parts]
    want = sum(rows * (1 + -(-cols * ch * bits // 8)) for cols, rows in shapes)
    try:
        z = zlib.decompressobj()
        raw = z.decompress(b"".join(packed), want + 1)
    except zlib.error as e:
        raise ImageError(f"broken PNG data: {e}") from e
    if len(raw) < want:
        raise ImageError("PNG data is cut off")
    out, pos = np.zeros((h, w, ch), ">u2" if bits == 16 else np.uint8), 0
    for (x, y, dx, dy), (cols, rows) in zip(parts, shapes):
        row = -(-cols * ch * bits // 8)
        px = _unfilter(raw[pos : pos + rows * (row + 1)], rows, row, max(1, ch * bits // 8))
        pos += rows * (row + 1)
        if bits == 16:
            px = px.copy().view(">u2")
        elif bits < 8:
            px = np.unpackbits(px, axis=1).reshape(rows, -1, bits)
            px = (px << np.arange(bits - 1, -1, -1, dtype=np.uint8)).sum(axis=2, dtype=np.uint8)[:, : cols * ch]
        out[y::dy, x::dx] = px.reshape(rows, cols, ch)
    if colour == 3:
        if out.max(initial=0) >= len(palette):
            raise ImageError("a PNG index lies outside the palette")
        alpha = np.full(len(palette), 255, np.uint8)
        alpha[: len(clear)] = np.frombuffer(clear, np.uint8)[: len(palette)]
        table = np.column_stack((palette, alpha)) if clear else palette
        out = table[out[..., 0]]
    elif clear and colour in (0, 2):
        key = np.frombuffer(clear, ">u2")[:ch]
        top = 65535 if bits == 16 else (1 << bits) - 1
        out = np.dstack((out, np.where((out == key).all(axis=-1), 0, top).astype(out.dtype)))
    if bits < 8 and colour != 3:
        out = (out * (255 // ((1 << bits) - 1))).astype(np.uint8)
    n, wide = out.shape[2], "16" if bits == 16 else "8"
    name = "".join(c + wide for c in "RGBA"[:n]) + ("_UNORM" if bits == 16 else "_SRGB")
    return name, w, h, out.astype("<u2" if bits == 16 else np.uint8).tobytes()


def read_hdr(data: bytes) -> tuple[str, int, int, bytes]:
    """Radiance RGBE, plain or run-length coded, to R32G32B32_SFLOAT."""
    if not data.startswith((b"#?RADIANCE", b"#?RGBE")):
        raise ImageError("not a Radiance file")
    end = data.find(b"\n\n")
    stop = data.find(b"\n", end + 2)
    size = data[end + 2 : stop].split()
    if end < 0 or stop < 0 or len(size) != 4 or size[0] != b"-Y" or size[2] != b"+X" or not size[1].isdigit() or not size[3].isdigit():
        raise ImageError("unsupported Radiance header")
    h, w, at = int(size[1]), int(size[3]), stop + 1
    if not w or not h or w * h > MOST_PIXELS:
        raise ImageError("unsupported Radiance size")
    out = np.zeros((h, w, 4), np.uint8)
    try:
        for y in range(h):
            if 8 <= w < 32768 and data[at : at + 2] == b"\x02\x02" and (data[at + 2] << 8 | data[at + 3]) == w:
                at += 4
                for c in range(4):
                    x = 0
                    while x < w:
                        n = data[at]
                        if n > 128:
                            out[y, x : x + n - 128, c] = data[at + 1]
                            x, at = x + n - 128, at + 2
                        else:
                            if n == 0 or x + n > w:
                                raise ImageError("a broken Radiance run")
                            out[y, x : x + n, c] = np.frombuffer(data, np.uint8, n, at + 1)
                            x, at = x + n, at + 1 + n
            else:
                out[y] = np.frombuffer(data, np.uint8, 4 * w, at).reshape(w, 4)
                at += 4 * w
    except (IndexError, ValueError) as e:
        raise ImageError("Radiance data is cut off or broken") from e
    scale = np.where(out[..., 3] > 0, np.exp2(out[..., 3].astype(float) - 136), 0)
    return "R32G32B32_SFLOAT", w, h, (out[..., :3] * scale[..., None]).astype("<f4").tobytes()


def read_image(data: bytes) -> tuple[str, int, int, bytes] | None:
    """A standard image by its first bytes; None for other files."""
    if data[:8] == PNG:
        return read_png(data)
    return read_hdr(data) if data.startswith((b"#?RADIANCE", b"#?RGBE")) else None


def write_png(px: np.ndarray) -> bytes:
    """(height, width, 1 to 4) uint8 or uint16 pixels as a plain PNG file."""
    h, w, ch = px.shape
    colour = {1: 0, 2: 4, 3: 2, 4: 6}[ch]
    rows = px.astype(">u2").view(np.uint8).reshape(h, -1) if px.dtype.itemsize == 2 else px.reshape(h, -1)
    raw = np.concatenate((np.zeros((h, 1), np.uint8), rows), axis=1).tobytes()
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8 * px.dtype.itemsize, colour, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
