"""Every block format: encode and decode again within an error bound, any size, and refused input."""

import numpy as np
import pytest
from texelarium.operators import codecs
from texelarium.plans import formats

BOUND = {"BC1_RGB": 9, "BC1_RGBA": 9, "BC2": 9, "BC3": 9, "BC4": 3, "BC5": 3, "BC7": 6, "ETC2_R8G8B8": 16, "ETC2_R8G8B8A8": 16, "EAC_R11": 3, "EAC_R11G11": 3}


def _smooth(w, h, channels):
    y, x = np.mgrid[0:h, 0:w]
    return np.stack([(40 + 3 * x + 2 * y + 20 * k) % 256 for k in range(channels)], -1)


@pytest.mark.parametrize("size", [(16, 16), (13, 7), (1, 1)])
@pytest.mark.parametrize("name", [n for n, r in formats.BY_NAME.items() if r[8] and n.endswith("_UNORM") and n not in ("ETC2_R8G8B8A1_UNORM",)])
def test_unorm(name, size):
    w, h = size
    channels = codecs._block(name)[3]
    px = _smooth(w, h, channels).astype(np.uint8)
    data = codecs.encode(px.tobytes(), w, h, name)
    r = formats.BY_NAME[name]
    assert len(data) == -(-w // r[5]) * -(-h // r[6]) * r[7]
    got = codecs.decode(data, w, h, name).astype(float)
    got = got * 255 / 2047 if name.startswith("EAC") else got
    n = min(got.shape[2], 3 if name.startswith(("BC1", "ETC2_R8G8B8_")) else channels)
    limit = BOUND.get(name.rsplit("_", 1)[0], 4 + (r[5] - 3) * (r[6] - 3))
    assert np.abs(got[..., :n] - px[..., :n]).mean() <= limit


@pytest.mark.parametrize("name", ["BC4_SNORM", "BC5_SNORM"])
def test_snorm(name):
    c = 1 if "4" in name else 2
    px = (_smooth(8, 8, c) - 128).clip(-127, 127).astype(np.int8)
    got = codecs.decode(codecs.encode(px.tobytes(), 8, 8, name), 8, 8, name)
    assert np.abs(got.astype(int) - px).max() <= 6


@pytest.mark.parametrize("name,low", [("BC6H_UFLOAT", 0), ("BC6H_SFLOAT", -4)])
def test_half(name, low):
    y, x = np.mgrid[0:8, 0:8]
    px = np.stack([low + (x + y + k) / 3 for k in range(4)], -1).astype(np.float16)
    got = codecs.decode(codecs.encode(px.tobytes(), 8, 8, name), 8, 8, name).view(np.float16).astype(float)
    assert np.abs(got - px[..., :3]).mean() < 0.35
    bad = np.array([[-1, np.nan, np.inf, 1]] * 16, np.float16)
    got = codecs.decode(codecs.encode(bad.tobytes(), 4, 4, name), 4, 4, name).view(np.float16)
    assert np.isfinite(got).all() and (low < 0 or (got >= 0).all())


def test_refused():
    with pytest.raises(codecs.CodecError):
        codecs.encode(b"\0" * 10, 4, 4, "BC7_UNORM")
    with pytest.raises(codecs.CodecError):
        codecs.encode(b"\0" * 64, 4, 4, "ETC2_R8G8B8A1_UNORM")
    with pytest.raises(codecs.CodecError):
        codecs.decode(b"\0" * 16, 8, 8, "BC7_UNORM")
    with pytest.raises(codecs.CodecError):
        codecs.decode(b"\0" * 16, 4, 4, "BC7_UNORM")


def test_astc_block_is_as_the_format_says():
    """A flat block: config bits, endpoints and reversed weights at their places."""
    b = codecs.encode(bytes([10, 20, 30, 255]) * 16, 4, 4, "ASTC_4x4_UNORM")
    n = int.from_bytes(b, "little")
    assert n & 2047 == 66 and n >> 13 & 15 == 12 and [n >> 17 + 8 * k & 255 for k in range(8)] == [10, 10, 20, 20, 30, 30, 255, 255]
