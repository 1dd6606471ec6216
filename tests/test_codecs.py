import numpy as np
import pytest
from texelarium.operators import codecs

RNG = np.random.default_rng(1)


def _gradient(channels: int) -> np.ndarray:
    i = np.arange(16)
    px = np.stack([i * 4 + 20, 200 - i * 3, i * 2 + 90, np.full(16, 255)], axis=1)
    return np.stack([px, px[::-1]]).astype(np.uint8)[:, :, :channels]


@pytest.mark.parametrize("name,limit", [("bc1", 30), ("bc2", 30), ("bc3", 30), ("bc5", 6), ("bc7", 4)])
def test_gradient_error(name, limit):
    # BC5: eight levels over a range of 60 and 45 leave a mean square of step ** 2 / 12, below 6
    encode, decode, ch = codecs.CODECS[name]
    px = _gradient(ch)
    back = decode(encode(px))[:, :, :ch]
    assert ((back.astype(float) - px) ** 2).mean() < limit


def test_bc4_error_and_constant():
    px = np.vstack([_gradient(1)[:, :, 0], np.full((1, 16), 77, np.uint8)])
    back = codecs.decode_bc4(codecs.encode_bc4(px))
    assert np.abs(back.astype(int) - px).max() <= 5
    assert (back[-1] == 77).all()


def test_bc7_mode_6_layout_and_anchor():
    blocks = codecs.encode_bc7(RNG.integers(0, 256, (50, 16, 4)).astype(np.uint8))
    assert blocks.shape == (50, 16) and (blocks[:, 0] & 0x7F == 0x40).all()
    with pytest.raises(ValueError):
        codecs.decode_bc7(np.zeros((1, 16), np.uint8))


@pytest.mark.parametrize("w,h", [(1, 1), (3, 3), (5, 5), (7, 3), (1024, 1)])
def test_tile_clamps_to_edge(w, h):
    px = RNG.integers(0, 256, (h, w, 4)).astype(np.uint8)
    t = codecs.tile_surface(px.tobytes(), w, h, 4)
    assert t.shape == (-(-w // 4) * -(-h // 4), 16, 4)
    assert (t[-1, 15] == px[h - 1, w - 1]).all()


def test_padded_stride_never_shows():
    rows = np.full((2, 20), 99, np.uint8)
    rows[:, :16] = np.arange(32).reshape(2, 16)
    t = codecs.tile_surface(rows.tobytes(), 4, 2, 4, stride=20)
    assert 99 not in t
