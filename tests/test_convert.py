"""Lanes, conversions, filters and coverage against plain computations."""

import math
import struct
import zlib

import numpy as np
import pytest
from texelarium.functions import equirect, lanes, pixel, resample
from texelarium.operators import codecs, convert, layout, validate
from texelarium.plans import formats, names
from texelarium.plans.planner import ConvertError, Desc, Settings, alpha_routes, plan
from texelarium.sources import containers as C
from texelarium.sources import images

PLAIN = [n for n in formats.BY_NAME if formats.classify(n) and not n.endswith("_SRGB")]


@pytest.mark.parametrize("name", PLAIN)
def test_lanes_round_trip(name):
    size, lane = formats.BY_NAME[name][4], formats.lane_type(name, name)
    data = np.random.default_rng(1).integers(0, 256, 7 * 5 * size, dtype=np.uint8).tobytes()
    x = lanes.load(data, 7, 5, name, lane=lane)
    again = lanes.load(lanes.store(x, name), 7, 5, name, lane=lane)
    assert np.array_equal(x, again, equal_nan=lane[0] == "f") and x.shape == (5, 7, 4)
    padded = b"".join(data[k * 7 * size : (k + 1) * 7 * size] + b"\xee" * 3 for k in range(5))[:-3]
    assert np.array_equal(lanes.load(padded, 7, 5, name, lane=lane, stride=7 * size + 3), x, equal_nan=lane[0] == "f")
    with pytest.raises(lanes.LaneError):
        lanes.load(data[:-1], 7, 5, name, lane=lane)


def test_defaults_and_rounding():
    assert lanes.load(b"\x80", 1, 1, "R8_UNORM").tolist()[0][0] == pytest.approx([128 / 255, 0, 0, 1])
    assert lanes.load(b"\x80", 1, 1, "R8_SINT", lane="u32").tolist() == [[[2**32 - 128, 0, 0, 2**32 - 1]]]
    one = lanes.swizzle(lanes.load(b"\x01", 1, 1, "R8_UINT", lane="u32"), "r1r1")
    assert lanes.store(one, "R8G8B8A8_UINT") == b"\x01\xff\x01\xff" and lanes.store(one, "R8G8B8A8_SINT") == b"\x01\xff\x01\xff"
    half = np.array([[[0.5 / 255, 1.5 / 255, math.nan, 2]]], np.float64)
    assert lanes.store(half, "R8G8B8A8_UNORM") == bytes([1, 2, 0, 255])
    assert lanes.store(np.array([[[0, 0, 0, -0.5 / 127]]]), "R8G8B8A8_SNORM")[3] == 255  # half goes away from zero
    assert lanes.store(np.array([[[1e9, -1, math.nan, 1]]], np.float32), "B10G11R11_UFLOAT_PACK32") == struct.pack("<I", (31 << 6) | (((31 << 5) + 1) << 22))
    every = bytes(range(256))
    srgb = lanes.load(every, 256, 1, "R8_SRGB", True)
    assert lanes.store(srgb, "R8_SRGB", True) == every


def test_half_columns_equal_numpy(spark):
    codes = list(range(0, 65536, 7))
    df = spark.createDataFrame([(c,) for c in codes], "c long")
    got = df.select(pixel.decode_half(df["c"]).alias("v"), pixel.store_small_float(pixel.decode_half(df["c"]), 10, True).alias("b")).collect()
    want = np.array(codes, np.uint16).view(np.float16)
    for c, w, r in zip(codes, want, got):
        assert (math.isnan(w) and math.isnan(r["v"])) or (float(w) == r["v"] and (r["b"] == c or w == 0))


@pytest.mark.parametrize("keeps,target,source,want", [(True, "straight", "opaque", ("opaque", "straight")), (False, "premultiplied", "straight", ("straight", "opaque")), (False, "straight", "premultiplied", ("opaque", "straight")), (False, "straight", "straight", ("opaque", "opaque")), (False, "premultiplied", "opaque", ("opaque", "opaque"))])
def test_alpha_routes(keeps, target, source, want):
    assert alpha_routes(keeps, target, source) == want


def test_names():
    for text, name, encoder in (("rgba8unorm", "R8G8B8A8_UNORM", None), ("BC7", "BC7_UNORM", "auto"), ("intel_bc7", "BC7_UNORM", "intel"), ("bc7e_bc7", "BC7_UNORM", "bc7e"), ("etc2_rgb_a1", "ETC2_R8G8B8A1_UNORM", "auto"), ("astcenc_astc_10x8", "ASTC_10x8_UNORM", "astcenc"), ("b10g11r11_ufloat", "B10G11R11_UFLOAT_PACK32", None)):
        assert names.parse_format(text) == names.Target(name, encoder)
    for text in ("rgb8unorm", "astc_7x7", "bc8", "", "intel_", "r64uint"):
        with pytest.raises(names.FormatNameError):
            names.parse_format(text)
    for short in ("bc1", "bc4s", "bc6h", "bc6hsf", "bc7", "etc1", "etc2_rgba", "eac_rg"):
        assert names.format_short_name(names.parse_compressed(short)) == short
    assert names.parse_opts("a=1; b = x;;") == {"a": "1", "b": "x"}
    with pytest.raises(ValueError):
        names.parse_opts("a")


def test_formats_know_their_parts():
    assert formats.normalize("BC7_SRGB") == ("BC7_UNORM", True) and formats.normalize("R8_UNORM") == ("R8_UNORM", False)
    assert formats.channel_bytes("R16G16_SFLOAT") == 2 and formats.channel_bytes("BC1_RGBA_UNORM") is None and formats.channel_bytes("A2B10G10R10_UNORM_PACK32") is None
    assert formats.has_alpha("ASTC_4x4_UNORM") and not formats.has_alpha("BC1_RGB_UNORM")
    assert formats.lane_type("R8_UINT", "R64_UINT") == "u64" and formats.lane_type("R64_SFLOAT", "R8_UNORM") == "f64" and formats.lane_type("R8_UNORM", "BC7_UNORM") == "f32"
    assert formats.classify("R8_UNORM", True).kind == "srgb8" and formats.classify("R16_UNORM", True).kind == "u16" and formats.classify("BC7_UNORM") is None


@pytest.mark.parametrize("name", ["nearest", *resample.FILTERS])
@pytest.mark.parametrize("size", [1, 2, 3, 5, 8, 97])
def test_filters(name, size):
    to = max(1, size // 2)
    index, weights = resample.taps(name, size, to)
    assert np.allclose(weights.sum(1), 1) and index.min() >= 0 and index.max() < size
    flat = np.full((size, size, 4), 0.25, np.float32)
    assert np.allclose(resample.resize(flat, to, to, name), 0.25)


def test_chain_keeps_what_is_supplied():
    base, own = np.zeros((3, 5, 4), np.float32), np.ones((1, 2, 4), np.float32)
    got = resample.complete([base, own])
    assert [x.shape[:2] for x in got] == [(3, 5), (1, 2), (1, 1)] and got[1] is own and (got[2] == 1).all()
    assert len(resample.complete([base, own], count=1)) == 1 and len(resample.complete([base], count=99)) == 3
    with pytest.raises(ValueError):
        resample.complete([base], count=0)
    assert np.allclose(resample.resize(np.arange(4.0).reshape(1, 4, 1), 2, 1)[0, :, 0], [5 / 7, 16 / 7])


def test_thresholds_brute_force():
    rng = np.random.default_rng(3)
    lanes_ = np.dstack((np.zeros((4, 5, 3)), rng.choice([0, 0.1, 0.4, 0.9, 1], (4, 5)))).astype(np.float32)
    alpha = lanes_[..., 3]
    for band in resample._bands(alpha):
        w, a = resample._corners(alpha, band)
        got = resample.pass_thresholds(w, a, 0.5)
        for s in (0.3, 0.75, 1.1, 2.0, 6.0, 50.0):
            passes = (w * np.minimum(a * s, 1)).sum(0) >= 0.5
            near = np.abs(got - s) < 1e-4
            assert ((got <= s) == passes)[~near].all()
    share = resample.passing_share(lanes_, 0.5)
    plain = 0
    for sy in range(16):
        for sx in range(20):
            y, x = (sy + 0.5) / 4 - 0.5, (sx + 0.5) / 4 - 0.5
            y0, x0 = math.floor(y), math.floor(x)
            at = lambda j, i: float(alpha[min(max(j, 0), 3), min(max(i, 0), 4)])
            v = (at(y0, x0) * (1 - x + x0) + at(y0, x0 + 1) * (x - x0)) * (1 - y + y0) + (at(y0 + 1, x0) * (1 - x + x0) + at(y0 + 1, x0 + 1) * (x - x0)) * (y - y0)
            plain += v >= 0.5 - 1e-7
    assert abs(share - plain / 320) < 0.01


def test_coverage_is_kept():
    rng = np.random.default_rng(4)
    alpha = (rng.random((64, 64)) < 0.2).astype(np.float32)
    base = np.dstack((np.ones((64, 64, 3)) * alpha[..., None], alpha)).astype(np.float32)
    plain = resample.complete([base])
    kept = resample.preserve(plain, 1, 0.5)
    want = resample.passing_share(base, 0.5)
    for k in (1, 2, 3):
        assert abs(resample.passing_share(kept[k], 0.5) - want) < 0.05 < abs(resample.passing_share(plain[k], 0.5) - want)
        assert (kept[k][..., :3] <= kept[k][..., 3:] + 1e-5).all()  # still premultiplied
    assert resample.preserve([base * 0, base * 0], 1, 0.5)[1] is not None
    opaque = np.ones((8, 8, 4), np.float32)
    assert all((x == 1).all() for x in resample.preserve(resample.complete([opaque]), 1, 0.5))


def test_convert_over_surfaces(spark):
    px = np.random.default_rng(5).integers(0, 256, (6, 10, 4), dtype=np.uint8)
    rows = [(1, 0, 0, 10, 6, px.tobytes()), (1, 1, 0, 10, 6, px[::-1].tobytes()), (2, 0, 0, 10, 6, b"short"), (3, 0, 0, 10, 6, None)]
    df = spark.createDataFrame(rows, "image_id long, layer int, mip int, width int, height int, data binary")
    out = convert.convert(df, Desc("R8G8B8A8_SRGB", True), Settings(vk_format="BC7_SRGB", mipmap=True, alpha_cutoff=0.5)).collect()
    good = sorted((r["layer"], r["mip"], r["width"], r["height"], len(r["data"])) for r in out if r["image_id"] == 1)
    assert good == [(s, k, w, h, n) for s in (0, 1) for k, w, h, n in ((0, 10, 6, 96), (1, 5, 3, 32), (2, 2, 1, 16), (3, 1, 1, 16))]
    assert all(r["error"] and r["data"] is None for r in out if r["image_id"] > 1)
    decoded = codecs.decode(bytes(next(r["data"] for r in out if (r["image_id"], r["layer"], r["mip"]) == (1, 0, 0))), 10, 6, "BC7_SRGB")
    assert decoded.shape == (6, 10, 4)
    two = spark.createDataFrame([(1, 0, 1, 2, 2, b"\xff" * 16), (1, 0, 0, 4, 4, b"\x00" * 64)], df.schema)
    kept = {r["mip"]: bytes(r["data"]) for r in convert.convert(two, Desc("R8G8B8A8_UNORM", False, "opaque"), Settings(mipmap=True, swizzle="rgba")).collect()}
    assert kept == {0: b"\x00" * 64, 1: b"\xff" * 16, 2: b"\xff" * 4}


def test_plan_rules():
    with pytest.raises(ConvertError):
        plan(Desc("R8G8B8A8_UNORM", False), Settings(vk_format="R8_UNORM"), volume=True)
    assert plan(Desc("R8G8B8A8_UNORM", False), Settings(), volume=True).steps == ("passthrough",)
    assert plan(Desc("R8G8B8A8_UNORM", False, "opaque"), Settings(mipmap=True, alpha_cutoff=9.0)).steps == ("load", "mips", "store")
    assert plan(Desc("R32_SFLOAT", False), Settings(vk_format="R64_SFLOAT", allow_discarding_alpha=True)).lane == "f64"


def test_projection():
    y, x = np.mgrid[0:64, 0:128]
    src = np.dstack(((x + 0.5) / 128, (y + 0.5) / 64, x * 0, x * 0 + 1)).astype(np.float32)
    f = list(equirect.project(src, 9))
    assert np.allclose([f[4][4, 4, 0], f[0][4, 4, 0], f[1][4, 4, 0]], [0.5, 0.75, 0.25], atol=1e-2) and f[2][4, 4, 1] < 0.05 and f[3][4, 4, 1] > 0.95
    turned = list(equirect.project(src, 9, front="+x"))
    assert np.allclose(turned[0][4, 4, 0], 0.5, atol=1e-2)
    assert np.allclose(list(equirect.project(src, 9, mirror=True))[0][4, 4, 0], 0.25, atol=1e-2)
    assert list(equirect.project(src))[0].shape == (32, 32, 4)
    u, v, *grad = equirect.positions(2, 8, range(8))
    eps = 1e-6
    for k, (du, dv) in enumerate((grad[:2], grad[2:])):
        axis, right, down = (np.array(t, float) for t in equirect.FACES[2])
        a, b = (2 * np.arange(8) + 1) / 8 - 1 + eps * (k == 0), (2 * np.arange(8) + 1) / 8 - 1 + eps * (k == 1)
        d = axis + a[None, :, None] * right + b[:, None, None] * down
        u2, v2 = 0.5 + np.arctan2(d[..., 0], d[..., 2]) / (2 * np.pi), np.arctan2(np.hypot(d[..., 0], d[..., 2]), d[..., 1]) / np.pi
        assert np.allclose((u2 - u) / eps, du, atol=1e-3) and np.allclose((v2 - v) / eps, dv, atol=1e-3)
    for bad in (0, 40_000):
        with pytest.raises(ValueError):
            equirect.validate_face_size(bad)


def test_atlases():
    assert layout.face_size(12, 2, "strip") == 2 and layout.face_size(8, 6, "cross") == 2 and layout.face_size(6, 8, "vertical") == 2
    with pytest.raises(ValueError):
        layout.face_size(13, 2, "strip")


def test_png():
    rng = np.random.default_rng(6)
    for kind in (np.uint8, np.uint16):
        for ch in (1, 2, 3, 4):
            px = rng.integers(0, np.iinfo(kind).max, (5, 7, ch)).astype(kind)
            name, w, h, data = images.read_png(images.write_png(px))
            assert (w, h) == (7, 5) and np.array_equal(np.frombuffer(data, kind).reshape(px.shape), px) and formats.BY_NAME[name][3] == ch
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    make = lambda bits, colour, raw, *more: images.PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", 4, 3, bits, colour, 0, 0, 0)) + b"".join(more) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
    want = np.array([[1, 2, 3, 4], [5, 7, 9, 11], [6, 9, 12, 15]], np.uint8)
    for f in range(5):  # each filter on every row, undone by the definition
        rows, up = b"", np.zeros(4, int)
        for line in want.astype(int):
            left, corner = np.concatenate(([0], line[:-1])), np.concatenate(([0], up[:-1]))
            p = left + up - corner
            near = np.where((abs(p - left) <= abs(p - up)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - up) <= abs(p - corner), up, corner))
            rows += bytes([f]) + ((line - [0, left, up, (left + up) // 2, near][f]) % 256).astype(np.uint8).tobytes()
            up = line
        assert images.read_png(make(8, 0, rows))[3] == want.tobytes()
    name, _, _, data = images.read_png(make(2, 3, b"\0\x1b\0\x1b\0\x1b", chunk(b"PLTE", bytes(range(12))), chunk(b"tRNS", b"\x07")))
    assert name == "R8G8B8A8_SRGB" and data[:16] == bytes([0, 1, 2, 7, 3, 4, 5, 255, 6, 7, 8, 255, 9, 10, 11, 255])
    good = make(8, 0, b"\0" * 15)
    for bad in (good[:-20], good[:40] + b"\xff" + good[41:], make(8, 0, b"\0" * 9), make(8, 0, b"\x09" + b"\0" * 14)):
        with pytest.raises(images.ImageError):
            images.read_png(bad)


def test_hdr():
    head = b"#?RADIANCE\nFORMAT=32-bit_rle_rgbe\n\n-Y 1 +X 8\n"
    flat = images.read_hdr(head + bytes([128, 64, 32, 129]) * 8)
    run = images.read_hdr(head + b"\x02\x02\x00\x08" + b"".join(bytes([136, v]) for v in (128, 64, 32, 129)))
    assert flat == run and np.frombuffer(flat[3], "<f4")[:3].tolist() == [1.0, 0.5, 0.25]
    with pytest.raises(images.ImageError):
        images.read_hdr(head + b"\x02\x02\x00\x08\x88")


def test_legacy_dds_and_volumes():
    def legacy(fmt: bytes, width=4, height=4, data=b"\0" * 64):
        return b"DDS " + struct.pack("<7I44x", 124, 0x1007, height, width, 0, 0, 1) + fmt + struct.pack("<5I", 0x1000, 0, 0, 0, 0) + data

    assert C.read_dds(legacy(struct.pack("<2I4s5I", 32, 4, b"DXT5", 0, 0, 0, 0, 0))).vk_format == "BC3_SRGB"
    assert C.read_dds(legacy(struct.pack("<2I4s5I", 32, 0x41, b"\0" * 4, 32, 0xFF0000, 0xFF00, 0xFF, 0xFF000000))).vk_format == "B8G8R8A8_SRGB"
    assert C.read_dds(legacy(struct.pack("<2I4s5I", 32, 0x20000, b"\0" * 4, 8, 0xFF, 0, 0, 0))).vk_format == "R8_UNORM"
    assert C.read_dds(legacy(struct.pack("<2I4s5I", 32, 4, struct.pack("<I", 113), 0, 0, 0, 0, 0), data=b"\0" * 128)).vk_format == "R16G16B16A16_SFLOAT"
    with pytest.raises(C.ContainerError):
        C.read_dds(legacy(struct.pack("<2I4s5I", 32, 4, b"????", 0, 0, 0, 0, 0)))
    t = C.Texture("R8_UNORM", 4, 4, [[b"a" * 64, b"b" * 8, b"c"]], depth=4)
    for kind, scheme in (("ktx2", None), ("ktx2", "zstd"), ("dds", None)):
        assert C.decode(C.encode(t, kind, scheme)) == t
    with pytest.raises(C.ContainerError):
        C.encode(C.Texture("R8_UNORM", 4, 4, [[b"a" * 64]] * 6, cube=True, depth=4))


def test_overrides_and_names_of_containers(tmp_path):
    t = C.Texture("R8G8B8A8_UNORM", 1, 1, [[b"abcd"]])
    for kind in ("ktx2", "dds"):
        assert C.decode(C.encode(t, kind), C.Overrides(srgb=True, premultiplied=True)) == C.Texture("R8G8B8A8_SRGB", 1, 1, [[b"abcd"]], premultiplied=True)
    assert C.encode(t, "raw") == b"abcd" and C.decode(b"junk") is None
    assert C.resolve_container("x/y.KTX2") == "ktx2" and C.resolve_container("y", "dds") == "dds"
    with pytest.raises(C.ContainerError):
        C.resolve_container("y.png")
    (tmp_path / "a").write_bytes(b"1")
    (tmp_path / "b").hardlink_to(tmp_path / "a")
    C.check_output_not_input(str(tmp_path / "c"), [str(tmp_path / "a")])
    with pytest.raises(C.ContainerError):
        C.check_output_not_input(str(tmp_path / "b"), [str(tmp_path / "a")])


def test_descriptor_has_samples():
    d = C.descriptor("R8G8B8A8_SRGB", False, True)
    assert struct.unpack_from("<I", d)[0] == len(d) and len(d) == 4 + 24 + 4 * 16 and d[12:15] == bytes([1, 1, 2])
    assert [struct.unpack_from("<HBB", d, 28 + 16 * k) for k in range(4)] == [(0, 7, 0), (8, 7, 1), (16, 7, 2), (24, 7, 15 | 16)]
    b = C.descriptor("BC3_UNORM", True, True)
    assert b[12] == 130 and b[15] == 1 and len(b) == 4 + 24 + 2 * 16 and b[16:18] == bytes([3, 3])


def test_bad_files_are_rows(spark):
    good = C.write_ktx2(C.Texture("R8_UNORM", 64, 64, [[bytes(4096)]]), "zlib")
    zst = C.write_ktx2(C.Texture("R8_UNORM", 64, 64, [[bytes(4096)]]), "zstd")
    flip = lambda d: d[:-6] + bytes([d[-6] ^ 255]) + d[-5:]
    import zstandard

    bomb = zstandard.ZstdCompressor().compress(bytes(1 << 26))
    at = struct.unpack_from("<Q", zst, 80)[0]
    big = bytearray(zst[:at] + bomb)
    struct.pack_into("<Q", big, 88, len(bomb))
    files = [(1, good), (2, flip(good)), (3, flip(zst)), (4, None), (5, bytes(big)), (6, b""), (7, images.write_png(np.zeros((2, 2, 4), np.uint8))), (8, images.PNG + b"x")]
    rows = {r["image_id"]: r for r in C.read(spark.createDataFrame(files, "image_id long, content binary")).collect()}
    assert [k for k, r in sorted(rows.items()) if r["error"]] == [2, 3, 4, 5, 6, 8] and rows[7]["vk_format"] == "R8G8B8A8_SRGB"
    with pytest.raises(C.ContainerError, match="more bytes"):
        C.read_ktx2(bytes(big))


def test_write_reports_bad_images(spark):
    rows = [(1, "R8_UNORM", 0, 0, 2, 1, b"ab"), (2, "R8_UNORM", 0, 1, 2, 1, b"ab"), (3, "R8_UNORM", 0, 0, 2, 1, b"a"), (4, "NO", 0, 0, 2, 1, b"a")]
    got = {r["image_id"]: r for r in C.write(spark.createDataFrame(rows, "image_id long, vk_format string, layer int, mip int, width int, height int, data binary")).collect()}
    assert got[1]["content"] and not got[1]["error"] and all(got[k]["error"] and got[k]["content"] is None for k in (2, 3, 4))


def test_cube_and_volume_rules(spark):
    rows = [(1, k, 0, "R8_UNORM", 4, 4, 1) for k in range(6)] + [(2, k, 0, "R8_UNORM", 4, 4, 1) for k in range(5)] + [(3, 0, 0, "R8_UNORM", 4, 4, 3)] + [(4, k, 0, "R8_UNORM", 4, 2, 1) for k in range(6)]
    df = spark.createDataFrame(rows, "image_id long, layer int, mip int, vk_format string, width int, height int, depth int")
    found = lambda kind: {r["image_id"]: r["problem"] for r in validate.images(df, kind).collect()}
    assert found("cube") == {2: "no multiple of six faces", 3: "no multiple of six faces", 4: "faces are not square"}
    assert set(found("3d")) == {1, 2, 4} and set(found("2d")) == {3}


def test_sql_curves_take_nan(spark):
    pixel.register_sql(spark)
    row = spark.sql("select srgb_eotf(double('NaN')) a, srgb_oetf(double('NaN')) b, srgb_eotf(0.5D) c").first()
    assert row["a"] == 0 and row["b"] == 0 and row["c"] == pytest.approx(0.21404114)
