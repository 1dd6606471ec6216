import struct

import pytest
from texelarium.sources import containers as C


def _texture(name="R8G8B8A8_UNORM", w=8, h=8, layers=2, mips=3, cube=False):
    return C.Texture(name, w, h, [[bytes((i + s + k) % 256 for i in range(C.level_bytes(name, w, h, k))) for k in range(mips)] for s in range(layers)], cube)


@pytest.mark.parametrize("scheme", [None, "zlib", "zstd"])
@pytest.mark.parametrize("name", ["R8G8B8A8_UNORM", "BC7_SRGB", "BC1_RGBA_UNORM", "ASTC_6x6_UNORM", "R16G16_SFLOAT"])
def test_ktx2_round_trip(scheme, name):
    t = _texture(name)
    data = C.write_ktx2(t, scheme)
    assert C.detect(data) == "ktx2" and C.read_ktx2(data) == t


@pytest.mark.parametrize("cube,layers", [(False, 3), (True, 6), (True, 12)])
def test_cube_and_array(cube, layers):
    t = _texture(layers=layers, cube=cube)
    assert C.read_ktx2(C.write_ktx2(t)) == t
    assert C.read_dds(C.write_dds(t)) == t


def test_premultiplied_survives_ktx2_only():
    t = _texture()
    t.premultiplied = True
    assert C.read_ktx2(C.write_ktx2(t)).premultiplied
    assert not C.read_dds(C.write_dds(t)).premultiplied


def test_hostile_headers():
    data = bytearray(C.write_ktx2(_texture()))
    for at, value in ((36, 5), (40, 99), (32, 1 << 30), (12, 7777), (44, 9), (80, 1 << 40)):
        bad = bytearray(data)
        struct.pack_into("<I" if at != 80 else "<Q", bad, at, value)
        with pytest.raises(C.ContainerError):
            C.read_ktx2(bytes(bad))
    with pytest.raises(C.ContainerError):
        C.read_ktx2(bytes(data[:-5]))


def test_bomb_is_bounded():
    t = _texture(mips=1)
    data = bytearray(C.write_ktx2(t, "zlib"))
    import zlib

    bomb = zlib.compress(b"\0" * (1 << 22))
    at = struct.unpack_from("<Q", data, 80)[0]
    struct.pack_into("<Q", data, 88, len(bomb))
    with pytest.raises(C.ContainerError):
        C.read_ktx2(bytes(data[:at]) + bomb)


def test_unsupported_and_invalid():
    with pytest.raises(C.ContainerError):
        C.write_dds(_texture("EAC_R11_UNORM"))
    with pytest.raises(C.ContainerError):
        C.write_ktx2(C.Texture("R8_UNORM", 4, 4, [[b"123"]]))


def test_spark_reader_reports_errors(spark):
    good = C.write_ktx2(_texture())
    df = spark.createDataFrame([(1, good), (2, b"junk"), (3, good[:100])], "image_id long, content binary")
    rows = C.read(df).collect()
    assert sum(r["image_id"] == 1 for r in rows) == 6
    assert all(r["error"] for r in rows if r["image_id"] != 1)


def _surface_rows(i, t):
    return [(i, t.vk_format, s, k, max(1, t.width >> k), max(1, t.height >> k), max(1, t.depth >> k), d) for s, mips in enumerate(t.surfaces) for k, d in enumerate(mips)]


_SURFACES = "image_id {}, vk_format string, layer int, mip int, width int, height int, depth int, data binary"


@pytest.mark.parametrize("per_batch", [1, 5, 10000])
def test_spark_writer_as_the_plain_one(spark, per_batch):
    """Images in any order of rows, cut by batches anywhere, a null id among them; what is no texture is an error row."""
    good = {i: _texture(n, w, w, layers, mips) for i, (n, w, layers, mips) in enumerate([("R8G8B8A8_UNORM", 8, 2, 3), ("BC7_SRGB", 5, 1, 1), ("R16_SFLOAT", 4, 6, 2), ("R8_UNORM", 1, 1, 1)] * 3)}
    good[None] = _texture(layers=3)
    good[90] = C.Texture("R8_UNORM", 4, 4, [[b"x" * 64, b"y" * 8]], depth=4)
    rows = [r for i, t in good.items() for r in _surface_rows(i, t)]
    lone = _surface_rows(70, _texture(mips=2))
    rows += lone[1:]  # the first mip of the first layer is missing
    rows += [(71, *r[1:]) for r in (*lone, lone[0])]
    rows += [(72, r[1] if r[2] else "R8_UNORM", *r[2:]) for r in lone]
    rows += [(73, r[1], 2 * r[2], *r[3:]) for r in lone]
    rows += [(74, *r[1:]) for r in lone[:3]]
    rows += [(75, *r[1:7], None) for r in lone]
    rows += [(76, *r[1:4], None, *r[5:]) for r in lone]
    rows += [(77, r[1], None, *r[3:]) for r in lone[:2]]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(per_batch))
    try:
        got = C.write(spark.createDataFrame(rows[::-1], _SURFACES.format("long")).repartition(3)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(good) + 8
    by = {r["image_id"]: r for r in got}
    assert all(by[i]["error"] is None and bytes(by[i]["content"]) == C.write_ktx2(t) for i, t in good.items())
    for i, part in ((70, "lacks a mip"), (71, "has one twice"), (72, "one format"), (73, "without gaps"), (74, "same number of mips"), (75, "mip 0 has 0 bytes"), (76, "at least one texel"), (77, "without gaps")):
        assert by[i]["content"] is None and part in by[i]["error"]


def test_spark_writer_knows_ids_that_are_no_numbers(spark):
    rows = [r for i in ("a", "b", None) for r in _surface_rows(i, _texture())]
    assert sorted(str(r["image_id"]) for r in C.write(spark.createDataFrame(rows, _SURFACES.format("string"))).collect()) == ["None", "a", "b"]
    rows = [r for i in (float("nan"), 1.5, None) for r in _surface_rows(i, _texture())]
    got = C.write(spark.createDataFrame(rows, _SURFACES.format("double"))).collect()
    assert len(got) == 3 and all(r["error"] is None for r in got)


def test_spark_writer_sorts_by_image_alone_and_batches_files(spark):
    """No list of an image's surfaces is aggregated, and small files do not come as a batch each."""
    s = spark.createDataFrame([r for i in range(50) for r in _surface_rows(i, _texture())], _SURFACES.format("long")).coalesce(1)
    files = C.write(s)
    plan = files._jdf.queryExecution().toString()
    assert "collect_list" not in plan and "array_sort" not in plan
    run, stop = [], RuntimeError("seen")

    class Frame:
        columns, schema = ["depth"], s.schema

        def __getattr__(self, name):
            return lambda *a: self

        def mapInArrow(self, f, form):
            run.append(f)
            raise stop

    with pytest.raises(RuntimeError):
        C.write(Frame())
    import pyarrow as pa

    table = pa.Table.from_pylist([r.asDict() for r in s.collect()], pa.schema([("image_id", pa.int64()), ("vk_format", pa.string()), *((c, pa.int32()) for c in ("layer", "mip", "width", "height", "depth")), ("data", pa.binary())]))
    assert [b.num_rows for b in run[0](iter(table.to_batches(max_chunksize=7)))] == [50]


def test_codecs_are_made_once(monkeypatch):
    import zstandard

    made = []
    for name in ("ZstdCompressor", "ZstdDecompressor"):
        monkeypatch.setattr(zstandard, name, lambda *a, f=getattr(zstandard, name), **b: made.append(1) or f(*a, **b))
    for _ in range(4):
        t = _texture()
        assert C.read_ktx2(C.write_ktx2(t, "zstd", 3)) == t
    assert len(made) <= 2


def test_dds_sizes_are_asked_once_a_level(monkeypatch):
    t, asked = _texture(layers=12, mips=3, cube=True), []
    monkeypatch.setattr(C, "level_bytes", lambda *a, f=C.level_bytes: asked.append(a) or f(*a))
    assert C.read_dds(C.write_dds(t)) == t
    assert len(asked) <= 8  # three levels and the pitch written, three levels read


def test_ktx2_descriptor_is_made_once_a_shape(monkeypatch):
    """Volumes of one shape share what stands before their levels."""
    made = []
    monkeypatch.setattr(C, "descriptor", lambda *a, f=C.descriptor: made.append(a) or f(*a))
    for k in range(5):
        t = C.Texture("R8G8_UNORM", 13, 13, [[bytes([k]) * C.level_bytes("R8G8_UNORM", 13, 13, m, 4) for m in range(2)]], depth=4)
        assert C.read_ktx2(C.write_ktx2(t, "zlib")) == t
    assert len(made) <= 1
