"""All queries of the texture engine and their SQL.

The driver's tables stand in for images: embeddings are 4x4 RGBA images,
events one luminance surface of width 100, lineitem a bulk of RGBA values.
Outputs are integer codes, since transcendental doubles differ by an ulp
between engines.
"""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import pixel as P
from ..operators import codecs, convert, equirect, layout, mips, validate
from ..sources import containers
from . import formats, names
from .planner import Desc, Settings

LANES = list(P.LANES)


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _embed(spark: SparkSession, d: str) -> DataFrame:
    """(image_id, y, x, r, g, b, a): sixteen texels per vector, lanes clamped to 0..1."""
    v = _t(spark, d, "embeddings").filter("embedding IS NOT NULL")
    lane = lambda k: P.clamp(F.element_at("embedding", F.col("i") * 4 + k + 1).cast("double") + 0.5)
    px = v.select(F.col("vec_id").alias("image_id"), "embedding", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("i"))
    return px.select("image_id", F.floor(F.col("i") / 4).cast("int").alias("y"), (F.col("i") % 4).alias("x"), *[lane(k).alias(c) for k, c in enumerate(LANES)])


def _events(spark: SparkSession, d: str) -> DataFrame:
    """(y, x, v): a surface of width 100, luminance 0..255."""
    e = _t(spark, d, "events")
    return e.select(F.floor(F.col("event_id") / 100).cast("int").alias("y"), (F.col("event_id") % 100).cast("int").alias("x"), P.store_unorm(F.col("value") / 500, 8).alias("v"))


def _line(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "lineitem")
    return e.select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 50).alias("r"), (F.col("l_discount") * 10).alias("g"), (F.col("l_tax") * 12.5).alias("b"), (F.lit(1.0) - F.col("l_discount")).alias("a"), "l_partkey", F.floor(F.col("l_quantity")).cast("long").alias("q"))


_EMBED_SQL = """embed as (select vec_id as image_id, (i // 4)::int as y, (i % 4)::int as x, least(greatest(embedding[i*4+1]::double + 0.5, 0.0::double), 1.0::double) as r, least(greatest(embedding[i*4+2]::double + 0.5, 0.0::double), 1.0::double) as g,
 least(greatest(embedding[i*4+3]::double + 0.5, 0.0::double), 1.0::double) as b, least(greatest(embedding[i*4+4]::double + 0.5, 0.0::double), 1.0::double) as a from embeddings, range(16) t(i) where embedding is not null)"""
_EVENTS_SQL = "ev as (select (event_id // 100)::int as y, (event_id % 100)::int as x, floor(least(greatest(value / 500, 0.0::double), 1.0::double) * 255 + 0.5)::bigint as v from events)"
_LINE_SQL = "line as (select l_orderkey, l_linenumber, l_quantity / 50 as r, l_discount * 10 as g, l_tax * 12.5::double as b, 1.0::double - l_discount as a, l_partkey, floor(l_quantity)::bigint as q from lineitem)"
_KEY = ["l_orderkey", "l_linenumber"]
_Q: dict = {}
_S: dict[str, str] = {}


def _add(name: str, run, sql: str | None = None) -> None:
    _Q[name] = run
    if sql:
        _S[name] = sql


def _per_line(name: str, cols, sql_cols: str) -> None:
    """A query of scalar functions over the bulk rows."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        return _line(spark, d).select(*_KEY, *[c.alias(n) for n, c in cols().items()])

    _add(name, run, f"with {_LINE_SQL} select l_orderkey, l_linenumber, {sql_cols} from line")


def _r(x: Column) -> Column:
    """A lane as an integer of millionths, so that engines agree."""
    return P.half_away(x * 1_000_000)


_c = lambda n: F.col(n)
_cl = lambda e: f"least(greatest({e}, 0.0::double), 1.0::double)"
_rs = lambda e: f"(case when {e} < 0 then -floor(-({e}) * 1000000 + 0.5) else floor(({e}) * 1000000 + 0.5) end)::bigint"
_eotf = lambda e: f"(case when {_cl(e)} <= 0.04045::double then {_cl(e)} / 12.92::double else pow(({_cl(e)} + 0.055::double) / 1.055::double, 2.4::double) end)"
_oetf = lambda e: f"(case when {_cl(e)} <= 0.0031308::double then {_cl(e)} * 12.92::double else pow({_cl(e)}, 1 / 2.4::double) * 1.055::double - 0.055::double end)"

_code = lambda: (_c("l_partkey") % 256).cast("long")
_code16 = lambda: (_c("l_partkey") * 37 % 65536).cast("long")
_word = lambda: (_c("l_orderkey") * 2654435761 + _c("l_partkey") * 40503) % 4294967296
_WORD = "((l_orderkey * 2654435761 + l_partkey * 40503) % 4294967296)"

_per_line("decode_unorm8", lambda: {"v": _r(P.decode_unorm(_code(), 8))}, f"{_rs('(l_partkey % 256) / 255.0::double')} as v")
_per_line("decode_snorm8", lambda: {"v": _r(P.decode_snorm(P.signed(_code(), 8), 8))}, f"{_rs('greatest((case when l_partkey % 256 >= 128 then l_partkey % 256 - 256 else l_partkey % 256 end) / 127.0::double, -1.0::double)')} as v")
_per_line("decode_unorm16", lambda: {"v": _r(P.decode_unorm(_code16(), 16))}, f"{_rs('(l_partkey * 37 % 65536) / 65535.0::double')} as v")
_per_line("decode_snorm16", lambda: {"v": _r(P.decode_snorm(P.signed(_code16(), 16), 16))}, f"{_rs('greatest((case when l_partkey * 37 % 65536 >= 32768 then l_partkey * 37 % 65536 - 65536 else l_partkey * 37 % 65536 end) / 32767.0::double, -1.0::double)')} as v")
for _order, _low in (("a2b10g10r10", True), ("a2r10g10b10", False)):
    _rr, _bb = (0, 20) if _low else (20, 0)
    _f = {"r": f"(({_WORD} >> {_rr}) & 1023)", "g": f"(({_WORD} >> 10) & 1023)", "b": f"(({_WORD} >> {_bb}) & 1023)", "a": f"(({_WORD} >> 30) & 3)"}
    _sg = {k: f"(case when {e} >= {512 if k != 'a' else 2} then {e} - {1024 if k != 'a' else 4} else {e} end)" for k, e in _f.items()}
    _per_line(f"decode_{_order}_uint", lambda low=_low: P.a2_10_10_10(_word(), low), ", ".join(f"{e}::bigint as {k}" for k, e in _f.items()))
    _per_line(f"decode_{_order}_sint", lambda low=_low: {k: P.signed(v, 2 if k == "a" else 10) for k, v in P.a2_10_10_10(_word(), low).items()}, ", ".join(f"{e}::bigint as {k}" for k, e in _sg.items()))
    _per_line(f"decode_{_order}_unorm", lambda low=_low: {k: _r(P.decode_unorm(v, 2 if k == "a" else 10)) for k, v in P.a2_10_10_10(_word(), low).items()}, ", ".join(f"{_rs(f'{e} / {3 if k == chr(97) else 1023}.0::double')} as {k}" for k, e in _f.items()))
    _per_line(f"decode_{_order}_snorm", lambda low=_low: {k: _r(P.decode_snorm(P.signed(v, 2 if k == "a" else 10), 2 if k == "a" else 10)) for k, v in P.a2_10_10_10(_word(), low).items()}, ", ".join(f"{_rs(f'greatest({e} / {1 if k == chr(97) else 511}.0::double, -1.0::double)')} as {k}" for k, e in _sg.items()))
_per_line("decode_e5b9g9r9", lambda: {k: F.floor(v * 16777216).cast("long") for k, v in P.decode_e5b9g9r9(_word()).items()}, ", ".join(f"floor((({_WORD} >> {s}) & 511) * pow(2.0::double, ({_WORD} >> 27) - 24) * 16777216)::bigint as {k}" for k, s in (("r", 0), ("g", 9), ("b", 18))) + ", 16777216::bigint as a")
_sf = lambda e, m: f"(case when ({e} >> {m}) = 0 then ({e} & {2**m - 1}) * pow(2.0::double, {-14 - m}) when ({e} >> {m}) = 31 then -1 else pow(2.0::double, ({e} >> {m}) - 15) * (({e} & {2**m - 1}) / {2**m}.0::double + 1) end)"
_per_line("decode_b10g11r11", lambda: {k: F.when(F.isnan(v) | (v == float("inf")), F.lit(-1048576).cast("long")).otherwise(F.floor(F.when(F.isnan(v) | (v == float("inf")), 0.0).otherwise(v) * 1048576).cast("long")) for k, v in P.decode_b10g11r11(_word()).items() if k != "a"}, ", ".join(f"floor({_sf(f'(({_WORD} >> {s}) & {2**n - 1})', m)} * 1048576)::bigint as {k}" for k, s, n, m in (("r", 0, 11, 6), ("g", 11, 11, 6), ("b", 22, 10, 5))))
_per_line("srgb_eotf_u16", lambda: {k: P.store_unorm(P.eotf(_c(k)), 16) for k in "rgb"}, ", ".join(f"floor({_eotf(k)} * 65535 + 0.5)::bigint as {k}" for k in "rgb"))
_per_line("srgb_oetf_u8", lambda: {k: P.store_srgb8(_c(k)) for k in "rgb"}, ", ".join(f"round_even({_oetf(k)} * 255, 0)::bigint as {k}" for k in "rgb"))
_per_line("premultiply", lambda: {k: _r(P.premultiply(_c(k), _c("a"))) for k in "rgb"}, ", ".join(f"{_rs(f'{k} * a')} as {k}" for k in "rgb"))
_per_line("unpremultiply", lambda: {k: _r(P.unpremultiply(_c(k), _c("g"))) for k in "rb"}, ", ".join(f"{_rs(f'({k} / (case when g > 0 then g else 1.0::double end))')} as {k}" for k in "rb"))
for _sw in ("bgra", "rgb1", "r000", "0r0g"):
    _per_line(f"swizzle_{_sw}", lambda s=_sw: {k: _r(v) for k, v in P.swizzle({x: _c(x) for x in P.LANES}, s).items()}, ", ".join(f"{_rs({'0': '0.0::double', '1': '1.0::double'}.get(p, p))} as {to}" for to, p in zip("rgba", _sw)))
_per_line("swizzle_integer_one", lambda: {k: P.store_sint(v, 8) for k, v in P.swizzle({x: _c("q") for x in P.LANES}, "rg01", integer=True).items()}, "q as r, q as g, 0::bigint as b, -1::bigint as a")
_per_line("store_unorm8", lambda: {k: P.store_unorm(_c(k), 8) for k in "rgba"}, ", ".join(f"floor({_cl(k)} * 255 + 0.5)::bigint as {k}" for k in "rgba"))
_per_line("store_unorm16", lambda: {k: P.store_unorm(_c(k), 16) for k in "rgba"}, ", ".join(f"floor({_cl(k)} * 65535 + 0.5)::bigint as {k}" for k in "rgba"))
_sn = lambda e, m: f"(case when {e} < 0 then -floor(-least(greatest({e}, -1.0::double), 1.0::double) * {m} + 0.5) else floor(least(greatest({e}, -1.0::double), 1.0::double) * {m} + 0.5) end)::bigint"
for _n, _m in ((8, 127), (16, 32767)):
    _per_line(f"store_snorm{_n}", lambda n=_n: {k: P.store_snorm(_c(k) * 2 - 1, n) for k in "rgba"}, ", ".join(f"{_sn(f'({k} * 2 - 1)', _m)} as {k}" for k in "rgba"))
_per_line("store_uint8_clamp", lambda: {"v": P.store_uint(_c("l_partkey"), 8)}, "least(l_partkey, 255)::bigint as v")
_per_line("store_sint8_clamp", lambda: {"v": P.store_sint(_word(), 8)}, f"least(greatest(case when {_WORD} >= 2147483648 then {_WORD} - 4294967296 else {_WORD} end, -128), 127)::bigint as v")
_per_line("pack_a2b10g10r10", lambda: {"w": P.pack_a2_10_10_10(*[P.store_unorm(_c(k), 2 if k == "a" else 10) for k in "rgba"])}, "(" + " + ".join(f"floor({_cl(k)} * {3 if k == 'a' else 1023} + 0.5)::bigint * {1 << s}" for k, s in (("r", 0), ("g", 10), ("b", 20), ("a", 30))) + ")::bigint as w")
_E = "(case when greatest(r, g, b) < pow(2.0::double, -15) then 0 else floor(log2(greatest(r, g, b)))::int + 16 end)"
_per_line("pack_e5b9g9r9", lambda: {"w": P.pack_e5b9g9r9(_c("r"), _c("g"), _c("b"))}, f"(select m.mr + m.mg * 512 + m.mb * 262144 + m.e2 * 134217728 from (select floor(r / pow(2.0::double, e2 - 24) + 0.5)::bigint as mr, floor(g / pow(2.0::double, e2 - 24) + 0.5)::bigint as mg, floor(b / pow(2.0::double, e2 - 24) + 0.5)::bigint as mb, e2 from (select case when floor(greatest(r, g, b) / pow(2.0::double, e - 24) + 0.5) >= 512 then e + 1 else e end as e2 from (select {_E}::bigint as e))) m)::bigint as w")


# codes of half and small floats
_half_sql = lambda e: f"(case when {e} = 0 then 0 else (floor(log2({e})) + 14) * 1024 + round_even({e} * pow(2.0::double, 10 - floor(log2({e}))), 0) end)::bigint"
_small_sql = lambda e, m: f"(case when {e} <= 0 then 0 else (greatest(floor(log2({e})), -14) + 14) * {1 << m} + round_even({e} * pow(2.0::double, {m} - greatest(floor(log2({e})), -14)), 0) end)::bigint"
_H = "(l_partkey * 37 % 31744)"
_per_line("decode_half", lambda: {"v": F.floor(P.decode_half((_c("l_partkey") * 37 % 31744).cast("long")) * 16777216).cast("decimal(38,0)")}, f"floor((case when {_H} < 1024 then {_H} * pow(2.0::double, -24) else pow(2.0::double, {_H} // 1024 - 15) * (1 + ({_H} % 1024) / 1024.0::double) end) * 16777216)::decimal(38,0) as v")
_per_line("store_half", lambda: {k: P.store_small_float(_c(k), 10, True) for k in "rga"}, ", ".join(f"{_half_sql(k)} as {k}" for k in "rga"))
_per_line("pack_b10g11r11", lambda: {"w": P.pack_b10g11r11(_c("r"), _c("g"), _c("b"))}, f"({_small_sql('r', 6)} + {_small_sql('g', 6)} * 2048 + {_small_sql('b', 5)} * 4194304)::bigint as w")
_per_line("pack_a2r10g10b10", lambda: {"w": P.pack_a2_10_10_10(*[P.store_unorm(_c(k), 2 if k == "a" else 10) for k in "rgba"], red_low=False)}, "(" + " + ".join(f"floor({_cl(k)} * {3 if k == 'a' else 1023} + 0.5)::bigint * {1 << sh}" for k, sh in (("b", 0), ("g", 10), ("r", 20), ("a", 30))) + ")::bigint as w")
_per_line("store_a2_uint", lambda: {"w": P.pack_a2_10_10_10(*[P.store_field(_c("l_partkey"), 2 if k == "a" else 10) for k in "rgba"])}, "(least(l_partkey, 1023) * 1049601 + least(l_partkey, 3) * 1073741824)::bigint as w")
_per_line("store_a2_sint", lambda: {"w": P.store_field(_word(), 10, True)}, f"(case when {_WORD} >= 2147483648 then greatest({_WORD} - 4294967296, -512) + 1024 else least({_WORD}, 511) end % 1024)::bigint as w")
_per_line("coverage_scale", lambda: {k: _r(v) for k, v in mips.apply_scale({x: _c(x) for x in P.LANES}, F.lit(1.25)).items()}, ", ".join(f"{_rs(f'(case when a > 0 then {k} * (least(a * 1.25::double, 1.0::double) / a) else {k} end)' if k != 'a' else 'least(a * 1.25::double, 1.0::double)')} as {k}" for k in "rgba"))


# layout, over the whole surface of events: width 100 unless an atlas or an odd width is asked for
def _count(spark: SparkSession, d: str) -> int:
    return _t(spark, d, "events").count()


def _surface(spark: SparkSession, d: str, width: int, height: int) -> DataFrame:
    """The events as a surface of another width; what makes no full row of it is left out."""
    e = _t(spark, d, "events").filter(F.col("event_id") < width * height)
    return e.select(F.floor(F.col("event_id") / width).cast("int").alias("y"), (F.col("event_id") % width).cast("int").alias("x"), P.store_unorm(F.col("value") / 500, 8).alias("v"))


_SIZE = "n as (select count(*) as n from events)"
_V = "floor(least(greatest(value / 500, 0.0::double), 1.0::double) * 255 + 0.5)::bigint as v"


def _surface_sql(width: str, height: str) -> str:
    return f"{_SIZE}, s as (select ({width})::int as w, ({height})::int as h from n), ev as (select (event_id // w)::int as y, (event_id % w)::int as x, {_V}, w, h from events, s where event_id < w * h)"


def _full(width: int, run):
    """A query over as many full rows of a width as there are."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        h = _count(spark, d) // width
        return run(_surface(spark, d, width, h), width, h)

    return query


_add("crop_region", lambda s, d: layout.crop(_events(s, d), 10, 5, 40, 30), f"with {_EVENTS_SQL} select (y - 5)::int as y, (x - 10)::int as x, v from ev where x between 10 and 49 and y between 5 and 34")
_add("rotate_180", _full(100, layout.rotate_180), f"with {_surface_sql('100', 'n // 100')} select (h - 1 - y)::int as y, (w - 1 - x)::int as x, v from ev")


def _atlas(kind: str, across: int, down: int):
    """The largest atlas of square faces that the table fills."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        n = int((_count(spark, d) / (across * down)) ** 0.5)
        return layout.split_cubemap(_surface(spark, d, across * n, down * n), across * n, down * n, kind).select("layer", "y", "x", "v")

    return query


def _faces_sql(table, across: int, down: int, turned: bool) -> str:
    side = f"floor(sqrt(n / {across * down}.0::double))::int"
    cases = " ".join(f"when x // f = {i} and y // f = {j} then {k}" for k, (i, j) in enumerate(table))
    flip = lambda c: f"(case when layer = 5 and {turned} then f - 1 - {c} % f else {c} % f end)::int as {c}"
    return f"with {_surface_sql(f'{across} * {side}', f'{down} * {side}')}, q as (select *, w // {across} as f, (case {cases.replace(' f ', f' (w // {across}) ')} end)::int as layer from ev) select layer, {flip('y')}, {flip('x')}, v from q where layer is not null"


_add("split_strip", _atlas("strip", 6, 1), _faces_sql([(k, 0) for k in range(6)], 6, 1, False))
_add("split_cross_h", _atlas("cross", 4, 3), _faces_sql([(2, 1), (0, 1), (1, 0), (1, 2), (1, 1), (3, 1)], 4, 3, False))
_add("split_cross_v", _atlas("vertical", 3, 4), _faces_sql([(2, 1), (0, 1), (1, 0), (1, 2), (1, 1), (1, 3)], 3, 4, True))
_TILE = "select (y2 // 4)::int as by, (x2 // 4)::int as bx, (y2 % 4)::int as ty, (x2 % 4)::int as tx, v from ev, range(((h + 3) // 4) * 4) yy(y2), range(((w + 3) // 4) * 4) xx(x2) where y = least(y2, h - 1) and x = least(x2, w - 1)"
_add("tile_blocks", _full(100, layout.tile), f"with {_surface_sql('100', 'n // 100')} " + _TILE)
_add("tile_blocks_clamped", _full(97, layout.tile), f"with {_surface_sql('97', 'n // 97')} " + _TILE)
for _name, _fn, _n, _col in (("assemble_array", layout.assemble_array, 5, "layer"), ("assemble_volume", layout.assemble_volume, 4, "z")):
    _add(_name, _full(100, lambda px, w, h, f=_fn, n=_n: f([layout.crop(px, w // n * k, 0, w // n, h) for k in range(n)])), f"with {_surface_sql('100', 'n // 100')} select (x // {100 // _n})::int as {_col}, y, (x % {100 // _n})::int as x, v from ev")


def _cubemap(spark: SparkSession, d: str) -> DataFrame:
    n = int((_count(spark, d) / 6) ** 0.5)
    px = _surface(spark, d, 6 * n, n)
    return layout.assemble_cubemap([layout.crop(px, n * k, 0, n, n) for k in range(6)])


_add("assemble_cubemap", _cubemap, f"with {_surface_sql('6 * floor(sqrt(n / 6.0::double))::int', 'floor(sqrt(n / 6.0::double))::int')} select (x // h)::int as layer, y, (x % h)::int as x, v from ev")

# mips and coverage
_WEIGHT = {
    "triangle": (1, "greatest(1 - abs({d}), 0.0::double)"),
    "catmull_rom": (2, "(case when abs({d}) < 1 then 1.5::double * pow(abs({d}), 3) - 2.5::double * pow({d}, 2) + 1 when abs({d}) < 2 then -0.5::double * pow(abs({d}), 3) + 2.5::double * pow({d}, 2) - 4 * abs({d}) + 2 else 0.0::double end)"),
    "gaussian": (3, "exp(-2 * {d} * {d})"),
    "lanczos3": (3, "(case when {d} = 0 then 1.0::double when abs({d}) < 3 then 3 * sin(pi() * {d}) * sin(pi() * {d} / 3) / (pi() * pi() * {d} * {d}) else 0.0::double end)"),
}


def _axis_sql(c: str, size: str, name: str) -> str:
    """(to, at, weight) of an axis: target texel, source texel."""
    support, weight = _WEIGHT[name]
    ratio = f"({size} / ({size} // 2)::double)"
    centre = f"((o + 0.5::double) * {ratio})"
    return f"{c}t as (select o::int as o, j::int as j, {weight.format(d=f'((j + 0.5::double - {centre}) / {ratio})')} as wt from s, range({size} // 2) a(o), range({size}) b(j) where j >= floor({centre} - {support} * {ratio}) and j < ceil({centre} + {support} * {ratio}))"


for _f in _WEIGHT:
    _add(f"mip_{_f}", _full(97, lambda px, w, h, f=_f: mips.level(px, [], ["v"], w, h, f).select("y", "x", F.floor(_c("v") * 999.7 + 0.5).cast("long").alias("v"))),
         f"with {_surface_sql('97', 'n // 97')}, {_axis_sql('y', 'h', _f)}, {_axis_sql('x', 'w', _f)}, rows_ as (select yt.o as oy, ev.x, sum(v * yt.wt) / sum(yt.wt) as v from ev join yt on ev.y = yt.j group by 1, 2) select oy as y, xt.o as x, floor(sum(v * xt.wt) / sum(xt.wt) * 999.7::double + 0.5)::bigint as v from rows_ join xt on rows_.x = xt.j group by 1, 2")
_add("mip_nearest", _full(97, lambda px, w, h: mips.level(px, [], ["v"], w, h, "nearest").select("y", "x", _c("v").cast("long").alias("v"))), f"with {_surface_sql('97', 'n // 97')} select oy::int as y, ox::int as x, v from ev, range(97 // 2) a(ox), (select unnest(range(h // 2)) as oy from s) where ev.x = floor((ox + 0.5::double) * (w / 48.0::double)) and ev.y = floor((oy + 0.5::double) * (h / (h // 2)::double))")
_T3 = "t(k, j, wt) as (values (0, 0, 3.0::double), (0, 1, 3.0::double), (0, 2, 1.0::double), (1, 1, 1.0::double), (1, 2, 3.0::double), (1, 3, 3.0::double))"
_levels_sql = f"""with {_EMBED_SQL}, {_T3}, l0 as (select image_id, y, x, floor(r * 255 + 0.5)::bigint as v from embed),
l1 as (select image_id, a.k as y, b.k as x, sum(v * a.wt * b.wt)::bigint as v from l0, t a, t b where l0.y = a.j and l0.x = b.j group by 1, 2, 3),
l2 as (select image_id, 0 as y, 0 as x, sum(v)::bigint as v from l1 group by 1)
select image_id, 0 as mip, y, x, (v * 196)::bigint as v from l0 union all select image_id, 1, y, x, (v * 4)::bigint from l1 union all select image_id, 2, y, x, v from l2"""
_scaled = lambda df: df.select("image_id", "mip", "y", "x", F.floor(_c("r").cast("double") * 255 * 196 + 0.5).cast("long").alias("v"))
_add("mip_chain", lambda s, d: _scaled(mips.chain(_embed(s, d).withColumn("r", P.store_unorm(_c("r"), 8) / 255.0), ["image_id"], ["r"], 4, 4)), _levels_sql)


def _bytes_of(codes: Column) -> Column:
    """An array of byte values as BINARY."""
    return F.to_binary(F.concat_ws("", F.transform(codes, lambda x: F.lpad(F.hex(x.cast("long")), 2, "0"))), F.lit("hex"))


def _images(spark: SparkSession, d: str, start: int = 1, lanes: int = 64, width: int = 4, height: int = 4) -> DataFrame:
    """Embeddings as surfaces of their components' bytes."""
    codes = F.transform(F.slice("embedding", start, lanes), lambda x: P.store_unorm(x.cast("double") + 0.5, 8))
    v = _t(spark, d, "embeddings").filter("embedding IS NOT NULL")
    return v.select(F.col("vec_id").alias("image_id"), F.lit(0).alias("layer"), F.lit(0).alias("mip"), F.lit(width).alias("width"), F.lit(height).alias("height"), _bytes_of(codes).alias("data"))


_CODE = "floor(least(greatest(embedding[{i}]::double + 0.5, 0.0::double), 1.0::double) * 255 + 0.5)::bigint"
_CODES_SQL = f"codes as (select vec_id as image_id, i::int as i, {_CODE.format(i='i + 1')} as c from embeddings, range(64) t(i) where embedding is not null), px as (select image_id, i // 4 as p, max(c) filter (where i % 4 = 0) as r, max(c) filter (where i % 4 = 1) as g, max(c) filter (where i % 4 = 2) as b, max(c) filter (where i % 4 = 3) as a from codes group by 1, 2)"
_RGBA8, _SRGB8 = "R8G8B8A8_UNORM", "R8G8B8A8_SRGB"


def _mips(spark: SparkSession, d: str) -> DataFrame:
    """The same chain by whole conversions of bytes to float surfaces."""
    out = convert.convert(_images(spark, d), Desc(_RGBA8, False, "opaque"), Settings(vk_format="R32G32B32A32_SFLOAT", mipmap=True))
    parts = [convert.pixels(out.filter(F.col("mip") == k), Desc("R32G32B32A32_SFLOAT", False, "opaque")).withColumn("mip", F.lit(k)) for k in range(3)]
    return _scaled(parts[0].unionByName(parts[1]).unionByName(parts[2]))


_add("convert_mipmaps", _mips, _levels_sql)


def _hexes(per_texel: str, sep: str = "order by p") -> str:
    return f"with {_CODES_SQL} select image_id, string_agg({per_texel}, '' {sep}) as data from px group by 1"


_b1 = lambda e: f"printf('%02X', {e})"
_b2 = lambda e: f"printf('%02X%02X', {e} % 256, {e} // 256)"
_b4 = lambda e: f"printf('%02X%02X%02X%02X', {e} % 256, {e} // 256 % 256, {e} // 65536 % 256, {e} // 16777216)"


def _convert(name: str, source: Desc, settings: Settings, per_texel: str) -> None:
    _add(f"convert_{name}", lambda s, d: convert.convert(_images(s, d), source, settings).select("image_id", F.hex("data").alias("data")), _hexes(per_texel))


_lin = lambda k: f"(case when {k} <= 10 then {k} / 255.0::double / 12.92::double else pow(({k} / 255.0::double + 0.055::double) / 1.055::double, 2.4::double) end)"
_unit = lambda k: f"({k} / 255.0::double)"
_opaque = Desc(_RGBA8, False, "opaque")
_convert("passthrough", _opaque, Settings(), " || ".join(_b1(k) for k in "rgba"))
_convert("bgra8", _opaque, Settings(vk_format="B8G8R8A8_UNORM"), " || ".join(_b1(k) for k in "bgra"))
_convert("swizzle", _opaque, Settings(swizzle="ab01"), f"{_b1('a')} || {_b1('b')} || '00FF'")
_convert("unorm16", _opaque, Settings(vk_format="R16G16B16A16_UNORM"), " || ".join(_b2(f"({k} * 257)") for k in "rgba"))
_convert("half", _opaque, Settings(vk_format="R16G16B16A16_SFLOAT"), " || ".join(_b2(_half_sql(_unit(k))) for k in "rgba"))
_convert("linear_from_srgb", Desc(_SRGB8, True, "opaque"), Settings(vk_format=_RGBA8, srgb=False), " || ".join(_b1(f"floor({_lin(k)} * 255 + 0.5)::bigint" if k != "a" else k) for k in "rgba"))
_convert("srgb_from_linear", _opaque, Settings(vk_format=_SRGB8, srgb=True), " || ".join(_b1(f"round_even({_oetf(_unit(k))} * 255, 0)::bigint" if k != "a" else k) for k in "rgba"))
_convert("b10g11r11", _opaque, Settings(vk_format="B10G11R11_UFLOAT_PACK32", allow_discarding_alpha=True), _b4(f"({_small_sql(_unit('r'), 6)} + {_small_sql(_unit('g'), 6)} * 2048 + {_small_sql(_unit('b'), 5)} * 4194304)"))
_convert("a2b10g10r10", _opaque, Settings(vk_format="A2B10G10R10_UNORM_PACK32"), _b4("(" + " + ".join(f"floor({_unit(k)} * {3 if k == 'a' else 1023} + 0.5)::bigint * {1 << sh}" for k, sh in (("r", 0), ("g", 10), ("b", 20), ("a", 30))) + ")"))
_convert("bc4_input", _opaque, Settings(vk_format="R8_UNORM", allow_discarding_alpha=True), _b1("r"))
_convert("uint16_from_uint8", Desc("R8G8B8A8_UINT", False, "opaque"), Settings(vk_format="R16G16B16A16_UINT"), " || ".join(_b2(k) for k in "rgba"))
_convert("sint8_from_uint8", Desc("R8G8B8A8_UINT", False, "opaque"), Settings(vk_format="R8G8B8A8_SINT", swizzle="rgb1"), " || ".join(_b1(f"least({k}, 127)") for k in "rgb") + " || 'FF'")
_convert("snorm_from_unorm", _opaque, Settings(vk_format="R8G8B8A8_SNORM"), " || ".join(_b1(f"floor({_unit(k)} * 127 + 0.5)::bigint") for k in "rgba"))


def _straight(spark: SparkSession, d: str) -> DataFrame:
    out = convert.convert(_images(spark, d), Desc(_RGBA8, False, "premultiplied"), Settings(vk_format="R32G32B32A32_SFLOAT", alpha="straight"))
    px = convert.pixels(out, Desc("R32G32B32A32_SFLOAT", False, "opaque"))
    return px.select("image_id", "y", "x", *[F.floor(_c(k) * 256 + 0.5).cast("long").alias(k) for k in P.LANES])  # no quotient of codes lies between two of these


_add("convert_straight_from_premultiplied", _straight, f"with {_CODES_SQL} select image_id, (p // 4)::int as y, (p % 4)::int as x, " + ", ".join(f"floor({k} / (case when a > 0 then a else 255 end)::double * 256 + 0.5)::bigint as {k}" for k in "rgb") + ", floor(a / 255.0::double * 256 + 0.5)::bigint as a from px")


def _load(name: str, vk_format: str, n: int, lane: str, per: int, sql: str, srgb: bool = False) -> None:
    """The bytes of an embedding read as another format; ``sql`` gives the lanes from the codes b0, b1 .. of a texel."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        px = convert.pixels(_images(spark, d, 1, n * per, n, 1), Desc(vk_format, srgb, "opaque"), lane)
        return px.select("image_id", "x", *[(_c(k) if lane[0] == "u" else F.floor(_c(k) * 2550 + 0.5).cast("long")).alias(k) for k in P.LANES])

    codes = ", ".join(f"max(c) filter (where i % {per} = {k}) as b{k}" for k in range(per))
    _add(f"load_{name}", run, f"with {_CODES_SQL}, q as (select image_id, i // {per} as x, {codes} from codes where i < {n * per} group by 1, 2) select image_id, x::int as x, {sql} from q")


_lane_sql = lambda values, form="bigint": ", ".join(f"{v}::{form} as {k}" for k, v in zip("rgba", values))
_mil = lambda e: f"floor({e} * 2550 + 0.5)"
_u = lambda *k: "(" + " + ".join(f"b{i}::hugeint * {1 << 8 * j}" for j, i in enumerate(k)) + ")"
_wide = lambda e, bits, lane=32: f"(case when {e} >= {1 << bits - 1} then {e} + {(1 << lane) - (1 << bits)}::hugeint else {e} end)"
_big = "decimal(20,0)"
_load("bgra8", "B8G8R8A8_UNORM", 16, "f32", 4, _lane_sql([_mil(_unit(f"b{k}")) for k in (2, 1, 0, 3)]))
_load("bgr8", "B8G8R8_UNORM", 16, "f32", 3, _lane_sql([*[_mil(_unit(f"b{k}")) for k in (2, 1, 0)], "2550"]))
_load("bgra8_srgb", "B8G8R8A8_SRGB", 16, "f32", 4, _lane_sql([*[_mil(_lin(f"b{k}")) for k in (2, 1, 0)], _mil(_unit("b3"))]), True)
_load("rg8_srgb", "R8G8_SRGB", 32, "f32", 2, _lane_sql([_mil(_lin("b0")), _mil(_lin("b1")), "0", "2550"]), True)
_load("rg8_sint", "R8G8_SINT", 32, "u32", 2, _lane_sql([_wide("b0", 8), _wide("b1", 8), "0", "4294967295"], _big))
_load("r16_uint", "R16_UINT", 32, "u32", 2, _lane_sql([_u(0, 1), "0", "0", "4294967295"], _big))
_load("rg16_sint", "R16G16_SINT", 16, "u32", 4, _lane_sql([_wide(_u(0, 1), 16), _wide(_u(2, 3), 16), "0", "4294967295"], _big))
_load("r32_uint", "R32_UINT", 16, "u32", 4, _lane_sql([_u(0, 1, 2, 3), "0", "0", "4294967295"], _big))
_load("rg32_sint", "R32G32_SINT", 8, "u32", 8, _lane_sql([_u(0, 1, 2, 3), _u(4, 5, 6, 7), "0", "4294967295"], _big))
_load("r64_uint", "R64_UINT", 8, "u64", 8, _lane_sql([_u(*range(8)), "0", "0", "18446744073709551615"], _big))
_load("rg64_sint", "R64G64_SINT", 4, "u64", 16, _lane_sql([_u(*range(8)), _u(*range(8, 16)), "0", "18446744073709551615"], _big))

_CUT = 0.4837  # no bilinear mean of byte codes lies on it
_sub = "(select y0 + 0.0::double as y0, y1, wy, s as sy from (select greatest(floor((s + 0.5::double) / 4 - 0.5::double), 0) as y0, least(floor((s + 0.5::double) / 4 - 0.5::double) + 1, 3) as y1, (s + 0.5::double) / 4 - 0.5::double - floor((s + 0.5::double) / 4 - 0.5::double) as wy, s from range(16) r(s)))"
_share_sql = f"""with {_CODES_SQL}, al as (select image_id, p // 4 as y, p % 4 as x, a / 255.0::double as a from px), g as {_sub},
v as (select al.image_id, gy.sy, gx.sy as sx, sum(a * ((case when y = gy.y0 then 1 - gy.wy else 0 end) + (case when y = gy.y1 then gy.wy else 0 end)) * ((case when x = gx.y0 then 1 - gx.wy else 0 end) + (case when x = gx.y1 then gx.wy else 0 end))) as v
      from al, g gy, g gx where (y = gy.y0 or y = gy.y1) and (x = gx.y0 or x = gx.y1) group by 1, 2, 3)
select image_id, count(*) filter (where v >= {_CUT}::double) as passing from v group by 1"""
_add("coverage_share", lambda s, d: convert.passing_shares(_images(s, d), _opaque, _CUT).select("image_id", "passing"), _share_sql)
_add("coverage_share_pixels", lambda s, d: mips.coverage_share(_embed(s, d).withColumn("a", P.store_unorm(_c("a"), 8) / 255.0), ["image_id"], "a", 4, 4, _CUT).select("image_id", "passing"), _share_sql)
_add("coverage_histogram", lambda s, d: mips.running(convert.threshold_histograms(_images(s, d), _opaque, _CUT), ["image_id"]))
_add("coverage_preserved", lambda s, d: convert.convert(_images(s, d), Desc(_RGBA8, False, "straight"), Settings(vk_format=_RGBA8, mipmap=True, alpha_cutoff=_CUT)).select("image_id", "mip", F.hex("data").alias("data")))

# blocks
_add("block_endpoints", lambda s, d: _embed(s, d).groupBy("image_id").agg(*[F.min(P.store_srgb8(_c(k))).alias(f"{k}_min") for k in "rgb"], *[F.max(P.store_srgb8(_c(k))).alias(f"{k}_max") for k in "rgb"]), f"with {_EMBED_SQL} select image_id, " + ", ".join(f"{f}(round_even({_oetf(k)} * 255, 0)::bigint) as {k}_{f}" for f in ("min", "max") for k in "rgb") + " from embed group by 1")


def _error_of(vk_format: str, channels: int):
    """Sum of the absolute errors of each image's pixels, written as blocks and decoded again."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        src = _images(spark, d, 1, 64, 64 // channels // 4, 4)
        plain = {1: "R8_UNORM", 2: "R8G8_UNORM", 4: _RGBA8}[channels]
        back = codecs.decode_surfaces(convert.convert(src, Desc(plain, False, "opaque"), Settings(vk_format=vk_format)), vk_format)
        px = [convert.pixels(x, Desc(plain, False, "opaque")).select("image_id", "y", "x", *[F.rint(_c(k) * 255).cast("long").alias(k + t) for k in "rgba"[:channels]]) for x, t in ((src, "0"), (back, "1"))]
        error = sum((F.sum(F.abs(_c(k + "0") - _c(k + "1"))) for k in "rgba"[:channels]), F.lit(0))
        return px[0].join(px[1], ["image_id", "y", "x"]).groupBy("image_id").agg(error.cast("long").alias("error"))

    return run


def _bc4_error(channels: int) -> str:
    """The nearest of a block's eight values, from its extremes, for each code."""
    width = 16 // channels
    return f"""with {_CODES_SQL}, q as (select image_id, i % {channels} as ch, i // {channels} as t, c from codes), blk as (select *, (t % {width}) // 4 as bx from q),
e as (select image_id, ch, bx, max(c) as hi, min(c) as lo from blk group by all), pal as (select e.*, case k when 0 then hi when 7 then lo else floor(((7 - k) * hi + k * lo) / 7.0::double + 0.5)::bigint end as v from e, range(8) r(k)),
o as (select blk.image_id, blk.ch, blk.t, min(abs(c - v)) as off from blk join pal using (image_id, ch, bx) group by all) select image_id, sum(off)::bigint as error from o group by 1"""


_add("bc4_error", _error_of("BC4_UNORM", 1), _bc4_error(1))
_add("bc5_error", _error_of("BC5_UNORM", 2), _bc4_error(2))
for _fmt in ("BC1_RGBA_UNORM", "BC2_UNORM", "BC3_UNORM", "BC7_UNORM", "ETC2_R8G8B8_UNORM", "ETC2_R8G8B8A8_UNORM", "ASTC_4x4_UNORM", "ASTC_6x6_UNORM", "BC6H_UFLOAT"):
    _add(f"convert_{_fmt.rsplit('_', 1)[0].lower()}", lambda s, d, f=_fmt: convert.convert(_images(s, d), _opaque, Settings(vk_format=f, allow_discarding_alpha=True)).select("image_id", F.hex("data").alias("blocks"), "error"))

# metadata
_FORMAT_RANGES = """(case when v between 9 and 15 then 1 when v between 16 and 22 then 2 when v between 23 and 36 then 3 when v between 37 and 50 then 4 when v between 58 and 69 then 4 when v between 70 and 76 then 2 when v between 77 and 83 then 4 when v between 84 and 90 then 6 when v between 91 and 97 then 8
 when v between 98 and 100 then 4 when v between 101 and 103 then 8 when v between 104 and 106 then 12 when v between 107 and 109 then 16 when v between 110 and 112 then 8 when v between 113 and 115 then 16 when v between 116 and 118 then 24 when v between 119 and 121 then 32 when v in (122, 123) then 4
 when v in (1, 127) then 1 when v between 2 and 8 then 2 when v = 124 then 2 when v in (125, 126, 129) then 4 when v = 128 then 3 when v = 130 then 5 when v in (131, 132, 133, 134, 139, 140, 147, 148, 149, 150, 153, 154) then 8 when v between 131 and 184 then 16 end)::int"""
_CHANNEL_RANGES = """(case when v between 9 and 15 or v between 70 and 76 or v between 98 and 100 or v between 110 and 112 or v between 124 and 127 or v in (139, 140, 153, 154) then 1 when v between 16 and 22 or v between 77 and 83 or v between 101 and 103 or v between 113 and 115 or v between 128 and 130 or v in (1, 141, 142, 155, 156) then 2
 when v between 23 and 36 or v between 84 and 90 or v between 104 and 106 or v between 116 and 118 or v in (4, 5, 122, 123, 131, 132, 143, 144, 147, 148) then 3 when v between 1 and 8 or v between 37 and 50 or v between 58 and 69 or v between 91 and 184 then 4 end)::int"""


def _metadata(spark: SparkSession, d: str) -> DataFrame:
    asked = _t(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 190).alias("vk_value"), F.col("p_size").alias("w"))
    f = F.broadcast(formats.formats(spark))  # under 200 rows, a fixed table
    row = F.ceil(F.col("w") / F.col("block_w")) * F.col("bytes_per_block")
    return asked.join(f, "vk_value", "left").select("p_partkey", F.col("bytes_per_block").alias("unit_bytes"), "channels", (F.col("channels") == 4).alias("has_alpha"), F.coalesce("compressed", F.lit(False)).alias("compressed"), row.cast("long").alias("row_bytes"), F.col("block_w"), F.col("block_h"))


_ASTC_SIZE = ", ".join(f"({157 + 2 * i + j}, {w}, {h})" for i, (w, h) in enumerate([(4, 4), (5, 4), (5, 5), (6, 5), (6, 6), (8, 5), (8, 6), (8, 8), (10, 5), (10, 6), (10, 8), (10, 10), (12, 10), (12, 12)]) for j in (0, 1))
_add("format_metadata", _metadata, f"""with astc(v, bw, bh) as (values {_ASTC_SIZE}), q as (select p_partkey, p_size, p_partkey % 190 as v from part), m as (select q.*, {_FORMAT_RANGES} as unit_bytes, {_CHANNEL_RANGES} as channels, coalesce(bw, case when v between 131 and 184 then 4 else 1 end)::int as block_w, coalesce(bh, case when v between 131 and 184 then 4 else 1 end)::int as block_h from q left join astc using (v))
select p_partkey, unit_bytes, channels, channels = 4 as has_alpha, v between 131 and 184 as compressed, (ceil(p_size / block_w::double) * unit_bytes)::bigint as row_bytes, case when unit_bytes is not null then block_w end as block_w, case when unit_bytes is not null then block_h end as block_h from m""")
#: Asked names and what they mean, by Vulkan's numbers, spelled out here for the SQL.
_NAMES = [("rgba8unorm", 37), ("R8G8B8A8_UNORM", 37), ("bgra8unorm", 44), ("rg16float", 83), ("r16g16b16a16_sfloat", 97), ("r32uint", 98), ("rgba32float", 109), ("rg11b10ufloat", 122), ("rgb9e5ufloat", 123), ("rgb10a2unorm", 64), ("a2r10g10b10_sint_pack32", 63), ("bc1", 133), ("bc3", 137), ("bc4s", 140), ("bc6h", 143), ("bc6h_sf", 144), ("bc7", 145), ("intel_bc7", 145), ("bc7e_bc7", 145), ("etcpak_etc1", 147), ("etc2", 151), ("eac_rg", 155), ("astc_6x6", 165), ("ASTCENC_ASTC_12x12", 183), ("astc_7x7", None), ("rgb8unorm", None), ("bc8", None)]


def _parse(spark: SparkSession, d: str) -> DataFrame:
    asked = F.element_at(F.array(*[F.lit(n) for n, _ in _NAMES]), (F.col("p_partkey") % len(_NAMES) + 1).cast("int"))
    f = F.broadcast(formats.formats(spark).select(F.col("vk_format").alias("found"), "vk_value"))
    q = _t(spark, d, "part").select("p_partkey", asked.alias("name")).withColumn("found", names.parse_format_column(F.col("name")))
    return q.join(f, "found", "left").select("p_partkey", "name", "vk_value")


_add("parse_format", _parse, "with n(k, name, vk_value) as (values " + ", ".join(f"({k}, '{n}', {'null' if v is None else v}::bigint)" for k, (n, v) in enumerate(_NAMES)) + f") select p_partkey, name, vk_value from part join n on p_partkey % {len(_NAMES)} = k")
_ENC_SQL = "e(encoder, priority, lo, hi) as (values ('bc7e', 1, 145, 146), ('bc7f', 2, 145, 146), ('intel', 3, 133, 134), ('intel', 3, 137, 139), ('intel', 3, 141, 141), ('intel', 3, 143, 143), ('intel', 3, 145, 148), ('etcpak', 4, 147, 148), ('etcpak', 4, 151, 153), ('etcpak', 4, 155, 155), ('etcpak', 4, 133, 134), ('etcpak', 4, 137, 139), ('etcpak', 4, 141, 141), ('amd', 5, 133, 146), ('astcenc', 6, 157, 184))"


def _auto(spark: SparkSession, d: str) -> DataFrame:
    best = formats.encoders(spark).groupBy("vk_format").agg(F.min_by("encoder", "priority").alias("encoder"), F.count("*").alias("n"))
    asked = _t(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 54 + 131).alias("vk_value"))
    f = F.broadcast(formats.formats(spark).join(best, "vk_format", "left"))  # under 200 rows
    return asked.join(f, "vk_value").select("p_partkey", "vk_value", "encoder", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


_add("auto_encoder", _auto, f"with {_ENC_SQL}, q as (select p_partkey, p_partkey % 54 + 131 as v from part) select p_partkey, v as vk_value, arg_min(encoder, priority) as encoder, count(encoder) as n from q left join e on v between lo and hi group by 1, 2")


# validation
def _surfaces(spark: SparkSession, d: str) -> DataFrame:
    """Documents as R8 surfaces whose declared size does not always hold."""
    t = _t(spark, d, "documents")
    return t.select(F.col("doc_id").alias("image_id"), F.lit(0).alias("layer"), F.lit(0).alias("mip"), F.when(F.col("doc_id") % 7 == 0, "BC4_UNORM").when(F.col("doc_id") % 11 == 0, "NO_FORMAT").otherwise("R8_UNORM").alias("vk_format"), F.col("n_chars").alias("width"), (F.col("doc_id") % 3).cast("int").alias("height"), F.when(F.col("doc_id") % 5 == 0, 10).alias("stride"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("data"), "lang", "source", (F.col("doc_id") % 2 + 1).alias("depth"))


_LAYOUT_SQL = """with q as (select doc_id as image_id, n_chars as w, doc_id % 3 as h, doc_id % 2 + 1 as d, case when doc_id % 5 = 0 then 10 end as stride, strlen(coalesce(text, '')) as bytes, case when doc_id % 7 = 0 then 4 when doc_id % 11 = 0 then null else 1 end as blk from documents),
r as (select *, ceil(w / blk::double) * (case blk when 4 then 8 else 1 end) as tight, ceil(h / blk::double) as hrows from q), t as (select *, coalesce(stride, tight) as st from r)
select image_id, 0 as layer, 0 as mip, problem from (select *, case when blk is null then 'unknown format' when w < 1 or h < 1 then 'no texels' when st < tight then 'short rows' when bytes < st * (hrows * d - 1) + tight then 'too few bytes' end as problem from t) where problem is not null"""
_add("validate_layout", lambda s, d: validate.layout(_surfaces(s, d)), _LAYOUT_SQL)
_add("validate_no_slices", lambda s, d: validate.no_volume_slices(_surfaces(s, d)).select("image_id", "problem"), "select doc_id as image_id, 'a volume slice' as problem from documents where doc_id % 2 + 1 <> 1")


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """Orders as images, their lines as levels and layers that do not always fit."""
    t = _t(spark, d, "lineitem")
    return t.select(F.col("l_orderkey").alias("image_id"), ((F.col("l_linenumber") - 1) % 2).cast("int").alias("layer"), F.floor((F.col("l_linenumber") - 1) / 2).cast("int").alias("mip"), F.when(F.col("l_partkey") % 50 == 0, "R8_SNORM").otherwise("R8_UNORM").alias("vk_format"), F.lit(8).alias("width"), F.when(F.col("l_partkey") % 40 == 1, 4).otherwise(8).alias("height"), F.lit(1).alias("depth"))


_IMAGES_SQL = """with q as (select l_orderkey as image_id, (l_linenumber - 1) % 2 as layer, (l_linenumber - 1) // 2 as mip, case when l_partkey % 50 = 0 then 's' else 'u' end as f, case when l_partkey % 40 = 1 then 4 else 8 end as h from lineitem),
lv as (select image_id, mip, count(distinct h) as sizes, count(*) as n from q group by 1, 2), l2 as (select image_id, max(sizes) as sizes, min(n) as least, max(n) as most, count(*) as mips, max(mip) as top, min(mip) as low from lv group by 1),
w as (select image_id, count(distinct layer) as layers, count(*) as rows_, count(distinct f) as formats from q group by 1)
select image_id, problem from (select image_id, case when formats <> 1 then 'several formats' when low <> 0 or top <> mips - 1 then 'levels missing' when least <> most or rows_ <> layers * mips then 'layers differ in mips' when sizes <> 1 then 'layers differ in size' when mips > 4 then 'more mips than a full chain' end as problem from w join l2 using (image_id)) where problem is not null"""
_add("validate_images", lambda s, d: validate.images(_lines(s, d)), _IMAGES_SQL)
_add("validate_mips", lambda s, d: validate.mip_counts(_lines(s, d).withColumn("g", F.col("image_id") % 100), ["g"]), "with q as (select distinct l_orderkey % 100 as g, l_orderkey as i, (l_linenumber - 1) // 2 as mip from lineitem), o as (select g, i, count(*) as mips from q group by 1, 2), r as (select g, min(mips) as least, max(mips) as most, arg_min(mips, i) as wanted from o group by 1) select g, least, most, min(i) as offender from o join r using (g) where least <> most and mips <> wanted group by 1, 2, 3")


def _shared(spark: SparkSession, d: str) -> DataFrame:
    t = _t(spark, d, "orders").select(F.col("o_custkey").alias("g"), F.col("o_orderkey").alias("input"), F.when(F.col("o_orderkey") % 9 == 0, "R8_SNORM").otherwise("R8_UNORM").alias("vk_format"), (F.col("o_orderkey") % 4 == 0).alias("srgb"), F.when(F.col("o_orderkey") % 3 == 0, "opaque").otherwise("straight").alias("alpha"))
    return validate.shared_desc(t, ["g"])


_add("shared_desc", _shared, """with q as (select o_custkey as g, o_orderkey as i, o_orderkey % 9 = 0 as f, o_orderkey % 4 = 0 as s, o_orderkey % 3 = 0 as a from orders), w as (select g, arg_min(f, i) as wf, arg_min(s, i) as ws, arg_min(a, i) as wa from q group by 1),
o as (select g, min(i) filter (where f <> wf) as f, min(i) filter (where s <> ws) as s, min(i) filter (where a <> wa) as a from q join w using (g) group by 1)
select g, case when f is not null then 'format' when s is not null then 'colour space' else 'alpha' end as problem, coalesce(f, s, a) as offender from o where coalesce(f, s, a) is not null""")
_add("validate_encoder_dims", lambda s, d: validate.encoder_dims(_t(s, d, "part").select(F.col("p_partkey").alias("image_id"), F.lit(0).alias("layer"), F.lit(0).alias("mip"), (F.col("p_partkey") * 1000).cast("long").alias("width"), (F.col("p_size") - 5).cast("long").alias("height"))).select("image_id", "problem"), "select image_id, problem from (select p_partkey as image_id, case when p_size - 5 < 1 or p_partkey < 1 then 'no texels' when p_partkey * 1000 > 2147483647 then 'side too long' when ceil(p_partkey * 1000 / 4.0) * ceil((p_size - 5) / 4.0) * 16 > 2147483647 then 'too many blocks' end as problem from part) where problem is not null")

# equirectangular
_FACE_SQL = "case face when 0 then {0} when 1 then {1} when 2 then {2} when 3 then {3} when 4 then {4} else {5} end"
_DIRS = [("1", "-1", "a", "a", "a", "-a"), ("-b", "-b", "1", "-1", "-b", "-b"), ("-a", "a", "b", "-b", "1", "-1")]


def _uv(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("l_orderkey") * 7 + F.col("l_linenumber")
    q = _t(spark, d, "lineitem").select(*_KEY, (k % 6).alias("face"), (F.floor(k / 6) % 64).alias("y"), (F.col("l_partkey") % 64).alias("x"))
    u, v = equirect.position(F.col("face"), F.col("y"), F.col("x"), 64)
    return q.select(*_KEY, _r(u).alias("u"), _r(v).alias("v"))


_add("equirect_position", _uv, f"with q as (select l_orderkey, l_linenumber, (l_orderkey * 7 + l_linenumber) % 6 as face, (2 * (l_partkey % 64) + 1) / 64.0::double - 1 as a, (2 * ((l_orderkey * 7 + l_linenumber) // 6 % 64) + 1) / 64.0::double - 1 as b from lineitem), p as (select *, {', '.join(f'({_FACE_SQL.format(*dirs)})::double as {c}' for c, dirs in zip(('dx', 'dy', 'dz'), _DIRS))} from q) select l_orderkey, l_linenumber, {_rs('(0.5::double + atan2(dx, dz) / (2 * pi()))')} as u, {_rs('(atan2(sqrt(dx * dx + dz * dz), dy) / pi())')} as v from p")
_add("equirect_faces", lambda s, d: equirect.project(_images(s, d, 1, 64, 4, 4), _opaque, 2).select("image_id", "layer", F.hex("data").alias("data"), "error"))


# containers
def _roundtrip(container: str, scheme: str | None):
    def run(spark: SparkSession, d: str) -> DataFrame:
        t = _t(spark, d, "documents").filter(F.octet_length("text") > 0)
        s = t.select(F.col("doc_id").alias("image_id"), F.lit("R8_UNORM").alias("vk_format"), F.lit(0).alias("layer"), F.lit(0).alias("mip"), F.octet_length("text").alias("width"), F.lit(1).alias("height"), F.col("text").cast("binary").alias("data"))
        files = containers.write(s, container, scheme)
        return containers.read(files).select("image_id", "width", "height", F.sha2("data", 256).alias("sha256"), "error")

    return run


_RT = "select doc_id as image_id, strlen(text)::int as width, 1::int as height, sha256(text) as sha256, null::varchar as error from documents where strlen(text) > 0"
for _name, _k, _sch in (("container_ktx2_roundtrip", "ktx2", None), ("ktx2_zlib_roundtrip", "ktx2", "zlib"), ("ktx2_zstd_roundtrip", "ktx2", "zstd"), ("container_dds_roundtrip", "dds", None)):
    _add(_name, _roundtrip(_k, _sch), _RT)


def _chains(container: str, scheme: str | None, cube: bool, layers: int, depth: int):
    """Orders as textures of several layers and mips, of one of three formats, filled with a letter a level."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        t = _t(spark, d, "orders").select(F.col("o_orderkey").alias("image_id"), (F.lit(2) + F.col("o_orderkey") % 7).cast("int").alias("w"), F.element_at(F.array(*[F.lit(x) for x in ("R8G8B8A8_UNORM", "R16_SFLOAT", "BC7_SRGB")]), (F.col("o_orderkey") % 3 + 1).cast("int")).alias("vk_format"))
        t = t.withColumn("layer", F.explode(F.sequence(F.lit(0), F.lit(layers - 1)))).withColumn("mip", F.explode(F.sequence(F.lit(0), F.lit(1))))
        side = F.greatest(F.expr("shiftright(w, mip)"), F.lit(1))
        deep = F.greatest(F.expr(f"shiftright({depth}, mip)"), F.lit(1))
        size = F.when(F.col("vk_format") == "BC7_SRGB", F.ceil(side / 4) * F.ceil(side / 4) * 16).when(F.col("vk_format") == "R16_SFLOAT", side * side * 2).otherwise(side * side * 4) * deep
        s = t.withColumn("n", size.cast("int")).select("image_id", "vk_format", "layer", "mip", side.alias("width"), side.alias("height"), F.lit(depth).alias("depth"), F.expr("cast(repeat(chr(65 + layer * 2 + mip), n) as binary)").alias("data"))
        back = containers.read(containers.write(s, container, scheme, cube))
        return back.select("image_id", "vk_format", "layer", "mip", "width", "height", "depth", F.sha2("data", 256).alias("sha256"), "error")

    return run


def _chains_sql(layers: int, depth: int) -> str:
    return f"""with q as (select o_orderkey as image_id, 2 + o_orderkey % 7 as w, o_orderkey % 3 as f, l::int as layer, m::int as mip from orders, range({layers}) a(l), range(2) b(m)), r as (select *, greatest(w >> mip, 1) as s, greatest({depth} >> mip, 1) as dd from q)
select image_id, case f when 0 then 'R8G8B8A8_UNORM' when 1 then 'R16_SFLOAT' else 'BC7_SRGB' end as vk_format, layer, mip, s::int as width, s::int as height, dd::int as depth, sha256(repeat(chr(65 + layer * 2 + mip), ((case f when 0 then s * s * 4 when 1 then s * s * 2 else ((s + 3) // 4) * ((s + 3) // 4) * 16 end) * dd)::int)) as sha256, null::varchar as error from r"""


for _name, _k, _sch, _cube, _n, _dep in (("ktx2_array_mips", "ktx2", "zstd", False, 3, 1), ("ktx2_cube_mips", "ktx2", None, True, 6, 1), ("ktx2_volume", "ktx2", "zlib", False, 1, 4), ("dds_array_mips", "dds", None, False, 3, 1), ("dds_cube_mips", "dds", None, True, 6, 1), ("dds_volume", "dds", None, False, 1, 4)):
    _add(_name, _chains(_k, _sch, _cube, _n, _dep), _chains_sql(_n, _dep))


def _png(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings as stored (uncompressed) grey PNG files, made in the JVM, read like any image."""
    row = lambda k: F.concat(F.lit("00"), F.concat_ws("", F.transform(F.slice("c", 16 * k + 1, 16), lambda x: F.lpad(F.hex(x), 2, "0"))))
    v = _t(spark, d, "embeddings").filter("embedding IS NOT NULL").select("vec_id", F.transform("embedding", lambda x: P.store_unorm(x.cast("double") + 0.5, 8)).alias("c"))
    raw = F.to_binary(F.concat(*[row(k) for k in range(4)]), F.lit("hex"))
    crc = lambda x: F.to_binary(F.lpad(F.hex(F.crc32(x)), 8, "0"), F.lit("hex"))
    # one stored deflate block of 68 bytes; its checksum is not needed to inflate it
    body = F.concat(F.lit(b"IDAT"), F.unhex(F.lit("7801014400BBFF")), F.col("raw"))
    head = bytes.fromhex("89504e470d0a1a0a0000000d") + b"IHDR" + bytes.fromhex("00000010000000040800000000")
    lead, end = head + zlib.crc32(head[12:]).to_bytes(4, "big") + (75).to_bytes(4, "big"), bytes(4) + b"IEND" + zlib.crc32(b"IEND").to_bytes(4, "big")
    files = v.withColumn("raw", raw).select(F.col("vec_id").alias("image_id"), F.concat(F.lit(lead), body, crc(body), F.lit(end)).alias("content"))
    return containers.read(files).select("image_id", "vk_format", "width", "height", F.hex("data").alias("data"), "error")


_add("png_read", _png, f"with {_CODES_SQL} select image_id, 'R8_SRGB' as vk_format, 16::int as width, 4::int as height, string_agg({_b1('c')}, '' order by i) as data, null::varchar as error from codes group by 1")


def queries() -> dict:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_S)
