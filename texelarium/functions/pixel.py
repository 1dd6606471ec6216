"""Pixel arithmetic as pure Column functions: decode, curves, alpha, swizzle, quantise, pack.

Lanes are DOUBLE on the float side and BIGINT on the integer side (ANSI mode
overflows INT). Everything stays inside whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LANES = ("r", "g", "b", "a")
U32 = (1 << 32) - 1


def _d(x: float) -> Column:
    return F.lit(float(x))


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """NaN counts as low."""
    return F.when(F.isnan(c), _d(low)).otherwise(F.least(F.greatest(c, _d(low)), _d(high)))


def half_away(c: Column) -> Column:
    """Rounds half away from zero, to BIGINT."""
    return F.when(c < 0, -F.floor(-c + 0.5)).otherwise(F.floor(c + 0.5)).cast("long")


# decoding: codes to lanes
def decode_unorm(code: Column, bits: int) -> Column:
    return code.cast("double") / _d((1 << bits) - 1)


def decode_snorm(code: Column, bits: int) -> Column:
    return F.greatest(code.cast("double") / _d((1 << bits - 1) - 1), _d(-1.0))


def field(word: Column, shift: int, bits: int) -> Column:
    return F.shiftright(word.cast("long"), shift).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))


def signed(code: Column, bits: int) -> Column:
    return F.when(code >= 1 << bits - 1, code - (1 << bits)).otherwise(code)


def a2_10_10_10(word: Column, red_low: bool = True) -> dict[str, Column]:
    """Raw fields of a 2:10:10:10 word; red in the low slot (A2B10G10R10) or in the high one."""
    r, b = (0, 20) if red_low else (20, 0)
    return {"r": field(word, r, 10), "g": field(word, 10, 10), "b": field(word, b, 10), "a": field(word, 30, 2)}


def decode_e5b9g9r9(word: Column) -> dict[str, Column]:
    scale = F.pow(_d(2.0), (field(word, 27, 5) - 24).cast("double"))
    return {c: field(word, s, 9).cast("double") * scale for c, s in (("r", 0), ("g", 9), ("b", 18))} | {"a": _d(1.0)}


def small_float(code: Column, mantissa: int) -> Column:
    """Unsigned float of five exponent bits (bias 15): denormals, infinity and NaN included."""
    e, m = F.shiftright(code, mantissa), code.bitwiseAND(F.lit((1 << mantissa) - 1).cast("long")).cast("double")
    normal = F.pow(_d(2.0), (e - 15).cast("double")) * (m / _d(1 << mantissa) + 1.0)
    top = F.when(m == 0, _d(float("inf"))).otherwise(_d(float("nan")))
    return F.when(e == 0, m * _d(2.0 ** (-14 - mantissa))).when(e == 31, top).otherwise(normal)


def decode_b10g11r11(word: Column) -> dict[str, Column]:
    return {"r": small_float(field(word, 0, 11), 6), "g": small_float(field(word, 11, 11), 6), "b": small_float(field(word, 22, 10), 5), "a": _d(1.0)}


def decode_half(code: Column) -> Column:
    """Half floats from their bits: denormals, infinities and NaN included."""
    size = small_float(code.bitwiseAND(F.lit(0x7FFF).cast("long")), 10)
    return F.when(code >= 0x8000, -size).otherwise(size)


# curves and alpha
def eotf(c: Column) -> Column:
    """sRGB code value to linear, exact curve, on values clamped to 0..1."""
    c = clamp(c)
    return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, _d(2.4)))


def oetf(c: Column) -> Column:
    """Linear to sRGB, exact curve, on values clamped to 0..1."""
    c = clamp(c)
    return F.when(c <= 0.0031308, c * 12.92).otherwise(F.pow(c, _d(1 / 2.4)) * 1.055 - 0.055)


def premultiply(c: Column, a: Column) -> Column:
    return c * a


def unpremultiply(c: Column, a: Column) -> Column:
    return c / F.when(a > 0, a).otherwise(_d(1.0))


def swizzle(lanes: dict[str, Column], pattern: str, integer: bool = False, bits: int = 32) -> dict[str, Column]:
    """Four of ``rgba01``; One is 1.0, or the lane's maximum on the integer side."""
    pattern = pattern.lower()
    if len(pattern) != 4 or set(pattern) - set("rgba01"):
        raise ValueError(f"a swizzle is four of rgba01, not {pattern!r}")
    if integer and bits not in (32, 64):
        raise ValueError(f"integer lanes have 32 or 64 bits, not {bits}")
    # the maximum of 64 bits has the pattern of -1
    one = F.lit((1 << 32) - 1 if bits == 32 else -1).cast("long") if integer else _d(1.0)
    zero = F.lit(0).cast("long") if integer else _d(0.0)
    return {to: {"0": zero, "1": one}.get(p, lanes.get(p)) for to, p in zip(LANES, pattern)}


# quantising: lanes to codes
def store_unorm(c: Column, bits: int) -> Column:
    return half_away(clamp(c) * ((1 << bits) - 1))


def store_snorm(c: Column, bits: int) -> Column:
    return half_away(clamp(c, -1.0, 1.0) * ((1 << bits - 1) - 1))


def store_srgb8(c: Column) -> Column:
    """Ties to even, unlike the unorm stores."""
    return F.rint(oetf(c) * 255).cast("long")


def store_uint(lane: Column, bits: int) -> Column:
    return F.least(lane.cast("long"), F.lit((1 << bits) - 1).cast("long"))


def store_sint(lane: Column, bits: int) -> Column:
    """A 32-bit lane read as signed, clamped to the narrower type."""
    lane = F.when(lane >= 1 << 31, lane - (1 << 32)).otherwise(lane)
    return F.least(F.greatest(lane, F.lit(-(1 << bits - 1)).cast("long")), F.lit((1 << bits - 1) - 1).cast("long"))


def pack_a2_10_10_10(r: Column, g: Column, b: Column, a: Column, red_low: bool = True) -> Column:
    low, high = (r, b) if red_low else (b, r)
    put = lambda c, s: F.shiftleft(c.cast("long").bitwiseAND(F.lit(1023 if s < 30 else 3).cast("long")), s)
    return put(low, 0).bitwiseOR(put(g, 10)).bitwiseOR(put(high, 20)).bitwiseOR(put(a, 30))


def store_field(lane: Column, bits: int, signed_: bool = False) -> Column:
    """An integer lane clamped to a field of a packed word, as the field's bits."""
    v = store_sint(lane, bits) if signed_ else store_uint(lane, bits)
    return v.bitwiseAND(F.lit((1 << bits) - 1).cast("long"))


def _exponent(a: Column, low: int, high: int) -> Column:
    """The exponent of a value, held between two bounds.

    A logarithm that rounds across a power of two gives its other side, where the
    stores below give the same code: a full mantissa carries. Counting the powers
    is exact too, but as code it is too long for the JVM to compile.
    """
    return F.floor(F.log2(F.least(F.greatest(a, _d(2.0**low)), _d(2.0**high)))).cast("long")


def store_small_float(c: Column, mantissa: int, sign: bool = False) -> Column:
    """Five exponent bits (bias 15), ties to even; without a sign negative values are 0, what is too large is infinity."""
    a = F.abs(c)
    e = _exponent(a, -14, 16)
    code = (e + 14) * (1 << mantissa) + F.rint(a * F.pow(_d(2.0), (F.lit(mantissa) - e).cast("double"))).cast("long")
    top = F.lit(31 << mantissa).cast("long")
    code = F.when(F.isnan(c), top + 1).when(a >= 2.0**16, top).otherwise(F.least(code, top))
    if not sign:
        return F.when((c <= 0) & ~F.isnan(c), F.lit(0).cast("long")).otherwise(code)
    return code + F.when((c < 0) & ~F.isnan(c), F.lit(1 << mantissa + 5).cast("long")).otherwise(F.lit(0).cast("long"))


def pack_b10g11r11(r: Column, g: Column, b: Column) -> Column:
    return store_small_float(r, 6) + store_small_float(g, 6) * (1 << 11) + store_small_float(b, 5) * (1 << 22)


def pack_e5b9g9r9(r: Column, g: Column, b: Column) -> Column:
    """Shared exponent from the largest channel; adds a half and truncates; bumps the exponent on carry."""
    r, g, b = (clamp(c, 0.0, 65408.0) for c in (r, g, b))
    top = F.greatest(r, g, b)
    e = _exponent(top, -16, 15) + 16
    unit = F.pow(_d(2.0), (e - 24).cast("double"))
    e = F.when(F.floor(top / unit + 0.5) >= 512, e + 1).otherwise(e)
    unit = F.pow(_d(2.0), (e - 24).cast("double"))
    m = [F.floor(c / unit + 0.5).cast("long") for c in (r, g, b)]
    return m[0] + m[1] * 512 + m[2] * (1 << 18) + e * (1 << 27)


def register_sql(spark) -> None:
    """Makes the curves callable from SQL, as SQL functions (expanded by the optimiser, no Python)."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION srgb_eotf(c DOUBLE) RETURNS DOUBLE RETURN CASE WHEN isnan(c) THEN 0D WHEN c <= 0.04045D THEN greatest(c, 0D) / 12.92D ELSE power((least(c, 1D) + 0.055D) / 1.055D, 2.4D) END")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION srgb_oetf(c DOUBLE) RETURNS DOUBLE RETURN CASE WHEN isnan(c) THEN 0D WHEN c <= 0.0031308D THEN greatest(c, 0D) * 12.92D ELSE power(least(c, 1D), 1D / 2.4D) * 1.055D - 0.055D END")
