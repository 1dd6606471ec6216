"""Constraints on surfaces and images as DataFrames of violations: empty where all is well.

surfaces: (image_id, layer, mip, width, height, data) and, as far as an operator
needs them, vk_format, depth, stride, srgb, alpha. A violation is a row (image_id,
layer, mip, problem), or (image_id, problem) for a whole image.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import formats

I32_MAX = (1 << 31) - 1


def _first(rules: list[tuple[str, Column]]) -> Column:
    """The first rule that is broken, by name."""
    return reduce(lambda later, rule: F.when(F.coalesce(rule[1], F.lit(True)), rule[0]).otherwise(later), reversed(rules), F.lit(None).cast("string"))


def _with_format(df: DataFrame) -> DataFrame:
    table = F.broadcast(formats.formats(df.sparkSession).select("vk_format", "block_w", "block_h", "bytes_per_block"))  # under 200 rows
    return df.join(table, "vk_format", "left")


def tight_row_bytes(width: Column) -> Column:
    return (F.ceil(width / F.col("block_w")) * F.col("bytes_per_block")).cast("long")


def rows_in_image(height: Column) -> Column:
    return F.ceil(height / F.col("block_h")).cast("long")


def layout(surfaces: DataFrame) -> DataFrame:
    """Surfaces without texels, of unknown format, with rows shorter than their texels, or with too few bytes."""
    df = _with_format(surfaces)
    tight, rows = tight_row_bytes(F.col("width")), rows_in_image(F.col("height"))
    depth = F.col("depth").cast("long") if "depth" in surfaces.columns else F.lit(1).cast("long")
    stride = F.coalesce(F.col("stride").cast("long"), tight) if "stride" in surfaces.columns else tight
    # each slice but the last is whole; the last row may lack its padding
    span = stride.cast("decimal(38,0)") * (rows * depth - 1) + tight
    broken = _first([("unknown format", F.col("block_w").isNull()), ("no texels", (F.col("width") < 1) | (F.col("height") < 1) | (depth < 1)), ("short rows", stride < tight), ("too few bytes", F.octet_length("data").cast("decimal(38,0)") < span)])
    return df.select("image_id", "layer", "mip", broken.alias("problem")).filter("problem is not null")


def no_volume_slices(surfaces: DataFrame) -> DataFrame:
    return surfaces.filter("depth <> 1").select("image_id", "layer", "mip", F.lit("a volume slice").alias("problem"))


def images(surfaces: DataFrame, kind: str = "2d") -> DataFrame:
    """Images whose layers differ in mips, format or size, lack levels, or do not make the ``kind`` (2d, cube, 3d) that they should."""
    depth = F.col("depth") if "depth" in surfaces.columns else F.lit(1)
    base = F.col("mip") == 0
    level = surfaces.groupBy("image_id", "mip").agg(F.countDistinct("width", "height").alias("sizes"), F.count("*").alias("n"))
    level = level.groupBy("image_id").agg(F.max("sizes").alias("sizes"), F.min("n").alias("least"), F.max("n").alias("most"), F.count("*").alias("mips"), F.max("mip").alias("top"), F.min("mip").alias("low"))
    whole = surfaces.groupBy("image_id").agg(F.countDistinct("layer").alias("layers"), F.count("*").alias("rows"), F.countDistinct("vk_format").alias("formats"), F.max(F.when(base, F.col("width"))).alias("w"), F.max(F.when(base, F.col("height"))).alias("h"), F.max(depth).alias("d"), F.min(depth).alias("d0"))
    full = F.length(F.bin(F.greatest(F.col("w"), F.col("h"), F.col("d"), F.lit(1)).cast("long")))
    rules = [
        ("several formats", F.col("formats") != 1),
        ("levels missing", (F.col("low") != 0) | (F.col("top") != F.col("mips") - 1)),
        ("layers differ in mips", (F.col("least") != F.col("most")) | (F.col("rows") != F.col("layers") * F.col("mips"))),
        ("layers differ in size", F.col("sizes") != 1),
        ("more mips than a full chain", F.col("mips") > full),
    ]
    if kind == "cube":
        rules += [("no multiple of six faces", F.col("layers") % 6 != 0), ("faces are not square", F.col("w") != F.col("h"))]
    if kind == "3d":
        rules += [("a volume has one layer", F.col("layers") != 1)]
    else:
        rules += [("a volume slice", F.col("d") != 1)]
    return whole.join(level, "image_id").select("image_id", _first(rules).alias("problem")).filter("problem is not null")


def mip_counts(surfaces: DataFrame, keys: list[str]) -> DataFrame:
    """Groups of images that are to be put together but have different numbers of mips: (keys, least, most, first image that differs from the group's first)."""
    one = surfaces.groupBy(*keys, "image_id").agg(F.countDistinct("mip").alias("mips"))
    group = one.groupBy(*keys).agg(F.min("mips").alias("least"), F.max("mips").alias("most"), F.min_by("mips", "image_id").alias("wanted")).filter("least <> most")
    return one.join(group, keys).filter("mips <> wanted").groupBy(*keys).agg(F.first("least").alias("least"), F.first("most").alias("most"), F.min("image_id").alias("offender"))


def shared_desc(inputs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, problem, offender): the first input of a group whose format, then colour space, then alpha differs from that of the group's first."""
    want = inputs.groupBy(*keys).agg(F.min_by(F.struct("vk_format", "srgb", "alpha"), "input").alias("want"))
    off = [F.min(F.when(~F.col(c).eqNullSafe(F.col(f"want.{c}")), F.col("input"))).alias(c) for c in ("vk_format", "srgb", "alpha")]
    found = inputs.join(want, keys).groupBy(*keys).agg(*off)
    names = {"vk_format": "format", "srgb": "colour space", "alpha": "alpha"}
    problem = reduce(lambda later, c: F.when(F.col(c).isNotNull(), F.struct(F.lit(names[c]).alias("problem"), F.col(c).alias("offender"))).otherwise(later), ("alpha", "srgb", "vk_format"), F.lit(None))
    return found.select(*keys, problem.alias("p")).filter("p is not null").select(*keys, "p.problem", "p.offender")


def encoder_dims(surfaces: DataFrame, block: tuple[int, int] = (4, 4)) -> DataFrame:
    """Surfaces too large for encoders that count in 32 bits, by side or by size of the blocks."""
    out = F.ceil(F.col("width") / block[0]).cast("decimal(38,0)") * F.ceil(F.col("height") / block[1]) * 16
    broken = _first([("no texels", (F.col("width") < 1) | (F.col("height") < 1)), ("side too long", (F.col("width") > I32_MAX) | (F.col("height") > I32_MAX)), ("too many blocks", out > I32_MAX)])
    return surfaces.select("image_id", "layer", "mip", broken.alias("problem")).filter("problem is not null")
