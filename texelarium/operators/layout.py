"""Coordinate remaps and assembly on the exploded ``pixels`` form: (image_id, [layer], y, x, lanes...)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Face order +X -X +Y -Y +Z -Z, (column, row) of each face in its atlas.
HORIZONTAL = ((2, 1), (0, 1), (1, 0), (1, 2), (1, 1), (3, 1))
VERTICAL = ((2, 1), (0, 1), (1, 0), (1, 2), (1, 1), (1, 3))


def crop(pixels: DataFrame, x0: int, y0: int, width: int, height: int) -> DataFrame:
    inside = F.col("x").between(x0, x0 + width - 1) & F.col("y").between(y0, y0 + height - 1)
    return pixels.filter(inside).withColumns({"x": F.col("x") - x0, "y": F.col("y") - y0})


def rotate_180(pixels: DataFrame, width: int, height: int) -> DataFrame:
    return pixels.withColumns({"x": F.lit(width - 1) - F.col("x"), "y": F.lit(height - 1) - F.col("y")})


def split_strip(pixels: DataFrame, n: int) -> DataFrame:
    """A 6x1 strip of n x n faces; ``layer`` is the face."""
    return pixels.filter((F.col("x") < 6 * n) & (F.col("y") < n)).withColumns({"layer": F.floor(F.col("x") / n).cast("int"), "x": F.col("x") % n})


def split_cross(pixels: DataFrame, n: int, vertical: bool = False) -> DataFrame:
    """A 4x3 or 3x4 cross; in the vertical one, -Z is stored rotated by 180 degrees. Pixels off the faces go."""
    cx, cy = F.floor(F.col("x") / n), F.floor(F.col("y") / n)
    layer = F.lit(None).cast("int")
    for face, (i, j) in reversed(list(enumerate(VERTICAL if vertical else HORIZONTAL))):
        layer = F.when((cx == i) & (cy == j), face).otherwise(layer)
    out = pixels.withColumn("layer", layer).filter("layer IS NOT NULL").withColumns({"x": F.col("x") % n, "y": F.col("y") % n})
    if vertical:
        turn = lambda c: F.when(F.col("layer") == 5, n - 1 - F.col(c)).otherwise(F.col(c)).cast("int")
        out = out.withColumns({"x": turn("x"), "y": turn("y")})
    return out


def face_size(width: int, height: int, kind: str) -> int:
    """The side of a face of an atlas: a strip is 6x1 faces, crosses are 4x3 and 3x4."""
    across, down = {"strip": (6, 1), "cross": (4, 3), "vertical": (3, 4)}[kind]
    n = width // across
    if n < 1 or n * across != width or n * down != height:
        raise ValueError(f"{width}x{height} pixels are no {kind} of square faces")
    return n


def split_cubemap(pixels: DataFrame, width: int, height: int, kind: str = "auto") -> DataFrame:
    """Faces of an atlas as layers; auto takes the layout that the ratio of the sides tells."""
    if kind == "auto":
        kind = "strip" if width == 6 * height else "cross" if 3 * width == 4 * height else "vertical"
    n = face_size(width, height, kind)
    return split_strip(pixels, n) if kind == "strip" else split_cross(pixels, n, kind == "vertical")


def tile(pixels: DataFrame, width: int, height: int, block: int = 4) -> DataFrame:
    """Block-major texels (by, bx, ty, tx), clamped to the edge where a block reaches over it.

    Instead of a join back to the texels, the texels of the last row and column
    are repeated to fill their blocks: a generator without a shuffle.
    """
    more = lambda c, size: F.when(F.col(c) == size - 1, F.sequence(F.col(c), F.lit((size + block - 1) // block * block - 1))).otherwise(F.array(F.col(c)))
    out = pixels.withColumn("_y", F.explode(more("y", height))).withColumn("_x", F.explode(more("x", width)))
    at = {"by": F.floor(F.col("_y") / block), "bx": F.floor(F.col("_x") / block), "ty": F.col("_y") % block, "tx": F.col("_x") % block}
    return out.withColumns({k: v.cast("int") for k, v in at.items()}).drop("_x", "_y", "x", "y")


def assemble_array(layers: list[DataFrame]) -> DataFrame:
    """Union in the order given; ``layer`` is the place in it."""
    return reduce(DataFrame.unionByName, [d.withColumn("layer", F.lit(k)) for k, d in enumerate(layers)])


def assemble_cubemap(faces: list[DataFrame]) -> DataFrame:
    if len(faces) % 6:
        raise ValueError(f"a cubemap takes a multiple of six faces, not {len(faces)}")
    return assemble_array(faces)


def assemble_volume(slices: list[DataFrame]) -> DataFrame:
    return assemble_array(slices).withColumnRenamed("layer", "z")
