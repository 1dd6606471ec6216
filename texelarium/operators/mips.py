"""Mip levels and alpha coverage on exploded pixels, as combining aggregates."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.resample import FILTERS, full_count

SUBSAMPLES = 4


def dims(width: int, height: int, count: int | None = None) -> list[tuple[int, int]]:
    """Sizes of a chain; a count is clamped to the full chain, and zero is an error."""
    if count == 0:
        raise ValueError("a mip chain has at least one level")
    n = min(count or 64, full_count(width, height))
    return [(max(1, width >> k), max(1, height >> k)) for k in range(n)]


def _pi(x: Column) -> Column:
    return x * math.pi


def weight(name: str, d: Column) -> Column:
    """A filter's weight at a distance, in the target's texels."""
    a = F.abs(d)
    sinc = lambda x: F.when(x == 0, 1.0).otherwise(F.sin(_pi(x)) / _pi(x))
    cubic = F.when(a < 1, 1.5 * a * a * a - 2.5 * a * a + 1).when(a < 2, -0.5 * a * a * a + 2.5 * a * a - 4 * a + 2).otherwise(0.0)
    return {"triangle": F.greatest(1 - a, F.lit(0.0)), "catmull_rom": cubic, "gaussian": F.exp(-2 * d * d), "lanczos3": F.when(a < 3, sinc(d) * sinc(d / 3)).otherwise(0.0)}[name]


def _outputs(c: str, size: int, to: int, name: str) -> Column:
    """The target texels of an axis that a source texel counts for, with its weight."""
    ratio = size / to
    x = F.col(c).cast("double")
    if name == "nearest":
        near = F.sequence(F.greatest(F.floor(x / ratio) - 1, F.lit(0)), F.least(F.floor(x / ratio) + 1, F.lit(to - 1)))
        return F.transform(F.filter(near, lambda i: F.floor((i + 0.5) * ratio) == F.col(c)), lambda i: F.struct(i.cast("int").alias("at"), F.lit(1.0).alias("w")))
    stretch = max(ratio, 1.0)
    reach = FILTERS[name][0] * stretch
    low, high = F.greatest(F.floor((x - reach - 1) / ratio), F.lit(0)), F.least(F.ceil((x + reach + 1) / ratio), F.lit(to - 1))
    centre = lambda i: (i + 0.5) * ratio
    inside = lambda i: (F.col(c) >= F.floor(centre(i) - reach)) & (F.col(c) < F.ceil(centre(i) + reach))
    return F.transform(F.filter(F.sequence(low, high), inside), lambda i: F.struct(i.cast("int").alias("at"), weight(name, (x + 0.5 - centre(i)) / stretch).alias("w")))


def level(pixels: DataFrame, keys: list[str], lanes: list[str], width: int, height: int, name: str = "triangle") -> DataFrame:
    """The next level of a chain by one of the five filters, weights normalised over the texels that exist.

    A texel is scattered to the outputs it counts for, so the gather is one
    combining aggregate instead of joins.
    """
    w, h = max(1, width // 2), max(1, height // 2)
    spread = pixels.withColumn("_h", F.explode(_outputs("y", height, h, name))).withColumn("_w", F.explode(_outputs("x", width, w, name)))
    by = F.col("_h.w") * F.col("_w.w")
    sums = [(F.sum(F.col(c) * by) / F.sum(by)).alias(c) for c in lanes]
    return spread.groupBy(*keys, F.col("_h.at").alias("y"), F.col("_w.at").alias("x")).agg(*sums)


def chain(pixels: DataFrame, keys: list[str], lanes: list[str], width: int, height: int, count: int | None = None, name: str = "triangle") -> DataFrame:
    """All levels, ``mip`` being the number; each is made from the one before."""
    sizes = dims(width, height, count)
    levels = [pixels.select(*keys, "y", "x", *lanes)]
    for w, h in sizes[:-1]:
        levels.append(level(levels[-1], keys, lanes, w, h, name))
    return reduce(DataFrame.unionByName, [d.withColumn("mip", F.lit(k)) for k, d in enumerate(levels)])


def coverage_share(pixels: DataFrame, keys: list[str], alpha: str, width: int, height: int, cutoff: float) -> DataFrame:
    """(keys, passing, share): of the 16 bilinear subsamples of each texel, those with alpha at or above the cutoff.

    Each texel is scattered to the subsamples that it counts for, up to three
    quarters of a texel away; edges repeat, so an edge texel counts twice there.
    """
    a = F.when(F.isnan(F.col(alpha)), 0.0).otherwise(F.least(F.greatest(F.col(alpha).cast("double"), F.lit(0.0)), F.lit(1.0)))

    def samples(c: str, size: int) -> Column:
        own = F.sequence(F.greatest(F.col(c) * SUBSAMPLES - 4, F.lit(0)), F.least(F.col(c) * SUBSAMPLES + 7, F.lit(size * SUBSAMPLES - 1)))
        at = lambda s: (s + 0.5) / SUBSAMPLES - 0.5
        low = lambda s: F.floor(at(s))
        edge = lambda i: F.least(F.greatest(i, F.lit(0)), F.lit(size - 1))
        w = lambda s: F.when(edge(low(s)) == F.col(c), 1 - (at(s) - low(s))).otherwise(0.0) + F.when(edge(low(s) + 1) == F.col(c), at(s) - low(s)).otherwise(0.0)
        return F.filter(F.transform(own, lambda s: F.struct(s.alias("at"), w(s).alias("w"))), lambda t: t["w"] > 0)

    spread = pixels.withColumn("_a", a).withColumn("_h", F.explode(samples("y", height))).withColumn("_w", F.explode(samples("x", width)))
    value = spread.groupBy(*keys, F.col("_h.at").alias("sy"), F.col("_w.at").alias("sx")).agg(F.sum(F.col("_a") * F.col("_h.w") * F.col("_w.w")).alias("v"))
    passing = F.sum((F.col("v") >= cutoff).cast("long"))
    return value.groupBy(*keys).agg(passing.alias("passing"), (passing / F.count("*")).alias("share"))


def running(histogram: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, bin, n) with the number of thresholds up to and with each bin: what passes at its upper edge."""
    return histogram.withColumn("through", F.sum("n").over(W.partitionBy(*keys).orderBy("bin").rowsBetween(W.unboundedPreceding, 0)))


def apply_scale(lanes: dict[str, Column], scale: Column) -> dict[str, Column]:
    """Alpha times scale, at most one, and the premultiplied colours in the same ratio; clear texels stay."""
    a = lanes["a"]
    to = F.least(a * scale, F.lit(1.0))
    ratio = F.when(a > 0, to / a).otherwise(1.0)
    return {k: F.when(a > 0, to).otherwise(a) if k == "a" else v * ratio for k, v in lanes.items()}
