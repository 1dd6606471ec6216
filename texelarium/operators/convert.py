"""Whole conversions: bytes in one format to bytes in another, as a map over surfaces or over mip chains.

The plan is made once, on the driver; executors run its steps. Without mipmaps a
surface is converted by itself: no shuffle. With mipmaps the levels of a layer,
one unit of work of at most some thirty levels, meet by a group.

A surface that cannot be read is a row with ``error``; nothing else stops the job.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lanes as L
from ..functions import resample
from ..plans import formats
from ..plans.planner import Desc, Plan, Settings, effective_cutoff, plan
from . import codecs

FORM = "vk_format string, layer int, mip int, width int, height int, data binary, error string"


def run_chain(chain: list[tuple[bytes, int, int]], source: Desc, settings: Settings, p: Plan) -> list[tuple[bytes, int, int]]:
    """Converts the levels (data, width, height) of one layer by a plan."""
    if p.steps == ("passthrough",):
        return chain
    levels = []
    for data, w, h in chain[: settings.mip_count or resample.full_count(*chain[0][1:])] if settings.mipmap else chain:
        x = L.load(data, w, h, source.vk_format, source.srgb, p.load_alpha, p.lane)
        levels.append(x if settings.swizzle is None else L.swizzle(x, settings.swizzle))
    if settings.mipmap:
        supplied = len(levels)
        levels = resample.complete(levels, settings.mip_filter, settings.mip_count)
        cutoff = effective_cutoff(settings, formats.has_alpha(p.target.vk_format), source.alpha, p.target.alpha)
        if cutoff is not None:
            levels = resample.preserve(levels, supplied, cutoff)
    out = []
    for x in levels:
        data = L.store(x, p.stored, p.target.srgb, p.store_alpha)
        if p.encoder is not None:
            data = codecs.encode(data, x.shape[1], x.shape[0], p.target.vk_format, dict(settings.options))
        out.append((data, x.shape[1], x.shape[0]))
    return out


def _schema(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "smallint": pa.int16()}[kind]


def convert(surfaces: DataFrame, source: Desc, settings: Settings) -> DataFrame:
    """(image_id, layer, mip, width, height, data) to the same with vk_format and error."""
    p = plan(source, settings)
    kind = surfaces.schema["image_id"].dataType.simpleString()
    level = F.struct(F.col("mip").cast("int").alias("mip"), F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"), "data")
    rows = surfaces.select("image_id", F.col("layer").cast("int").alias("layer"), level.alias("level"))
    if settings.mipmap:
        rows = rows.groupBy("image_id", "layer").agg(F.array_sort(F.collect_list("level")).alias("chain"))
    else:
        rows = rows.select("image_id", "layer", F.array("level").alias("chain"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for i, layer, chain in zip(batch.column("image_id").to_pylist(), batch.column("layer").to_pylist(), batch.column("chain")):
                chain = chain.as_py()
                try:
                    got = run_chain([(c["data"] or b"", c["width"], c["height"]) for c in chain], source, settings, p)
                except (L.LaneError, codecs.CodecError) as e:
                    out.append((i, None, layer, chain[0]["mip"], None, None, None, str(e)))
                    continue
                out += [(i, p.target.vk_format, layer, chain[0]["mip"] + k, w, h, d, None) for k, (d, w, h) in enumerate(got)]
            kinds = [_schema(kind), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string()]
            names = ["image_id", "vk_format", "layer", "mip", "width", "height", "data", "error"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 8, kinds)], names=names)

    return rows.mapInArrow(run, f"image_id {kind}, {FORM}")


def pixels(surfaces: DataFrame, source: Desc, lane: str = "f32") -> DataFrame:
    """(image_id, width, height, data) to one row per texel (image_id, y, x, r, g, b, a); integer lanes as DECIMAL(20,0)."""
    kind, integer = surfaces.schema["image_id"].dataType.simpleString(), lane.startswith("u")
    to = pa.uint64() if integer else pa.float64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, (w, h, data) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("width", "height", "data")))):
                x = L.load(data, w, h, source.vk_format, source.srgb, source.alpha, lane).reshape(-1, 4)
                at = np.arange(len(x), dtype=np.int32)
                ids = batch.column("image_id").take(pa.array(np.full(len(x), n)))
                lanes = [pa.array(x[:, k].astype(np.uint64 if integer else np.float64), to) for k in range(4)]
                lanes = [v.cast(pa.decimal128(20, 0)) for v in lanes] if integer else lanes
                yield pa.RecordBatch.from_arrays([ids, pa.array(at // w), pa.array(at % w), *lanes], names=["image_id", "y", "x", *"rgba"])

    form = "decimal(20,0)" if integer else "double"
    src = surfaces.select("image_id", "width", "height", "data")
    return src.mapInArrow(run, f"image_id {kind}, y int, x int, " + ", ".join(f"{c} {form}" for c in "rgba"))


def passing_shares(surfaces: DataFrame, source: Desc, cutoff: float) -> DataFrame:
    """(image_id, layer, mip, passing, subsamples): bilinear subsamples with alpha at or above the cutoff, a map."""
    kind = surfaces.schema["image_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [L.load(d, w, h, source.vk_format, source.srgb) for d, w, h in zip(*(batch.column(c).to_pylist() for c in ("data", "width", "height")))]
            cols = [pa.array([resample.passing_count(v, cutoff) for v in x], pa.int64()), pa.array([v.shape[0] * v.shape[1] * resample.SUBSAMPLES**2 for v in x], pa.int64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("image_id", "layer", "mip")), *cols], names=["image_id", "layer", "mip", "passing", "subsamples"])

    src = surfaces.select("image_id", F.col("layer").cast("int"), F.col("mip").cast("int"), "width", "height", "data")
    return src.mapInArrow(run, f"image_id {kind}, layer int, mip int, passing long, subsamples long")


def threshold_histograms(surfaces: DataFrame, source: Desc, cutoff: float) -> DataFrame:
    """(image_id, bin, n): thresholds of all subsamples in log-spaced bins; surfaces of an image add up."""
    kind = surfaces.schema["image_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, bins, counts = [], [], []
            for i, d, w, h in zip(*(batch.column(c).to_pylist() for c in ("image_id", "data", "width", "height"))):
                hist = resample.threshold_histogram(L.load(d, w, h, source.vk_format, source.srgb), cutoff)
                at = np.flatnonzero(hist)
                ids += [i] * len(at)
                bins.append(at)
                counts.append(hist[at])
            cols = [pa.array(ids, batch.schema.field("image_id").type), pa.array(np.concatenate([np.zeros(0, int), *bins])), pa.array(np.concatenate([np.zeros(0, int), *counts]))]
            yield pa.RecordBatch.from_arrays(cols, names=["image_id", "bin", "n"])

    got = surfaces.select("image_id", "width", "height", "data").mapInArrow(run, f"image_id {kind}, bin long, n long")
    return got.groupBy("image_id", "bin").agg(F.sum("n").alias("n"))
