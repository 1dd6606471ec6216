"""Panoramas to cubemaps: positions as Column functions, and whole projections as a map over images."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import equirect as E
from ..functions import lanes as L
from ..plans.planner import Desc


def position(face: Column, y: Column, x: Column, n: int, front: str = "+z", mirror: bool = False) -> tuple[Column, Column]:
    """(u, v) in the panorama, 0 to 1, of a face's texel."""
    E.validate_face_size(n)
    a, b = (2 * x + 1) / n - 1, (2 * y + 1) / n - 1
    turned = [[E.orient(np.array(v, float), front, mirror) for v in f] for f in E.FACES]

    def part(axis: int) -> Column:
        out = F.lit(0.0)
        for k in reversed(range(6)):
            m, r, d = (float(v[axis]) for v in turned[k])
            out = F.when(face == k, F.lit(m) + a * r + b * d).otherwise(out)
        return out

    dx, dy, dz = (part(k) for k in range(3))
    return 0.5 + F.atan2(dx, dz) / (2 * math.pi), F.atan2(F.sqrt(dx * dx + dz * dz), dy) / math.pi


def project(surfaces: DataFrame, source: Desc, face_size: int | None = None, front: str = "+z", mirror: bool = False) -> DataFrame:
    """(image_id, width, height, data) to six R32G32B32A32_SFLOAT faces, linear; ``layer`` is the face. Other sizes and formats are error rows."""
    kind = surfaces.schema["image_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["image_id", "layer", "width", "height", "data", "error"]
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string()]
        for batch in batches:
            for n, (w, h, data) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("width", "height", "data")))):
                try:
                    lanes = L.load(data or b"", w, h, source.vk_format, source.srgb)
                    rows = [(k, f.shape[1], f.shape[0], f.astype("<f4").tobytes(), None) for k, f in enumerate(E.project(lanes, face_size, front, mirror))]
                except (L.LaneError, ValueError) as e:
                    rows = [(None, None, None, None, str(e))]
                ids = batch.column("image_id").take(pa.array([n] * len(rows)))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, t in zip(zip(*rows), kinds))], names=names)

    src = surfaces.select("image_id", "width", "height", "data")
    return src.mapInArrow(run, f"image_id {kind}, layer int, width int, height int, data binary, error string")
