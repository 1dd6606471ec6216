"""Stateless streaming of containers: files that arrive in a folder become surfaces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import containers

_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def stream_surfaces(spark: SparkSession, path: str) -> DataFrame:
    """A streaming DataFrame of surfaces; each file is decoded once, without state between files."""
    files = spark.readStream.format("binaryFile").schema(_SCHEMA).load(path)
    return containers.read(files.select(F.col("path").alias("image_id"), "content"))
