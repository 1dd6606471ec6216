"""Makes the package importable by Spark's Python workers."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parent


def ensure_importable(spark: SparkSession) -> None:
    """Ships the package's sources with the job, unless workers find it already.

    A package that is installed, or whose folder is in PYTHONPATH, is found.
    Otherwise a zip of the sources goes to the executors through Spark's own file server.
    """
    sc = spark.sparkContext
    on_path = [os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if str(_ROOT.parent) in on_path or "site-packages" in _ROOT.parts or getattr(sc, "_texelarium_shipped", False):
        return
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for p in sorted(_ROOT.rglob("*.py")):
            z.write(p, p.relative_to(_ROOT.parent).as_posix())
    path = Path(tempfile.mkdtemp(prefix="texelarium-")) / "texelarium-src.zip"
    path.write_bytes(data.getvalue())
    sc.addPyFile(str(path))
    sc._texelarium_shipped = True
