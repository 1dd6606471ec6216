"""Helpers that the operators share: the shared folder, written tables, Python batches."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Hashable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ship import ensure_importable

#: ASCII white space of the contracts: space, \t, \n, \v, \f, \r.
WHITE = r"[\x20\x09-\x0D]"


_RESIDENT: dict[Hashable, Any] = {}


def resident(key: Hashable, build: Callable[[], Any]) -> Any:
    """The one model that a Python worker holds, kept between tasks.

    Spark reuses workers across stages, so another stage's model is dropped
    before this one is built: a worker never holds two.
    """
    if key not in _RESIDENT:
        release()
        _RESIDENT[key] = build()
    return _RESIDENT[key]


def release() -> None:
    """Drops the model that this Python worker still holds from an earlier stage and gives its memory back."""
    if _RESIDENT:
        _RESIDENT.clear()
        gc.collect()
        give_back()


def give_back() -> None:
    """Returns memory that is free inside this process, of Arrow and of the C library, to the machine."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function of batches whose worker holds no freed memory once its task has ended; idle workers live on for a minute."""

    @functools.wraps(run)
    def own(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return own


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset and
    Spark runs in one local process, as in tests, a temporary folder is set as the
    checkpoint folder; on a cluster, whose machines would each write to their own
    disk, that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
        if own.isDefined():
            return own.get()
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="texelarium-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/texelarium/{uuid.uuid4().hex}-{tag}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it back.

    It cuts the lineage and survives lost executors: a lost task re-reads files
    instead of recomputing what came before.
    """
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._texelarium_path = path
    if _SCRATCH:
        _SCRATCH[-1].append(out)
    return out


_SCRATCH: list[list[DataFrame]] = []


def tidy(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """An operator whose result is written, so that the tables it wrote on the way can be deleted."""

    @functools.wraps(f)
    def run(*args: Any, **options: Any) -> DataFrame:
        _SCRATCH.append([])
        try:
            out = f(*args, **options)
            own, _SCRATCH[-1] = _SCRATCH[-1], []
            done = materialize(out, f.__name__)
        finally:
            _SCRATCH.pop()
        for df in own:
            discard(df)
        if _SCRATCH:
            _SCRATCH[-1].append(done)
        return done

    return run


def discard(df: DataFrame) -> None:
    """Deletes the files of a table that ``materialize`` wrote and no plan needs any more."""
    path = getattr(df, "_texelarium_path", None)
    if path:
        spark = df.sparkSession
        jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jvm_path, True)


def pieces(df: DataFrame, size: int = 1 << 20) -> int:
    """How many partitions suit tables about as large as this one that ``materialize`` wrote: one a MB, two a core at least."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._texelarium_path)
    n = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    return max(2 * spark.sparkContext.defaultParallelism, -(-n // size))


def gathered(df: DataFrame, most: int | None) -> DataFrame:
    """``df`` in at most so many partitions, all rows kept; None: as they are.

    A small table that is dealt over many shuffle partitions costs a task and a
    file for each of them, which take far longer than its rows.
    """
    return df if most is None else df.coalesce(most)


def light_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 4 MB, where the session has Spark's default of 64 MB.

    Rows hold whole texts here; an executor has a batch several times at once, in
    the JVM and in each Python worker, and larger ones save no time.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) in ("64MB", "64m", "67108864", "67108864b"):
        spark.conf.set(key, "4194304b")


def fold(key: str | Column, n: int) -> Column:
    """crc32 of the key as text, modulo n; a null key is fold 0."""
    return F.coalesce(F.crc32(F.col(key).cast("string") if isinstance(key, str) else key.cast("string")), F.lit(0)) % n


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ensure_importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_slices(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int, list[str | None]]]:
    """(start, end, texts) of runs of an Arrow column with about ``most`` bytes together (a longer text is alone)."""
    size = np.asarray(pc.fill_null(pc.binary_length(column), 0))
    start = total = 0
    for i, n in enumerate(size):
        if i > start and total + n > most:
            yield start, i, column.slice(start, i - start).to_pylist()
            start, total = i, 0
        total += int(n)
    if start < len(size):
        yield start, len(size), column.slice(start).to_pylist()
