"""Links between the parts of buckets, found by comparing blocks of members.

Parts are the components known so far. Of every bucket with more than one part,
all pairs of members of different parts are compared, exactly; pairs of one part
are connected already. A large part has blocks of its own, small parts share
some, spread by hash, so no bucket is one task's; a task holds two blocks at a
time, and no pairs of members are listed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gathered, lean, materialize, release


def _jobs(hits: Callable[[list, list], np.ndarray]):
    def job(side: np.ndarray, part: np.ndarray, value: np.ndarray) -> set:
        code, names = pd.factorize(part)
        x, y = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        y = y if len(y) else x
        if len(names) < 2:
            return set()
        hit = hits(list(value[x]), list(value[y])) & (code[x][:, None] != code[y][None, :])
        i, j = np.nonzero(hit)
        a, b = np.minimum(code[x][i], code[y][j]), np.maximum(code[x][i], code[y][j])
        return {(min(names[u], names[v]), max(names[u], names[v])) for u, v in np.unique(np.stack((a, b), 1), axis=0)}

    @lean
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        held: pd.DataFrame | None = None
        for pdf in batches:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            if not len(pdf):
                continue
            jobs, side, part, value = (pdf[c].to_numpy() for c in ("job", "side", "part", "value"))
            ends = [0, *(np.flatnonzero(jobs[1:] != jobs[:-1]) + 1)]
            out = [p for s, e in zip(ends, ends[1:]) for p in job(side[s:e], part[s:e], value[s:e])]
            held = pdf.iloc[ends[-1] :]
            if out:
                yield pd.DataFrame(out, columns=["a", "b"])
        if held is not None and (out := job(*(held[c].to_numpy() for c in ("side", "part", "value")))):
            yield pd.DataFrame(list(out), columns=["a", "b"])

    return run


def cross_links(members: DataFrame, keys: list[str], values: DataFrame, hits: Callable[[list, list], np.ndarray], block: int, most: int | None = None) -> DataFrame:
    """(a, b): pairs of parts of which two members that share a bucket are linked.

    members: (keys of the bucket, node, part); values: (node, value), once a node;
    ``hits`` tells from two lists of values which of their pairs are linked. What
    holds no values is done in at most ``most`` partitions, where that is given.
    """
    mixed = members.groupBy(*keys).agg((F.min("part") != F.max("part")).alias("mixed")).filter("mixed").select(*keys)
    mixed = materialize(gathered(mixed, most), "keys")
    members = materialize(gathered(members.join(mixed, keys), most), "mixed")
    small = F.col("n") < block // 2
    sizes = members.groupBy(*keys, "part").agg(F.count("*").alias("n"))
    sizes = sizes.select(*keys, "part", small.alias("small"), "n", F.when(small, F.lit(b"")).otherwise(F.col("part")).alias("own"))
    # tables of their own, so that the joins are plain ones whose hot buckets can be split
    sizes = materialize(gathered(sizes, most), "sizes")
    fill = sizes.groupBy(*keys, "own").agg(F.ceil(F.sum("n") / block).cast("long").alias("blocks"))
    fill = materialize(gathered(fill, most), "fill")
    k = F.pmod(F.xxhash64(F.when(F.col("small"), F.col("part")).otherwise(F.col("node"))), F.col("blocks"))
    placed = members.join(sizes, [*keys, "part"]).join(fill, [*keys, "own"]).select(*keys, "own", F.xxhash64("own", k).alias("i"), "node", "part")
    placed = materialize(gathered(placed, most), "placed")
    blocks = materialize(gathered(placed.select(*keys, "own", "i").distinct(), most), "blocks")
    same = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in keys]
    meet = F.expr("x.i <= y.i AND (x.own <> y.own OR octet_length(x.own) = 0)")
    pairs = blocks.alias("x").join(blocks.alias("y"), [*same, meet])
    pairs = pairs.select(*[F.col(f"x.{c}").alias(c) for c in keys], F.col("x.i").alias("i"), F.col("y.i").alias("j")).withColumn("job", F.xxhash64(*keys, "i", "j"))
    first, second = F.struct(F.col("i"), F.lit(0).alias("side")), F.struct(F.col("j").alias("i"), F.lit(1).alias("side"))
    sides = pairs.select(*keys, "job", F.explode(F.when(F.col("i") == F.col("j"), F.array(first)).otherwise(F.array(first, second))).alias("s")).select(*keys, "job", "s.i", "s.side")
    rows = sides.join(placed, [*keys, "i"]).select("job", "side", "part", "node").join(values, "node").select("job", "side", "part", "value")
    across = rows.repartition("job").sortWithinPartitions("job", "side").mapInPandas(_jobs(hits), "a binary, b binary").distinct()
    return materialize(gathered(across, most), "across")
