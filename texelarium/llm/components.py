"""Connected components of a link table, by alternating large-star and small-star steps.

All links stay in DataFrames: each step is an aggregate to the smallest
neighbour (which combines before it shuffles), written as a table of its own, and
a join back: a plain shuffled join, so adaptive execution can split a hub's rows.
The only thing that reaches the driver is a two-number checksum per step.

The alternation ends at its fixed point, which it is proven to reach (in
O(log^2 n) steps), so no number of steps is set.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, gathered, materialize


def _checksum(df: DataFrame) -> tuple:
    # addition modulo a prime: order does not matter, overflow cannot happen
    row = df.agg(F.count("*").alias("n"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(2147483647))).alias("s")).first()
    return row["n"], row["s"]


def connected_components(links: DataFrame, a: str, b: str, most: int | None = None) -> DataFrame:
    """Returns (node, component): the smallest node that each linked node reaches.

    Nodes that occur in no link to another node are not returned. Null ends and
    self-links are ignored. Any orderable type can name a node. Each step is done
    in at most ``most`` partitions, where that is given.
    """
    e = links.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v")
    e = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = materialize(gathered(e, most), "links")
    seen = _checksum(e)
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        least = materialize(gathered(least, most), "least")
        large = gathered(both.filter("v > u").join(least, "u"), most).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(gathered(large, most), "large")
        low = materialize(gathered(large.groupBy("u").agg(F.min("v").alias("m")), most), "low")
        pair = lambda x: F.struct(F.col(x).alias("u"), F.col("m").alias("v"))
        small = gathered(large.join(low, "u"), most).select(F.explode(F.array(pair("u"), pair("v"))).alias("p")).select("p.u", "p.v").filter("u <> v").distinct()
        small = materialize(gathered(small, most), "small")
        now = _checksum(small)
        for old in (e, least, large, low):
            discard(old)
        e = small
        if now == seen:
            break
        seen = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
