"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions only.

A source's target over its size is the expected number of copies of each of its
documents. Whole copies are certain; the fraction p left is a fixed-size Pareto
order sample: a document's rank key is (u / (1 - u)) / (p / (1 - p)), u being
its uniform random number, and the smallest keys are taken until the words left
to the source are used up. With ``weight_col`` the expected copies, and so p,
differ between the documents of a source.

The cut is found without sorting a source in one task: keys fall into ``bins``
ranges (counted by an aggregate that combines before the shuffle), running sums
over a source's ranges name the range that holds the cut, that range is divided
again, ``levels`` times in all, and only the documents of the last range, one in
``bins ** levels`` of the source, are ordered one by one. The only windows without
a partition are over the table of sources, one row each.

Random numbers are md5 of seed and id, so reruns agree on any partitioning.
Defined cases: null text has size 0; sources without words have target 0; null
sources are one source, last in order; rows with equal ids share a random number
and are ordered by size; null ids count as the empty id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize

#: Weights of the sources, repeating.
WEIGHTS = (3, 1, 2)


def words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def uniform(key: Column, seed: str) -> Column:
    """A number strictly between 0 and 1 from 52 bits of md5(seed:key)."""
    h = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))
    return (F.conv(F.substring(h, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size) to (source, source_size, target): one row per source, by water-filling.

    Sources fill up in the order of source_size / weight. A source is full when
    its part of what earlier full sources leave is more than its cap.
    One row per source is sorted here, a table of the sources' own size.
    """
    by_name = W.orderBy(F.asc_nulls_last("source"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    cap = sizes.withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    order = W.orderBy(F.col("cap") / F.col("w"), F.asc_nulls_last("source"))
    before, rest = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    total = F.sum("source_size").over(W.partitionBy()) * F.lit(float(share))
    part = F.col("w") * (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(rest)
    cap = cap.withColumn("part", part).withColumn("full", F.col("part") >= F.col("cap"))
    # all sources from the first that is not full share what is left by weight
    first = F.min(F.when(~F.col("full"), F.col("cap") / F.col("w"))).over(W.partitionBy())
    open_ = F.coalesce(F.col("cap") / F.col("w") >= first, F.lit(False))
    level = F.first(F.when(~F.col("full"), F.col("part") / F.col("w")), ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return cap.select("source", "source_size", F.when(open_, F.least(F.col("w") * level, F.col("cap"))).otherwise(F.col("cap")).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight_col: str | None = None, weights: tuple = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: str = "mix", bins: int = 128, levels: int = 3, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: (id, source, size, source_size, target, taken, whole, copies).

    ``taken`` is size times copies, the whole copies plus the sampled one. The
    columns named in ``carry`` come along under their names with ``carry_`` before
    them; they are joined only with the tables of sources and cuts.
    """
    weight = F.lit(1.0) if weight_col is None else F.coalesce(F.col(weight_col).cast("double"), F.lit(0.0))
    sized = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), words(text_col).alias("size"), weight.alias("weight"), *[F.col(c).alias(f"carry_{c}") for c in carry])
    rows = materialize(sized.select("id", "source", "size", "weight"), "sizes")
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.col("size") * F.col("weight")).alias("mass"))
    goal = targets(sums.select("source", "source_size"), weights, share, most)
    goal = materialize(goal.join(sums.select(F.col("source").alias("s"), "mass"), F.col("source").eqNullSafe(F.col("s"))).drop("s"), "targets")
    keyed = (sized if carry else rows).join(goal.withColumnRenamed("source", "g"), F.col("source").eqNullSafe(F.col("g"))).drop("g")
    expected = F.least(F.lit(float(most)), F.when(F.col("mass") > 0, F.col("target") * F.col("weight") / F.col("mass")).otherwise(0.0))
    keyed = keyed.withColumn("expected", expected).withColumn("whole", F.floor("expected").cast("long")).withColumn("p", F.col("expected") - F.col("whole"))
    u = uniform(F.col("id"), seed)
    key = F.when(F.col("p") > 0, (u / (1 - u)) / (F.col("p") / (1 - F.col("p"))))
    keyed = keyed.withColumn("key", key)
    place = lambda level: F.floor(F.col("key") / (1 + F.col("key")) * float(bins**level)).cast("long")
    # words that the certain copies leave to the sample; all keys are in range 0 of level 0
    left = F.greatest(F.lit(0.0), F.max("target") - F.sum(F.col("whole") * F.col("size"))).alias("left")
    cut = keyed.groupBy(F.col("source").alias("g")).agg(F.lit(0).cast("long").alias("cut_bin"), F.lit(0).cast("long").alias("cut_before"), left)
    cut = materialize(cut, "cut")
    run = W.partitionBy("g").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    for level in range(1, levels + 1):
        inside = keyed.filter(F.col("key").isNotNull()).join(cut, F.col("source").eqNullSafe(F.col("g"))).filter(place(level - 1) == F.col("cut_bin"))
        sums = inside.groupBy("g", place(level).alias("bin")).agg(F.sum("size").alias("words"), F.max("cut_before").alias("start"), F.max("left").alias("left"))
        sums = sums.withColumn("before", F.col("start") + F.coalesce(F.sum("words").over(run), F.lit(0)))
        found = sums.filter((F.col("before") <= F.col("left")) & (F.col("before") + F.col("words") > F.col("left"))).groupBy("g").agg(F.min(F.struct("bin", "before", "left")).alias("c"))
        cut = materialize(found.select("g", F.col("c.bin").alias("cut_bin"), F.col("c.before").alias("cut_before"), F.col("c.left").alias("left")), "cut")
    placed = keyed.withColumn("bin", place(levels)).join(cut, F.col("source").eqNullSafe(F.col("g")), "left")
    tie = W.partitionBy("source").orderBy("key", F.asc_nulls_first("id"), "size").rowsBetween(W.unboundedPreceding, -1)
    inside = placed.filter(F.col("key").isNotNull() & (F.col("bin") == F.col("cut_bin")))
    inside = inside.withColumn("start", F.col("cut_before") + F.coalesce(F.sum("size").over(tie), F.lit(0)))
    # the document across the cut is taken when that brings the sum nearer to the target
    inside = inside.withColumn("extra", F.when(F.col("start") + F.col("size") / 2 <= F.col("left"), 1).otherwise(0))
    below = F.col("key").isNotNull() & (F.col("cut_bin").isNull() | (F.col("bin") < F.col("cut_bin")))
    others = placed.filter(~(F.col("key").isNotNull() & F.coalesce(F.col("bin") == F.col("cut_bin"), F.lit(False)))).withColumn("extra", F.when(below, 1).otherwise(0))
    more = [f"carry_{c}" for c in carry]
    names = ["id", "source", "size", "source_size", "target", "whole", "extra", *more]
    out = others.select(*names).unionByName(inside.select(*names)).withColumn("copies", F.col("whole") + F.col("extra"))
    return out.select("id", "source", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "whole", "copies", *more)
