"""Exact dedup with a heavy-hitter split, in DataFrame functions only.

Misra-Gries counters (``DataFrame.freqItems``, an aggregate of at most 1/support
counters) name every digest that more than ``support`` of all rows have. Their
exact winners and sizes are computed by an aggregate that combines before the
shuffle, and are broadcast (at most 1/support rows, a proven bound), so each row
of a heavy group is decided where it is read and never crosses the network. Only
the remaining digests, none above that share, are shuffled: their winners are a
table of their own, joined back by digest.

Rows get a number when their digests are written, so of rows that repeat in full
exactly one wins.

Defined cases: null text counts as empty text; texts are equal when identical
after deleting ASCII white space; null ids come last in ties; of repeated rows
(same id, same text) exactly one can stay. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITE, materialize


def normalised(text: str = "text"):
    """The text without white space; equality of texts is equality of this."""
    return F.regexp_replace(F.coalesce(F.col(text).cast("string"), F.lit("")), WHITE + "+", "")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest binary(32), size in code points): all that the decisions need, so texts are not shuffled."""
    return docs.select(F.col(id_col).alias("id"), F.unhex(F.sha2(normalised(text_col).cast("binary"), 256)).alias("digest"), F.length(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).cast("long").alias("size"))


def heavy_digests(rows: DataFrame, support: float = 0.001) -> DataFrame:
    """(digest): the Misra-Gries candidates, among them every digest of more than ``support`` of the rows."""
    found = rows.select(F.hex("digest").alias("h")).freqItems(["h"], support)
    return found.select(F.explode(F.col("h_freqItems")).alias("h")).select(F.unhex("h").alias("digest"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = 0.001) -> DataFrame:
    """One row per row of ``docs``: (id, keep_id, group_size, kept, digest, size).

    Of equal texts, the row with the most code points of original text, then the
    smallest id stays.
    """
    rows = materialize(digests(docs, id_col, text_col).withColumn("n", F.monotonically_increasing_id()), "digests")
    order = F.struct((-F.col("size")).alias("s"), F.col("id").isNull().alias("none"), F.col("id"), F.col("n"))
    winners = lambda some: some.groupBy("digest").agg(F.count("*").alias("group_size"), F.min(order).alias("best")).select("digest", "group_size", F.col("best.id").alias("keep_id"), F.col("best.n").alias("keep_n"))
    candidates = F.broadcast(materialize(heavy_digests(rows, support), "candidates"))  # at most 1 / support rows
    heavy = F.broadcast(materialize(winners(rows.join(candidates, "digest", "left_semi")), "heavy"))  # at most 1 / support rows
    light = rows.join(heavy, "digest", "left_anti")
    # written, so that the join below is a plain one
    decided = rows.join(heavy, "digest").unionByName(light.join(materialize(winners(light), "light"), "digest"))
    return decided.select("id", "keep_id", "group_size", (F.col("n") == F.col("keep_n")).alias("kept"), "digest", "size")
