"""URL filter: a blocked Bloom filter of listed canonical URLs, then an exact hash join.

A listed entry is a host and a path prefix with a verdict. It fits its host and
all subdomains if the URL's path starts with the entry's path. A URL has a few
candidate expressions: its host's last k labels with the first n characters of
its path, for each pair (k, n) that the list has. These lengths are a small table
by k: at most as many rows as hosts have labels, each with at most as many lengths
as paths have characters, whatever the length of the list. The Bloom filter (256-bit
blocks of four words, eight bits a key) is a small table keyed by block; an
expression touches one block. Possible hits go to an exact join with the list,
which removes false positives. The longest entry wins, block before allow on a tie.

Defined cases: null URLs and URLs without ``://`` have empty host and path and
fit no entry; an empty list decides nothing; entries with null parts are
ignored; URLs without a fitting entry get the default verdict. Repeated pages
and null ids are kept row by row, as results are joined back by URL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Blocks up to this many are broadcast: 40 bytes each, so 20 MB; more take a shuffled join.
BROADCAST_BLOCKS = 500_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _after(url: Column) -> Column:
    at = F.locate("://", F.coalesce(url, F.lit("")))
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    return F.translate(F.regexp_extract(_after(url), r"^([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1)


def _block(blocks: int) -> Column:
    return F.pmod(F.xxhash64("host", "path"), F.lit(blocks)).cast("long")


def _masks() -> list[Column]:
    """Two bits in each of the four words of a block, from a second hash."""
    bit = lambda i: F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {6 * i}) & 63L as int))")
    return [bit(2 * w).bitwiseOR(bit(2 * w + 1)) for w in range(4)]


def _with_bits(df: DataFrame, blocks: int) -> DataFrame:
    df = df.withColumns({"block": _block(blocks), "h": F.xxhash64("path", "host", F.lit("bloom"))})
    return df.withColumns({f"m{w}": m for w, m in enumerate(_masks())}).drop("h")


def bloom(listed: DataFrame, keys: int, bits_per_key: int = 16) -> tuple[DataFrame, int]:
    """(block, w0..w3) of the listed (host, path) keys, and the number of blocks."""
    blocks = max(1, -(-keys * bits_per_key // 256))
    return _with_bits(listed.select("host", "path"), blocks).groupBy("block").agg(*[F.bit_or(f"m{w}").alias(f"w{w}") for w in range(4)]), blocks


def judge(pages: DataFrame, listed: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """Every row of ``pages`` with host, path, rule (host + path of the entry that wins, or null) and verdict.

    listed: (host, path, verdict).
    """
    entries = listed.filter("host is not null and path is not null and verdict is not null").select("host", "path", "verdict")
    entries = materialize(entries.groupBy("host", "path").agg(F.max("verdict").alias("verdict")), "listed")  # block after allow
    urls = pages.select(F.col(url_col).alias("_url")).filter("_url is not null").distinct()
    urls = urls.withColumns({"_host": host_of(F.col("_url")), "_path": path_of(F.col("_url"))})
    keys = entries.count()
    # one row per number of labels
    shapes = F.broadcast(entries.groupBy(F.size(F.split("host", r"\.")).alias("k")).agg(F.sort_array(F.collect_set(F.length("path"))).alias("lengths")))
    labels = F.split("_host", r"\.")
    asked = urls.filter("_host <> ''").select("_url", "_path", labels.alias("labels"), F.explode(F.sequence(F.lit(1), F.size(labels))).alias("k")).join(shapes, "k")
    asked = asked.select("_url", "_path", F.array_join(F.slice("labels", -F.col("k"), F.col("k")), ".").alias("host"), F.explode(F.filter("lengths", lambda n: n <= F.length("_path"))).alias("n"))
    asked = asked.select("_url", "host", F.substring("_path", F.lit(1), F.col("n")).alias("path"))
    filter_, blocks = bloom(entries, keys)
    filter_ = F.broadcast(filter_) if blocks <= BROADCAST_BLOCKS else filter_
    maybe = _with_bits(asked, blocks).join(filter_, "block")
    for w in range(4):
        maybe = maybe.filter(F.col(f"m{w}").bitwiseAND(F.col(f"w{w}")) == F.col(f"m{w}"))
    exact = maybe.select("_url", "host", "path").join(entries, ["host", "path"])
    best = F.struct((F.length("host") + F.length("path")).alias("n"), F.col("verdict"), F.concat("host", "path").alias("rule"))
    hits = exact.groupBy("_url").agg(F.max(best).alias("best")).select("_url", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("said"))
    hits = materialize(hits, "hits")  # a table of its own, so that the join below is a plain one whose hot URLs can be split
    keep = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    # rows without a host fit no entry and are not joined, so null URLs do not meet in one task
    has = F.coalesce(host_of(F.col(url_col)) != "", F.lit(False))
    none = F.lit(None).cast("string")
    some = pages.filter(has).select(*keep).join(hits, F.col(url_col) == F.col("_url"), "left").drop("_url")
    out = some.unionByName(pages.filter(~has).select(*keep, none.alias("rule"), none.alias("said")))
    return out.select(*keep, F.coalesce(host_of(F.col(url_col)), F.lit("")).alias("host"), F.coalesce(path_of(F.col(url_col)), F.lit("")).alias("path"), "rule", F.coalesce("said", F.lit(default)).alias("verdict"))
