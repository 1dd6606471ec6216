"""Embedding near-dedup by sorted projection passes.

Each pass gives a vector 64 sign bits of random projections (concatenated random
hashes), orders the vectors of a label lexicographically by them, compares every
vector with its next ``window`` neighbours in double precision, and the verified
pairs of all passes are united. Where vectors of a label lie dense, more than
``window`` of them share the leading bits of a pass; in such crowded cells all
pairs of different components are compared in blocks, or in the whole label once
where that is less work. So whether a pair is compared depends on its own angle
only, not on the vectors around it. Range partitioning by (label, pass, code, node)
spreads equal codes too, so no label or code is one task's; a window ends at a
partition's bound, which other passes make up for (the measured recall counts it).

Links are kept in proportion to the vectors, also in dense groups:
* equal vectors of a label are one node with a count;
* nodes within half the angle of a leader form its ball. All pairs in a ball
  link by the triangle inequality, so they are counted, not listed. The leader is
  the smallest node of a tight verified pair; leaders of leaders are adopted as
  long as a member is itself verified to be that near;
* balls that verified pairs connect form a component, whose members are compared
  in blocks of NumPy products that return one count per member. Blocks of the
  same ball are not compared, nor blocks too far apart for any link. No pairs
  are listed.

So number of links = ball (copies included) less one + links to other balls of the component.

Defined cases: null labels or vectors, zero vectors and vectors with null or
non-finite components link with nothing: 0 links, own component. Vectors of
different length do not link. Repeated rows are copies and link with each other.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import cross_links
from .common import light_batches, materialize, tidy
from .components import connected_components


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64).reshape(len(column), -1)


def _nodes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Names a valid vector by a digest of label and components; others get null."""
    for pdf in batches:
        out = []
        for label, v in zip(pdf["label"], pdf["vec"]):
            node = None
            if v is not None and len(v) and not pd.isna(label):
                x = np.array([np.nan if y is None else y for y in v], dtype=np.float64) + 0.0
                n = float(np.sqrt(x @ x)) if np.isfinite(x).all() else 0.0
                if 0 < n < math.inf:
                    node = hashlib.md5(f"{int(label)}:{len(x)}:".encode() + x.tobytes(), usedforsecurity=False).digest()
            out.append(node)
        yield pdf.assign(node=out)


def _codes(passes: int, seed: int, carry: bool = True):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        planes: dict[int, np.ndarray] = {}
        for pdf in batches:
            dims = pdf["vec"].map(len).to_numpy()
            for d in np.unique(dims):
                part = pdf[dims == d]
                if d not in planes:
                    planes[d] = np.random.default_rng([seed, int(d)]).standard_normal((passes * 64, d))
                bits = (_matrix(part["vec"]) @ planes[d].T > 0).reshape(len(part), passes, 64)
                code = np.packbits(bits, axis=2).view(">u8")[:, :, 0].astype(np.uint64)
                code = (code ^ np.uint64(1 << 63)).view(np.int64)  # signed order is bit order
                for p in range(passes):
                    out = pd.DataFrame({"label": part["label"], "dim": np.full(len(part), d, np.int32), "pass": np.full(len(part), p, np.int32), "code": code[:, p], "node": part["node"]})
                    yield out.assign(vec=part["vec"]) if carry else out

    return run


def _cos(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", x, y) / (nx * ny)


def _windows(window: int, threshold: float, tight: float):
    """From sorted rows: the smallest tight neighbour of each vector, its nearest linked one in order, and all other links."""

    def group(pdf: pd.DataFrame, old: int) -> list[tuple[bytes, bytes, bool]]:
        x, node, out = _matrix(pdf["vec"]), pdf["node"].tolist(), []
        n = np.sqrt(np.einsum("ij,ij->i", x, x))
        best: dict[int, int] = {}
        chained = np.zeros(len(x), bool)
        for d in range(1, min(window, len(x) - 1) + 1):
            j = np.arange(max(old, d), len(x))
            if not len(j):
                continue
            i = j - d
            c = _cos(x[i], x[j], n[i], n[j])
            for a, b in zip(i[c >= tight], j[c >= tight]):
                for v, w in ((a, b), (b, a)):
                    if node[w] < node[best.get(v, v)]:
                        best[v] = w
            near = (c >= threshold) & ((c < tight) | ~chained[j])
            chained[j[c >= threshold]] = True
            out += [(node[a], node[b], False) for a, b in zip(i[near], j[near])]
        return out + [(node[v], node[w], True) for v, w in best.items()]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for pdf in batches:
            keys = ["label", "dim", "pass"]
            old = 0 if held is None else len(held)
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            new = (pdf[keys].to_numpy()[1:] != pdf[keys].to_numpy()[:-1]).any(axis=1)
            ends = [0, *(np.flatnonzero(new) + 1), len(pdf)]
            rows = []
            for s, e in zip(ends, ends[1:]):
                if e > old:
                    rows += group(pdf.iloc[s:e].reset_index(drop=True), max(0, old - s))
            held = pdf.iloc[max(ends[-2], len(pdf) - window) :]
            if rows:
                yield pd.DataFrame(rows, columns=["a", "b", "tight"])

    return run


def _near(limit: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x, y = _matrix(pdf["vec"]), _matrix(pdf["to_vec"])
                c = _cos(x, y, np.sqrt(np.einsum("ij,ij->i", x, x)), np.sqrt(np.einsum("ij,ij->i", y, y)))
                yield pdf.loc[c >= limit, ["node", "to"]]

    return run


def _between(threshold: float):
    """Counts the links between the members of two blocks, but for members of one ball."""
    reach = math.acos(threshold)

    def block(balls, mult, flat) -> tuple:
        balls, mult = np.array(balls, dtype="S16"), np.asarray(mult, dtype=np.int64)
        x = np.asarray(flat, dtype=np.float64).reshape(len(mult), -1)
        x = x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
        c = x.mean(axis=0)
        c = c / max(float(np.sqrt(c @ c)), 1e-300)
        return balls, mult, x, c, float(np.arccos(np.clip(x @ c, -1, 1)).max())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[bytes, int] = {}
        last, own = None, None
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                if r.i != last:
                    last, own = r.i, block(r.balls, r.mult, r.flat)
                ba, ma, x, ca, ra = own
                bb, mb, y, cb, rb = block(r.balls_b, r.mult_b, r.flat_b)
                if float(np.arccos(np.clip(ca @ cb, -1, 1))) > ra + rb + reach + 1e-6:
                    continue
                hit = (x @ y.T >= threshold) & (ba[:, None] != bb[None, :])
                sides = [(r.nodes, hit @ mb)] + ([] if r.i == r.j else [(r.nodes_b, hit.T @ ma)])
                for nodes, n in sides:
                    for k in np.flatnonzero(n):
                        total[nodes[k]] = total.get(nodes[k], 0) + int(n[k])
            if len(total) > 200_000:
                yield pd.DataFrame(list(total.items()), columns=["node", "n"])
                total = {}
        if total:
            yield pd.DataFrame(list(total.items()), columns=["node", "n"])

    return run


def _linked(threshold: float):
    def unit(v: list) -> np.ndarray:
        x = np.array(v, dtype=np.float64)
        return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]

    return lambda x, y: unit(x) @ unit(y).T >= threshold


def cell_bits(rows: int, window: int) -> int:
    """Leading bits that at most about half a window of ``rows`` spread vectors share."""
    return min(63, max(1, math.ceil(math.log2(max(2.0, rows / window))) + 1))


def crowded(codes: DataFrame, window: int) -> DataFrame:
    """(label, dim, pass, cell, node) of the cells with more members than a window spans; of a label as one cell where its crowded cells hold more pairs than it has."""
    cell, whole = ["label", "dim", "pass", "cell"], ["label", "dim"]
    full = materialize(codes.groupBy(*cell).count().filter(F.col("count") > window + 1), "crowded")
    size = codes.filter(F.col("pass") == 0).groupBy(*whole).agg(F.count("*").alias("n"))
    load = full.groupBy(*whole).agg(F.sum(F.col("count").cast("double") * F.col("count")).alias("load")).join(size, whole)
    all_of = load.filter(F.col("load") > F.col("n").cast("double") * F.col("n")).select(*whole)
    by_cell = codes.join(full.select(*cell), cell).join(all_of, whole, "left_anti").select(*cell, "node")
    at_once = codes.filter(F.col("pass") == 0).join(all_of, whole).select(*whole, F.lit(-1).alias("pass"), F.lit(0).cast("long").alias("cell"), "node")
    return by_cell.unionByName(at_once)


def passes_for(rows: int, window: int, threshold: float, missed: float = 1e-3) -> int:
    """Passes until a pair right at the threshold is missed with probability ``missed``.

    Among ``rows`` vectors in random order a pair stands within the window if
    about log2(rows / window) leading bits agree, each with 1 - angle / pi.
    """
    agree = (1 - math.acos(threshold) / math.pi) ** max(1.0, math.log2(max(2.0, rows / window)))
    return max(4, math.ceil(math.log(missed) / math.log(1 - min(agree, 0.999))))


@tidy
def near_duplicate_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = 0.98, window: int = 32, passes: int | None = None, seed: int = 7, block: int = 256, most_hops: int = 8, cell_block: int = 2048) -> DataFrame:
    """One row per row: (id, n_links, component_id, kept, ball)."""
    light_batches(vectors.sparkSession)
    half = math.cos(math.acos(threshold) / 2) + 1e-9
    src = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vec_col).alias("vec"))
    kind = src.schema["vec"].dataType.simpleString()
    named = materialize(src.mapInPandas(_nodes, f"id long, label long, vec {kind}, node binary"), "vectors")
    nodes = named.filter("node is not null").groupBy("node").agg(F.first("label").alias("label"), F.first("vec").alias("vec"), F.count("*").alias("mult"))
    nodes = materialize(nodes, "nodes")
    most = nodes.groupBy("label").count().agg(F.max("count")).first()[0] or 1
    bits = cell_bits(most, window)
    if passes is None:
        passes = passes_for(window << bits, window, threshold)
    spark = vectors.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["label", "dim", "pass", "code", "node"]
    coded = nodes.select("label", "node", "vec").mapInPandas(_codes(passes, seed), f"label long, dim int, pass int, code long, node binary, vec {kind}")
    ordered = coded.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    found = materialize(ordered.mapInPandas(_windows(window, threshold, half), "a binary, b binary, tight boolean"), "found")
    # leaders: from each vector to its smallest tight neighbour, then on to that one's leader while the member is verified
    first = found.filter("tight").groupBy(F.col("a").alias("node")).agg(F.min("b").alias("ball"))
    balls = nodes.select("node", "mult").join(first, "node", "left").select("node", "mult", F.coalesce("ball", "node").alias("ball"))
    balls = materialize(balls, "balls")
    vecs = nodes.select("node", "vec")
    for _ in range(most_hops):
        up = balls.select(F.col("node").alias("ball"), F.col("ball").alias("to"))
        ask = balls.filter("ball <> node").join(up, "ball").filter("to <> ball").select("node", "to")
        ok = ask.join(vecs, "node").join(vecs.select(F.col("node").alias("to"), F.col("vec").alias("to_vec")), "to").select("node", "to", "vec", "to_vec").mapInPandas(_near(half), "node binary, to binary")
        ok = materialize(ok, "hop")
        if ok.isEmpty():
            break
        balls = materialize(balls.join(ok, "node", "left").select("node", "mult", F.coalesce("to", "ball").alias("ball")), "balls")
    of = balls.select("node", "ball")
    pairs = found.join(of.select(F.col("node").alias("a"), F.col("ball").alias("x")), "a").join(of.select(F.col("node").alias("b"), F.col("ball").alias("y")), "b").filter("x <> y")
    pairs = materialize(pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "pairs")
    sizes = balls.groupBy("ball").agg(F.sum("mult").alias("ball_mult"), F.count("*").alias("members"))
    groups = connected_components(pairs, "a", "b").select(F.col("node").alias("ball"), "component")
    groups = materialize(groups, "groups")
    codes = nodes.select("label", "node", "vec").mapInPandas(_codes(passes, seed, False), "label long, dim int, pass int, code long, node binary")
    codes = materialize(codes.select("label", "dim", "pass", F.shiftright("code", 64 - bits).alias("cell"), "node"), "codes")
    known = balls.join(groups, "ball", "left").select("node", F.coalesce("component", "ball").alias("part"))
    across = cross_links(crowded(codes, window).join(known, "node"), ["label", "dim", "pass", "cell"], vecs.withColumnRenamed("vec", "value"), _linked(threshold), cell_block)
    if not across.isEmpty():
        groups = connected_components(pairs.unionByName(across), "a", "b").select(F.col("node").alias("ball"), "component")
        groups = materialize(groups, "groups")
    # blocks: a large ball has its own, small balls of a component share some; spread by hash, so no group is one task's
    member = balls.join(groups, "ball").join(sizes.select("ball", "members"), "ball")
    small = F.col("members") < block // 2
    part = F.when(small, F.lit(b"")).otherwise(F.col("ball"))
    member = member.withColumn("part", part)
    fill = member.groupBy("component", "part").agg(F.ceil(F.count("*") / block).cast("long").alias("blocks"))
    spread = F.pmod(F.xxhash64(F.when(small, F.col("ball")).otherwise(F.col("node"))), F.col("blocks")).alias("k")
    member = member.join(fill, ["component", "part"]).join(vecs, "node")
    listed = member.groupBy("component", "part", spread).agg(F.collect_list(F.struct("node", "ball", "mult", "vec")).alias("m"))
    cols = {"nodes": F.transform("m", lambda x: x["node"]), "balls": F.transform("m", lambda x: x["ball"]), "mult": F.transform("m", lambda x: x["mult"]), "flat": F.flatten(F.transform("m", lambda x: x["vec"]))}
    blocks = materialize(listed.withColumns(cols).withColumn("i", F.xxhash64("component", "part", "k")).select("component", "part", "i", *cols), "blocks")
    other = blocks.select("component", *[F.col(c).alias(f"{c}_b") for c in ("part", *cols)], F.col("i").alias("j"))
    both = blocks.join(other, "component").filter("i <= j AND NOT (part = part_b AND octet_length(part) > 0)")
    more = both.select("i", "j", *cols, *[f"{c}_b" for c in cols]).mapInPandas(_between(threshold), "node binary, n long").groupBy("node").agg(F.sum("n").alias("more"))
    whole = balls.join(sizes.select("ball", "ball_mult"), "ball").join(groups, "ball", "left").join(more, "node", "left")
    whole = whole.select("node", "ball", F.coalesce("component", "ball").alias("component"), (F.col("ball_mult") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"))
    rows = materialize(named.select("id", "node").join(whole, "node", "left"), "rows")
    least = rows.filter("component is not null").groupBy("component").agg(F.min("id").alias("component_id"))
    # a table of its own, so that the join below is a plain one whose hot components can be split
    out = rows.join(materialize(least, "least"), "component", "left")
    alone = F.col("component").isNull()
    name = F.when(alone, F.col("id")).otherwise(F.col("component_id"))
    return out.select("id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), name.alias("component_id"), F.coalesce(F.col("id") == name, F.lit(False)).alias("kept"), F.hex("ball").alias("ball"))
