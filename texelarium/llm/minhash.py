"""MinHash near-duplicate detection by ProbMinHash, banding and verification.

Every distinct shingle of a text (five words) with weight w is a Poisson process
of rate w whose points fall on k registers; a register keeps the shingle that
arrives first. Generation stops for a shingle once its next point is later than
the latest first arrival (early termination). Two texts agree on a register with
the probability Jaccard similarity of their weighted shingles. A shingle's weight
is its number of occurrences (the production setting), or one with
``weights="unit"``; texts that repeat no shingle have the Jaccard similarity of
their shingle sets either way.

Plan: (1) one pass makes per row a 128-bit digest of its words and its band
keys; (2) rows with equal words collapse to one node by an aggregate that
combines before the shuffle, so groups of copies never meet in one task;
(3) in every bucket of a band the nodes are compared with one centre that
differs by band; members that the centre does not match go on to a next round
with a new centre, for ``rounds`` rounds; (4) candidate pairs are verified on the
shingles of the whole texts, exactly; (5) connected components of the verified
links; (6) in every bucket that still holds more than one component, all pairs of
different components are verified in blocks, so each pair that shares a bucket is
verified or connected. Shingles are written once a node, only for nodes that
share a bucket; centres, components and shingles are tables of their own, so
every join is a plain one whose hot keys adaptive execution can split. Tables of
keys, nodes and links are small next to the shingles and many: they are gathered
in partitions that suit their size, however many a shuffle has.

Defined cases: null and empty texts and texts without words have no shingles and
link with nothing (each is its own class). Rows with equal words are one class.
Repeated rows and repeated or null ids are kept apart by row, as ids never
identify a node. A class is named by the smallest id of its rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import cross_links
from .common import gathered, lean, light_batches, materialize, pieces, release, text_slices, tidy
from .components import connected_components
from .shingles import digest, mix, normalise, shingle_hashes, shingle_set

_U = np.uint64


def signatures(doc: np.ndarray, h: np.ndarray, n_docs: int, k: int, weight: np.ndarray | None = None) -> np.ndarray:
    """ProbMinHash signatures (n_docs x k, uint64); zeros for documents without shingles.

    doc and h: document index and hash of each element. Without weights, repeats
    do no harm as they make the same points.
    """
    first = np.full(n_docs * k, np.inf)
    who = np.zeros(n_docs * k, _U)
    x = np.zeros(len(h))
    step = 0
    while len(h):
        step += 1
        r = mix(h + _U((step * 0xD1342543DE82EF95) & 0xFFFFFFFFFFFFFFFF))
        gap = -np.log(((r >> _U(11)).astype(np.float64) + 0.5) / float(1 << 53))
        x = x + (gap if weight is None else gap / weight)
        flat = doc * k + ((mix(r ^ _U(0x632BE59BD9B4E019)) >> _U(32)) % _U(k)).astype(np.int64)
        np.minimum.at(first, flat, x)
        best = x == first[flat]
        who[flat[best]] = h[best]
        live = x < first.reshape(n_docs, k).max(axis=1)[doc]
        doc, h, x = doc[live], h[live], x[live]
        weight = None if weight is None else weight[live]
    return who.reshape(n_docs, k)


def weighted(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct elements of each document with their counts as weights."""
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])))) if len(h) else np.zeros(0, np.int64)
    return doc[new], h[new], np.diff(np.concatenate((new, [len(h)]))).astype(np.float64)


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact probability Jaccard of two weighted sets (sorted elements, weights)."""
    (ha, wa), (hb, wb) = a, b
    common, ia, ib = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    x, y = wa[ia].astype(float), wb[ib].astype(float)
    ratio = y / x
    order = np.argsort(ratio)
    cx, cy = np.concatenate(([0.0], np.cumsum(x[order]))), np.concatenate(([0.0], np.cumsum(y[order])))
    at = np.searchsorted(ratio[order], ratio, "right")
    only_a, only_b = wa.sum() - x.sum(), wb.sum() - y.sum()
    return float(np.sum(1.0 / ((only_a + cx[at]) / x + (only_b + cy[-1] - cy[at]) / y)))


def band_keys(sig: np.ndarray, bands: int) -> np.ndarray:
    rows = sig.shape[1] // bands
    keys = np.zeros((len(sig), bands), _U)
    for b in range(bands):
        s = np.full(len(sig), b + 1, _U)
        for r in range(rows):
            s = mix(s + sig[:, b * rows + r])
        keys[:, b] = s
    return keys.view(np.int64)


def _sign(width: int, bands: int, rows: int, weights: str):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for i, j, texts in text_slices(batch.column("text")):
                docs = [normalise(t) for t in texts]
                doc, h = shingle_hashes(docs, width)
                full = np.bincount(doc, minlength=len(docs)) > 0
                doc, h, weight = weighted(doc, h) if weights == "count" else (doc, h, None)
                keys = band_keys(signatures(doc, h, len(docs), bands * rows, weight), bands)
                cols = [batch.column("id").slice(i, j - i), pa.array([digest(d) if f else None for d, f in zip(docs, full)], pa.binary()), pa.array([x if f else None for x, f in zip(keys, full)], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(cols, names=["id", "node", "bands"])

    return run


@lean
def _with_node(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release()
    for batch in batches:
        for i, j, texts in text_slices(batch.column("text")):
            nodes = [digest(w) if (w := normalise(t)) else None for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), batch.column("text").slice(i, j - i)], names=["node", "text"])


def _sets(width: int, weights: str):
    """The sorted shingle hashes of each node, with repeats where they weigh."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for i, j, texts in text_slices(batch.column("text")):
                own = [shingle_set(t, width) for t in texts]
                values = [(np.repeat(h, n) if weights == "count" else h).view(np.int64) for h, n in own]
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(i, j - i), pa.array(values, pa.list_(pa.int64()))], names=["node", "value"])

    return run


def similarity(x: np.ndarray, y: np.ndarray) -> float:
    """Exact probability Jaccard of two sorted arrays of shingle hashes in which repeats are weights."""
    if (x[1:] == x[:-1]).any() or (y[1:] == y[:-1]).any():
        return probability_jaccard(np.unique(x, return_counts=True), np.unique(y, return_counts=True))
    n = len(np.intersect1d(x, y, assume_unique=True))
    return n / max(1, len(x) + len(y) - n)


def _verify(threshold: float):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            sides = [(c.offsets.to_numpy(), c.values.to_numpy()) for c in (batch.column("x"), batch.column("y"))]
            (ox, vx), (oy, vy) = sides
            hit = [similarity(vx[ox[i] : ox[i + 1]], vy[oy[i] : oy[i + 1]]) >= threshold for i in range(batch.num_rows)]
            yield batch.select(["a", "b"]).filter(pa.array(hit, pa.bool_()))

    return run


def _occurrences(v: np.ndarray) -> np.ndarray:
    """Sorted hashes with the k-th repeat of one made distinct, so that common elements of two are their multiset's."""
    v = np.asarray(v, np.int64).view(_U)
    new = np.concatenate(([True], v[1:] != v[:-1])) if len(v) else np.zeros(0, bool)
    at = np.arange(len(v))
    k = at - np.maximum.accumulate(np.where(new, at, 0)) if len(v) else at
    return np.where(k > 0, mix(v + k.astype(_U) * _U(0x9E3779B97F4A7C15)), v)


def _weighed(x: list, y: list, ask: np.ndarray, threshold: float, room: int = 1 << 18) -> np.ndarray:
    """Which of the asked pairs of two lists of shingle arrays in which repeats are weights reach the threshold: as ``similarity`` says, many at once.

    With s the sum of the smaller shares that a shingle has of either text, the
    probability Jaccard is s at most and s / (2 - s) at least; between, it is
    computed by its definition, and right at the threshold by ``similarity``.
    """
    out = np.zeros(ask.shape, bool)
    own = [np.unique(v, return_counts=True) for v in y]
    total = np.array([max(1, len(v)) for v in y], float)
    longest = max((len(h) for h, _ in own), default=0)
    for i in np.flatnonzero(ask.any(axis=1)):
        hx, wx = np.unique(x[i], return_counts=True)
        wx = wx.astype(float)
        asked, step = np.flatnonzero(ask[i]), max(1, room // max(1, len(hx), longest))
        for js in (asked[s : s + step] for s in range(0, len(asked), step)):
            h, w = (np.concatenate(c) for c in zip(*(own[j] for j in js)))
            row = np.repeat(np.arange(len(js)), [len(own[j][0]) for j in js])
            col = np.searchsorted(hx, h)
            both = np.flatnonzero(hx[np.minimum(col, len(hx) - 1)] == h)
            wy = np.zeros((len(js), len(hx)))
            wy[row[both], col[both]] = w[both]
            s = np.minimum(wy / total[js, None], wx / wx.sum()).sum(axis=1)
            out[i, js] = s / (2 - s) >= threshold + 1e-9
            left = np.flatnonzero(~out[i, js] & (s >= threshold - 1e-9))
            by = np.argsort(wy[left] / wx, axis=1)
            xs, ys = wx[by], np.take_along_axis(wy[left], by, 1)
            rest = total[js[left], None] - np.cumsum(ys, axis=1)
            p = np.divide(1.0, np.cumsum(xs, axis=1) / xs + rest / np.where(ys > 0, ys, 1.0), out=np.zeros_like(xs), where=ys > 0).sum(axis=1)
            out[i, js[left]] = p >= threshold
            for j in js[left[np.abs(p - threshold) < 1e-9]]:
                out[i, j] = similarity(x[i].view(_U), y[j].view(_U)) >= threshold
    return out


def _alike(threshold: float, step: int = 1 << 14):
    """Which pairs of two lists of shingle arrays reach the threshold, from exact counts of their common shingles."""

    def common(x: list, y: list) -> np.ndarray:
        size = np.array([len(v) for v in (*x, *y)])
        _, col, n = np.unique(np.concatenate((*x, *y)), return_inverse=True, return_counts=True)
        shared = n[col] > 1
        doc, col = np.repeat(np.arange(len(size)), size)[shared], (np.cumsum(n > 1) - 1)[col[shared]]
        order = np.argsort(col, kind="stable")
        doc, col = doc[order], col[order]
        out = np.zeros((len(x), len(y)))
        for s in range(0, int(col[-1]) + 1 if len(col) else 0, step):
            lo, hi = np.searchsorted(col, (s, s + step))
            m = np.zeros((len(size), step), np.float32)
            m[doc[lo:hi], col[lo:hi] - s] = 1
            out += m[: len(x)] @ m[len(x) :].T
        return out

    def hits(x: list, y: list) -> np.ndarray:
        x, y = ([np.asarray(v, np.int64) for v in side] for side in (x, y))
        n = common(*([_occurrences(v) for v in side] for side in (x, y)))
        a, b = np.array([len(v) for v in x])[:, None], np.array([len(v) for v in y])[None, :]
        out = n / np.maximum(1, a + b - n) >= threshold
        flat_x, flat_y = (np.array([not (v[1:] == v[:-1]).any() for v in side]) for side in (x, y))
        # where shingles repeat, common occurrences over the smaller total bound the similarity from above; what passes is computed exactly
        weigh = ~(flat_x[:, None] & flat_y[None, :])
        ask = weigh & (n > 0) & (n >= threshold * np.minimum(a, b) * (1 - 1e-9))
        return np.where(weigh, _weighed(x, y, ask, threshold), out) if weigh.any() else out

    return hits


@tidy
def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, threshold: float = 0.8, bands: int = 16, rows: int = 4, rounds: int = 4, weights: str = "count", block: int = 128) -> DataFrame:
    """Classes of near-duplicate rows.

    Returns one row per row of ``docs``: (id, node binary, class_id, class_size,
    kept). ``class_id`` is the smallest id of the class (null only where all its
    ids are null); ``kept`` is true for exactly one row of each class, one with
    that id; ``node`` is the digest of the row's words (null without words).

    At a similarity of 0.8, a pair shares one of 16 bands of 4 rows with
    probability 0.9998.
    """
    light_batches(docs.sparkSession)
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    signed = materialize(src.mapInArrow(_sign(width, bands, rows, weights), f"id {kind}, node binary, bands array<long>"), "signed")
    some = pieces(signed)
    one = signed.filter("node is not null").groupBy("node").agg(F.first("bands").alias("bands"))
    spread = one.select("node", F.posexplode("bands").alias("band", "key"))
    multi = spread.groupBy("band", "key").agg(F.count("*").alias("n")).filter("n > 1").select("band", "key")
    multi = materialize(gathered(multi, some), "multi")
    members = materialize(gathered(spread.join(multi, ["band", "key"]).select("band", "key", "node"), some), "members")
    few = pieces(members)
    wanted = members.select("node").distinct()
    # copies combine before the shuffle and the join, so a text with many of them is no task's burden
    texts = src.filter(F.col("text").isNotNull()).select("text").mapInArrow(_with_node, "node binary, text string").filter("node is not null").groupBy("node").agg(F.min("text").alias("text")).join(wanted, "node", "left_semi")
    values = materialize(texts.mapInArrow(_sets(width, weights), "node binary, value array<long>"), "shingles")
    whole, links, tried = members, None, None
    for k in range(rounds):
        rank = F.struct(F.xxhash64("node", "band", F.lit(k)).alias("h"), F.col("node"))
        centre = members.groupBy("band", "key").agg(F.min(rank)["node"].alias("c"), F.count("*").alias("n")).filter("n > 1")
        centre = materialize(gathered(centre, few), "centre")
        near = gathered(members.join(centre, ["band", "key"]).filter("node <> c"), few)
        pairs = near.select(F.least("node", "c").alias("a"), F.greatest("node", "c").alias("b")).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = materialize(gathered(pairs, few), "pairs")
        sides = pairs.join(values.select(F.col("node").alias("a"), F.col("value").alias("x")), "a").join(values.select(F.col("node").alias("b"), F.col("value").alias("y")), "b")
        found = sides.select("a", "b", "x", "y").mapInArrow(_verify(threshold), "a binary, b binary")
        # the many tasks that read shingles find few links each: dealt anew, as each file costs its executor a process (chmod) on local folders
        found = materialize(gathered(found.repartition("a", "b"), few), "found")
        links = found if links is None else links.unionByName(found)
        tried = pairs if tried is None else tried.unionByName(pairs)
        if k + 1 == rounds:
            break
        # what the centre does not match goes on, without the centre
        left = near.select("band", "key", "node", F.least("node", "c").alias("a"), F.greatest("node", "c").alias("b")).join(links, ["a", "b"], "left_anti").select("band", "key", "node")
        left = materialize(gathered(left, few), "left")
        if left.isEmpty():
            break
        members = left
    groups = materialize(gathered(connected_components(links, "a", "b", few), few), "groups")
    # the only pair of a bucket of two has met already
    more = whole.groupBy("band", "key").count().filter("count > 2").select("band", "key")
    more = materialize(gathered(more, few), "more")
    parts = whole.join(more, ["band", "key"]).join(groups, "node", "left").select("band", "key", "node", F.coalesce("component", "node").alias("part"))
    across = cross_links(parts, ["band", "key"], values, _alike(threshold), block, few)
    if not across.isEmpty():
        # a part without links so far is a node of its own
        over = materialize(gathered(connected_components(across, "a", "b", few), few), "over").select(F.col("node").alias("component"), F.col("component").alias("top"))
        known = groups.unionByName(over.select(F.col("component").alias("node"), "component").join(groups.select("node"), "node", "left_anti"))
        groups = known.join(over, "component", "left").select("node", F.coalesce("top", "component").alias("component"))
    groups = groups.withColumnRenamed("node", "g")
    # repeated rows are counted before they are joined, and unfolded at the end
    counted = signed.groupBy("id", "node").agg(F.count("*").alias("m"))
    # without words there is no class but the row itself
    named = counted.join(groups, F.col("node") == F.col("g"), "left").select("id", "node", "m", F.coalesce("component", "node").alias("component"))
    named = materialize(gathered(named, some), "named")
    best = named.filter("component is not null").groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("node"))).alias("best"), F.sum("m").alias("class_size"))
    # a table of its own, so that the join is a plain one whose hot classes can be split
    out = named.join(materialize(gathered(best, some), "best"), "component", "left").withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"))))
    alone = F.col("component").isNull()
    chosen = F.col("id").eqNullSafe(F.col("best.id")) & (F.col("node") == F.col("best.node")) & (F.col("i") == 1)
    return gathered(out, some).select("id", "node", F.when(alone, F.col("id")).otherwise(F.col("best.id")).alias("class_id"), F.coalesce("class_size", F.lit(1).cast("long")).alias("class_size"), F.when(alone, F.lit(True)).otherwise(chosen).alias("kept"))
