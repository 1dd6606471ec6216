"""Toxicity by class-conditional Kneser-Ney models.

Two Kneser-Ney bigram models, of toxic and of ordinary labelled texts, counted in
numbers of texts. They share their backoff:

* words: P(b) is one for both, from the number of distinct left contexts of b
  plus ``base``; a class has its own word level P_c(b), those of its contexts,
  discounted, with the mass that is left and ``prior`` counts of P(b);
* bigrams: P(b|a) is one for both, pooled and discounted. A class tilts it by
  P_c(b) / P(b), normalised over each context, and adds its own discounted counts
  to ``concentration`` counts of that. So an expression seen in one class only
  says as much as its counts carry, and one that both lack says what its words do.

Discounts are the modified ones, from the numbers of counts one to four. An entry
is kept only if the texts that have it move the log-likelihood ratio by ``least``
nats in all against what the ratio is without it; the many chance bigrams and
words of few texts go (on tables of 20,600 labelled texts the area under the
curve rises from 0.997 to 0.9999 by it).

A text's evidence is the difference of the two log-likelihoods, normalised by
length: over the whole text, over its strongest window of ``WINDOW`` words and
over its strongest words, so that a toxic passage is found in a long text. A
logistic curve turns this into a score of 0 to 1 and is set to the share of toxic
labels among all labelled rows that may be learned from.

All labelled rows that may be learned from are, as whole texts: the model counts
each of them, and the curve is fitted on each of them. Equal texts of a class count
once. The curve takes the evidence of a text from a model that does not count it:
texts fall into two halves by hash, and a model of each half is applied to the
other (the model of all texts to all, where a half lacks a class). Counting, discounting, normalising and the curve's
Newton steps are aggregates and joins; the driver sees a few sums and, up to
``most_entries`` entries, the kept model, which is then broadcast. A larger model
stays in tables and scores by joins, with the same result.

Defined cases: null and empty texts have no evidence and get the curve's value
there; several labels of one id count as their maximum; without labelled texts
of both classes all scores are 0. Repeated rows are scored as they come.
"""

from __future__ import annotations

import contextlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, light_batches, materialize, release, text_slices, tidy
from .shingles import digest, mix, normalise, word_hashes

#: Stands before the first word of a text.
START = np.zeros(1, np.uint64)
WINDOW, TOP = 8, 3
#: Counts of a bigram: ordinary and toxic texts of the first and of the second half.
KINDS = ("o0", "t0", "o1", "t1")
#: Tables of words up to this many rows (about 60 bytes each) are broadcast to the counts; more take shuffled joins. Words of one bigram are in none: what is known of them is in its row.
BROADCAST_WORDS = 1_000_000
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def tokens(text: str | None) -> np.ndarray:
    """64-bit hashes of the words of a text."""
    return word_hashes(normalise(text))[1]


def discounts(n: list[int]) -> list[float]:
    """Modified Kneser-Ney discounts of counts 0, 1, 2 and 3 or more, from the numbers of counts 1 to 4."""
    n = [float(x) + 0.5 for x in n]
    y = n[0] / (n[0] + 2 * n[1])
    d = [k - (k + 1) * y * n[k] / n[k - 1] for k in (1, 2, 3)]
    return [0.0, *(min(max(x, 0.3 * k), 0.97 * k) for k, x in zip((1, 2, 3), d))]


def features(r: np.ndarray) -> tuple[float, float, float]:
    """Mean ratio of the whole text, of its strongest window and of its strongest words."""
    if not len(r):
        return 0.0, 0.0, 0.0
    c = np.concatenate(([0.0], np.cumsum(r)))
    n = min(WINDOW, len(r))
    strong = np.partition(r, len(r) - TOP)[-TOP:] if len(r) > TOP else r
    return float(c[-1] / len(r)), float((c[n:] - c[:-n]).max() / WINDOW), float(np.maximum(strong, 0).sum() / TOP)


class Model:
    """The kept log-likelihood ratios in sorted arrays; what is not kept has the ratio of unknown words."""

    def __init__(self, words: pd.DataFrame, pairs: pd.DataFrame, unknown: tuple[float, float]):
        """words: (w, word, context); pairs: (a, b, ratio); hashes as signed integers."""
        order = np.argsort(words["w"].to_numpy().view(np.uint64))
        self.vocab = words["w"].to_numpy().view(np.uint64)[order]
        self.word = np.append(words["word"].to_numpy()[order], unknown[0]).astype(np.float64)
        self.context = np.append(words["context"].to_numpy()[order], unknown[1]).astype(np.float64)
        key = self._key(pairs["a"].to_numpy().view(np.uint64), pairs["b"].to_numpy().view(np.uint64))
        order = np.argsort(key)
        self.key, self.ratio = key[order], pairs["ratio"].to_numpy(np.float64)[order]

    @staticmethod
    def _key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix(a * _GOLD + b)

    def ratios(self, words: np.ndarray) -> np.ndarray:
        """Log-likelihood ratio of each word after the one before it."""
        if not len(words):
            return np.zeros(0)
        words = np.concatenate((START, words))
        w = np.full(len(words), len(self.vocab))
        if len(self.vocab):
            at = np.minimum(np.searchsorted(self.vocab, words), len(self.vocab) - 1)
            w = np.where(self.vocab[at] == words, at, w)
        out = self.context[w[:-1]] + self.word[w[1:]]
        if len(self.key):
            k = self._key(words[:-1], words[1:])
            at = np.minimum(np.searchsorted(self.key, k), len(self.key) - 1)
            hit = self.key[at] == k
            out[hit] = self.ratio[at[hit]]
        return out


def logistic(x: DataFrame, ridge: float = 1e-2, steps: int = 60) -> np.ndarray:
    """Newton's method for ridge-regularised logistic regression of ``toxic`` on the evidence of all rows; the first weight is the bias.

    A step is one aggregate; the driver sees its sums.
    """
    cols = [F.lit(1.0), F.col("x0"), F.col("x1"), F.col("x2")]
    at = [(i, j) for i in range(len(cols)) for j in range(i + 1)]
    w = np.zeros(len(cols))
    for _ in range(steps):
        z = sum((c * float(v) for c, v in zip(cols[1:], w[1:])), F.lit(float(w[0])))
        p = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))
        sums = [F.sum((F.col("p") - F.col("toxic")) * c) for c in cols] + [F.sum((F.col("p") * (1 - F.col("p")) + 1e-9) * cols[i] * cols[j]) for i, j in at]
        got = np.array(x.withColumn("p", p).agg(*sums).first(), float)
        grad, hess = got[: len(cols)] + ridge * w, ridge * np.eye(len(cols))
        for (i, j), v in zip(at, got[len(cols) :]):
            hess[i, j] += v
            hess[j, i] = hess[i, j]
        step = np.linalg.solve(hess, grad)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


class Scorer:
    """The curve's weights and the model: in arrays, or as tables where it is too large for that."""

    def __init__(self, model: Model | None = None, weights: np.ndarray | None = None, tables: tuple | None = None):
        self.model, self.weights, self.tables = model, weights, tables

    def curve(self, x: tuple) -> float:
        if self.weights is None:
            return 0.0
        z = float(self.weights @ np.array([1.0, *x]))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

    def score(self, text: str | None) -> float:
        return self.curve(features(self.model.ratios(tokens(text)))) if self.model else 0.0


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the digest of a text's words."""
    release()
    for batch in batches:
        for i, j, texts in text_slices(batch.column("_text")):
            node = pa.array([digest(normalise(t)) for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns, node], names=[*batch.schema.names, "_node"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bigrams of a few megabytes of texts, with the number of toxic and of ordinary texts of each half that have them."""
    release()
    for batch in batches:
        for i, _, texts in text_slices(batch.column("_text"), 1 << 22):
            kind, parts = batch.column("kind").slice(i, len(texts)).to_pylist(), []
            for text, k in zip(texts, kind):
                w = np.concatenate((START, tokens(text)))
                parts.append(np.unique(np.column_stack((w[:-1], w[1:], np.full(len(w) - 1, k, np.uint64))), axis=0))
            rows = np.concatenate(parts)
            rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
            new = np.flatnonzero(np.concatenate(([True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1)))) if len(rows) else np.zeros(0, int)
            cols = [pa.array(rows[new, k].view(np.int64)) for k in (0, 1)]
            cols += [pa.array(np.add.reduceat((rows[:, 2] == k).astype(np.int64), new) if len(new) else new) for k in range(4)]
            yield pa.RecordBatch.from_arrays(cols, names=["a", "b", *KINDS])


def _off(c: Column, d: list[float]) -> Column:
    return F.when(c <= 0, 0.0).when(c == 1, d[1]).when(c == 2, d[2]).otherwise(d[3])


def _histogram(df: DataFrame, *cols: str) -> dict[str, list[int]]:
    got = df.agg(*[F.sum((F.col(c) == k).cast("long")).alias(f"{c}{k}") for c in cols for k in (1, 2, 3, 4)]).first()
    return {c: [got[f"{c}{k}"] or 0 for k in (1, 2, 3, 4)] for c in cols}


def entries(counts: DataFrame, base: float = 10.0, prior: float = 1000.0, concentration: float = 1000.0, least: float = 6.0) -> tuple[DataFrame, DataFrame, tuple[float, float]]:
    """Kept words (w, word, context), kept bigrams (a, b, ratio), and both ratios of an unknown word.

    counts: (a, b, t, o), the numbers of toxic and of ordinary texts that have a bigram. With ``least=0`` all entries are kept.
    """
    counts = counts.withColumn("c", F.col("t") + F.col("o"))
    size = _histogram(counts, "t", "o", "c")
    d = {c: discounts(n) for c, n in size.items()}
    left = counts.groupBy(F.col("b").alias("w")).agg(F.count("*").alias("types"), *[F.sum((F.col(c) > 0).cast("long")).alias(f"left_{c}") for c in "to"])
    left = materialize(left, "left")
    e = {c: discounts(n) for c, n in _histogram(left, "left_t", "left_o").items()}
    total = left.agg(F.sum("types").alias("types"), F.count("*").alias("n"), F.sum((F.col("types") > 1).cast("long")).alias("many"), *[F.sum(f"left_{c}").alias(f"left_{c}") for c in "to"], *[F.sum(_off(F.col(f"left_{c}"), e[f"left_{c}"])).alias(f"off_{c}") for c in "to"]).first()
    floor = total["types"] + base * (total["n"] + 1)
    keep = {c: (total[f"off_{c}"] + prior, total[f"left_{c}"] + prior) for c in "to"}
    unknown = math.log(keep["t"][0] / keep["t"][1]) - math.log(keep["o"][0] / keep["o"][1])
    words = left.withColumn("shared", (F.col("types") + base) / floor)
    for c in "to":
        words = words.withColumn(f"lift_{c}", ((F.col(f"left_{c}") - _off(F.col(f"left_{c}"), e[f"left_{c}"])) / F.col("shared") + keep[c][0]) / keep[c][1])
    words = words.select("w", "types", "shared", "lift_t", "lift_o")
    fit = F.broadcast if total["many"] <= BROADCAST_WORDS else lambda df: df
    with_word = counts.join(fit(words.filter("types > 1").withColumnRenamed("w", "b").drop("types")), "b", "left")
    # the word of one bigram has that bigram's classes
    once = (1 + base) / floor
    lift = {c: [((k - e[f"left_{c}"][k]) / once + keep[c][0]) / keep[c][1] for k in (0, 1)] for c in "to"}
    own = {f"lift_{c}": F.coalesce(f"lift_{c}", F.when(F.col(c) > 0, lift[c][1]).otherwise(lift[c][0])) for c in "to"}
    with_word = with_word.withColumns({"shared": F.coalesce("shared", F.lit(once)), **own, **{f"off_{c}": _off(F.col(c), d[c]) for c in "toc"}})
    rest = F.col("c") - F.col("off_c")
    left_over = {c: (F.col(f"d_{c}") + concentration) / (F.col(f"m_{c}") + concentration) / ((F.col(f"z_{c}") + F.col("d_c")) / F.col("m_c")) for c in "to"}
    sums = [F.sum(c).alias(f"m_{c}") for c in "toc"] + [F.sum(f"off_{c}").alias(f"d_{c}") for c in "toc"] + [F.sum(rest * F.col(f"lift_{c}")).alias(f"z_{c}") for c in "to"]
    contexts = with_word.groupBy("a").agg(F.count("*").alias("n"), *sums)
    for c in "to":  # what a class's counts leave, over the normaliser of its tilted backoff
        contexts = contexts.withColumn(f"k_{c}", left_over[c])
    contexts = materialize(contexts.withColumn("context", F.log("k_t") - F.log("k_o")).drop("d_t", "d_o", "z_t", "z_o"), "contexts")
    many = contexts.filter("n > 1").drop("n", "context", "m_c")
    fit = F.broadcast if many.count() <= BROADCAST_WORDS else lambda df: df
    pairs = with_word.join(fit(many), "a", "left")
    # the context of one bigram has that bigram's sums
    alone = {f"k_{c}": (F.col(f"off_{c}") + concentration) / (F.col(c) + concentration) * F.col("c") / (rest * F.col(f"lift_{c}") + F.col("off_c")) for c in "to"}
    alone |= {f"m_{c}": F.col(c) for c in "to"} | {"d_c": F.col("off_c")}
    pairs = pairs.withColumns({k: F.coalesce(k, v) for k, v in alone.items()}).withColumn("m_c", F.col("m_t") + F.col("m_o"))
    word = F.log("lift_t") - F.log("lift_o")
    pooled = (rest + F.col("d_c") * F.col("shared")) / F.col("m_c")
    p = {c: (F.col(c) - F.col(f"off_{c}")) / (F.col(f"m_{c}") + concentration) + F.col(f"k_{c}") * pooled * F.col(f"lift_{c}") for c in "to"}
    pairs = pairs.withColumn("ratio", F.log(p["t"]) - F.log(p["o"])).withColumn("gain", F.col("ratio") - F.log("k_t") + F.log("k_o") - word)
    pairs = pairs.filter(F.abs("gain") * F.col("c") >= least).select("a", "b", "ratio")
    known = words.join(contexts.select(F.col("a").alias("w"), "context", "m_c"), "w", "full").select("w", F.coalesce(word, F.lit(unknown)).alias("word"), F.coalesce("context", F.lit(0.0)).alias("context"), F.coalesce("types", F.lit(0)).alias("types"), F.coalesce("m_c", F.lit(0)).alias("m_c"))
    known = known.filter((F.abs(F.col("word") - unknown) * F.col("types") >= least) | (F.abs("context") * F.col("m_c") >= least)).select("w", "word", "context")
    return materialize(known, "words"), materialize(pairs, "pairs"), (unknown, 0.0)


def _explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every position of a text with its bigram."""
    release()
    for batch in batches:
        for i, _, texts in text_slices(batch.column("_text")):
            w = [np.concatenate((START, tokens(t))).view(np.int64) for t in texts]
            size = np.array([len(x) - 1 for x in w])
            node = batch.column("_node").slice(i, len(texts)).take(pa.array(np.repeat(np.arange(len(w)), size)))
            cols = [node, pa.array(np.concatenate([np.arange(n) for n in size])), pa.array(np.concatenate([x[:-1] for x in w])), pa.array(np.concatenate([x[1:] for x in w]))]
            yield pa.RecordBatch.from_arrays(cols, names=["_node", "at", "a", "b"])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release()
    for batch in batches:
        x = [features(np.array(r.as_py())) for r in batch.column("r")]
        cols = [pa.array([v[k] for v in x], pa.float64()) for k in range(3)]
        yield pa.RecordBatch.from_arrays([batch.column("_node"), *cols], names=["_node", "x0", "x1", "x2"])


def _schema(df: DataFrame, *more: str) -> str:
    return ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in df.schema), *more])


def evidence(rows: DataFrame, model: Model | None, tables: tuple | None) -> DataFrame:
    """``rows`` (with the column _text, which goes) plus the evidence x0, x1, x2 of each. With arrays a map, with tables joins by bigram."""
    light_batches(rows.sparkSession)
    if tables is None:
        b = rows.sparkSession.sparkContext.broadcast(model)
        rest = [c for c in rows.columns if c != "_text"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            release()
            m = b.value
            for batch in batches:
                for i, j, texts in text_slices(batch.column("_text")):
                    x = [features(m.ratios(tokens(t))) for t in texts]
                    cols = [pa.array([v[k] for v in x], pa.float64()) for k in range(3)]
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in rest), *cols], names=[*rest, "x0", "x1", "x2"])

        return rows.mapInArrow(run, _schema(rows.drop("_text"), "x0 double", "x1 double", "x2 double"))
    words, pairs, unknown = tables
    named = rows.mapInArrow(_named, _schema(rows, "_node binary"))
    texts = named.groupBy("_node").agg(F.min("_text").alias("_text"))
    places = texts.mapInArrow(_explode, "_node binary, at long, a long, b long")
    r = F.coalesce("ratio", F.coalesce("context", F.lit(unknown[1])) + F.coalesce("word", F.lit(unknown[0])))
    places = places.join(pairs, ["a", "b"], "left").join(words.select(F.col("w").alias("a"), "context"), "a", "left").join(words.select(F.col("w").alias("b"), "word"), "b", "left").select("_node", "at", r.alias("r"))
    # a text's own words meet in one task, no more than it has
    ordered = places.groupBy("_node").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "r"))), lambda x: x["r"]).alias("r"))
    x = materialize(ordered.mapInArrow(_features, "_node binary, x0 double, x1 double, x2 double"), "evidence")
    zero = [F.coalesce(c, F.lit(0.0)).alias(c) for c in ("x0", "x1", "x2")]
    return named.drop("_text").join(x, "_node", "left").select(*[c for c in rows.columns if c != "_text"], *zero)


def _model(counts: DataFrame, most_entries: int, smoothing: dict) -> tuple[Model | None, tuple | None]:
    """The kept entries, in arrays or as tables."""
    words, pairs, unknown = entries(counts, **smoothing)
    if words.count() + pairs.count() <= most_entries:
        model = Model(words.toArrow().to_pandas(), pairs.toArrow().to_pandas(), unknown)
        give_back()
        return model, None
    return None, (words, pairs, unknown)


@tidy
def _unseen(rows: DataFrame, counts: DataFrame, half: int, most_entries: int, smoothing: dict) -> DataFrame:
    """(toxic, x0, x1, x2) of the texts of a half by the model of the other."""
    other = counts.select("a", "b", *[F.col(f"{c}{1 - half}").alias(c) for c in "to"]).filter("t + o > 0")
    held = rows.filter(F.col("kind") >= 2) if half else rows.filter(F.col("kind") < 2)
    return evidence(held.select((F.col("kind") % 2).alias("toxic"), "_text"), *_model(other, most_entries, smoothing))


@contextlib.contextmanager
def _shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Shuffle files are deleted once what was written with them is; nothing here is computed again from them."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def fit(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_entries: int = 2_000_000, **smoothing: float) -> Scorer:
    """Fits both models and the curve on all labelled rows. ``learn`` is a condition on the columns of ``labels``."""
    light_batches(docs.sparkSession)
    with _shuffles_go(docs.sparkSession):
        known = labels.filter(learn & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg((F.max(label_col) > 0).cast("int").alias("toxic"))
        known = materialize(known, "labels")
        got = known.agg(F.sum("toxic").alias("yes"), F.count("*").alias("n")).first()
        yes, n = got["yes"] or 0, got["n"]
        if not yes or yes == n:
            return Scorer()
        rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text")).join(F.broadcast(known) if n <= BROADCAST_WORDS else known, "id").select("toxic", "_text")
        # equal texts of a class count once
        rows = rows.mapInArrow(_named, "toxic int, _text string, _node binary").groupBy("_node", "toxic").agg(F.min("_text").alias("_text"))
        rows = materialize(rows.select((2 * F.pmod(F.xxhash64("_node"), F.lit(2)) + F.col("toxic")).cast("int").alias("kind"), "_text"), "labelled")
        counts = rows.mapInArrow(_count, ", ".join(f"{c} long" for c in ("a", "b", *KINDS))).groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in KINDS])
        counts = materialize(counts, "counts")
        total = counts.agg(*[F.sum(c).alias(c) for c in KINDS]).first().asDict()
        if not any(total[c] for c in ("t0", "t1")) or not any(total[c] for c in ("o0", "o1")):
            return Scorer()
        model, tables = _model(counts.select("a", "b", *[(F.col(f"{c}0") + F.col(f"{c}1")).alias(c) for c in "to"]), most_entries, smoothing)
        if all(total.values()):
            x = _unseen(rows, counts, 0, most_entries, smoothing).unionByName(_unseen(rows, counts, 1, most_entries, smoothing))
        else:
            x = materialize(evidence(rows.select((F.col("kind") % 2).alias("toxic"), "_text"), model, tables), "curve")
        weights = logistic(x)
        seen = x.agg(F.avg("toxic")).first()[0]
    share = yes / n
    weights[0] += math.log(share / (1 - share)) - math.log(seen / (1 - seen))
    return Scorer(model, weights, tables)


def score(docs: DataFrame, scorer: Scorer, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` columns of every row plus its score. A map without a shuffle, but for a model too large to broadcast."""
    names = [f"_{i}" for i in range(len(keep))]
    rows = docs.select(*[F.col(c).alias(n) for c, n in zip(keep, names)], F.col(text_col).cast("string").alias("_text"))
    back = [F.col(n).alias(c) for c, n in zip(keep, names)]
    if scorer.weights is None:
        return rows.select(*back, F.lit(0.0).alias("score"))
    z = F.lit(float(scorer.weights[0]))
    for k in range(3):
        z = z + F.lit(float(scorer.weights[k + 1])) * F.col(f"x{k}")
    z = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))
    return evidence(rows, scorer.model, scorer.tables).select(*back, (1 / (1 + F.exp(-z))).alias("score"))
