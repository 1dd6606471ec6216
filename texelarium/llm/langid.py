"""Language ID by cross-parsing entropy.

For every language a suffix automaton of labelled text is built, in a task of its
own, and packed into integer arrays (rows of transitions overlap in one table, each
entry naming the state that it belongs to). A text is parsed greedily into
longest phrases that occur in that labelled text, a character that the labelled
text lacks being a phrase; phrases times log2(labelled size) over the text's
length estimates the cross-entropy in bits a character. The language with the
least wins. Whole texts are parsed; the texts of a batch and the languages step
through the tables side by side.

Training is bounded and documented: per language at most ``docs_per_lang``
labelled rows, chosen by hash, each whole; if there are so many languages that
this makes more than ``most_rows`` rows, each has an equal share of these, one at
least. No language is left out. It does not limit what is scored. The score is
second / (best + second) of the two least costs: 0.5 for a tie, near 1 for a
clear case, 1 with one language only.

Defined cases: null text and text without a letter give ``und`` and score 0; so
does everything if no language was learned; equal costs go to the first language
by code point; rows are scored as they come (repeats, null ids).
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import lean, light_batches, release, resident, text_slices

_LETTERS = re.compile(r"[^\W\d_]+")
#: With so few parses left, they go on one by one instead of side by side.
_FEW = 64
#: Characters whose numbers are looked up at once.
_PIECE = 1 << 16


def normalise(text: str) -> str:
    """Lower-case runs of letters, joined by single spaces, with a space at both ends."""
    return " " + " ".join(_LETTERS.findall(text.lower())) + " "


def suffix_automaton(text: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a text; state 0 is the root."""
    nodes: list[dict] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        new = len(nodes)
        nodes.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nodes[p]:
            nodes[p][c] = new
            p = link[p]
        if p >= 0:
            q = nodes[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(nodes)
                nodes.append(dict(nodes[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nodes[p].get(c) == q:
                    nodes[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return nodes


def pack(nodes: list[dict[int, int]], letters: int, tries: int = 32) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(base, owner, to): state s goes by letter c to to[base[s] + c] if owner[base[s] + c] is s.

    The root gets no entries: what is not found goes on from the root.
    """
    total = sum(map(len, nodes))
    size = 2 * total + 2 * letters + 2
    used, base = bytearray(size), [0] * len(nodes)
    owner, to = np.full(size, -1, np.int32), np.zeros(size, np.int32)
    single, first, end = [], letters, letters
    for s in sorted(range(1, len(nodes)), key=lambda s: -len(nodes[s])):
        cs = list(nodes[s])
        if len(cs) == 1:
            single.append(s)
        if len(cs) < 2:
            continue
        low = min(cs)
        first = at = used.find(0, first)
        for _ in range(tries):
            b = at - low
            if not any(used[b + c] for c in cs):
                break
            at = used.find(0, at + 1)
        else:
            b = end - low
        base[s] = b
        for c in cs:
            used[b + c] = 1
            end = max(end, b + c + 1)
    at = letters
    for s in single:
        at = used.find(0, at)
        base[s] = at - next(iter(nodes[s]))
        used[at] = 1
    for s in range(1, len(nodes)):
        for c, t in nodes[s].items():
            owner[base[s] + c], to[base[s] + c] = s, t
    last = used.rfind(1) + 1 + letters + 1
    return np.array(base, np.int32), owner[:last], to[:last]


def build(text: str, letters: list[str]) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(number of states, base, owner, to, the root's transitions by letter) of the automaton of one language's text."""
    ids = {c: k + 1 for k, c in enumerate(letters)}  # 0: a character that no sample has
    nodes = suffix_automaton([ids[c] for c in text])
    root = np.zeros(len(letters) + 1, np.int32)
    for c, t in nodes[0].items():
        root[c] = t
    return len(nodes), *pack(nodes, len(letters)), root


def _build(letters: list[str]):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                n, *arrays = build(text, letters)
                cols = [pa.array([lang]), pa.array([n], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in arrays)]
                yield pa.RecordBatch.from_arrays(cols, names=["lang", "n", "base", "owner", "to", "root"])

    return run


class Identifier:
    """The packed automata of all languages in common tables; a state's number tells its language."""

    def __init__(self, samples: dict[str, str], spark: SparkSession | None = None):
        """Builds the automata, in Spark tasks where a session is given."""
        samples = {k: t for k, t in sorted(samples.items()) if t.strip()}
        self.langs = list(samples)
        self.bits = np.array([math.log2(max(2, len(t))) for t in samples.values()])
        seen = sorted(set().union(*samples.values())) if samples else []
        self.codes = np.array([ord(c) for c in seen], np.uint32)
        if spark is not None and samples:
            few = spark.createDataFrame(list(samples.items()), "lang string, text string").repartition(len(samples))
            rows = few.mapInArrow(_build(seen), "lang string, n long, base binary, owner binary, to binary, root binary").collect()
            built = {r["lang"]: (r["n"], *(np.frombuffer(r[c], np.int32) for c in ("base", "owner", "to", "root"))) for r in rows}
        else:
            built = {lang: build(text, seen) for lang, text in samples.items()}
        bases, tables, states, slots, roots = [], [], 0, 0, np.zeros((len(seen) + 1, len(samples)), np.int32)
        for k, lang in enumerate(samples):
            n, base, owner, to, root = built.pop(lang)
            bases.append(base + np.int32(slots))
            # one look-up gives the owner and the next state
            tables.append(np.where(owner >= 0, owner.astype(np.int64) + states, -1) << 32 | (to.astype(np.int64) + states))
            roots[:, k] = root + states
            states, slots = states + n, slots + len(owner)
        self.roots = roots
        self.start = roots[0] if samples else np.zeros(0, np.int32)
        self.base, self.table = (np.concatenate(x) if x else np.zeros(1, np.int64) for x in (bases, tables))

    def letters(self, texts: list[str]) -> np.ndarray:
        """The letters' numbers of the texts one after another, found for a piece at a time: on the way a character takes ten times what its number does."""
        out, end = np.empty(sum(map(len, texts)), np.int32), 0
        for piece in (t[i : i + _PIECE] for t in texts for i in range(0, len(t), _PIECE)):
            code = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32)
            at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
            out[end : end + len(code)] = np.where(self.codes[at] == code, at + 1, 0)
            end += len(code)
        return out

    def phrases(self, texts: list[str]) -> np.ndarray:
        """Number of greedy longest-match phrases of each normalised text in each language."""
        n = np.zeros((len(texts), len(self.langs)), np.int64)
        size = np.array([len(t) for t in texts])
        order = np.argsort(-size, kind="stable")
        size = size[order]
        flat = self.letters([texts[i] for i in order])
        start = np.concatenate(([0], np.cumsum(size)[:-1]))
        state = np.tile(self.start.astype(np.int64), (len(texts), 1))
        count = np.zeros_like(n)
        t, k = 0, int((size > 0).sum())
        while k * len(self.langs) > _FEW:
            until = int(size[k - 1])
            at, s, own = start[:k], state[:k], count[:k]
            while t < until:
                c = flat.take(at + t)
                got = self.table.take(self.base.take(s) + c[:, None])
                hit = got >> 32 == s
                own += ~hit
                s = np.where(hit, got & 0xFFFFFFFF, self.roots.take(c, axis=0))
                t += 1
            state[:k] = s
            k = int((size > t).sum())
        base, table, roots = (memoryview(np.ascontiguousarray(x)) for x in (self.base, self.table, self.roots))
        for j in range(k):
            rest = flat[start[j] + t : start[j] + size[j]].tolist()
            for lang in range(len(self.langs)):
                s, more = int(state[j, lang]), 0
                for c in rest:
                    got = table[base[s] + c]
                    if got >> 32 == s:
                        s = got & 0xFFFFFFFF
                    else:
                        more += 1
                        s = roots[c, lang]
                count[j, lang] += more
        n[order] = count
        return n

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        norm = [normalise(t or "") for t in texts]
        known = [k for k, t in enumerate(norm) if t.strip() and self.langs]
        out = [("und", 0.0)] * len(texts)
        if not known:
            return out
        cost = self.phrases([norm[k] for k in known]) * self.bits / np.array([len(norm[k]) for k in known])[:, None]
        best = cost.argmin(axis=1)  # the first of equals
        for row, k, b in zip(cost, known, best):
            if len(row) == 1:
                out[k] = self.langs[0], 1.0
            else:
                second = float(np.partition(row, 1)[1])
                out[k] = self.langs[b], second / (float(row[b]) + second)
        return out


def samples(docs: DataFrame, learn: Column, key: Column, text_col: str = "text", lang_col: str = "lang", docs_per_lang: int = 80, most_rows: int = 2000) -> dict[str, str]:
    """The bounded labelled text of each language: the rows of least hash among those that ``learn`` allows."""
    spark = docs.sparkSession
    rows = docs.filter(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), key.cast("string").alias("key"))
    counts = rows.groupBy("lang").count().collect()  # one row a language
    if not counts:
        return {}
    docs_per_lang = min(docs_per_lang, max(1, most_rows // len(counts)))
    # a hash threshold leaves a few times the wanted rows, of each language alike
    share = spark.createDataFrame([(r["lang"], min(1.0, (3 * docs_per_lang + 30) / r["count"])) for r in counts], "lang string, share double")
    h = (F.pmod(F.xxhash64("key", F.lit("lang")), F.lit(1 << 40)) / float(1 << 40)).alias("h")
    few = rows.select("lang", "key", h, "text").join(F.broadcast(share), "lang").filter("h < share")
    few = few.withColumn("n", F.row_number().over(W.partitionBy("lang").orderBy("h", "key", "text"))).filter(F.col("n") <= docs_per_lang)
    out: dict[str, list[str]] = {}
    for r in sorted(few.select("lang", "n", "text").collect(), key=lambda r: (r["lang"], r["n"])):
        out.setdefault(r["lang"], []).append(normalise(r["text"]))
    return {lang: "".join(t) for lang, t in out.items()}


def identify(docs: DataFrame, learned: dict[str, str], keep: list[str], text_col: str = "text", lang_to: str = "lang_pred", score_to: str = "score") -> DataFrame:
    """``keep`` columns of every row plus the predicted language and its score. A map: no shuffle."""
    light_batches(docs.sparkSession)
    b = docs.sparkSession.sparkContext.broadcast(Identifier(learned, docs.sparkSession))
    tag = hash(frozenset(learned.items()))
    names = [f"_{i}" for i in range(len(keep))]
    kept = [F.col(c).alias(n) for c, n in zip(keep, names)]
    plain = text_col in keep and isinstance(docs.schema[text_col].dataType, StringType)
    text = names[keep.index(text_col)] if plain else "_text"
    src = docs.select(*kept, *([] if plain else [F.col(text_col).cast("string").alias("_text")]))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = resident(("langid", tag), lambda: b.value)
        for batch in batches:
            # kept columns pass through as they are; only a slice of texts at a time becomes Python strings
            got = [x for _, _, texts in text_slices(batch.column(text), 1 << 23) for x in model.predict(texts)]
            preds = [pa.array([x for x, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *preds], names=[*names, "lang_pred", "score"])

    kinds = "".join(f"{n} {src.schema[n].dataType.simpleString()}, " for n in names)
    out = src.mapInArrow(run, f"{kinds}lang_pred string, score double")
    return out.select(*[F.col(n).alias(c) for c, n in zip(keep, names)], F.col("lang_pred").alias(lang_to), F.col("score").alias(score_to))
