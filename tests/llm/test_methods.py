"""Each method against a plain or brute-force version, and the registered queries against theirs."""

import hashlib
import random
import textwrap
import tracemalloc
from collections import defaultdict
from pathlib import Path

import corpus_pipeline
import duckdb
import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F
from texelarium.llm import blocks, bpe, components, langid, licenses, minhash, mixing, queries, shingles, toxicity
from texelarium.llm.components import connected_components

QUERIES, SQL = queries.queries(), queries.oracle_sql()


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for p in Path(data).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, duck, data, name):
    df = QUERIES[name](spark, data)
    got, cur = df.collect(), duck.execute(SQL[name])
    names, want = [x[0] for x in cur.description], cur.fetchall()
    cols = sorted(names)
    assert sorted(df.columns) == cols
    key = lambda rows, at: sorted(tuple(str(r[i]) for i in at) for r in rows)
    assert key(got, [df.columns.index(c) for c in cols]) == key(want, [names.index(c) for c in cols])


@pytest.fixture(scope="module")
def encoding():
    path, pattern = queries.tokenizer_path()
    ranks = bpe.load_ranks(path)
    return bpe.Codec(ranks, pattern), tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_tiktoken(encoding):
    codec, enc = encoding
    rng = random.Random(1)
    chars = "ab éñ\u2003\u3000\x1c\x85\xa0'sTtheing0123²½Ⅷ中文😀\n\r\t_-.,!\u0300𝔘"
    for k in range(3000):
        x = "".join(rng.choice(chars) for _ in range(rng.randint(0, 30))) if k % 100 else "".join(rng.choice("abthe") for _ in range(9000))
        assert codec.encode(x) == enc.encode_ordinary(x)
        assert "".join(codec.decode(codec.encode(x))) == x


def test_bpe_stream_with_small_tables(encoding):
    codec, enc = encoding
    small = bpe.Transducer(codec.machine.ranks, most_states=50)
    text = "".join(random.Random(2).choice("thequickbrown") for _ in range(5000))
    assert list(small.stream([text[i : i + 7].encode() for i in range(0, 5000, 7)], every=64)) == enc.encode_ordinary(text)


def test_bpe_keeps_frequent_pieces_among_rare_ones(encoding, monkeypatch):
    monkeypatch.setattr(bpe, "_PIECES", 60)
    enc, codec, rng = encoding[1], bpe.Codec(encoding[0].machine.ranks, encoding[0].fine.pattern), random.Random(5)
    word = lambda: " " + "".join(rng.choice("qzxvkjw") for _ in range(9))
    often, met = [word() for _ in range(40)], []
    plain = codec.machine.encode
    monkeypatch.setattr(codec.machine, "encode", lambda p: met.append(p) or plain(p))
    for _ in range(30):
        text = "".join([*often, *(word() for _ in range(200))])
        assert codec.encode(text) == enc.encode_ordinary(text)
    # each of the 6,000 rare pieces once, the frequent ones until they are kept
    assert len(met) < 6000 + 40 * 5 and max(len(codec.memo), len(codec.older)) <= 60


def test_bpe_builds_no_state_for_the_last_byte(encoding, monkeypatch):
    machine, steps = bpe.Transducer(encoding[0].machine.ranks), []
    plain = machine.step
    monkeypatch.setattr(machine, "step", lambda s, c: steps.append(c) or plain(s, c))
    piece = b" qzxvkjwq"
    assert list(machine.encode(piece)) == encoding[1].encode_ordinary(piece.decode()) and len(steps) == len(piece) - 1


def test_utf8_machine_equals_python(encoding):
    codec, _ = encoding
    rng = random.Random(3)
    for _ in range(3000):
        b = bytes(rng.choice([rng.randrange(256), 0xE0, 0xED, 0xF0, 0xF4, 0x80, 0x9F, 65]) for _ in range(10))
        assert "".join(codec.decode([codec.machine.ranks[bytes([x])] for x in b])) == b.decode("utf-8", "replace")


def test_op3_whole_table(spark, data, duck, encoding):
    got = {r["doc_id"]: r for r in QUERIES["op3_bpe_round_trip"](spark, data).collect()}
    for i, text in duck.execute("select doc_id, text from documents").fetchall():
        ids = encoding[1].encode_ordinary(text or "")
        assert got[i]["n_tokens"] == len(ids) and got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()


def _plain_phrases(base, text):
    n = at = 0
    while at < len(text):
        k = 0
        while at + k < len(text) and text[at : at + k + 1] in base:
            k += 1
        at += max(1, k)
        n += 1
    return n


@pytest.mark.parametrize("texts", [3, 40])
def test_suffix_automaton_phrases(texts):
    """Exact numbers of phrases, side by side and one by one; 'd' and 'é' occur in one language or none."""
    rng = random.Random(texts)
    base = {f"l{k}": "".join(rng.choice("abc" + "d" * (k == 2)) for _ in range(rng.randint(1, 80))) for k in range(5)}
    many = ["".join(rng.choice("abcdé") for _ in range(rng.randint(0, 300))) for _ in range(texts)] + ["abcdabc", "dd", ""]
    got = langid.Identifier(base).phrases(many)
    assert got.tolist() == [[_plain_phrases(base[k], t) for k in sorted(base)] for t in many]
    assert langid.Identifier({"x": "abc"}).phrases(["abcdabc"]).tolist() == [[3]]


def test_language_on_held_out(spark, data, duck):
    lang = dict(duck.execute("select doc_id, lang from documents").fetchall())
    rows = [r for r in QUERIES["op4_language_id"](spark, data).collect() if r["held_out"]]
    assert len(rows) > 20 and np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in rows]) >= 0.95


def _classes(ids, links):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def _alike(texts):
    """All pairs whose probability Jaccard of counted shingles is 0.8 or more, by the definition."""
    counts = {i: dict(zip(*(x.tolist() for x in shingles.shingle_set(t)))) for i, t in texts}
    ids, links = sorted(counts), []
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            a, b = counts[i], counts[j]
            both = a.keys() & b.keys()
            if not both or sum(min(a[x], b[x]) for x in both) < 0.8 * min(sum(a.values()), sum(b.values())):
                continue  # an upper bound
            every = a.keys() | b.keys()
            w = np.array([(a.get(x, 0), b.get(x, 0)) for x in every], float)
            if sum(1 / np.maximum(w[:, 0] / a[x], w[:, 1] / b[x]).sum() for x in both) >= 0.8:
                links.append((i, j))
    return links


def test_near_duplicates_brute_force(spark, data, duck):
    docs = duck.execute("select doc_id, text from documents").fetchall()
    got = QUERIES["op9_minhash_dedup"](spark, data).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == _classes([i for i, _ in docs], _alike(docs))


def test_near_duplicates_weighted(spark):
    """Texts whose shingles repeat differently often: sets are equal, weights are not."""
    rng = random.Random(9)
    lines = [" ".join(rng.choice("abcdefghij") * 3 + str(rng.randrange(50)) for _ in range(12)) for _ in range(6)]
    docs = [(k, "\n".join(line for line in lines for _ in range(rng.choice((1, 1, 2, 9))))) for k in range(60)]
    links = _alike(docs)
    sets = {i: set(shingles.shingle_set(t)[0].tolist()) for i, t in docs}
    plain = [(i, j) for i in sets for j in sets if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    want = _classes(range(60), links)
    assert len(links) != len(plain) and len(set(want.values())) > 3
    got = minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r["id"]: r["class_id"] for r in got} == want


@pytest.mark.parametrize("copies", [200, 1000])
def test_near_duplicates_star(spark, copies):
    """One original with independently edited copies: each is near to it, none to another."""
    rng = random.Random(copies)
    base = [f"w{i}" for i in range(500)]
    texts = [base]
    for k in range(copies):
        words = list(base)
        for at in rng.sample(range(5, 495), 9):
            words[at] = f"x{k}at{at}"
        texts.append(words)
    docs = [(k, " ".join(w)) for k, w in enumerate(texts)]
    sets = [set(shingles.shingle_set(t)[0].tolist()) for _, t in docs]
    links = [(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert len(links) < 1.2 * copies
    got = minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r["id"]: r["class_id"] for r in got} == _classes(range(len(sets)), links)


def test_near_duplicates_write_few_files_of_links(spark, monkeypatch):
    files, rng = defaultdict(list), random.Random(8)
    plain = minhash.materialize

    def counted(df, tag):
        done = plain(df, tag)
        files[tag].append(len(done.inputFiles()))
        return done

    monkeypatch.setattr(minhash, "materialize", counted)
    rows = []
    for k in range(0, 60, 2):
        words = [f"{rng.randrange(1 << 30):x}" for _ in range(20_000)]
        rows += [(k, " ".join(words)), (k + 1, " ".join(words[:-9]))]
    before = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "12")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        out = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
        assert {r["id"]: r["class_id"] for r in out.collect()} == {k: k // 2 * 2 for k in range(60)}
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    assert max(files["shingles"]) > 1 and max(files["found"]) == 1


def test_near_duplicates_small_tables_in_few_files(spark, monkeypatch):
    """Many shuffle partitions that nothing joins again: tables without shingles are not cut in as many files."""
    files, rng = defaultdict(list), random.Random(10)
    plain = minhash.materialize

    def counted(df, tag):
        done = plain(df, tag)
        files[tag].append(len(done.inputFiles()))
        return done

    for m in (minhash, blocks, components):
        monkeypatch.setattr(m, "materialize", counted)
    monkeypatch.setattr(minhash, "pieces", lambda df: 4, raising=False)
    base = [f"w{i}" for i in range(300)]
    rows = []
    for k in range(60):
        words = list(base)
        for at in rng.sample(range(5, 295), 2 + k % 13):
            words[at] = f"x{k}at{at}"
        rows.append((k, " ".join(words)))
    before = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "24")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    assert {r["id"]: r["class_id"] for r in got} == _classes(range(60), _alike(rows))
    large = {t: max(n) for t, n in files.items() if t not in ("signed", "shingles") and max(n) > 4}
    assert len(files) > 12 and not large, large


def test_blocks_of_repeating_texts(monkeypatch):
    """All pairs of blocks whose shingles repeat: as computed one by one, without doing so for most."""
    rng = np.random.default_rng(11)
    pool = rng.integers(-(1 << 62), 1 << 62, 40)

    def one(most):
        n = rng.integers(1, most, len(pool)) * (rng.random(len(pool)) < 0.97)
        return np.sort(np.repeat(pool, n))

    base = one(9)
    near = [np.sort(np.concatenate((base, rng.choice(pool, k)))) for k in rng.integers(0, 90, 40)]
    x, y = [*near[:20], *(one(6) for _ in range(10)), np.unique(base)], [*near[20:], *(one(3) for _ in range(10)), base, np.repeat(base, 2)]
    value = np.array([[minhash.similarity(a.view(np.uint64), b.view(np.uint64)) for b in y] for a in x])
    asked, plain = [], minhash.similarity
    monkeypatch.setattr(minhash, "similarity", lambda a, b: asked.append(1) or plain(a, b))
    for threshold in (0.6, 0.8, 0.9, float(value[0, 1])):  # the last one is met exactly
        assert 20 < (value >= threshold).sum() < value.size - 20
        assert ((value >= threshold) == minhash._alike(threshold)(x, y)).all()
    assert len(asked) < 0.05 * value.size
    for room in (1, 200, 1 << 18):
        assert ((value >= 0.8) == minhash._weighed(x, y, np.ones(value.shape, bool), 0.8, room)).all()


def test_shingles_are_those_of_words():
    texts = ["The cat, sat on THE mat today", "a b", "", "é è ê ë ē x", "x " * 300_000]
    for t in texts:
        words = shingles.normalise(t).split()
        want = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
        assert len(shingles.shingle_set(t)[0]) == len(want)


def test_probability_jaccard_estimate():
    rng = np.random.default_rng(5)
    h = rng.integers(1, 1 << 62, 300).astype(np.uint64)
    a, b = (h[:220], rng.integers(1, 6, 220).astype(float)), (h[80:], rng.integers(1, 6, 220).astype(float))
    exact = 0.0
    wa, wb = dict(zip(a[0].tolist(), a[1])), dict(zip(b[0].tolist(), b[1]))
    for i in set(wa) & set(wb):
        exact += 1 / sum(max(wa.get(j, 0) / wa[i], wb.get(j, 0) / wb[i]) for j in set(wa) | set(wb))
    order = [np.argsort(x[0]) for x in (a, b)]
    a, b = ((x[0][o], x[1][o]) for x, o in zip((a, b), order))
    assert abs(minhash.probability_jaccard(a, b) - exact) < 1e-9
    doc = np.repeat([0, 1], 220)
    sig = minhash.signatures(doc, np.concatenate((a[0], b[0])), 2, 4096, np.concatenate((a[1], b[1])))
    assert abs((sig[0] == sig[1]).mean() - exact) < 0.04


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 300)] + [(500, 400), (500, 600), (7, 7), (None, 3)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert got == {i: 1 for i in range(1, 301)} | {400: 400, 500: 400, 600: 400}


def test_vectors_brute_force(spark, duck, tmp_path):
    rng = np.random.default_rng(6)
    base = rng.standard_normal((60, 64))
    x = np.vstack([base, np.repeat(base[:3], [60, 200, 5], axis=0) + rng.standard_normal((265, 64)) * 0.1, base[:5] + rng.standard_normal((5, 64)) * 0.2])
    label = rng.integers(0, 2, len(x))
    label[60:] = np.repeat([0, 1, 0, 1], [60, 200, 5, 5])
    df = spark.createDataFrame([(i, [float(np.float32(y)) for y in v], int(z)) for i, (v, z) in enumerate(zip(x, label))], "vec_id long, embedding array<float>, label int")
    df.write.parquet(str(tmp_path / "embeddings.parquet"))
    x = x.astype(np.float32).astype(float)
    cos = x @ x.T / np.outer(n := np.linalg.norm(x, axis=1), n)
    hit = (cos >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(hit, False)
    want = _classes(range(len(x)), [(i, j) for i, j in zip(*np.nonzero(hit)) if i < j])
    got = QUERIES["op2_embedding_dedup"](spark, str(tmp_path)).collect()
    found = sum(r["n_links"] for r in got)
    assert hit.sum() > 1000 and 0.99 * hit.sum() <= found <= hit.sum()
    assert np.mean([r["component_id"] == want[r["vec_id"]] for r in got]) > 0.99


def test_unequal_probabilities(spark):
    """Pareto order sampling with weights: fixed size, and inclusion near to what is asked."""
    rows = [(k, " ".join(["w"] * 10), "s", 1.0 + k % 4) for k in range(4000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string, w double"), weight_col="w", share=0.5, bins=8, levels=2).collect()
    assert abs(sum(r["taken"] for r in got) - 20_000) <= 10
    for k in range(4):
        want = 0.5 * (1 + k) / 2.5
        assert abs(np.mean([r["copies"] for r in got if r["id"] % 4 == k]) - want) < 0.05


def test_licence_rules():
    text = "Intro here.\nLicensed under the Apache License, Version 2.0. You may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\nhttp://www.apache.org\nUnless.\nReleased under the MIT License.\nSPDX-License-Identifier: BSD-3-Clause\n"
    n, found = licenses.scan_text(text)
    assert [x[0] for x in found] == ["Apache-2.0", "MIT", "BSD-3-Clause"] and n == 8
    assert text[found[1][2] : found[1][3]].strip() == "Released under the MIT License"
    assert licenses.match([(0, "mit.grant"), (9, "mit.include")]) == []


@pytest.mark.parametrize("mutual", [0.5, 0.8, 0.95])
def test_vectors_clustered(spark, tmp_path, mutual):
    """Pairs at cosine 0.983 among the vectors of one dense topic."""
    rng = np.random.default_rng(11)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    own = unit(rng.standard_normal((5500, 64)))
    c = (0.983 - mutual) / (1 - mutual)
    side = rng.standard_normal((500, 64))
    side = unit(side - (side * own[:500]).sum(1, keepdims=True) * own[:500])
    own = np.vstack([own, c * own[:500] + np.sqrt(1 - c * c) * side])
    x = (np.sqrt(mutual) * unit(rng.standard_normal((1, 64))) + np.sqrt(1 - mutual) * own).astype(np.float32)
    spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    x = unit(x.astype(float))
    hit = x @ x.T >= 0.98
    np.fill_diagonal(hit, False)
    got = sum(r["n_links"] for r in QUERIES["op2_embedding_dedup"](spark, str(tmp_path)).collect())
    assert hit.sum() > 800 and 0.995 * hit.sum() <= got <= hit.sum()


MIT = """Copyright (c) 2020 A Person

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
BSD2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
BSD3 = BSD2 + "\n\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""
MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
CC0 = "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."
CC = "This work is licensed under a Creative Commons {} 4.0 International License."
FULL = {
    "mit": (MIT, "MIT", "r2"), "bsd2": (BSD2, "BSD-2-Clause", "r5"), "bsd3": (BSD3, "BSD-3-Clause", "r4"), "apache": (APACHE, "Apache-2.0", "r0"), "gpl": (GPL, "GPL-3.0-or-later", "r6"), "mpl": (MPL, "MPL-2.0", "r8"), "isc": (ISC, "ISC", "r10"), "cc0": (CC0, "CC0-1.0", "r18"),
    "gpl-only": ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0-only", "r13"), "unlicense": ("This is free and unencumbered software released into the public domain.", "Unlicense", "r14"),
    "by": (CC.format("Attribution"), "CC-BY-4.0", "r15"), "by-sa": (CC.format("Attribution-ShareAlike"), "CC-BY-SA-4.0", "r16"), "by-nc": (CC.format("Attribution-NonCommercial"), "CC-BY-NC-4.0", "r17"), "reserved": ("All rights reserved.", "LicenseRef-all-rights-reserved", "r20"),
}


@pytest.mark.parametrize("name", sorted(FULL))
@pytest.mark.parametrize("sign", ["", "# ", " * "])
@pytest.mark.parametrize("width", [40, 72, 78, 10_000])
def test_wrapped_licences(name, sign, width):
    text, licence, rule = FULL[name]
    lines = [x for p in text.split("\n\n") for x in [*textwrap.wrap(p, width, break_long_words=False, break_on_hyphens=False), ""]]
    for end in ("\n", "\r\n"):
        whole = "Some words before.\n" + end.join(sign + x for x in lines) + end
        assert [x[:2] for x in licenses.scan_text(whole)[1]] == [(licence, rule)]


def test_licences_among_others():
    """Random sequences of wrapped licences, with other sentences between them, against what was put in."""
    rng = random.Random(5)
    filler = "Nothing of note is said here. Another plain sentence follows it. A third one ends the part. And one more for the gap.\n\n"
    for _ in range(60):
        names = [rng.choice(sorted(FULL)) for _ in range(rng.randint(1, 6))]
        sign, width = rng.choice(["", "// ", "* "]), rng.randint(45, 100)
        parts = ["\n".join(sign + x for p in FULL[n][0].split("\n\n") for x in [*textwrap.wrap(p, width, break_long_words=False, break_on_hyphens=False), ""]) for n in names]
        text = filler + ("\n" + filler).join(parts) + "\n" + filler
        assert [x[:2] for x in licenses.scan_text(text)[1]] == [FULL[n][1:] for n in names]


@pytest.mark.parametrize("text,names", [
    ("SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0-only WITH Classpath-exception-2.0", ["MIT", "Apache-2.0", "GPL-2.0-only", "Classpath-exception-2.0"]),
    ("# SPDX-License-Identifier: bsd-3-clause\nimport os", ["BSD-3-Clause"]),
    ("This file is licensed under the MIT License.", ["MIT"]),
    ("The code, unless noted, is licensed under the Apache License, Version 2.0 (see below).", ["Apache-2.0"]),
    ("Licensed to nobody under the sun", []),
    ("SPDX-License-Identifier:", []),
])
def test_licence_names(text, names):
    assert [x[0] for x in licenses.scan_text(text)[1]] == names


def test_toxicity_rows(spark, data, duck):
    rows = [r for r in QUERIES["op10_toxicity"](spark, data).collect()]
    assert len(rows) == duck.execute("select count(*) from documents").fetchone()[0]
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)


def test_kneser_ney_brute_force(spark):
    """Ratios, shared backoff and normalised class probabilities against a plain computation of the definition."""
    rng = random.Random(8)
    counts = {}
    for _ in range(400):
        ab = rng.randint(0, 12), rng.randint(1, 20)
        t, o = counts.get(ab, (0, 0))
        counts[ab] = (t + 1, o) if rng.random() < 0.4 else (t, o + 1)
    for k in range(1, 21):
        counts.setdefault((0, k), (0, 1))
    base, prior, conc = 2.0, 5.0, 7.0
    hist = lambda v: [sum(x == k for x in v) for k in (1, 2, 3, 4)]
    off = lambda x, d: d[min(int(x), 3)]
    words, contexts = sorted({b for _, b in counts}), sorted({a for a, _ in counts})
    types = {b: sum(y == b for _, y in counts) for b in words}
    floor = sum(types.values()) + base * (len(words) + 1)
    shared = {b: (types[b] + base) / floor for b in words}
    d_all = toxicity.discounts(hist([t + o for t, o in counts.values()]))
    prob, unseen = [], []
    for cls in (0, 1):
        left = {b: sum(y == b and n[cls] > 0 for (_, y), n in counts.items()) for b in words}
        e = toxicity.discounts(hist(left.values()))
        mass = sum(off(x, e) for x in left.values()) + prior
        word = {b: (left[b] - off(left[b], e) + mass * shared[b]) / (sum(left.values()) + prior) for b in words}
        unknown = mass * base / floor / (sum(left.values()) + prior)
        assert abs(sum(word.values()) + unknown - 1) < 1e-9
        d, own = toxicity.discounts(hist([n[cls] for n in counts.values()])), {}
        for a in contexts:
            seen = {b: n for (x, b), n in counts.items() if x == a}
            total = sum(t + o for t, o in seen.values())
            gamma = sum(off(t + o, d_all) for t, o in seen.values()) / total
            pooled = lambda b: (sum(seen[b]) - off(sum(seen[b]), d_all) if b in seen else 0) / total + gamma * shared[b]  # noqa: B023, E731
            tilt = {b: pooled(b) * word[b] / shared[b] for b in words} | {None: gamma * unknown}
            z, m = sum(tilt.values()), sum(n[cls] for n in seen.values())
            free = sum(off(n[cls], d) for n in seen.values()) + conc
            p = {b: ((seen[b][cls] - off(seen[b][cls], d) if b in seen else 0) + free * x / z) / (m + conc) for b, x in tilt.items()}
            assert abs(sum(p.values()) - 1) < 1e-9
            own |= {(a, b): x for b, x in p.items()}
        prob.append(own)
        unseen.append(word | {None: unknown})
    df = spark.createDataFrame([(a, b, t, o) for (a, b), (t, o) in counts.items()], "a long, b long, t long, o long")
    w, pairs, unknown = toxicity.entries(df, base, prior, conc, least=0.0)
    m = toxicity.Model(w.toPandas(), pairs.toPandas(), unknown)
    want = [np.log(prob[0][a, b] / prob[1][a, b]) for a in contexts for b in [*words, None]]
    name = lambda b: 10**6 if b is None else b
    got = [m.ratios(np.array([a, name(b)], np.uint64))[1] for a in contexts for b in [*words, None]]
    assert np.allclose(got, want, atol=1e-9)
    # a context that nothing is known of leaves the word level
    assert np.allclose([m.ratios(np.array([999, name(b)], np.uint64))[1] for b in [*words, None]], [np.log(unseen[0][b] / unseen[1][b]) for b in [*words, None]])


def test_toxicity_separates_and_joins_agree(spark):
    """Held-out texts are told apart, and a model in tables scores as one in arrays does."""
    rng = random.Random(12)
    plain, bad = [f"w{k}" for k in range(300)], ["vile", "scum", "rot", "filth"]
    rows = []
    for k in range(900):
        words, toxic = [rng.choice(plain) for _ in range(rng.randint(5, 80))], k % 4 == 0
        for _ in range(3 if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((k, " ".join(words), int(toxic if rng.random() < 0.97 else not toxic), int(toxic)))
    rows += [(900, None, 0, 0), (901, "", 0, 0), (902, rows[0][1], rows[0][2], 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int, truth int")
    learn = F.col("doc_id") % 3 != 1
    scorers = [toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic"), learn, most_entries=n) for n in (10**6, 0)]
    assert scorers[0].model is not None and scorers[1].tables is not None
    a, b = ({r["doc_id"]: r["score"] for r in toxicity.score(df, s, ["doc_id"]).collect()} for s in scorers)
    assert a.keys() == b.keys() and len(a) == len(rows) and all(abs(a[k] - b[k]) < 1e-9 for k in a)
    held = [(a[k], truth) for k, _, _, truth in rows if k % 3 == 1]
    hit = [x > y for x, p in held for y, q in held if p and not q]
    assert np.mean(hit) > 0.97


def test_toxicity_learns_from_all_labelled_rows(spark, monkeypatch):
    """The counts have every labelled text, also where ordinary ones are many, and the curve has the evidence of each."""
    rng = random.Random(31)
    rows = []
    for k in range(240):
        words, toxic = [f"w{rng.randint(0, 30)}" for _ in range(rng.randint(2, 12))], int(k % 12 == 0)
        rows.append((k, " ".join(words + ["vile"] * toxic), toxic))
    rows += [(240, rows[0][1], 1), (241, rows[1][1], 0)]  # equal texts of a class count once
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    counted, curves, entries, logistic = [], [], toxicity.entries, toxicity.logistic
    monkeypatch.setattr(toxicity, "entries", lambda c, **o: (counted.append({(r["a"], r["b"]): (r["t"], r["o"]) for r in c.collect()}), entries(c, **o))[1])
    monkeypatch.setattr(toxicity, "logistic", lambda x, *o: (curves.append(len(x) if isinstance(x, np.ndarray) else x.count()), logistic(x, *o))[1])
    learn = F.col("doc_id") % 3 != 1
    scorer = toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic"), learn)
    want, texts = {}, {(t, y) for k, t, y in rows if k % 3 != 1}
    for text, y in texts:
        w = np.concatenate((toxicity.START, toxicity.tokens(text))).view(np.int64).tolist()
        for ab in set(zip(w, w[1:])):
            t, o = want.get(ab, (0, 0))
            want[ab] = (t + y, o + 1 - y)
    assert counted[0] == want and curves == [len(texts)]
    # the models of the halves add up to all
    halves = [{ab: n for ab, n in c.items()} for c in counted[1:]]
    assert len(halves) == 2 and {ab: tuple(sum(h.get(ab, (0, 0))[k] for h in halves) for k in (0, 1)) for ab in want} == want
    assert scorer.weights is not None


def test_toxicity_curve_is_the_plain_logistic(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 3))
    y = (x @ [2.0, -1.0, 0.5] + rng.normal(size=300) > 0.3).astype(int)
    df = spark.createDataFrame([(int(k), *map(float, v)) for k, v in zip(y, x)], "toxic int, x0 double, x1 double, x2 double")
    w, full = toxicity.logistic(df), np.column_stack((np.ones(300), x))
    p = 1 / (1 + np.exp(-full @ w))
    assert np.abs(full.T @ (p - y) + 1e-2 * w).max() < 1e-6  # the gradient of the penalised likelihood


def test_language_id_holds_little_beside_its_texts():
    """Parsing takes a few bytes a character, and the letters of a text are the same in pieces."""
    rng = random.Random(5)
    model = langid.Identifier({"a": " some plain words of a language ", "b": " andere worte einer sprache é "})
    texts = [langid.normalise(" ".join(rng.choice(["some", "worte", "plain", "é日", "𐐨x"]) for _ in range(800))) for _ in range(200)]
    tracemalloc.start()
    model.phrases(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 10 * sum(map(len, texts))
    number, long = {chr(c): k + 1 for k, c in enumerate(model.codes)}, "".join(texts[:40])
    assert len(long) > 2 * langid._PIECE and model.letters([long]).tolist() == [number.get(c, 0) for c in long]


@pytest.mark.parametrize("lang", [None, "und", "en"])
def test_language_stage_keeps_texts_with_letters(spark, lang):
    rows = [(k, "some plain words é", lang, "s", 18) for k in range(20)] + [(20, "123 !!", lang, "s", 6), (21, None, lang, "s", 0), (22, "", lang, "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["doc_id"] for r in corpus_pipeline.language_id(spark, docs, "").collect()} == set(range(20))
    only = docs.filter("doc_id >= 20 or crc32(cast(doc_id as string)) % 5 = 0")  # no row to learn from has a letter
    kept = {r["doc_id"] for r in only.filter("doc_id < 20").collect()}
    assert kept and {r["doc_id"] for r in corpus_pipeline.language_id(spark, only, "").collect()} == kept


def test_pipeline_brute_force(spark, data, duck, encoding):
    """run() against the stages done plainly in Python, but for the mix, which SQL checks; here its totals are held."""
    docs = {i: t for i, t in duck.execute("select doc_id, text from documents").fetchall() if t and any(map(str.isalpha, t))}
    best = {}
    for i, t in sorted(docs.items()):
        k = "".join(c for c in t if c not in " \t\n\v\f\r")
        if k not in best or len(t) > len(docs[best[k]]):
            best[k] = i
    ids = sorted(best.values())
    links = _alike([(i, docs[i]) for i in ids])
    kept = {i for i, c in _classes(ids, links).items() if i == c}
    rows = corpus_pipeline.run(spark, data).collect()
    assert {r["doc_id"] for r in rows} <= kept
    times = defaultdict(int)
    for r in rows:
        times[r["doc_id"]] += 1
        assert r["n_tokens"] == len(encoding[1].encode_ordinary(docs[r["doc_id"]]))
    assert max(times.values()) <= 2
    size = {i: len(docs[i].split()) for i in kept}
    assert abs(sum(size[i] * n for i, n in times.items()) / (1.5 * sum(size.values())) - 1) < 0.05
