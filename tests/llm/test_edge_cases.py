"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing extra columns, for every operator."""

import hashlib

import pytest
from pyspark.sql import functions as F
from texelarium.llm import bpe, embedding_dedup, exact_dedup, langid, licenses, minhash, mixing, toxicity, url_filter, warc
from texelarium.llm.queries import RULES, tokenizer_path

LONG = " ".join(f"word{i % 977}" for i in range(60_000))
#: The extra columns bear names that operators use themselves.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, id string, score string, key string, copies string"
ROWS = [(1, "a b c", "en", "s1"), (1, "a b c", "en", "s1"), (2, None, None, None), (3, "", "en", "s2"), (None, "a  b\tc", "en", "s1"), (None, None, None, None), (4, LONG, "en", "s2"), (5, LONG + " x", "de", "s2"), (6, "123 !!", None, "s3")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, None, "x", "y", "z", "k", "c") for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def none(spark, docs):
    return docs.limit(0)


def test_licences(docs, none):
    assert licenses.scan(docs).count() == len(ROWS) and licenses.scan(none).count() == 0


def test_bpe(docs, none):
    got = {r["id"]: r for r in bpe.encode_documents(docs, *tokenizer_path()).collect()}
    assert got[2]["n_tokens"] == 0 and got[2]["ids_sha256"] == hashlib.sha256(b"").hexdigest()
    assert got[4]["decoded_sha256"] == hashlib.sha256(LONG.encode()).hexdigest()
    back = bpe.decode_documents(bpe.encode_documents(docs, *tokenizer_path()), *tokenizer_path())
    assert back.filter("id = 5").first()["text"] == LONG + " x"
    assert bpe.encode_documents(none, *tokenizer_path()).count() == 0


def test_language(docs, none):
    learned = langid.samples(docs, F.lit(True), F.col("doc_id"))
    got = langid.identify(docs, learned, ["doc_id", "score"], score_to="s").collect()
    assert len(got) == len(ROWS) and {r["lang_pred"] for r in got if r["doc_id"] in (2, 3, 6)} == {"und"}
    assert langid.samples(none, F.lit(True), F.col("doc_id")) == {}
    assert langid.identify(none, {}, ["doc_id"]).count() == 0


def test_mixing(docs, none):
    got = mixing.mix(docs, carry=tuple(docs.columns)).collect()
    assert len(got) == len(ROWS) and all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    assert all(r["carry_copies"] == "c" for r in got) and mixing.mix(none).count() == 0


def test_exact_dedup(docs, none):
    got = exact_dedup.exact_duplicates(docs).collect()
    assert len(got) == len(ROWS)
    groups = {}
    for r in got:
        groups.setdefault(bytes(r["digest"]), []).append(r)
    assert all(sum(r["kept"] for r in g) == 1 and len(g) == g[0]["group_size"] for g in groups.values())
    abc = next(g for g in groups.values() if len(g) == 3 and any(r["id"] == 1 for r in g))
    assert {r["keep_id"] for r in abc} == {None}  # six code points beat five
    assert exact_dedup.exact_duplicates(none).count() == 0


def test_minhash(docs, none):
    got = minhash.near_duplicates(docs, id_col="doc_id").collect()
    assert len(got) == len(ROWS)
    by = {}
    for r in got:
        by.setdefault(bytes(r["node"]) if r["node"] else None, []).append(r)
    long = [r for r in got if r["id"] in (4, 5)]
    assert {r["class_id"] for r in long} == {4} and sum(r["kept"] for r in long) == 1
    abc = [r for r in got if r["class_id"] == 1]
    assert len(abc) == 3 and sum(r["kept"] for r in abc) == 1
    assert all(r["kept"] for r in by[None])
    assert minhash.near_duplicates(none).count() == 0


def test_toxicity(spark, docs, none):
    labels = spark.createDataFrame([(1, 1), (1, 0), (3, 0), (4, 0), (5, 1), (None, 1), (6, None)], "doc_id long, toxic int")
    s = toxicity.fit(docs, labels, F.lit(True))
    got = toxicity.score(docs, s, ["doc_id", "key"]).collect()
    assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.fit(none, labels.limit(0), F.lit(True)).score("a") == 0.0


def test_warc(spark, tmp_path):
    big = "<html>\r\n\r\nWARC/1.1\r\n" + "é" * 200
    rows = [(3, "http://a", big), (2, "http://b c", big), (2, "http://b c", big), (None, None, big), (5, "u", None), (6, "u", ""), (7, "u", "small"), (8, "u", "small")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    path = warc.write_archive(pages)
    back = warc.read_archive(spark, path)
    got = back.collect()
    assert sorted((r["page_id"] or -1, r["record_type"], r["refers_to"]) for r in got if len(r["payload"]) > 100) == [(-1, "revisit", 2), (2, "response", None), (2, "response", None), (3, "revisit", 2)]
    assert all(r["record_type"] == "response" for r in got if len(r["payload"]) < 100)
    assert all(hashlib.sha256(r["payload"]).hexdigest() == r["digest"] for r in got)
    # the parts give back exactly the bytes that were written
    whole = sorted(bytes(r[0]) for r in back.select(warc.original_record(F.col("header"), F.col("payload"), F.col("record_type"))).collect())
    assert whole == sorted((r["record"] + "\n").encode() for r in warc.records(pages).collect())
    assert warc.read_archive(spark, warc.write_archive(pages.limit(0))).count() == 0


def test_url_filter(spark):
    listed = spark.createDataFrame(RULES, "host string, path string, verdict string")
    urls = [(1, "http://EXAMPLE.org/es/x", "example.org/es/", "block"), (2, "https://a.example.org/en/12?q", "example.org/en/1", "block"), (3, "http://b.org", None, "allow"), (4, None, None, "allow"), (5, "nothing", None, "allow"), (5, "nothing", None, "allow"), (6, "x://notorg/", None, "allow"), (7, "http://z.com/de/#f", "com/de/", "block"), (8, "http://org/", "org/", "allow"), (None, "http://k.org/a", "org/", "allow")]
    pages = spark.createDataFrame([(a, b, "h", "v") for a, b, _, _ in urls], "page_id long, url string, host string, verdict string")
    got = url_filter.judge(pages, listed)
    assert sorted((str(r["page_id"]), str(r["rule"]), r["verdict"]) for r in got.collect()) == sorted((str(a), str(c), d) for a, _, c, d in urls)
    assert url_filter.judge(pages, listed.limit(0)).filter("rule is not null").count() == 0
    assert url_filter.judge(pages.limit(0), listed).count() == 0


def test_vectors(spark):
    v = [1.0, 0.0, 0.5]
    rows = [(1, v, 0), (2, v, 0), (2, v, 0), (3, [2.0, 0.0, 1.0], 0), (4, v, 1), (5, v, None), (6, None, 0), (7, [0.0] * 3, 0), (8, [1.0, None, 0.0], 0), (9, [float("nan"), 1.0, 0.0], 0), (10, [0.0, 1.0, 0.0], 0), (11, [1.0, 0.0], 0), (None, v, 1)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, node string")
    got = sorted(((r["id"] or -1, r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_duplicate_vectors(df).collect()), key=str)
    want = [(1, 3, 1, True), (2, 3, 1, False), (2, 3, 1, False), (3, 3, 1, False), (4, 1, 4, True), (-1, 1, 4, False), *[(k, 0, k, True) for k in range(5, 12)]]
    assert got == sorted(want, key=str)
    assert embedding_dedup.near_duplicate_vectors(df.limit(0)).count() == 0
