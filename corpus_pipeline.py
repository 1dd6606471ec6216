"""From raw documents to token counts: language ID, exact dedup, MinHash near-dedup, mixing, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it
as Parquet in the shared folder and rereads it as the next stage's ``docs``. All
but the last return the columns of ``documents``.

Stages keep rows, not ids: a row is known by its id and a digest of its text, so
null, repeated or clashing ids lose nothing, and of rows that repeat in full one
stays where one should.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from texelarium.llm import bpe, exact_dedup, langid, minhash, mixing
from texelarium.llm.common import discard, fold, materialize, table, tidy
from texelarium.llm.queries import tokenizer_path


def _row_key() -> Column:
    """Id (in numeric order, null last) and text of a row as one string."""
    number = F.lpad((F.col("doc_id").cast("decimal(20,0)") + F.lit("9223372036854775808").cast("decimal(20,0)")).cast("string"), 20, "0")
    return F.concat(F.coalesce(number, F.lit("~")), F.lit(":"), F.coalesce(F.md5(F.col("text").cast("binary")), F.lit("")))


#: Keys that are broadcast to filter documents: at most so many, of 60 bytes or less; more take a shuffled join.
BROADCAST_KEYS = 200_000


def _only(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, by (__key, kept) of every row.

    Most keys belong to one row, which stays; only the others are listed, so where
    these are few no text is shuffled.
    """
    per_key = decided.groupBy("__key").agg(F.count("*").alias("n"), F.sum(F.col("kept").cast("int")).alias("stay"))
    listed = materialize(per_key.filter("n > 1 OR stay = 0"), "listed")
    small = F.broadcast if listed.count() <= BROADCAST_KEYS else lambda df: df
    keyed = docs.withColumn("__key", F.md5(_row_key().cast("binary")))
    # a key of several rows stands for rows that repeat in id and text
    again = keyed.join(small(listed.filter("stay > 0").select("__key")), "__key", "left_semi").dropDuplicates(["__key"])
    return keyed.join(small(listed.select("__key")), "__key", "left_anti").unionByName(again).select(*docs.columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without an identifiable language: null text or no letter, also where no language could be learned."""
    learned = langid.samples(docs, fold("doc_id", 5) != 0, F.col("doc_id"))
    if not any(t.strip() for t in learned.values()):  # no language to tell apart, so no reason to drop a text with a letter
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    out = langid.identify(docs, learned, docs.columns, lang_to="__lang", score_to="__score")
    # only what has no language scores 0; a label may be called 'und' too
    return out.filter("__score > 0").select(*docs.columns)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal without white space, keeps the longest original, then the smallest id."""
    keyed = docs.select(_row_key().alias("key"), "text")
    out = exact_dedup.exact_duplicates(keyed, id_col="key", text_col="text")
    return _only(docs, out.select(F.md5(F.col("id").cast("binary")).alias("__key"), "kept"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates, keeps the row of smallest id."""
    keyed = docs.select(_row_key().alias("key"), "text")
    out = minhash.near_duplicates(keyed, id_col="key", text_col="text")
    return _only(docs, out.select(F.md5(F.col("id").cast("binary")).alias("__key"), "kept"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it (0, 1 or 2 times)."""
    out = mixing.mix(docs, carry=tuple(docs.columns)).filter("copies > 0")
    out = out.withColumn("__n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return out.select(*[F.col(f"carry_{c}").alias(c) for c in docs.columns])


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and of the decoded bytes."""
    out = bpe.encode_documents(docs, *tokenizer_path(), with_ids=False)
    return out.select(F.col("id").alias("doc_id"), "n_tokens", "ids_sha256", "decoded_bytes", "decoded_sha256")


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_duplicates),
    ("minhash_dedup", near_duplicates),
    ("source_mix", mix_sources),
    ("bpe", tokenise),
]

#: Language ID, ProbMinHash and BPE are not SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:  # each result is written; what a stage wrote on the way, and its input, is deleted
        done = tidy(stage)(spark, docs, sf_dir)
        discard(docs)
        docs = done
    return docs
