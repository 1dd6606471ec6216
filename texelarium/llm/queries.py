"""The registered queries of this subpackage and, where SQL can say it, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, embedding_dedup, exact_dedup, langid, licenses, minhash, mixing, toxicity, url_filter, warc
from .common import fold, new_path, table, tidy

#: Listed entries of op8: host, path, verdict.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def tokenizer_path(name: str = "byte_bpe_multi_50k.tiktoken") -> tuple[str, str]:
    """(vocabulary file, splitting pattern) of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    names = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["license"])))
    return found.select(F.col("id").alias("doc_id"), "n_sentences", F.size("matches").cast("long").alias("n_matches"), F.array_join(names, ",").alias("licenses"), F.array_join(F.transform("matches", lambda m: F.concat_ws(":", m["rule"], m["start"].cast("string"), m["end"].cast("string"))), ",").alias("spans"))


@tidy
def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = embedding_dedup.near_duplicate_vectors(table(spark, sf_dir, "embeddings"))
    return out.select(F.col("id").alias("vec_id"), "n_links", "component_id", "kept")


def op3_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.encode_documents(table(spark, sf_dir, "documents"), *tokenizer_path(), with_ids=False)
    return out.select(F.col("id").alias("doc_id"), "n_tokens", "ids_sha256", "decoded_sha256", "decoded_bytes")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = fold("doc_id", 5) == 0
    learned = langid.samples(docs, ~held, F.col("doc_id"))
    return langid.identify(docs, learned, ["doc_id"]).select("doc_id", held.alias("held_out"), "lang_pred", "score")


@tidy
def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


@tidy
def op6_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.write_archive(table(spark, sf_dir, "pages"), new_path(spark, "warc"))
    back = warc.read_archive(spark, path)
    return back.select("page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"), "record_type", "refers_to")


@tidy
def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


@tidy
def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spark.createDataFrame(RULES, "host string, path string, verdict string")
    out = url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), listed)
    return out.select("page_id", "host", "path", "rule", "verdict")


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = minhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "class_id", "class_size", "kept")


@tidy
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = fold("doc_id", 3) == 1
    scorer = toxicity.fit(docs, labels, ~held)
    out = toxicity.score(docs, scorer, ["doc_id"])
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    own = [op1_license_scan, op2_embedding_dedup, op3_bpe_round_trip, op4_language_id, op5_source_mix, op6_warc_archive, op7_exact_dedup, op8_url_filter, op9_minhash_dedup, op10_toxicity, pipeline]
    return {f.__name__: f for f in own}


_WS = r"[\x20\x09-\x0D]"

OP2_SQL = """
with recursive v as materialized (select row_number() over () as n, vec_id, label, embedding::double[] as e from embeddings),
ok as materialized (select * from v where label is not null and e is not null and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
p as materialized (select a.n as x, b.n as y from ok a join ok b on a.label = b.label and len(a.e) = len(b.e) and a.n <> b.n
                   where list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.98),
reach(n, m) as (select n, n from v union select r.n, p.y from reach r join p on p.x = r.m)
select v.vec_id, (select count(*) from p where p.x = v.n) as n_links, c.component_id, v.vec_id = c.component_id as kept
from v join (select r.n, min(w.vec_id) as component_id from reach r join v w on w.n = r.m group by r.n) c using (n)
"""

OP5_SQL = rf"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
             (('0x' || substr(md5('mix:' || coalesce(doc_id::varchar, '')), 1, 13))::bigint::double + 0.5) / 4503599627370496.0 as u from documents),
s as (select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) as k from d group by source),
w as (select *, case (k - 1) % 3 when 0 then 3.0::double when 1 then 1.0::double else 2.0::double end as w, source_size * 2.0::double as cap from s),
p as (select *, w * ((sum(source_size) over ())::double * 1.5::double - coalesce(sum(cap) over (order by cap / w, source nulls last rows between unbounded preceding and 1 preceding), 0.0::double))
             / sum(w) over (order by cap / w, source nulls last rows between current row and unbounded following) as part from w),
l as (select min(cap / w) filter (where part < cap) as first_open from p),
v as (select arg_min(part / w, cap / w) filter (where part < cap) as level from p),
t as (select source, source_size, case when cap / w >= first_open then least(w * level, cap) else cap end as target from p, l, v),
e as (select d.*, t.source_size, t.target, least(2.0::double, case when t.source_size > 0 then t.target * 1.0::double / t.source_size::double else 0.0::double end) as expected
      from d join t on d.source is not distinct from t.source),
f as (select *, floor(expected)::bigint as whole, expected - floor(expected) as frac from e),
g as (select *, case when frac > 0 then (u / (1 - u)) / (frac / (1 - frac)) end as key from f),
h as (select *, coalesce(sum(case when key is not null then size else 0 end) over (partition by source order by key nulls last, doc_id nulls first, size rows between unbounded preceding and 1 preceding), 0) as start,
             target - sum(whole * size) over (partition by source) as left_words from g)
select doc_id, size, source_size, target, (size * (whole + case when key is not null and start + size / 2.0::double <= left_words then 1 else 0 end))::bigint as taken from h
"""

OP6_SQL = """
with p as (select page_id, coalesce(html, '') as html from pages),
q as (select page_id, strlen(html)::bigint as payload_bytes, sha256(html) as payload_digest from p),
r as (select *, min(page_id) over (partition by payload_digest) as first from q)
select page_id, payload_bytes, payload_digest, case when payload_bytes >= 100 and page_id <> first then 'revisit' else 'response' end as record_type,
       case when payload_bytes >= 100 and page_id <> first then first end as refers_to from r
"""

OP7_SQL = rf"""
with d as (select doc_id, length(coalesce(text, '')) as size, sha256(regexp_replace(coalesce(text, ''), '{_WS}+', '', 'g')) as text_sha256 from documents)
select doc_id, first_value(doc_id) over w as keep_id, count(*) over (partition by text_sha256) as group_size,
       row_number() over w = 1 as kept, text_sha256 from d window w as (partition by text_sha256 order by size desc, doc_id nulls last)
"""

OP8_SQL = r"""
with u as (select page_id, case when url is not null and strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
h as (select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u),
r(rhost, rpath, said) as (values ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
m as (select h.page_id, h.host, h.path, r.rhost || r.rpath as rule, r.said, row_number() over (partition by h.page_id order by length(r.rhost) + length(r.rpath) desc, r.said desc) as k
      from h left join r on (h.host = r.rhost or ends_with(h.host, '.' || r.rhost)) and starts_with(h.path, r.rpath))
select page_id, host, path, rule, coalesce(said, 'allow') as verdict from m where k = 1
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_embedding_dedup": OP2_SQL, "op5_source_mix": OP5_SQL, "op6_warc_archive": OP6_SQL, "op7_exact_dedup": OP7_SQL, "op8_url_filter": OP8_SQL}
