"""The queries of this subpackage, one for each operator, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import crossparse_lang, importance_duckdb, kn_quality, line_dedup, pareto_mix, png_media, ring_sharding, secrets_crf, simhash_gray, sp_tokenizer, spelling_wavelet, toxicity_fm, warc_zstd
from .common import bounded_batches, documents


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets_crf.scan_secrets(documents(spark, sf_dir))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity_fm.score(docs, toxicity_fm.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return png_media.media_features(documents(spark, sf_dir))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kn_quality.quality(documents(spark, sf_dir))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crossparse_lang.identify(documents(spark, sf_dir))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ring_sharding.assign(documents(spark, sf_dir))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(documents(spark, sf_dir))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_gray.near_duplicates(documents(spark, sf_dir))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp_tokenizer.token_report(documents(spark, sf_dir))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pareto_mix.mix_report(documents(spark, sf_dir))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return warc_zstd.archive_report(spark.read.parquet(f"{sf_dir}/pages.parquet"))


# CRC-32 byte by byte: `tab` is the table of its polynomial, `CRC` goes through the hex digits of a text's bytes.
TAB = "tab as (select list(c order by i) as t from (select i, list_reduce(list_prepend(i::bigint, range(8)), lambda a, b: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end) as c from range(256) r(i)))"
CRC = "xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(length({0}) // 2), lambda k: ('0x' || substr({0}, (2 * k + 1)::int, 2))::bigint)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295)"
ASCII_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP12 = f"""
with {TAB}, x as (select doc_id, 1 as raw, text from documents union all select null, 0, text from benchmark),
w as (select row_number() over () as k, doc_id, raw, regexp_extract_all({ASCII_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as ws from x),
g as (select k, raw, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) as f from w),
n as (select k, raw, f, count(*) as n from g group by all), u as (select f, hex(encode(f)) as h from (select distinct f from n)),
b as (select f, {CRC.format("h")} % 10000 as b from u, tab), m as (select k, raw, b, sum(n) as n from n join b using (f) group by all),
c as (select b, sum(n * raw) as s, sum(n * (1 - raw)) as t from m group by b), z as (select sum(s) as ss, sum(t) as tt from c),
v as (select b, floor(1000 * ln((t + 1)::double * (ss + 10000)::double / ((s + 1)::double * (tt + 10000)::double))) as gain from c, z),
e as (select k, sum(n)::bigint as n_features, floor(sum(n * gain) / sum(n))::bigint as weight from m join v using (b) where raw = 1 group by k),
y as (select doc_id, len(ws) as n_words, coalesce(n_features, 0)::bigint as n_features, coalesce(weight, 0)::bigint as weight, ('0x' || left(sha256('7:' || coalesce(doc_id::varchar, '')), 8))::bigint::double as h from w left join e using (k) where raw = 1),
q as (select *, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296.0::double)))::bigint as score from y),
r as (select *, row_number() over (partition by n_words >= 20 order by score desc, doc_id) as place, count(*) over (partition by n_words >= 20) as n from q)
select doc_id, n_features, weight, score, case when n_words >= 20 and place <= 25 * n // 100 then place end as rank from r
"""

# Words of equal length are near where one deletion at the same place makes them equal, others where a deletion of one makes the other.
OP13 = f"""
with recursive {TAB}, x as (select coalesce(doc_id::varchar, '') as id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{{7,}}')) as run from documents),
d as (select id, {ASCII_LOWER.format("run")} as run, count(*) as n from x group by all), e as (select *, hex(encode(id || ':' || run)) as hx from d),
h as (select run, n, {CRC.format("hx")} as h from e, tab), p as (select run, n, h, (h % length(run))::int as p from h),
s as (select case when h % 31 = 0 then substr(run, 1, p) || substr(run, p + 2) else run end as word, n from p),
w as materialized (select word, sum(n)::bigint as n from s where length(word) >= 7 group by word having sum(n) >= 2),
v as materialized (select word, i, substr(word, 1, i::int) || substr(word, (i + 2)::int) as v from (select word, unnest(range(length(word))) as i from w) q),
o as (select distinct v.word as a, w.word as b from v join w on v.v = w.word),
near as (select a.word as word, b.word as other from v a join v b on a.v = b.v and a.i = b.i and a.word <> b.word union all select a, b from o union all select b, a from o),
m as (select near.word, count(*) as n_near, arg_min(other, (-w.n, other)) as best, max(w.n) as best_n from near join w on w.word = near.other group by near.word),
f as materialized (select w.word, w.n, coalesce(n_near, 0) as n_near, case when best_n >= 10 * w.n then best end as form, case when best_n >= 10 * w.n then best_n end as form_n from w left join m using (word)),
c as (select word, word as tail, 0 as k from f union all select c.word, f.form, k + 1 from c join f on f.word = c.tail where f.form is not null),
r as (select word, arg_max(tail, k) as root from c group by word)
select word, form, root, n, n_near::bigint as n_near, form_n from f join r using (word)
"""

# Base 32 is 8 groups of 5 hex digits, each four symbols.
OP11 = """
with p as (select page_id, coalesce(html, '') as html from pages), h as (select page_id, html, sha1(html) as hex, octet_length(encode(html)) as n from p),
r as (select *, row_number() over (partition by hex order by page_id) as k, min(page_id) over (partition by hex) as first_id from h),
s as (select *, list_transform(range(8), lambda i: ('0x' || substr(hex, (5 * i + 1)::int, 5))::int) as v from r)
select page_id, n::bigint as payload_bytes, list_aggregate(list_transform(range(32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (1 + ((v[j // 4 + 1] >> (15 - 5 * (j % 4))::int) & 31))::int, 1)), 'string_agg', '') as payload_digest,
case when k = 1 then 'response' else 'revisit' end as record_type, case when k > 1 then first_id end as refers_to from s
"""


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_duckdb.importance_report(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_wavelet.variant_report(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_secret_scan, op2_toxicity, op3_media_columns, op4_quality_rules, op5_language_id, op6_sharding, op7_line_dedup, op8_simhash_near_dedup, op9_sentencepiece, op10_source_mixing, op11_warc, op12_importance_resampling, op13_spelling_variants)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    """The results that SQL can express; tests/llm holds the others against brute force."""
    return {"op11_warc": OP11, "op12_importance_resampling": OP12, "op13_spelling_variants": OP13}
