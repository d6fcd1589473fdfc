"""One query for each corpus operator over the whole of its table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataweave.llm import bpe, exact, html, lines, packing, quality, simhash, substring, tokenfile, urls
from strataweave.llm.common import stage

#: A public tokenizer's file; a parameter of every operator that uses one.
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
END_OF_DOCUMENT = 50256
PACK_END = 1


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op2_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact.exact_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep="largest")
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bpe.encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), TOKENIZER, decode=True)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return found.select(F.col("id").alias("doc_id"), F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    files = stage(tokenfile.write(docs, TOKENIZER, END_OF_DOCUMENT), "token-files")
    counts = tokenfile.token_counts(files, END_OF_DOCUMENT)
    return tokenfile.document_ids(files).join(counts, ["file", "ordinal"], "left").select(F.col("id").alias("doc_id"), "file", "ordinal", "n_tokens")


def op5_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["length"])
    return found.select(F.col("id").alias("doc_id"), "n_words", removed.alias("n_removed"), F.sha2("kept_text", 256).alias("kept_sha256"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    found = quality.judge(docs, quality.train(docs, labels))
    return found.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"), F.struct("page_id", "url"))
    return found.select("row.page_id", "row.url", "text", F.length("text").cast("bigint").alias("n_chars"))


def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.line_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("id").alias("doc_id"), "n_lines", F.size("dropped").cast("bigint").alias("n_dropped"), F.array_join(F.col("dropped").cast("array<string>"), ",").alias("dropped_lines"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), TOKENIZER, PACK_END).withColumnRenamed("id", "doc_id")


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = urls.filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return found.select("page_id", "url_verdict.host", "url_verdict.path", "url_verdict.rule", "url_verdict.verdict")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_simhash, op2_exact, op3_bpe, op4_token_counts, op5_substring, op6_quality, op7_html, op8_lines, op9_packing, op10_urls)}


_OP2 = """
with t as (select doc_id, coalesce(text, '') as text from documents)
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size,
       row_number() over (partition by text order by doc_id desc nulls last) = 1 as kept, sha256(text) as text_sha256
from t window w as (partition by text)
"""

_OP5 = """
with d as (select row_number() over () as r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents),
s as (select r, doc_id, unnest(range(len(w) - 12)) as i, w from d where len(w) >= 13),
g as (select r, doc_id, i, array_to_string(w[i + 1:i + 13], ' ') as t from s),
m as (select t, min(doc_id) as low from g group by t),
c as (select distinct r, unnest(range(i, i + 13)) as p from g join m using (t) where low < coalesce(doc_id, 9223372036854775807)),
p as (select r, unnest(w) as word, unnest(range(len(w))) as p from d),
k as (select p.r, string_agg(word, ' ' order by p.p) filter (c.p is null) as kept, count(c.p) as gone from p left join c on p.r = c.r and p.p = c.p group by p.r)
select doc_id, len(w) as n_words, coalesce(gone, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from d left join k using (r)
"""

_OP10 = """
with u as (select page_id, coalesce(url, '') as url from pages),
r as (select page_id, case when instr(url, '://') > 0 then regexp_extract(substring(url, instr(url, '://') + 3), '^[^?#]*') else '' end as rest from u),
p as (select page_id, translate(regexp_extract(rest, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_replace(rest, '^[^/]*', '') as path from r),
rules(site, start, verdict) as (values ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
f as (select page_id, host, path, site || start as rule, verdict from p left join rules on (host = site or ends_with(host, '.' || site)) and starts_with(path, start)),
b as (select page_id, host, path, arg_max(rule, length(rule)) as rule, arg_max(verdict, length(rule)) as verdict from f group by all)
select page_id, host, path, rule, coalesce(verdict, case when regexp_matches(host || path, '(?i)(^|[^a-z0-9])(%s)([^a-z0-9]|$)') then 'block' else 'allow' end) as verdict from b
""" % "|".join(r.tokens[0] for r in urls.WORDS)


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for the queries that SQL can express; the others are tested against brute force in tests/llm/."""
    return {"op2_exact": _OP2, "op5_substring": _OP5, "op10_urls": _OP10}
