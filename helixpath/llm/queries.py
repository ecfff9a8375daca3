"""The registered queries opN_<name> over the tables of a folder, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, decontam, filter_audit, licenses, mixing, ogg, quality, simhash, token_counts, token_files, topk, toxicity, url_rules
from .scratch import saved


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.scores(docs, toxicity.train(docs, labels(spark, sf_dir)))


def op2_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.decode_column(saved(ogg.encode_column(documents(spark, sf_dir)), "media"), keep_payload=False).drop("payload")


def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return url_rules.judge(pages, url_rules.rule_table(spark, url_rules.RULES)).select("page_id", "host", "path", "rule", "verdict")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_files.write_ids(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return token_files.read_ids(spark, path)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality.scores(docs, quality.train(docs, labels(spark, sf_dir)))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir)).drop("detections")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_classes(documents(spark, sf_dir)).select("doc_id", "fingerprint", "component_id")


def op11_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(filter_audit.joint_failures(filter_audit.flags(documents(spark, sf_dir), labels(spark, sf_dir))))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment_counts(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_ogg": op2_ogg,
    "op3_url_rules": op3_url_rules,
    "op4_token_counts": op4_token_counts,
    "op5_token_files": op5_token_files,
    "op6_quality": op6_quality,
    "op7_mixing": op7_mixing,
    "op8_licenses": op8_licenses,
    "op9_decontamination": op9_decontamination,
    "op10_simhash": op10_simhash,
    "op11_topk": op11_topk,
    "op12_filter_audit": op12_filter_audit,
    "op13_alignment": op13_alignment,
}

ORACLE_SQL: dict[str, str] = {
    "op3_url_rules": r"""
        with cut as (select page_id, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
        parts as (select page_id, translate(regexp_extract(rest, '(?s)^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
                         regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) as path from cut),
        rules(rhost, rpath, v) as (values ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block'))
        select page_id, host, path,
               (select rhost || rpath from rules where (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath) order by length(rhost || rpath) desc limit 1) as rule,
               coalesce((select v from rules where (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath) order by length(rhost || rpath) desc limit 1), 'allow') as verdict
        from parts
    """,
    "op11_topk": r"""
        with v as (select vec_id, list_transform(embedding, lambda x: floor(1024 * cast(x as double))) as e from embeddings
                   where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        pairs as (select q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.e, c.e) as bigint) as score from v q join v c on c.vec_id <> q.vec_id where q.vec_id % 100 = 0),
        ranked as (select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score from pairs)
        select query_id, rank, vec_id, score from ranked where rank <= 10
    """,
    "op12_filter_audit": r"""
        with recursive t as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text from documents),
        w as (select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words from t),
        l as (select doc_id, max(cast(quality = 1 as int)) as good, max(cast(toxic = 1 as int)) as toxic from labels group by doc_id),
        f as (select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic, {
                'A': len(words) < 100, 'B': 100 * len(list_distinct(words)) < 80 * len(words), 'C': 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text),
                'D': regexp_matches(text, '[#$%&*|]'), 'E': w.doc_id > min(w.doc_id) over (partition by text)} as fails from w left join l using (doc_id)),
        c as (select part, concat(case when fails.A then 'A' else '' end, case when fails.B then 'B' else '' end, case when fails.C then 'C' else '' end, case when fails.D then 'D' else '' end, case when fails.E then 'E' else '' end) as failed,
                     count(*) as n, sum(good) as good, sum(toxic) as toxic from f group by all),
        orders(o) as (select '' union all select o || x from orders, (select unnest(['A', 'B', 'C', 'D', 'E']) as x) where length(o) < 5 and not contains(o, x)),
        steps as (select o as filter_order, k as step, substr(o, k, 1) as x, substr(o, 1, k - 1) as before from orders, (select unnest([1, 2, 3, 4, 5]) as k) where length(o) = 5),
        met as (select part, filter_order, step, x, n, good, toxic, contains(failed, x) as hit, failed = x as alone, translate(failed, before, '') <> failed as gone from c, steps),
        sums as (select part, filter_order, step, x, coalesce(sum(n) filter (not gone and not hit), 0) as kept, coalesce(sum(n) filter (not gone and hit), 0) as removed, coalesce(sum(n) filter (gone and hit), 0) as redundant,
                        coalesce(sum(n) filter (alone), 0) as unique_fails, coalesce(sum(good) filter (not gone and hit), 0) as good_lost, coalesce(sum(toxic) filter (not gone and hit), 0) as toxic_lost from met group by all)
        select part, filter_order, cast(step as integer) as step, cast(kept as bigint) as kept, cast(removed as bigint) as removed, cast(redundant as bigint) as redundant, cast(unique_fails as bigint) as unique_fails,
               cast(good_lost as bigint) as good_lost, cast(toxic_lost as bigint) as toxic_lost, cast(sum(removed) over (partition by part, x) as bigint) as shapley from sums
    """,
}
