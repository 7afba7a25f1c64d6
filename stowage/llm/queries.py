"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from stowage.llm.bpe import bpe_digest
from stowage.llm.common import read_table
from stowage.llm.exact import exact_classes
from stowage.llm.html import extract
from stowage.llm.lines import line_report
from stowage.llm.neardup import near_classes
from stowage.llm.packing import pack
from stowage.llm.secrets import secret_spans
from stowage.llm.tokencount import token_counts
from stowage.llm.topk import top_k
from stowage.llm.toxicity import fit, toxicity


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(read_table(spark, sf_dir, "documents"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_classes(read_table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(read_table(spark, sf_dir, "documents"), width=3, percent=85)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return toxicity(docs, fit(docs, read_table(spark, sf_dir, "labels")))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read_table(spark, sf_dir, "pages"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digest(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(read_table(spark, sf_dir, "documents"))


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


SQL = {
    "op2_exact_dedup": """
        with t as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as norm from documents)
        select doc_id, max(doc_id) over (partition by norm) as keep_id, count(*) over (partition by norm) as group_size,
               row_number() over (partition by norm order by doc_id desc nulls last) = 1 as kept, sha256(norm) as text_sha256
        from t""",
    "op4_near_dedup": r"""
        with recursive d as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
        s as (select r, doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
                     else list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) end) as g from d),
        n as (select r, doc_id, len(g) as n, unnest(g) as x from s),
        p as (select a.doc_id as a, b.doc_id as b, a.r as ra, b.r as rb, any_value(a.n) as na, any_value(b.n) as nb, count(*) as c
              from n a join n b on a.x = b.x and a.r <> b.r where a.doc_id is not null and b.doc_id is not null group by all),
        e as (select distinct a, b from p where 100 * c >= 85 * (na + nb - c)),
        t(v, root) as (select a, a from e union select e.b, t.root from t join e on e.a = t.v where t.root < e.b),
        m as (select v, min(root) as root from t group by v)
        select s.doc_id, len(s.g) as n_shingles, case when s.doc_id is not null then least(coalesce(m.root, s.doc_id), s.doc_id) end as component_id,
               s.doc_id is null or coalesce(m.root, s.doc_id) >= s.doc_id as kept
        from s left join m on m.v = s.doc_id""",
    "op10_exact_topk": """
        with v as (select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as e from embeddings
                   where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        s as (select q.vec_id as query_id, c.vec_id as vec_id,
                     list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i]))::bigint as score
              from v q join v c on c.vec_id <> q.vec_id and len(c.e) = len(q.e) where q.vec_id % 100 = 0),
        r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
        select query_id, rank::integer as rank, vec_id, score from r where rank <= 10""",
}
