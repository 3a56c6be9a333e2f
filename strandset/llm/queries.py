"""The registered queries of the corpus operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .ann import nearest
from .bpe import bpe_digests
from .common import table
from .dedup import dedup_report
from .html_text import extract_text
from .langid import language_predictions
from .lm import corpus_scores
from .ngram_join import component_report
from .packing import pack_sequences
from .tokens import token_digests
from .warc import warc_round_trip


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_report(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_predictions(table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(table(spark, sf_dir, "pages"))


def op4_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), added=True)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return component_report(table(spark, sf_dir, "documents"))


def op7_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_scores(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_sequences(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), added=True)


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), "id % 20 = 0")


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_language_id": op2_language_id,
    "op3_warc": op3_warc,
    "op4_token_ids": op4_token_ids,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_ngram_join": op6_ngram_join,
    "op7_lm_scores": op7_lm_scores,
    "op8_packing": op8_packing,
    "op9_nearest": op9_nearest,
    "op10_html_text": op10_html_text,
}

#: DuckDB SQL where it can express a query.
ORACLE_SQL: dict[str, str] = {
    "op1_exact_dedup": r"""
with n as (
  select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as text_sha256, length(coalesce(text, '')) as size,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as body
  from documents
)
select doc_id,
       first_value(doc_id) over w as keep_id,
       count(*) over (partition by body) as group_size,
       doc_id = first_value(doc_id) over w as kept,
       text_sha256
from n window w as (partition by body order by size desc, doc_id)
""",
    "op6_ngram_join": r"""
with recursive t as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as words
  from documents
),
s as (
  select doc_id, case when len(words) = 0 then [] when len(words) < 3 then [array_to_string(words, ' ')]
                      else list_distinct(list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2])) end as grams
  from t
),
g as (select doc_id, len(grams) as size, unnest(grams) as gram from s),
o as (select a.doc_id as x, b.doc_id as y, any_value(a.size) as xs, any_value(b.size) as ys, count(*) as shared from g a join g b on a.gram = b.gram and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
l as (select x, y from o where 100 * shared >= 90 * (xs + ys - shared)),
e as (select x, y from l union all select y, x from l),
r as (select doc_id as x, doc_id as y from s union select r.x, e.y from r join e on r.y = e.x),
c as (select x, min(y) as component_id from r group by x)
select doc_id, cast(len(grams) as bigint) as n_shingles, component_id from s join c on s.doc_id = c.x
""",
    "op3_warc": """
with p as (select page_id, encode(coalesce(html, '')) as payload from pages),
q as (select page_id, octet_length(payload) as payload_bytes, sha1(payload) as payload_digest, max(page_id) over (partition by payload) as top from p)
select page_id, payload_bytes, payload_digest,
       case when payload_bytes >= 1000 and page_id < top then 'revisit' else 'response' end as record_type,
       case when payload_bytes >= 1000 and page_id < top then top end as refers_to
from q
""",
}
