"""Queries of the training-data operators, and their DuckDB SQL where it can say them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.llm import bpe, chat_format, flac, language_id, license_scan, packing, quality_model, quality_rules, simhash, url_filter
from panelwright.llm.common import table


def tokenizer_path() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_filter(table(spark, sf_dir, "pages"))


def url_filters_with_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator where components decide: of every three pages in order of their
    ids, the second names the first as canonical and the third sends on to the second."""
    pages = table(spark, sf_dir, "pages")
    to = pages.select(F.col("page_id").alias("to_id"), F.col("url").alias("to_url"))
    at = F.when(F.col("page_id") % 3 > 0, F.col("page_id") - 1)
    canonical = F.concat(F.lit("<link rel='canonical' href='"), "to_url", F.lit("'>"))
    refresh = F.concat(F.lit("<meta http-equiv='refresh' content='0; url="), "to_url", F.lit("'>"))
    html = F.when(F.col("page_id") % 3 == 1, canonical).otherwise(refresh)
    return url_filter.url_filter(pages.join(to, F.col("to_id") == at, "left").select("page_id", "url", html.alias("html")))


def op4_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_digests(table(spark, sf_dir, "documents"), tokenizer_path())


def op5_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify_documents(table(spark, sf_dir, "documents"))


def language_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator where pages declare languages and have addresses."""
    return language_id.identify_pages(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op7_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flac.media_digests(table(spark, sf_dir, "documents"))


def flac_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of ``op7_flac_media`` what SQL can say: the payload that was read back."""
    return op7_flac_media(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat_format.with_probe(table(spark, sf_dir, "conversations"))
    return chat_format.chat_digests(chat_format.format_chats(rows))


#: The pages of ``url_filters_with_aliases``, before the query's own tables.
ALIASED = """
with recursive made as (
  select p.page_id, p.url, case when p.page_id % 3 = 1 then concat('<link rel=''canonical'' href=''', t.url, '''>') else concat('<meta http-equiv=''refresh'' content=''0; url=', t.url, '''>') end as html
  from pages p left join pages t on t.page_id = case when p.page_id % 3 > 0 then p.page_id - 1 end
)
"""


PAYLOADS = r"""
with texts as (
  select doc_id, encode(coalesce(text, '')) as b from documents
), payloads as (
  select doc_id, octet_length(b) as n, b || repeat('\x00'::blob, case when octet_length(b) = 0 then 64 else (64 - octet_length(b) % 64) % 64 end) as payload from texts
)
select doc_id, n::bigint as n_bytes, octet_length(payload)::bigint as payload_bytes, sha256(payload) as payload_sha256 from payloads
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_quality_classifier,
        op2_best_fit_packing,
        op3_url_filters,
        op4_bpe_encoding,
        op5_license_scans,
        op6_language_id,
        op7_flac_media,
        op8_quality_rules,
        op9_simhash_near_dedup,
        op10_chat_formatting,
        language_of_pages,
        url_filters_with_aliases,
        flac_payloads,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op3_url_filters": url_filter.oracle(),
        "url_filters_with_aliases": ALIASED + url_filter.oracle().strip().replace("with recursive p as", ", p as", 1).replace(" from pages\n", " from made\n", 1),
        "op5_license_scans": license_scan.oracle(),
        "flac_payloads": PAYLOADS,
        "op8_quality_rules": quality_rules.oracle(),
        "op10_chat_formatting": chat_format.ORACLE,
    }
