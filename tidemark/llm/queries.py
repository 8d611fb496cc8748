"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, language, pii, quality, secrets, simhash, spotsigs, token_counts, url_filter
from ._common import remainder, table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.pseudonymise(table(spark, sf_dir, "documents"), key="surrogates of the query")
    return found.select("doc_id", "n_entities", F.array_join("kinds", ",").alias("kinds"), "text")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.train(docs, remainder("doc_id", 4) != 2)
    return language.identify_languages(docs, model).select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op6_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return spotsigs.with_links(spotsigs.edit_report(docs), spotsigs.fingerprints(docs))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), keep_ids=False, keep_text=False)


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages")).drop("trust", "distrust")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"), remainder("doc_id", 5) != 0)
    return quality.score_quality(docs, model).select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_pii_surrogates": op2_pii_surrogates,
    "op3_simhash": op3_simhash,
    "op4_token_counts": op4_token_counts,
    "op5_language": op5_language,
    "op6_spotsigs": op6_spotsigs,
    "op7_bpe": op7_bpe,
    "op8_url_filter": op8_url_filter,
    "op9_secrets": op9_secrets,
    "op10_quality": op10_quality,
}
#: DuckDB SQL for the rows of a query, where SQL can express it.
ORACLES = {
    "op1_decontamination": decontaminate.REPORT_SQL,
    "op3_simhash": simhash.REPORT_SQL,
    "op6_spotsigs": spotsigs.REPORT_SQL,
    "op8_url_filter": url_filter.REPORT_SQL,
}
