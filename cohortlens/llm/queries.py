"""Registered queries of the operators: thin, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm import bpe, collocations, decontaminate, html_text, imatch, language_id, licenses, lm_score, mixing
from cohortlens.llm import prefix_trie, simhash, token_count, url_filter

#: Rules of the URL query.
URL_RULES = [
    url_filter.Rule("allow", "org", "/"),
    url_filter.Rule("block", "example.org", "/es/"),
    url_filter.Rule("block", "example.org", "/en/1"),
    url_filter.Rule("allow", "com", "/fr/"),
    url_filter.Rule("block", "com", "/de/"),
]
#: Weights of the sources in their order, repeating.
MIX_WEIGHTS = [5.0, 2.0, 1.0]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _partitions(spark: SparkSession) -> int:
    """The cluster's number of shuffle partitions, which is to grow with the data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def page_label_id(path: Column) -> Column:
    """The document that a page shows: the number at the end of its path (``/en/12.html``); else null."""
    return F.regexp_extract(path, r"/([0-9]{1,18})(?:\.html|/)?$", 1).try_cast("bigint")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled outcome of a page: the quality and toxicity labels of the document that it shows."""
    labels = _table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("label_id"),
        F.when((F.col("quality") == 1) & (F.col("toxic") == 0), 1).otherwise(0).alias("good"))
    return url_filter.judge_urls(_table(spark, sf_dir, "pages"), labels, URL_RULES, page_label_id(F.col("path")))


def fitted_language_model(docs: DataFrame) -> language_id.Model:
    return language_id.fit(docs.where(~language_id.held_out(F.col("doc_id"))).select("text", "lang"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = language_id.predict(docs.select("doc_id", "text"), fitted_language_model(docs))
    return found.select("row.doc_id", language_id.held_out(F.col("row.doc_id")).alias("held_out"), "lang_pred", "score",
                        "rejected")


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(_table(spark, sf_dir, "documents"), words=4, bits=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_count.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return imatch.fingerprint_edits(docs, imatch.band_lexicon(docs), _partitions(spark))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    found = decontaminate.contamination(docs.select("doc_id", "text"), benchmark, window=10)
    return found.select("row.doc_id", "n_words", "n_hit", "n_items", "items_sha256",
                        (F.col("n_hit") > 0).alias("contaminated"))


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"), _partitions(spark))


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lm_score.lm_scores(_table(spark, sf_dir, "documents"), 2 * _partitions(spark))
    return found.select("doc_id", "n_words", "n_backoff", F.round("score", 6).alias("score"))


def op9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"), MIX_WEIGHTS).select(
        "doc_id", "size", "source_size", "target", "taken")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(_table(spark, sf_dir, "documents")).drop("spans")


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode_and_decode(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                                 _partitions(spark))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"), min_count=100, top=2000)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(_table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_url_filter, op2_language_id, op3_simhash_near_dedup, op4_token_counts, op5_imatch,
                            op6_decontaminate, op7_html_extract, op8_lm_score, op9_mix, op10_license_scan, op11_bpe,
                            op12_collocations, op13_prefix_trie)}
