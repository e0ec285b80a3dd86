"""Queries of this package and, where SQL can say it, the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillgraph.llm import bpe, html_text, langid, media, mixing, near_dedup, paragraphs, quality, suffix_dedup, topk


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(spark, _documents(spark, sf_dir), n_words=4)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(spark, _documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op3_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.find_repeats(spark, _documents(spark, sf_dir))


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_documents(spark, sf_dir))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(spark, _documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_table(spark, _documents(spark, sf_dir)).drop("digest", "shard", "at", "length")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_documents(spark, sf_dir).select("doc_id", "text"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_passages(spark, _documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_near_dedup, op2_quality, op3_paragraph_dedup, op4_exact_topk, op5_language_id, op6_mixing, op7_media, op8_bpe, op9_html_text, op10_suffix_dedup)}
SQL = {"op1_near_dedup": near_dedup.SQL, "op10_suffix_dedup": suffix_dedup.SQL, "op4_exact_topk": topk.SQL, "op6_mixing": mixing.SQL}
