"""The ``opN_<name>`` queries: each operator over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from issq.llm.common import documents

TOKENIZER = "word_bpe_49k.json"
TOKEN_LIMIT = 2048


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from issq.llm.op01_decontamination import leaks

    return leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from issq.llm.op02_jaccard_join import near_duplicates

    return near_duplicates(documents(spark, sf_dir))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from issq.llm.op03_exact_dedup import exact_dedup

    return exact_dedup(documents(spark, sf_dir).select("doc_id", "text"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from issq.llm.op04_token_counts import token_counts

    counted = token_counts(documents(spark, sf_dir), tokenizer_path())
    total = F.coalesce(F.try_element_at("prefix_tokens", F.lit(-1)), F.lit(0)).cast("long")
    return counted.select("doc_id", "n_bytes", total.alias("n_tokens"), (total > TOKEN_LIMIT).alias("over_limit"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from issq.llm.op05_toxicity import fit, toxicity

    docs = documents(spark, sf_dir)
    return toxicity(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from issq.llm.op06_url_filter import url_filter

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return url_filter(pages).drop("url")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from issq.llm.op07_secret_scan import KINDS, secret_scan, written

    found = secret_scan(documents(spark, sf_dir))

    def count(k: int):
        return F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")

    counts = [count(k) for k in range(3)]
    return found.select("doc_id", *counts, F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.concat("base", "linked")).alias("spans"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from issq.llm.op08_lm_scoring import lm_scores

    return lm_scores(documents(spark, sf_dir))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from issq.llm.op09_quality import fit, quality

    docs = documents(spark, sf_dir)
    return quality(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from issq.llm.op10_packing import pack

    return pack(documents(spark, sf_dir), tokenizer_path())


def queries() -> dict:
    return {f.__name__: f for f in (op1_decontamination, op2_jaccard_join, op3_exact_dedup, op4_token_counts, op5_toxicity, op6_url_filter, op7_secret_scan, op8_lm_scoring, op9_quality, op10_packing)}


def oracle_sql() -> dict[str, str]:
    from issq.llm import oracles

    return oracles.oracle_sql()
