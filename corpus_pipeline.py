"""Cleaning a corpus in five stages, each one operator of ``issq.llm``.

toxicity -> exact dedup -> near duplicates -> decontamination -> packing. Every
stage but the last returns the columns of documents; a stage sees all that the
one before kept. SQL cannot express the first, third and fourth stage, so there
is no ORACLE_SQL; tests compare each stage with a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from issq.llm import op01_decontamination, op02_jaccard_join, op03_exact_dedup, op05_toxicity, op10_packing
from issq.llm.common import Scratch, documents, free_name
from issq.llm.registry import tokenizer_path

ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go. Null and empty texts have no toxic word and
    stay; repeated rows share their fate. The model is fitted on labelled rows of
    this stage's documents; without any labelled row only the fixed insult words
    count."""
    model = op05_toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return op05_toxicity.without_toxic(docs, model)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for white space, the longest row stays, of equally
    long ones the smallest id (null last), of rows with equal ids just one. Null,
    empty and blank texts are equal, so one of them stays."""
    kept = free_name(docs.columns, "kept")
    return op03_exact_dedup.exact_dedup(docs, carry=docs.columns).where(F.col(kept)).select(*[f"`{c}`" for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by shingle similarity 0.75, the smallest id stays.
    Texts without words link with nothing and stay, as do rows with a null id;
    repeated rows with the smallest id all stay (the stage before leaves one)."""
    return op02_jaccard_join.one_per_group(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, each row by its own text,
    whatever its id. Null and empty texts hold none and stay."""
    return op01_decontamination.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rest, tokenised and packed; one row a piece. A null or empty text is
    its end token; repeated rows are packed each; an empty table has no piece."""
    return op10_packing.pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("jaccard_join", drop_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written to the shared
    folder before the next reads them."""
    scratch, docs = Scratch(spark, "pipeline"), documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch.table(docs, name)
    return docs
