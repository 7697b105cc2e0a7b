"""The corpus pipeline: quality rules, exact dedup, near-dedup, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last
return the columns of documents; the last returns doc_id, n_tokens and ids
(little-endian unsigned 32-bit integers) for every copy that mixing made. Nulls,
repeated rows and empty tables have the results that the operators define.

Stages may be called one on the other's result without writing it, and several
pipelines at a time: what a stage leaves in the shared folder is a table of the
ids it rejects, or of rates; run() deletes those of a stage once its result is
written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from tallygrove.llm import bpe_prefix, exact_dedup, minhash_dedup, poisson_mix, quality_rules
from tallygrove.session import delete, materialize, release, scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.keep_good(docs).select(COLUMNS)


def exact(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    return exact_dedup.deduplicate(docs).select(COLUMNS)


def near(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return minhash_dedup.drop_near_duplicates(docs).select(COLUMNS)


def mixing(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to tempered source weights and shuffled."""
    return poisson_mix.mix(docs).select(COLUMNS)


def encoding(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document."""
    return bpe_prefix.encode(docs, bpe_prefix.vocabulary())


STAGES = [
    ("quality rules", quality),
    ("exact dedup", exact),
    ("minhash near-dedup", near),
    ("poisson mixing", mixing),
    ("bpe encoding", encoding),
]

#: Near-duplicate components and BPE ids aren't expressible in SQL; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        if i == len(STAGES) - 1:
            return stage(spark, docs, sf_dir)
        held: list[str] = []
        with scratch(held):
            out = stage(spark, docs, sf_dir)
        before, docs = docs, materialize(out, "pipeline")
        for path in held:
            delete(spark, path)
        release(before)
