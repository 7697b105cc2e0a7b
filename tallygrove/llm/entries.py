"""Queries of this subpackage and their SQL, for the driver's entry module."""

from __future__ import annotations

import importlib

import corpus_pipeline

MODULES = (
    "minhash_dedup", "secrets", "pii", "quality_rules", "poisson_mix",
    "suffix_tree_lm", "exact_dedup", "token_store", "bpe_prefix", "snapshots",
)


def _all(name: str) -> dict:
    found: dict = {}
    for module in MODULES:
        found |= getattr(importlib.import_module(f"tallygrove.llm.{module}"), name)
    return found


def queries() -> dict:
    return _all("QUERIES") | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict:
    sql = corpus_pipeline.ORACLE_SQL
    return _all("ORACLES") | ({"pipeline": sql} if sql else {})
