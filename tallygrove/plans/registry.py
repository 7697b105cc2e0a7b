"""All registered queries with their SQL twins. Both sides give the columns of ``schemas`` with the same types."""

from __future__ import annotations

import importlib
import re

from pyspark.sql import functions as F

from tallygrove.plans.schemas import SCHEMAS

FAMILIES = ("temporal", "metrics", "text", "routing", "structure", "records", "scalars", "evaluation", "experiments", "files")
#: Decimal places that both engines keep of a double, as sums come in another order.
PLACES = 6
_SQL_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN", "string": "VARCHAR", "timestamp_ntz": "TIMESTAMP"}


def _modules():
    return [importlib.import_module(f"tallygrove.plans.{name}") for name in FAMILIES]


def _columns(name: str) -> list[tuple[str, str]]:
    return [tuple(c.split(" ", 1)) for c in re.split(r", (?=\w+ )", SCHEMAS[name])]


def _typed(name: str, query):
    def run(spark, sf_dir):
        df = query(spark, sf_dir)
        cell = lambda c, t: F.round(F.col(c).cast(t), PLACES) if t == "double" else F.col(c).cast(t)
        return df.select(*[cell(c, t).alias(c) for c, t in _columns(name)])

    return run


def _typed_sql(name: str, sql: str) -> str:
    def cell(c, t):
        if t == "double":
            return f'round(CAST("{c}" AS DOUBLE), {PLACES}) AS "{c}"'
        return f'CAST("{c}" AS {_SQL_TYPES[t]}) AS "{c}"' if t in _SQL_TYPES else f'"{c}"'

    return f"SELECT {', '.join(cell(c, t) for c, t in _columns(name))} FROM ({sql}) AS result"


def raw_queries() -> dict:
    return {k: f for m in _modules() for k, f in m.QUERIES.items()}


def queries() -> dict:
    return {k: _typed(k, f) for k, f in raw_queries().items()}


def oracle_sql() -> dict:
    return {k: _typed_sql(k, s) for m in _modules() for k, s in m.ORACLES.items()}


def flagship(spark, sf_dir):
    return queries()["activity_features"](spark, sf_dir)
