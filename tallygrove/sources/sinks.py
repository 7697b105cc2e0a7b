"""Sinks: CSV with stable columns, JSON lines, features, stage results, append logs, an embedding cache, markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, first: list[str]) -> None:
    """CSV with the named columns first, then the keys of a map column ``fields`` in order, as far as rows have them."""
    rest = [c for c in df.columns if c not in first and c != "fields"]
    out = [F.col(c) for c in [*[c for c in first if c in df.columns], *rest]]
    if "fields" in df.columns:
        # Names of columns: as few as a table has.
        keys = [r[0] for r in df.select(F.explode(F.map_keys("fields")).alias("k")).distinct().orderBy("k").collect()]
        out += [F.element_at("fields", F.lit(k)).alias(k) for k in keys]
    df.select(*out).write.mode("overwrite").options(header=True, quote='"', escape='"').csv(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def write_stage(df: DataFrame, path: str, stage: str, key: str = "ticket_id") -> None:
    """Append results of a stage to one table (stage, ticket_id, payload)."""
    row = df.select(F.lit(stage).alias("stage"), F.col(key).cast("string").alias("ticket_id"), F.to_json(F.struct("*")).alias("payload"))
    row.write.mode("append").partitionBy("stage").parquet(path)


def append_events(df: DataFrame, path: str) -> None:
    df.withColumn("day", F.to_date("created_at")).write.mode("append").partitionBy("day").parquet(path)


def cache_embeddings(texts: DataFrame, cache: DataFrame, encode) -> tuple[DataFrame, DataFrame]:
    """(texts with vectors, rows to append to the cache). Keyed by content digest; encode maps (key, text) to (key, vector)."""
    keyed = texts.withColumn("key", F.sha2(F.coalesce("text", F.lit("")), 256))
    fresh = keyed.select("key", "text").dropDuplicates(["key"]).join(cache.select("key"), "key", "left_anti")
    new = encode(fresh)
    known = cache.select("key", "vector").unionByName(new.select("key", "vector"))
    return keyed.join(known, "key", "left"), new


def markdown(df: DataFrame, title: str, most: int = 200) -> str:
    """A report table of a small result; more rows than ``most`` are an error, not cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    head = f"| {' | '.join(df.columns)} |\n|{'---|' * len(df.columns)}\n"
    return f"## {title}\n\n{head}" + "".join(f"| {' | '.join('' if v is None else str(v) for v in r)} |\n" for r in rows)
