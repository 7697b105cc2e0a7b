"""Exact deduplication by skew-safe combining.

Digests of all rows are counted first; a text whose digest no other row has is
the only one of its kind. Rows of the other digests are written with their
normalised texts and combined in three stages, each on the digest *and* the
whole text, so that a collision never merges two different texts:

1. locally: the salt is the index of the map task, so the partial aggregation
   leaves one row for each text in a task, however many copies it read;
2. salted: rows of equal (digest, text, salt) are merged; a text held by a third
   of all rows is spread over ``salts`` reducers;
3. globally: the salt winners, at most ``salts`` for each text, are combined.

Those rows then look up their group by digest and whole text. The hot keys of
that lookup are split by AQE, as the group side has one row for each text.

Defined results: a null text counts as empty; a null id never wins over an id
(a group with null ids only keeps null, all its rows count as kept); rows that
repeat an id with an equal text are one document: the report has a row for
each, ``deduplicate`` leaves one of them. An empty table gives no rows. Texts of
any length are compared whole; further columns pass through ``deduplicate``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallygrove.session import BROADCAST_ROWS, delete, materialize, scratch, small_side

#: Runs of these six characters become one space.
BLANKS = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, " ")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    body = docs.select(F.col(f"`{id_col}`").alias("_id"), normalised(F.col(f"`{text_col}`")).alias("_body"))
    return body.withColumn("_digest", F.unhex(F.sha2("_body", 256)))


def text_groups(keyed: DataFrame, salts: int = 256) -> DataFrame:
    """One row for each distinct text of (_id, _body, _digest): _digest, _body, keep_id, group_size."""
    local = keyed.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    salted = local.groupBy("_digest", "_body", "_salt").agg(F.min("_id").alias("_least"), F.count("*").alias("_n"))
    return salted.groupBy("_digest", "_body").agg(F.min("_least").alias("keep_id"), F.sum("_n").alias("group_size"))


def duplicate_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 256) -> DataFrame:
    """One row for each document, dropped ones too: id, keep_id, group_size, kept, text_sha256."""
    digests = materialize(_keyed(docs, id_col, text_col).select("_id", "_digest"), "exact-digests")
    many = digests.groupBy("_digest").agg(F.count("*").alias("_n")).where("_n > 1").select("_digest")
    many = small_side(many)
    rows = materialize(_keyed(docs, id_col, text_col).join(many, "_digest", "left_semi"), "exact-rows")
    # Written, so that the lookup has an exchange on either side and AQE may split a hot text.
    groups = materialize(text_groups(rows, salts), "exact-groups")
    met = rows.join(groups, ["_digest", "_body"]).drop("_body")
    alone = digests.join(many, "_digest", "left_anti").withColumns({"keep_id": F.col("_id"), "group_size": F.lit(1).cast("long")})
    return met.unionByName(alone).select(
        F.col("_id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("_digest")).alias("text_sha256"),
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 256) -> DataFrame:
    """The rows of docs that stay, with all their columns.

    Only ids and digests of dropped rows, and of rows that repeat an id with an
    equal text, are joined with docs; they are broadcast if counted to be few.
    """
    held: list[str] = []
    with scratch(held):
        report = duplicate_report(docs, id_col, text_col, salts)
    slim = report.select(F.col(id_col).alias("_i"), F.unhex("text_sha256").alias("_d"), "kept")
    per = slim.groupBy("_i", "_d").agg(F.max("kept").alias("_kept"), F.count("*").alias("_n"))
    odd = materialize(per.where("not _kept or _n > 1"), "exact-odd")
    for path in held:
        delete(docs.sparkSession, path)
    gone, repeated = odd.where("not _kept").select("_i", "_d"), odd.where("_kept").select("_i", "_d")
    n_gone, n_repeated = gone.count(), repeated.count()
    left = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
        F.col(f"`{id_col}`").alias("_id"),
        F.unhex(F.sha2(normalised(F.col(f"`{text_col}`")), 256)).alias("_digest"),
    )
    same = F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_digest") == F.col("_d"))
    if n_gone:
        left = left.join(F.broadcast(gone) if n_gone <= BROADCAST_ROWS else gone, same, "left_anti")
    if n_repeated:
        side = F.broadcast(repeated) if n_repeated <= BROADCAST_ROWS else repeated
        once = left.join(side, same, "left_semi").dropDuplicates(["_id", "_digest"])
        left = left.join(side, same, "left_anti").unionByName(once)
    return left.select("_row.*")


def op7_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return duplicate_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY body) AS keep_id,
       count(*) OVER (PARTITION BY body) AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER (PARTITION BY body) AS kept,
       sha256(body) AS text_sha256
FROM n
"""

QUERIES = {"op7_exact_dedup": op7_exact_dedup}
ORACLES = {"op7_exact_dedup": ORACLE}
