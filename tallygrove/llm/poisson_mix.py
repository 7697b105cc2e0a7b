"""Mixing of sources to target weights by Poisson replication.

Each source has a mean repetition rate ``total * weight / rows of the source``.
A document's count is the inverse of the Poisson distribution with that rate at
a uniform number hashed from (seed, id); it is exploded into that many copies
and the copies are shuffled globally by a hash of (seed, id, copy).

The same seed gives the same counts whatever the partitioning, so a recomputed
task repeats them. A null source is a source of its own, a null id hashes as
the empty string, repeated rows draw alike. Weights of absent sources are left
out, sources without a weight have weight 0; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallygrove.session import materialize

#: Hex digits of the digest that make the uniform number: 52 bits, exact in a double.
DIGITS = 13
#: Sources up to which the rates are broadcast: some hundred bytes each, and 8 * (24 * sqrt(rate) + 40) at high rates.
BROADCAST_SOURCES = 20_000


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) hashed from the parts."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, DIGITS), 16, 10).cast("bigint") / F.lit(float(16**DIGITS))


def _first(rate: Column) -> Column:
    """The least count looked at: P(X < _first) is under exp(-72)."""
    return F.greatest(F.floor(rate - 12 * F.sqrt(rate) - 20), F.lit(0)).cast("int")


def _distribution(rate: Column) -> Column:
    """P(X <= k) for k = _first, _first + 1, .. until it can't be told from 1 at 52 bits.

    Terms are relative to the first one and divided by their sum, which stays
    under 1e100 at any rate, where exp(-rate) would become 0.
    """
    last = F.ceil(rate + 12 * F.sqrt(rate) + 20).cast("int")
    return F.aggregate(
        F.sequence(_first(rate) + 1, last),
        F.struct(F.lit(1.0).alias("p"), F.array(F.lit(1.0)).alias("c")),
        lambda s, k: F.struct(
            (s["p"] * rate / k).alias("p"),
            F.concat(s["c"], F.array(F.element_at(s["c"], -1) + s["p"] * rate / k)).alias("c"),
        ),
        lambda s: F.transform(s["c"], lambda c: c / F.element_at(s["c"], -1)),
    )


def source_rates(
    docs: DataFrame,
    weights: dict | None = None,
    source_col: str = "source",
    tempering: float = 0.5,
    epochs: float = 1.0,
) -> DataFrame:
    """(_source, n_docs, rate): weights given, or each source's rows to the power of ``tempering``."""
    counts = docs.groupBy(F.col(source_col).alias("_source")).agg(F.count("*").alias("n_docs"))
    if weights is None:
        weighed = counts.withColumn("_w", F.pow(F.col("n_docs").cast("double"), F.lit(tempering)))
    else:
        if any(w < 0 or math.isinf(w) or math.isnan(w) for w in weights.values()):
            raise ValueError("weights must be finite and not negative")
        chosen = F.lit(0.0)
        for name, w in weights.items():
            chosen = F.when(F.col("_source").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(chosen)
        weighed = counts.withColumn("_w", chosen)
    total = weighed.agg(F.sum("_w").alias("_all_w"), F.sum("n_docs").alias("_all_n"))
    return weighed.crossJoin(F.broadcast(total)).select(
        "_source",
        "n_docs",
        F.when(
            F.col("_all_w") > 0, F.lit(epochs) * F.col("_all_n") * F.col("_w") / F.col("_all_w") / F.col("n_docs")
        ).otherwise(0.0).alias("rate"),
    )


def mix(
    docs: DataFrame,
    weights: dict | None = None,
    id_col: str = "doc_id",
    source_col: str = "source",
    seed: int = 17,
    tempering: float = 0.5,
    epochs: float = 1.0,
    shuffle: bool = True,
) -> DataFrame:
    """Rows of docs repeated to the target weights: all columns, then _copy from 1 and _order, the shuffle key, which replace columns of these names.

    Rates have one row for each source; they are broadcast if counted to be at
    most BROADCAST_SOURCES, and else joined by source with hot sources split by
    AQE. The global shuffle is a range partitioning by a uniform hash,
    which no source can skew.
    """
    rates = materialize(source_rates(docs, weights, source_col, tempering, epochs), "mix-rates")
    few = rates.count() <= BROADCAST_SOURCES
    rates = rates.select("_source", _first(F.col("rate")).alias("_least"), _distribution(F.col("rate")).alias("_cdf"))
    rates = F.broadcast(rates) if few else rates
    own = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("_copy", "_order")]
    packed = docs.select(F.struct(*own).alias("_row"), F.col(f"`{id_col}`").alias("_id"), F.col(f"`{source_col}`").alias("_s"))
    joined = packed.join(rates, F.col("_s").eqNullSafe(F.col("_source")))
    u = uniform(F.lit(seed), F.col("_id"))
    counted = joined.withColumn("_n", F.col("_least") + F.size(F.filter("_cdf", lambda c: c <= u)))
    copies = counted.where("_n > 0").select("_row", "_id", F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("_copy"))
    out = copies.select("_row", "_copy", F.xxhash64(F.lit(seed), F.col("_id"), F.col("_copy")).alias("_order"))
    if shuffle:
        parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        out = out.repartitionByRange(parts, "_order").sortWithinPartitions("_order")
    return out.select("_row.*", "_copy", "_order")


def op5_poisson_mix(spark, sf_dir: str) -> DataFrame:
    mixed = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return mixed.select("doc_id", "source", F.col("_copy").alias("copy"), "lang", "n_chars", "text")


ORACLE = """
WITH s AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
w AS (SELECT source, n, sqrt(n::DOUBLE) AS w FROM s),
r AS (SELECT source, (SELECT sum(n) FROM w) * w / (SELECT sum(w) FROM w) / n AS rate FROM w),
p AS (
  SELECT source, k, exp(-rate + k * ln(rate) - lgamma(k + 1)) AS p
  FROM r, range(0, 400) t(k) WHERE k <= ceil(rate + 12 * sqrt(rate) + 20)
),
c AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM p),
u AS (
  SELECT *, ('0x' || substr(md5('17|' || doc_id), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM documents
),
n AS (SELECT u.doc_id, count(*) AS n FROM u JOIN c ON u.source = c.source AND c.c <= u.u GROUP BY u.doc_id)
SELECT d.doc_id, d.source, t.copy::INT AS copy, d.lang, d.n_chars, d.text
FROM documents d JOIN n USING (doc_id), range(1, 400) t(copy) WHERE t.copy <= n.n
"""

QUERIES = {"op5_poisson_mix": op5_poisson_mix}
ORACLES = {"op5_poisson_mix": ORACLE}
