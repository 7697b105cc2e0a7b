"""Evaluation metrics as aggregations over prediction tables.

Ratios with denominator 0 are 0. Curves group equal scores first, and running
sums go by score cells, so no window holds all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallygrove.operators.temporal import running_total

#: 97.5 % point of the normal distribution.
Z = 1.959963984540054


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def wilson(k: Column, n: Column) -> tuple[Column, Column]:
    """Interval for k successes of n; [0, 1] without trials."""
    p = k / n
    mid = p + Z * Z / (2 * n)
    half = Z * F.sqrt(p * (1 - p) / n + Z * Z / (4 * n * n))
    low, high = ((mid - half) / (1 + Z * Z / n)), ((mid + half) / (1 + Z * Z / n))
    return F.when(n > 0, F.greatest(low, F.lit(0.0))).otherwise(0.0), F.when(n > 0, F.least(high, F.lit(1.0))).otherwise(1.0)


def per_label(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """(label, tp, fp, fn, precision, recall, f1) for every label seen on either side."""
    hit = (F.col(actual) == F.col(predicted)).cast("long")
    a = df.groupBy(F.col(actual).alias("label")).agg(F.count("*").alias("support"), F.sum(hit).alias("tp"))
    p = df.groupBy(F.col(predicted).alias("label")).agg(F.count("*").alias("said"))
    m = a.join(p, "label", "full_outer").na.fill(0, ["support", "tp", "said"])
    m = m.withColumns({"fp": F.col("said") - F.col("tp"), "fn": F.col("support") - F.col("tp")})
    m = m.withColumns({"precision": ratio(F.col("tp"), F.col("said")), "recall": ratio(F.col("tp"), F.col("support"))})
    return m.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).drop("said")


def macro(labels: DataFrame) -> DataFrame:
    n = F.sum("support")
    return labels.agg(
        F.avg("f1").alias("macro_f1"), ratio(F.sum(F.col("f1") * F.col("support")), n).alias("weighted_f1"),
        F.avg("recall").alias("macro_recall"), F.min("recall").alias("min_recall"), ratio(F.sum("tp"), n).alias("accuracy"),
    )


def confusion(df: DataFrame, actual: str, predicted: str, levels: list) -> DataFrame:
    return df.groupBy(actual).pivot(predicted, levels).count().na.fill(0)


def ranking(ranked: DataFrame, relevant: DataFrame, query: str, item: str, rank: str, ks: list[int]) -> DataFrame:
    """Per query: average precision over all relevant items, reciprocal rank, hit and recall at k, first relevant rank.

    Repeated items count once, at their best rank; queries without relevant items are left out.
    """
    total = relevant.select(query, item).distinct()
    n = total.groupBy(query).agg(F.count("*").alias("n_relevant"))
    return ranking_of_hits(n, ranked.join(total, [query, item]), query, item, rank, ks)


def ranking_of_hits(n: DataFrame, hits: DataFrame, query: str, item: str, rank: str, ks: list[int]) -> DataFrame:
    """ranking() from counts (query, n_relevant) and the ranked rows that are relevant, where listing all relevant pairs is too much."""
    best = hits.groupBy(query, item).agg(F.min(rank).alias("_r"))
    hits = best.withColumn("_seen", F.row_number().over(Window.partitionBy(query).orderBy("_r")))
    within = [F.sum((F.col("_r") <= k).cast("long")).alias(f"_k{k}") for k in ks]
    per = hits.groupBy(query).agg(F.sum(F.col("_seen") / F.col("_r")).alias("_ap"), F.min("_r").alias("first_rank"), *within)
    out = n.join(per, query, "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.select(
        query, "n_relevant", "first_rank", (zero(F.col("_ap")) / F.col("n_relevant")).alias("ap"),
        F.coalesce(1 / F.col("first_rank"), F.lit(0.0)).alias("rr"),
        *[(zero(F.col(f"_k{k}")) > 0).cast("int").alias(f"hit_{k}") for k in ks],
        *[(zero(F.col(f"_k{k}")) / F.col("n_relevant")).alias(f"recall_{k}") for k in ks],
    )


def threshold_curve(df: DataFrame, score: str, label: str, cell: float = 0.01) -> DataFrame:
    """One row for each distinct score as threshold: tp, fp and the scores derived, ties taken together. Scores in [0, 1]."""
    grouped = df.groupBy(score).agg(F.count("*").alias("_n"), F.sum(F.col(label).cast("long")).alias("_p"))
    down = _descending(grouped, score, cell)
    total = df.agg(F.sum(F.col(label).cast("long")).alias("positives"), F.count("*").alias("total"))
    m = down.crossJoin(F.broadcast(total))
    tp, fp = F.col("tp"), F.col("predicted") - F.col("tp")
    precision, recall = ratio(tp, F.col("predicted")), ratio(tp, F.col("positives"))
    return m.select(
        F.col(score).alias("threshold"), "tp", fp.alias("fp"), (F.col("positives") - tp).alias("fn"), precision.alias("precision"),
        recall.alias("recall"), ratio(2 * tp, F.col("predicted") + F.col("positives")).alias("f1"),
        ((F.col("total") - F.col("positives") - fp + tp) / F.col("total")).alias("accuracy"),
    )


def _descending(grouped: DataFrame, score: str, cell: float) -> DataFrame:
    turned = grouped.withColumn("_neg", -F.col(score))
    values = {"predicted": F.col("_n"), "tp": F.col("_p")}
    return running_total(turned, ["_neg"], F.floor(F.col("_neg") / cell), values).drop("_neg", "_n", "_p")


def best_threshold(curve: DataFrame) -> DataFrame:
    """The row with the greatest (f1, precision, recall, accuracy, threshold)."""
    key = F.struct("f1", "precision", "recall", "accuracy", "threshold")
    return curve.agg(F.max(F.struct(key.alias("k"), "tp", "fp", "fn")).alias("b")).select("b.k.*", "b.tp", "b.fp", "b.fn")


def auroc(df: DataFrame, score: str, label: str, cell: float = 0.01) -> DataFrame:
    """Area under ROC from average ranks, ties shared; null without both classes."""
    g = df.groupBy(score).agg(F.count("*").alias("_n"), F.sum(F.col(label).cast("long")).alias("_p"))
    r = running_total(g, [score], F.floor(F.col(score) / cell), {"_upto": F.col("_n")})
    s = r.agg(
        F.sum(F.col("_p") * (F.col("_upto") - (F.col("_n") - 1) / 2)).alias("rank_sum"), F.sum("_p").alias("positives"), F.sum("_n").alias("total")
    )
    p, n = F.col("positives"), F.col("total") - F.col("positives")
    return s.select("positives", "total", F.when((p > 0) & (n > 0), (F.col("rank_sum") - p * (p + 1) / 2) / (p * n)).alias("auroc"))


def calibration(df: DataFrame, p: str, label: str, bins: int = 10) -> DataFrame:
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    y = F.col(label).cast("double")
    return df.groupBy(b.alias("bin")).agg(
        F.count("*").alias("n"), F.avg(p).alias("confidence"), F.avg(y).alias("accuracy"), F.sum((F.col(p) - y) ** 2).alias("_sq")
    )


def calibration_summary(df: DataFrame, p: str, label: str, bins: int = 10) -> DataFrame:
    c = calibration(df, p, label, bins)
    gap = F.abs(F.col("accuracy") - F.col("confidence"))
    return c.agg(
        (F.sum(gap * F.col("n")) / F.sum("n")).alias("ece"), F.max(gap).alias("mce"), (F.sum("_sq") / F.sum("n")).alias("brier"), F.sum("n").alias("n")
    )


def psi(expected: DataFrame, actual: DataFrame, value: str, edges: DataFrame, smoothing: float = 0.5) -> DataFrame:
    """Population stability index; edges: one row with an ascending array ``edges``; a value is in the bin of the edges it reaches."""
    binned = lambda d, n: (
        d.crossJoin(F.broadcast(edges))
        .groupBy(F.size(F.filter("edges", lambda e: e <= F.col(value))).alias("bin"))
        .agg(F.count("*").alias(n))
    )
    bins = edges.select(F.explode(F.sequence(F.lit(0), F.size("edges"))).alias("bin"))
    m = bins.join(binned(expected, "e"), "bin", "left").join(binned(actual, "a"), "bin", "left").na.fill(0)
    m = m.crossJoin(F.broadcast(m.agg(F.sum("e").alias("te"), F.sum("a").alias("ta"), F.count("*").alias("k"))))
    pe = (F.col("e") + smoothing) / (F.col("te") + smoothing * F.col("k"))
    pa = (F.col("a") + smoothing) / (F.col("ta") + smoothing * F.col("k"))
    return m.agg(F.sum((pa - pe) * F.log(pa / pe)).alias("psi"), F.count("*").alias("bins"))


def entropy(df: DataFrame, keys: list[str], item: str) -> DataFrame:
    """Entropy and normalised entropy of item within keys."""
    c = df.groupBy(*keys, item).agg(F.count("*").alias("_n"))
    t = c.groupBy(*keys).agg(
        F.sum("_n").alias("n"), F.count("*").alias("distinct"), F.sum(F.col("_n") * F.log(F.col("_n"))).alias("_l")
    )
    h = F.log(F.col("n")) - F.col("_l") / F.col("n")
    return t.select(*keys, "n", "distinct", h.alias("entropy"), F.when(F.col("distinct") > 1, h / F.log("distinct")).otherwise(0.0).alias("normalised"))
