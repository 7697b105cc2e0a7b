"""Summaries, gates and alignments of labelled rows, each for any DataFrame.

Null keys never join; a group without rows has no result row; empty input gives
no rows, or one row of zeros and nulls where there is no group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallygrove.operators.temporal import running_total


def _flag(cond: Column) -> Column:
    return F.when(cond, 1.0).otherwise(0.0)


def weekly_summary(rows: DataFrame, ts: str, aggregates: dict[str, Column]) -> DataFrame:
    """(iso_year, iso_week, aggregates)."""
    year, week = F.extract(F.lit("YEAROFWEEK"), F.col(ts)), F.extract(F.lit("WEEK"), F.col(ts))
    return rows.groupBy(year.alias("iso_year"), week.alias("iso_week")).agg(*[c.alias(n) for n, c in aggregates.items()])


def field_accuracy(gold: DataFrame, said: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """One row: n, the accuracy of each field and of all at once, and ids that either side lacks. What isn't said counts as wrong."""
    g = gold.select(F.col(key).alias("_k"), *[F.col(f).alias(f"_g_{f}") for f in fields])
    s = said.select(F.col(key).alias("_j"), *[F.col(f).alias(f"_s_{f}") for f in fields])
    met = g.join(s, F.col("_k") == F.col("_j"), "full_outer")
    right = {f: F.col(f"_g_{f}") == F.col(f"_s_{f}") for f in fields}
    every = None
    for cond in right.values():
        every = cond if every is None else every & cond
    return met.agg(
        F.count("*").alias("n"), *[F.avg(_flag(c)).alias(f"{f}_accuracy") for f, c in right.items()], F.avg(_flag(every)).alias("exact_match"),
        F.count_if(F.col("_j").isNull()).alias("missing_prediction"), F.count_if(F.col("_k").isNull()).alias("extra_prediction"),
    )


def risk_coverage(rows: DataFrame, confidence: str, correct: Column, total: int) -> DataFrame:
    """(threshold, answered, coverage, accuracy, risk) at each confidence in [0, 1]; rows are counted by confidence first."""
    g = rows.groupBy(confidence).agg(F.count("*").alias("n"), F.sum(correct.cast("long")).alias("k")).withColumn("_down", -F.col(confidence))
    c = running_total(g, ["_down"], F.floor(F.col("_down") * 1000), {"answered": F.col("n"), "good": F.col("k")})
    share = F.col("good") / F.col("answered")
    return c.select(F.col(confidence).alias("threshold"), "answered", (F.col("answered") / F.lit(total)).alias("coverage"), share.alias("accuracy"), (1 - share).alias("risk"))


def confidence_bins(rows: DataFrame, confidence: str, correct: str, bins: int = 10) -> DataFrame:
    """(bin, n, accuracy, confidence) of equal bins of [0, 1]."""
    place = F.least(F.floor(F.col(confidence) * bins), F.lit(bins - 1))
    return rows.groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.avg(correct).alias("accuracy"), F.avg(confidence).alias("confidence"))


def macro_of_groups(rows: DataFrame, outer: str, inner: str, value: str, least: int) -> DataFrame:
    """Mean over inner groups of their means, of all and of those with ``least`` rows."""
    g = rows.groupBy(outer, inner).agg(F.count("*").alias("_n"), F.avg(value).alias("_a"))
    large = F.when(F.col("_n") >= least, F.col("_a"))
    return g.groupBy(outer).agg(F.count("*").alias("groups"), F.sum("_n").alias("n"), F.avg("_a").alias("macro"), F.avg(large).alias("macro_min_rows"))


def class_imbalance(rows: DataFrame, label: str) -> DataFrame:
    c = rows.groupBy(label).agg(F.count("*").alias("n"))
    return c.agg(
        F.count("*").alias("classes"), (F.max("n") / F.min("n")).alias("imbalance"), (F.max("n") / F.sum("n")).alias("top_share"),
        F.count_if(F.col("n") == 1).alias("singletons"),
    )


def top_values(rows: DataFrame, column: str, k: int) -> DataFrame:
    """(column, n, share) of the k most frequent values, ties by value: a report of k rows."""
    c = rows.groupBy(column).agg(F.count("*").alias("n"))
    return c.crossJoin(F.broadcast(c.agg(F.sum("n").alias("_t")))).select(column, "n", (F.col("n") / F.col("_t")).alias("share")).orderBy(F.desc("n"), column).limit(k)


def gold_alignment(gold: DataFrame, said: DataFrame, key: str, label: str, answer: str) -> DataFrame:
    """By label: gold rows, answered ones, and accuracy in which an unanswered row is wrong."""
    s = said.select(F.col(key).alias("_j"), F.col(answer).alias("_a"))
    met = gold.join(s, F.col(key) == F.col("_j"), "left")
    return met.groupBy(label).agg(F.count("*").alias("gold"), F.count("_j").alias("answered"), F.avg(_flag(F.col("_a") == F.col(label))).alias("accuracy"))


def relevant_sets(rows: DataFrame, group: str, item: str) -> DataFrame:
    """(item, head, n_relevant): each group's least item and how many others it has; the set itself isn't expanded."""
    g = rows.groupBy(group).agg(F.count("*").alias("_n"), F.min(item).alias("head"))
    return rows.join(g, group).select(item, "head", (F.col("_n") - 1).alias("n_relevant"))


def run_summary(stages: DataFrame, ticket: str, finished: Column) -> DataFrame:
    """(status, runs, mean_stages, most_stages): tickets are done, open or partial by their stages."""
    t = stages.groupBy(ticket).agg(F.count("*").alias("n"), F.count_if(finished).alias("f"))
    status = F.when(F.col("f") == F.col("n"), "done").when(F.col("f") == 0, "open").otherwise("partial")
    return t.groupBy(status.alias("status")).agg(F.count("*").alias("runs"), F.avg("n").alias("mean_stages"), F.max("n").alias("most_stages"))


def taxonomy(rows: DataFrame, kinds: dict[str, Column], other: str = "regular") -> DataFrame:
    """(kind, n): rows by the first kind whose condition holds."""
    kind = None
    for name, cond in kinds.items():
        kind = F.when(cond, name) if kind is None else kind.when(cond, name)
    return rows.groupBy((kind.otherwise(other) if kind is not None else F.lit(other)).alias("kind")).agg(F.count("*").alias("n"))


def distinct_counts(rows: DataFrame, fields: dict[str, Column]) -> DataFrame:
    return rows.agg(F.count("*").alias("rows_"), *[F.count_distinct(c).alias(n) for n, c in fields.items()])


def frequency_buckets(rows: DataFrame, key: str, head: int, middle: int) -> DataFrame:
    """(bucket, keys, rows): keys by how many rows they have."""
    c = rows.groupBy(key).agg(F.count("*").alias("n"))
    bucket = F.when(F.col("n") >= head, "head").when(F.col("n") >= middle, "middle").otherwise("tail")
    return c.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("keys"), F.sum("n").alias("rows"))


def equal_texts(left: DataFrame, right: DataFrame, left_text: Column, right_text: Column) -> DataFrame:
    """Rows of left with those of right whose text is equal, joined on digest and length, so that no text is moved."""
    keyed = lambda df, t, n: df.withColumns({f"_{n}d": F.sha2(t, 256), f"_{n}l": F.length(t)})
    met = keyed(left, left_text, "x").join(keyed(right, right_text, "y"), (F.col("_xd") == F.col("_yd")) & (F.col("_xl") == F.col("_yl")))
    return met.drop("_xd", "_xl", "_yd", "_yl")


def gates(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """One row of named conditions on aggregates."""
    return rows.agg(*[c.alias(n) for n, c in checks.items()])


def latest_weeks_gate(rows: DataFrame, key: str, ts: str, value: Column, limit: float, weeks: int) -> DataFrame:
    """(key, passes, weeks): whether the mean of each of a key's latest weeks is over the limit. A key has one row for each week before the ranking."""
    w = rows.groupBy(key, F.date_trunc("week", ts).alias("_wk")).agg(F.avg(value).alias("_v"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("_wk")))
    last = w.withColumn("_r", rank).where(F.col("_r") <= weeks)
    return last.groupBy(key).agg((F.min("_v") > limit).alias("passes"), F.count("*").alias("weeks"))


def paired_outcomes(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """(key, outcome): better, worse or same where both runs have a value; a missing one is the same."""
    a = after.select(F.col(key).alias("_k"), F.col(value).alias("_a"))
    met = before.join(a, F.col(key) == F.col("_k"), "left")
    return met.select(key, F.when(F.col("_a") > F.col(value), "better").when(F.col("_a") < F.col(value), "worse").otherwise("same").alias("outcome"))


def allowed_values(rows: DataFrame, field: str, by: str, least: int) -> DataFrame:
    """(by, value, n): the vocabulary of a field, values with ``least`` rows or more."""
    return rows.where(F.col(field).isNotNull()).groupBy(by, F.col(field).alias("value")).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def observable_fields(rows: DataFrame, text: str, fields: list[str]) -> DataFrame:
    """(field, n, observed): rows with a value, and those whose text holds it as a word, in any case."""
    low = F.lower(F.coalesce(text, F.lit("")))
    padded = F.concat(F.lit(" "), F.regexp_replace(low, "[^a-z0-9]+", " "), F.lit(" "))
    held = rows.withColumn("_p", padded)
    one = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.lower(F.col(f).cast("string")).alias("v")) for f in fields]))
    each = held.select("_p", one.alias("_f")).where("_f.v is not null")
    seen = F.instr(F.col("_p"), F.concat(F.lit(" "), F.col("_f.v"), F.lit(" "))) > 0
    return each.groupBy(F.col("_f.f").alias("field")).agg(F.count("*").alias("n"), F.count_if(seen).alias("observed"))
