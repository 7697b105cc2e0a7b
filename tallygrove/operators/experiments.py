"""Bookkeeping of experiments: folds, caps, outcomes, audits and ablations, each for any DataFrame.

Null ids take no part in joins; empty input gives no rows unless a result is one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallygrove.operators.temporal import running_total


def fold_means(rows: DataFrame, keys: list[str], queries: str, metrics: list[str], seconds: str) -> DataFrame:
    """Means over folds by experiment, of those that have queries if any has; seconds are summed over all."""
    some = F.max(F.when(F.col(queries) > 0, 1).otherwise(0))
    of = lambda c: F.when(some == 1, F.avg(F.when(F.col(queries) > 0, F.col(c)))).otherwise(F.avg(c))
    return rows.groupBy(*keys).agg(F.round(of(queries)).cast("long").alias(queries), *[of(m).alias(m) for m in metrics], F.sum(seconds).alias(seconds))


def capped(priority: DataFrame, base: DataFrame, keys: list[str], most: int, seed: int) -> DataFrame:
    """At most ``most`` distinct rows: the priority ones first, by key, then base rows in the order of a seeded hash."""
    first = priority.select(*keys).distinct()
    rest = base.select(*keys).distinct().join(first, keys, "left_anti")
    taken = first.orderBy(*keys).limit(most)
    left = most - min(most, first.count())
    drawn = rest.orderBy(F.sha2(F.concat_ws("|", F.lit(seed), *keys), 256), *keys).limit(left)
    return taken.withColumn("is_priority", F.lit(True)).unionByName(drawn.withColumn("is_priority", F.lit(False)))


def non_duplicates(tickets: DataFrame, ticket: str, links: DataFrame, resolution: Column, allowed: list[str]) -> DataFrame:
    """Tickets on neither side of a link whose resolution is one of the allowed; links has a and b."""
    linked = links.select(F.explode(F.array("a", "b")).alias("_l")).distinct()
    known = tickets.where(F.lower(F.trim(F.coalesce(resolution, F.lit("")))).isin(*allowed))
    return known.join(linked, F.col(ticket) == F.col("_l"), "left_anti")


def stage_outcome(ranked: DataFrame, gold: DataFrame, query: str, item: str, rank: str, k: int) -> DataFrame:
    """(query, n_gold, found, hit, recall, outcome): whether all, some or none of the gold items are among the first k."""
    top = ranked.where(F.col(rank) <= k).select(query, item).distinct().withColumn("_f", F.lit(1))
    met = gold.select(query, item).distinct().join(top, [query, item], "left")
    return outcomes(met.groupBy(query).agg(F.count("*").alias("n_gold"), F.count("_f").alias("found")))


def outcomes(g: DataFrame) -> DataFrame:
    """The columns of stage_outcome() from counts n_gold and found."""
    outcome = F.when(F.col("found") == 0, "miss").when(F.col("found") < F.col("n_gold"), "partial").otherwise("full")
    return g.withColumns({"hit": (F.col("found") > 0).cast("int"), "recall": F.col("found") / F.col("n_gold"), "outcome": outcome})


def set_overlap(predicted: DataFrame, reference: DataFrame, key: str, item: str) -> DataFrame:
    """By key of the reference: sizes of both sets of items, of what they share, and whether they are equal."""
    p = predicted.select(key, item).distinct().withColumn("_p", F.lit(1))
    r = reference.select(key, item).distinct().withColumn("_r", F.lit(1))
    g = p.join(r, [key, item], "full_outer").groupBy(key).agg(
        F.count("_p").alias("n_predicted"), F.count("_r").alias("n_reference"), F.count(F.when(F.col("_p") == F.col("_r"), 1)).alias("n_common")
    )
    same = (F.col("n_common") == F.col("n_reference")) & (F.col("n_common") == F.col("n_predicted"))
    return g.where("n_reference > 0").withColumn("exact", same)


def gold_in_snapshot(gold: DataFrame, snapshot: DataFrame, key: str, item: str) -> DataFrame:
    """By key: gold items, those the base snapshot holds, and whether any and all can be reached."""
    held = snapshot.select(F.col(item).alias("_i")).distinct()
    met = gold.select(key, item).distinct().join(held, F.col(item) == F.col("_i"), "left")
    g = met.groupBy(key).agg(F.count("*").alias("n_gold"), F.count("_i").alias("n_present"))
    return g.withColumns({"any_present": F.col("n_present") > 0, "all_present": F.col("n_present") == F.col("n_gold")})


def change_audit(rows: DataFrame, created: str, changed: str, test_start: Column, test_end: Column) -> DataFrame:
    """By split: rows, rows whose last change is after the test's start or end, and training rows that are safe to learn from."""
    split = F.when(F.col(created) < test_start, "train").when(F.col(created) < test_end, "test")
    late = F.col(changed) > test_start
    return rows.withColumn("split", split).where("split is not null").groupBy("split").agg(
        F.count("*").alias("n"), F.count_if(late).alias("changed_after_start"), F.count_if(F.col(changed) > test_end).alias("changed_after_end"),
        F.count_if((F.col("split") == "train") & (F.col(changed) <= test_start)).alias("eligible_history"),
    )


def evidence_ablation(expected: DataFrame, rank: str, sources: str, cutoffs: list[int]) -> DataFrame:
    """(cutoff, source, hits, retained, supported, unique): what is left of the hits within a cutoff without a source of evidence; sources is an array."""
    total = [F.count_if(F.col(rank) <= c).alias(f"_h{c}") for c in cutoffs]
    one = expected.select(rank, F.explode(F.array_distinct(sources)).alias("source"), F.size(F.array_distinct(sources)).alias("_n"))
    per = one.groupBy("source").agg(
        *[F.count_if(F.col(rank) <= c).alias(f"_s{c}") for c in cutoffs], *[F.count_if((F.col(rank) <= c) & (F.col("_n") == 1)).alias(f"_u{c}") for c in cutoffs]
    )
    met = per.crossJoin(F.broadcast(expected.agg(*total)))
    cell = lambda c: F.struct(F.lit(c).alias("cutoff"), F.col(f"_h{c}").alias("hits"), F.col(f"_s{c}").alias("supported"), F.col(f"_u{c}").alias("unique"))
    each = met.select("source", F.explode(F.array(*[cell(c) for c in cutoffs])).alias("x")).select("source", "x.*")
    return each.withColumn("retained", F.col("hits") - F.col("unique"))


def holdout_registry(runs: DataFrame, run: str, content: Column, at: list[str]) -> DataFrame:
    """(run, content, sealed, n_runs): the first run on each content is the one that counts."""
    named = runs.select(run, content.alias("content"), F.struct(*at, run).alias("_at"))
    first = named.groupBy("content").agg(F.min("_at").alias("_first"), F.count("*").alias("n_runs"))
    return named.join(first, "content").select(run, "content", (F.col("_at") == F.col("_first")).alias("sealed"), "n_runs")


def review_queue(rows: DataFrame, confidence: str, correct: Column) -> DataFrame:
    """rows with a confidence label and a review priority: unsure and wrong ones come first."""
    label = F.when(F.col(confidence) >= 0.8, "high").when(F.col(confidence) >= 0.5, "medium").otherwise("low")
    place = F.when(~correct & (F.col(confidence) >= 0.8), "P1").when(~correct, "P2").when(F.col(confidence) < 0.5, "P3").otherwise("P4")
    return rows.withColumns({"confidence_label": label, "review_priority": place})


def demo_cases(rows: DataFrame, group: str, item: str, miss: Column, confidence: str, k: int) -> DataFrame:
    """The k cases of each group to show, misses first, the most confident first: a report of k rows a group."""
    from pyspark.sql import Window

    order = Window.partitionBy(group).orderBy(miss.desc(), F.desc(confidence), item)
    return rows.withColumns({"is_miss": miss, "place": F.row_number().over(order)}).where(F.col("place") <= k)


def auprc(rows: DataFrame, score: str, positive: Column) -> DataFrame:
    """One row: positives, total and average precision, ties of a score counted together."""
    g = rows.groupBy(score).agg(F.sum(positive.cast("long")).alias("p"), F.count("*").alias("n")).withColumn("_down", -F.col(score))
    c = running_total(g, ["_down"], F.floor(F.col("_down") * 1000), {"tp": F.col("p"), "seen": F.col("n")})
    area = F.sum(F.col("p") * F.col("tp") / F.col("seen")) / F.sum("p")
    return c.agg(F.sum("p").alias("positives"), F.sum("n").alias("total"), area.alias("auprc"))


def quantile_grid(rows: DataFrame, value: str, steps: int = 100) -> DataFrame:
    """(step, value): linear quantiles at steps + 1 points, from the counts of distinct values placed by running totals."""
    g = rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n"))
    c = running_total(g, [value], F.floor(F.col(value)), {"upto": F.col("n")}).select(F.col(value).alias("v"), "upto", (F.col("upto") - F.col("n")).alias("before"))
    total = g.agg(F.sum("n").alias("t"))
    at = F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("step")
    points = total.where("t > 0").select("t", at).withColumn("h", F.col("step") * (F.col("t") - 1) / steps)
    points = points.withColumns({"lo": F.floor("h"), "hi": F.ceil("h")})
    # A hundred points against the distinct values, each of which takes those in its own range.
    low = c.join(F.broadcast(points), (F.col("lo") >= F.col("before")) & (F.col("lo") < F.col("upto"))).select("step", F.col("v").alias("_low"), (F.col("h") - F.col("lo")).alias("_w"))
    high = c.join(F.broadcast(points), (F.col("hi") >= F.col("before")) & (F.col("hi") < F.col("upto"))).select("step", F.col("v").alias("_high"))
    return low.join(high, "step").select("step", (F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("_w")).alias("value"))
