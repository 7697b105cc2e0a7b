"""Owner evidence, candidate pools, rerank blends and routing policy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallygrove.session import parts_for


def owner_counts(history: DataFrame) -> DataFrame:
    """Counts by owner for component, product, their pair and overall; all but the pairs' are sums of these. Rows are dealt to as many tasks as they need before they are counted."""
    keys = ["owner", "component", "product"]
    rows = history.select(*keys)
    n = parts_for(history.sparkSession, rows.count())
    pairs = rows.repartition(n, *keys).groupBy(*keys).agg(F.count("*").alias("n"))
    none = {c: F.lit(None).cast(rows.schema[c].dataType) for c in keys}
    level = lambda name, *kept: F.struct(F.lit(name).alias("level"), *[(F.col(c) if c in kept else none[c]).alias(c) for c in keys[1:]])
    sets = F.explode(F.array(level("component", "component"), level("product", "product"), level("global"))).alias("_g")
    rolled = pairs.select("owner", "n", sets).select("_g.level", "owner", "_g.component", "_g.product", "n")
    by = ["level", *keys]
    rolled = rolled.repartition(n, *by).groupBy(*by).agg(F.sum("n").alias("n"))
    return pairs.select(F.lit("pair").alias("level"), *keys, "n").unionByName(rolled)


def dominant_owner(history: DataFrame, keys: list[str], owner: str, least: int, share: float) -> DataFrame:
    """Most common owner per key with enough support and share; ties go to the least owner. No window: max of a struct."""
    c = history.groupBy(*keys, owner).agg(F.count("*").alias("n"))
    best = c.groupBy(*keys).agg(F.max(F.struct("n", (-F.col(owner)).alias("o"))).alias("b"), F.sum("n").alias("total"))
    out = best.select(*keys, (-F.col("b.o")).alias(owner), F.col("b.n").alias("support"), (F.col("b.n") / F.col("total")).alias("share"))
    return out.where((F.col("support") >= least) & (F.col("share") >= share))


def roster(history: DataFrame, owner: str, ts: str, as_of: Column, active: int = 90, dormant: int = 365) -> DataFrame:
    """Counts in look-back windows, last seen and status of each owner before as_of."""
    age = F.timestamp_diff("DAY", F.col(ts).cast("timestamp"), as_of.cast("timestamp"))
    g = history.where(F.col(ts) < as_of).groupBy(owner).agg(
        F.count("*").alias("n"), F.count_if(age < active).alias("n_active"), F.count_if(age < dormant).alias("n_dormant"), F.max(ts).alias("last_seen")
    )
    return g.withColumn("status", F.when(F.col("n_active") > 0, "active").when(F.col("n_dormant") > 0, "inactive").otherwise("dormant"))


def smoothed_share(count: Column, total: Column, prior: Column, mass: float = 5.0) -> Column:
    return (count + mass * prior) / (total + mass)


def quota_pool(candidates: DataFrame, query: str, item: str, source: str, score: str, quotas: dict[str, int], size: int) -> DataFrame:
    """Per source the best ``quota``, an item kept under its first source, then the best of the rest up to size."""
    order = F.array_position(F.array(*[F.lit(s) for s in quotas]), F.col(source))
    quota = F.element_at(F.create_map(*[x for s, q in quotas.items() for x in (F.lit(s), F.lit(q))]), F.col(source))
    by_source = Window.partitionBy(query, source).orderBy(F.desc(score), item)
    ranked = candidates.withColumns({"_r": F.row_number().over(by_source), "_o": order, "_q": quota})
    best = ranked.groupBy(query, item).agg(
        F.min(F.when(F.col("_r") <= F.col("_q"), F.struct("_o", "_r", source))).alias("_p"), F.max(score).alias(score)
    )
    place = Window.partitionBy(query).orderBy(F.col("_p").isNull(), F.desc(score), item)
    out = best.withColumn("place", F.row_number().over(place)).where(F.col("place") <= size)
    return out.select(query, item, score, F.coalesce(F.col(f"_p.{source}"), F.lit("backfill")).alias("from_source"), "place")


def min_max(score: str, query: str) -> Column:
    """Scores of a query scaled to [0, 1]; a constant row becomes 1."""
    w = Window.partitionBy(query)
    lo, hi = F.min(score).over(w), F.max(score).over(w)
    return F.when(hi > lo, (F.col(score) - lo) / (hi - lo)).otherwise(1.0)


def stable_blend(pool: DataFrame, query: str, item: str, model: str, lexical: str, metadata: str, weights=(0.54, 0.30, 0.08, 0.08), size: int = 50) -> DataFrame:
    """Weighted sum of min-max scaled scores, metadata and the agreement of both ranks within the pool."""
    rank = lambda c: F.row_number().over(Window.partitionBy(query).orderBy(F.desc(c), item))
    r = pool.withColumns({"_m": min_max(model, query), "_l": min_max(lexical, query), "_r1": rank(model), "_r2": rank(lexical)})
    agree = F.greatest(F.lit(0.0), 1 - F.abs(F.col("_r1") - F.col("_r2")) / size)
    a, b, c, d = weights
    return r.withColumn("blend", a * F.col("_m") + b * F.col("_l") + c * F.col(metadata) + d * agree).drop("_m", "_l", "_r1", "_r2")


def owner_confidence(best: Column, second: Column, signals: Column) -> Column:
    margin = F.when(best > 0, (best - F.coalesce(second, F.lit(0.0))) / best).otherwise(0.0)
    return F.least(F.lit(0.95), F.greatest(F.lit(0.35), 0.55 + 0.30 * margin + F.least(F.lit(0.20), 0.05 * signals)))


def route(confidence: Column, known: Column, sources: Column, high: float, low: float, least_sources: int = 2) -> Column:
    """Ordered ladder, first match wins."""
    return (
        F.when(~known, "manual_unknown").when(sources < least_sources, "manual_thin")
        .when(confidence >= high, "auto").when(confidence >= low, "confirm_top3").otherwise("manual")
    )


def piecewise(x: Column, knots: list[tuple[float, float]]) -> Column:
    """Piecewise-linear calibration, flat outside the knots."""
    out = F.lit(knots[-1][1])
    for (x0, y0), (x1, y1) in reversed(list(zip(knots, knots[1:]))):
        out = F.when(x < x1, y0 + (x - x0) * (y1 - y0) / (x1 - x0)).otherwise(out)
    return F.when(x <= knots[0][0], F.lit(knots[0][1])).otherwise(out)


def policy_grid(df: DataFrame, confidence: str, correct: str, steps: int = 61, least_accuracy: float = 0.6) -> DataFrame:
    """The threshold of a grid with the greatest coverage that holds the accuracy. One pass: each row is counted in its grid cell."""
    cell = F.least(F.floor(F.col(confidence) * (steps - 1)), F.lit(steps - 1)).cast("int")
    cells = df.groupBy(cell.alias("_c")).agg(F.count("*").alias("_n"), F.sum(F.col(correct).cast("long")).alias("_k"))
    w = Window.partitionBy(F.lit(1)).orderBy(F.desc("_c")).rowsBetween(Window.unboundedPreceding, 0)
    c = cells.select((F.col("_c") / (steps - 1)).alias("threshold"), F.sum("_n").over(w).alias("answered"), F.sum("_k").over(w).alias("good"))
    c = c.crossJoin(F.broadcast(cells.agg(F.sum("_n").alias("total"))))
    c = c.select("threshold", (F.col("answered") / F.col("total")).alias("coverage"), (F.col("good") / F.col("answered")).alias("accuracy"))
    return c.where(F.col("accuracy") >= least_accuracy).orderBy(F.desc("coverage"), "threshold").limit(1)


def hash_bucket(key: Column, buckets: int = 10_000) -> Column:
    return F.conv(F.substring(F.sha2(F.trim(key.cast("string")), 256), 1, 8), 16, 10).cast("bigint") % buckets


def hash_fold(key: Column, folds: int, seed: str = "fold") -> Column:
    return hash_bucket(F.concat_ws("|", F.lit(seed), key.cast("string")), folds).cast("int")


def stratified_take(df: DataFrame, stratum: str, id_col: str, quota: int, seed: str = "take") -> DataFrame:
    """``quota`` rows of each stratum in the order of a seeded hash."""
    h = F.sha2(F.concat_ws("|", F.lit(seed), F.col(id_col).cast("string")), 256)
    rank = F.row_number().over(Window.partitionBy(stratum).orderBy(h, id_col))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= quota).drop("_rank")


def latest_by_key(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in key and c not in order]
    best = df.groupBy(*key).agg(F.max(F.struct(*order, *rest)).alias("_r"))
    return best.select(*key, *[F.col(f"_r.{c}").alias(c) for c in [*order, *rest]])


def override_union(history: DataFrame, feedback: DataFrame, key: str) -> DataFrame:
    return history.join(feedback.select(key), key, "left_anti").unionByName(feedback)


def exclude_overlap(rows: DataFrame, history: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that share no key with history; nulls never match."""
    out = rows
    for k in keys:
        out = out.join(history.select(k).where(F.col(k).isNotNull()).distinct(), k, "left_anti")
    return out.select(*rows.columns)


def exclude_sequential(rows: DataFrame, id_col: str, keys: list[str], history: dict[str, DataFrame], max_rounds: int = 1000) -> DataFrame:
    """Rows kept when going by id and dropping each that shares a key with history or with a row kept before.

    A kept row blocks later ones, a dropped row doesn't. In each round the rows
    that are first on all their keys are kept, what they block is dropped, and
    the rest go on; so hot keys shrink to one row in their first round.
    """
    from tallygrove.session import materialize, release

    left = rows
    for k, h in history.items():
        left = left.join(h.select(F.col(k).alias("_h")).where("_h is not null").distinct(), F.col(k) == F.col("_h"), "left_anti")
    packed = left.select(F.col(id_col), F.array_compact(F.array(*[F.when(F.col(k).isNotNull(), F.concat(F.lit(k + "|"), F.col(k).cast("string"))) for k in keys])).alias("_k"))
    free = packed.where(F.size("_k") == 0).select(id_col)
    now, kept = materialize(packed.where(F.size("_k") > 0), "exclude"), None
    for _ in range(max_rounds):
        each = now.select(id_col, F.explode("_k").alias("_x"))
        first = each.groupBy("_x").agg(F.min(id_col).alias("_f"))
        lead = each.join(first, "_x").groupBy(id_col).agg(F.bool_and(F.col(id_col) == F.col("_f")).alias("_ok")).where("_ok").select(id_col)
        lead = materialize(lead, "exclude")
        if not lead.limit(1).count():
            break
        kept = lead if kept is None else kept.unionByName(lead)
        blocked = each.join(lead, id_col, "left_semi").select("_x").distinct()
        hit = each.join(blocked, "_x", "left_semi").select(id_col).distinct()
        after = materialize(now.join(hit, id_col, "left_anti"), "exclude")
        release(now)
        now = after
    else:
        raise RuntimeError("not settled")
    ids = free if kept is None else free.unionByName(kept)
    return rows.join(ids, id_col, "left_semi")


def constrained_thresholds(df: DataFrame, group: str, confidence: str, correct: str, steps: int = 61, least_accuracy: float = 0.6, least_rows: int = 1) -> DataFrame:
    """Per group the threshold of a grid with the greatest coverage that holds the accuracy on enough rows."""
    cell = F.least(F.floor(F.col(confidence) * (steps - 1)), F.lit(steps - 1)).cast("int")
    cells = df.groupBy(group, cell.alias("_c")).agg(F.count("*").alias("_n"), F.sum(F.col(correct).cast("long")).alias("_k"))
    # At most ``steps`` rows of a group.
    w = Window.partitionBy(group).orderBy(F.desc("_c")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(group)
    c = cells.select(
        group, (F.col("_c") / (steps - 1)).alias("threshold"), F.sum("_n").over(w).alias("answered"), F.sum("_k").over(w).alias("_good"), F.sum("_n").over(whole).alias("_t")
    )
    ok = c.where((F.col("_good") >= least_accuracy * F.col("answered")) & (F.col("answered") >= least_rows))
    best = ok.groupBy(group).agg(F.max(F.struct("answered", (-F.col("threshold")).alias("t"), "_good", "_t")).alias("b"))
    return best.select(group, (-F.col("b.t")).alias("threshold"), (F.col("b.answered") / F.col("b._t")).alias("coverage"), (F.col("b._good") / F.col("b.answered")).alias("accuracy"))
