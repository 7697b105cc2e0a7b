"""Record work around tickets: aliases, imports, vocabularies, parsing, snapshots, clusters, digests, folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallygrove.operators.cleaning import canonical
from tallygrove.operators.cluster import connected_components
from tallygrove.operators.temporal import interval_join, running_total
from tallygrove.session import materialize, release


def resolve_aliases(aliases: DataFrame, name: str, target: str, max_rounds: int = 40) -> DataFrame:
    """(name, final): aliases followed to their end by doubling; a cycle is an error. Names must be unique."""
    now = materialize(aliases.where(F.col(name).isNotNull() & (F.col(name) != F.col(target))).select(F.col(name).alias("a"), F.col(target).alias("b")), "alias")
    for _ in range(max_rounds):
        step = now.select(F.col("a").alias("m"), F.col("b").alias("n"))
        met = now.join(step, F.col("b") == F.col("m"), "left")
        after = materialize(met.select("a", F.coalesce("n", "b").alias("b"), F.col("n").isNotNull().alias("_moved")), "alias")
        moved = after.where("_moved").limit(1).count()
        if after.where("a = b").limit(1).count():
            raise ValueError("alias cycle")
        release(now)
        now = after.select("a", "b")
        if not moved:
            return now.select(F.col("a").alias(name), F.col("b").alias("final"))
    raise ValueError("alias cycle")


def merge_records(old: DataFrame, new: DataFrame, key: str, mode: str = "append") -> DataFrame:
    """Import of records: 'replace' keeps the new ones only, 'append' lets them replace old ones of the same key."""
    if mode == "replace":
        return new
    if mode != "append":
        raise ValueError(mode)
    return old.join(new.select(key).distinct(), key, "left_anti").select(*old.columns).unionByName(new)


def allowed_value(value: Column, allowed: list[str], default: str | None = None) -> Column:
    """The allowed spelling equal to value up to case and blanks, else the only allowed value it contains, else default."""
    v = F.lower(F.trim(value))
    options = F.array(*[F.lit(a) for a in allowed])
    equal = F.get(F.filter(options, lambda a: F.lower(a) == v), F.lit(0))
    inside = F.filter(options, lambda a: F.contains(v, F.lower(a)))
    return F.coalesce(equal, F.when(F.size(inside) == 1, F.get(inside, F.lit(0))), F.lit(default))


def labelled_field(text: Column, labels: list[str]) -> Column:
    """What follows one of the labels and a colon on a line of free text."""
    found = F.regexp_extract(text, r"(?im)^[ \t]*(?:" + "|".join(labels) + r")[ \t]*[:：][ \t]*([^\n]*)$", 1)
    return canonical(found)


def repaired_json(text: Column, schema: str) -> Column:
    """The first {...} of a reply, fences and trailing commas removed, parsed; null if it still isn't JSON."""
    body = F.regexp_extract(F.regexp_replace(text, r"(?s)```(?:json)?", ""), r"(?s)(\{.*\})", 1)
    return F.from_json(F.regexp_replace(body, r",\s*([}\]])", "$1"), schema)


def missing_fields(columns: dict[str, Column], held=canonical) -> Column:
    """Names of the columns that hold nothing: those of which ``held``, by default the value unless it is a placeholder, is null."""
    return F.array_compact(F.array(*[F.when(held(c.cast("string")).isNull(), n) for n, c in columns.items()]))


def one_snapshot(rows: DataFrame, snapshots: DataFrame, id_col: str, ts: str, start: str, end: str) -> DataFrame:
    """Rows with the snapshot valid at their time, if any; two valid snapshots are an error."""
    met = interval_join(rows.withColumn("_k", F.lit(1)), snapshots.withColumn("_k", F.lit(1)), ["_k"], ts, start, end, "left").drop("_k")
    n = met.groupBy(id_col).agg(F.count("*").alias("_n"))
    bad = F.when(F.col("_n") > 1, F.raise_error(F.lit("more than one snapshot is valid")).cast("int")).otherwise(F.lit(1))
    return met.join(n, id_col).where(bad == 1).drop("_n")


def collapse_clusters(rows: DataFrame, id_col: str, ts: str, keys: list[Column], links: DataFrame | None = None) -> DataFrame:
    """(id, representative, size): clusters by equal keys or links, represented by their earliest record."""
    keyed = rows.select(F.col(id_col), F.explode(F.array_compact(F.array(*keys))).alias("_k"))
    hub = keyed.groupBy("_k").agg(F.min(id_col).alias("b"))
    edges = keyed.join(hub, "_k").select(F.col(id_col).alias("a"), "b")
    if links is not None:
        edges = edges.unionByName(links.select("a", "b"))
    comp = connected_components(edges)
    met = rows.join(comp, rows[id_col] == comp["id"], "left").withColumn("_c", F.coalesce("component", id_col))
    first = met.groupBy("_c").agg(F.min(F.struct(ts, id_col)).alias("_f"), F.count("*").alias("size"))
    return met.select(id_col, "_c").join(first, "_c").select(id_col, F.col(f"_f.{id_col}").alias("representative"), "size")


def content_digest(rows: DataFrame, keys: list[str], content: Column) -> DataFrame:
    """One digest of each key's rows whatever their order: digests are sorted in 256 buckets, then the buckets' digests."""
    d = rows.select(*keys, F.sha2(content, 256).alias("_d"))
    parts = d.groupBy(*keys, F.substring("_d", 1, 2).alias("_b")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("_d")), ""), 256).alias("_p"), F.count("*").alias("_n"))
    whole = parts.groupBy(*keys).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_b", "_p"))), lambda x: x["_p"]), ""), 256).alias("digest"), F.sum("_n").alias("n"))
    return whole


def enough_history(rows: DataFrame, key: str, least: int) -> tuple[DataFrame, DataFrame]:
    """(rows of keys with at least so many rows, audit of the keys left out)."""
    c = rows.groupBy(key).agg(F.count("*").alias("n"))
    return rows.join(c.where(F.col("n") >= least).select(key), key, "left_semi"), c.where(F.col("n") < least)


def disjoint_holdout(rows: DataFrame, group: str, share: float, seed: str = "holdout") -> DataFrame:
    """(group, part): whole groups in the order of a seeded hash go to the holdout until it has its share. Groups are scanned in cells of hashes."""
    c = rows.groupBy(group).agg(F.count("*").alias("n"))
    h = F.sha2(F.concat_ws("|", F.lit(seed), F.col(group).cast("string")), 256)
    t = c.agg(F.sum("n").alias("_t"))
    cell = F.conv(F.substring("_h", 1, 3), 16, 10).cast("long")
    run = running_total(c.withColumn("_h", h), ["_h"], cell, {"_s": F.col("n")}).crossJoin(F.broadcast(t))
    return run.select(group, "n", F.when(F.col("_s") <= F.col("_t") * share, "holdout").otherwise("train").alias("part"))


def representatives(rows: DataFrame, group: str, spread: str, id_col: str, score: str, k: int) -> DataFrame:
    """k rows of each group: the best of each spread value first, then the best of the rest."""
    own = F.row_number().over(Window.partitionBy(group, spread).orderBy(F.desc(score), id_col))
    r = rows.withColumn("_o", own)
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.col("_o") > 1, F.desc(score), id_col))
    return r.withColumn("place", place).where(F.col("place") <= k).drop("_o")


def rank_agreement(rows: DataFrame, query: str, item: str, a: str, b: str, pool: int) -> DataFrame:
    rank = lambda c: F.row_number().over(Window.partitionBy(query).orderBy(F.desc(c), item))
    r = rows.withColumns({"_a": rank(a), "_b": rank(b)})
    return r.withColumn("agreement", F.greatest(F.lit(0.0), 1 - F.abs(F.col("_a") - F.col("_b")) / pool)).drop("_a", "_b")
