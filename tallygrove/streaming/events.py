"""Event streams. Each function also takes a batch frame, where it gives what a stream has given in the end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrove.session import delete, temporary


def windowed_counts(events: DataFrame, late: str = "2 days", size: str = "1 day") -> DataFrame:
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", size), "event_type")
        .agg(F.count("*").alias("n"), F.sum("value").alias("total"))
        .select(F.col("window.start").alias("day"), "event_type", "n", "total")
    )


def deduplicated(events: DataFrame, keys: list[str], late: str = "7 days") -> DataFrame:
    """The first of events with equal keys; state is dropped behind the watermark."""
    if events.isStreaming:
        return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)
    return events.dropDuplicates(keys)


def replay(spark: SparkSession, source: DataFrame, transform, folder: str | None = None) -> DataFrame:
    """Run a stream over files to its end (availableNow) into a Parquet table in the shared folder and read it; a folder of the caller's is resumed in later calls."""
    base = folder or temporary(spark, "replay")
    out = transform(source)
    q = (
        out.writeStream.outputMode("append").format("parquet").trigger(availableNow=True)
        .option("checkpointLocation", f"{base}/state").option("path", f"{base}/rows").start()
    )
    q.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{base}/rows")


def latest_state(spark: SparkSession, source: DataFrame, keys: list[str], order: list[str], folder: str | None = None) -> DataFrame:
    """Latest row per key of a stream: each micro-batch is reduced and merged with the table so far, written under its number, so a repeated batch changes nothing.

    The table before the last is kept for such a repeat, older ones are deleted;
    a folder of the caller's is resumed in later calls.
    """
    from tallygrove.operators.routing import latest_by_key

    base = folder or temporary(spark, "state")
    schema = source.schema

    def merge(batch: DataFrame, number: int) -> None:
        now = latest_by_key(batch, keys, order).select(*schema.names)
        if number:
            now = latest_by_key(now.unionByName(spark.read.schema(schema).parquet(f"{base}/{number - 1}")), keys, order).select(*schema.names)
        now.write.mode("overwrite").parquet(f"{base}/{number}")
        if number > 1:
            delete(spark, f"{base}/{number - 2}")

    q = source.writeStream.foreachBatch(merge).option("checkpointLocation", f"{base}/log").trigger(availableNow=True).start()
    q.awaitTermination()
    where = spark._jvm.org.apache.hadoop.fs.Path(base)
    names = [f.getPath().getName() for f in where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where)]
    done = max((int(n) for n in names if n.isdigit()), default=None)
    return spark.createDataFrame([], schema) if done is None else spark.read.schema(schema).parquet(f"{base}/{done}")


def rolling_replay(history: DataFrame, queries: DataFrame, windows: DataFrame, key: str) -> DataFrame:
    """Per window: queries in it, and history whose label was available by the window's first query.

    windows has name, start, end (half-open). A query whose key is in the usable
    history is dropped. Returns (window, queries, usable, overlapping).
    """
    # A few hundred windows; the history isn't joined with them: each row is counted at the first window that it is known in.
    w = F.broadcast(windows)
    q = queries.join(w, (F.col("at") >= F.col("start")) & (F.col("at") < F.col("end"))).select("name", key, "at")
    total = q.groupBy("name").agg(F.min("at").alias("first_at"), F.count("*").alias("queries"))
    firsts = total.agg(F.sort_array(F.collect_list("first_at")).alias("_firsts"))
    place = F.size(F.filter("_firsts", lambda f: f < F.col("available_at")))
    by = history.crossJoin(F.broadcast(firsts)).groupBy(place.alias("_k")).agg(F.count("*").alias("_n"))
    by = by.agg(F.map_from_entries(F.collect_list(F.struct("_k", "_n"))).alias("_by"))
    known = lambda i: F.coalesce(F.element_at("_by", i), F.lit(0))
    mine = F.size(F.filter("_firsts", lambda f: f < F.col("first_at")))
    usable = F.aggregate(F.sequence(F.lit(0), mine), F.lit(0).cast("long"), lambda s, i: s + known(i))
    counted = total.crossJoin(F.broadcast(firsts)).crossJoin(F.broadcast(by)).select("name", "queries", "first_at", usable.alias("usable"))
    since = history.groupBy(key).agg(F.min("available_at").alias("_since"))
    seen = q.join(since, key).join(F.broadcast(total.select("name", "first_at")), "name").where(F.col("_since") <= F.col("first_at"))
    over = seen.groupBy("name").agg(F.count("*").alias("overlapping"))
    return counted.drop("first_at").join(over, "name", "left").na.fill(0, ["usable", "overlapping"])


def with_ttl(state: DataFrame, at: str, days: int, now) -> DataFrame:
    """State rows not older than ``days`` at ``now``."""
    return state.where(F.col(at).cast("timestamp") > now - F.make_dt_interval(F.lit(days)))
