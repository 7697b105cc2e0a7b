"""Scalar functions, chunk signals and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallygrove.functions import scalars as S
from tallygrove.operators import code as K
from tallygrove.operators.routing import constrained_thresholds, exclude_sequential
from tallygrove.plans.metrics import EMB, PRED, embedding_ranks, predictions
from tallygrove.session import table


def time_features(spark, sf):
    """Cyclic hour and weekday of events and their value clamped to [0, 50]."""
    ev = table(spark, sf, "events")
    hs, hc = S.cyclic(F.hour("ts"), 24)
    ws, wc = S.cyclic(F.weekday("ts"), 7)
    return ev.select("event_id", hs.alias("hour_sin"), hc.alias("hour_cos"), ws.alias("day_sin"), wc.alias("day_cos"), S.number(F.col("value"), 0.0, 0, 50).alias("value"))


TIME = """SELECT event_id, sin(hour(ts) * 2 * pi() / 24) AS hour_sin, cos(hour(ts) * 2 * pi() / 24) AS hour_cos, sin((isodow(ts) - 1) * 2 * pi() / 7) AS day_sin,
 cos((isodow(ts) - 1) * 2 * pi() / 7) AS day_cos, least(50.0, greatest(0.0, coalesce(value, 0))) AS value FROM events"""


def chunk_signals(spark, sf):
    """Chunk score of ranked vectors from six signals, best file and the gate of each query."""
    r = embedding_ranks(spark, sf)
    signals = {
        "stack": (F.col("item_id") % 3 == 0).cast("int"), "path": (F.col("item_id") % 5 == F.col("query_id") % 5).cast("int"), "identifier": F.col("score"),
        "keyword": S.clamp(F.col("score") * 1.2), "symbol": (F.col("label") == F.col("query_label")).cast("int"), "proximity": 1 / F.col("rank"),
    }
    scored = r.withColumn("s", F.round(K.chunk_score(signals), 6))
    top = scored.groupBy("query_id").agg(
        F.slice(F.reverse(F.array_sort(F.collect_list("s"))), 1, 2).alias("t"), F.sum((F.col("label") == F.col("query_label")).cast("int")).alias("evidence")
    )
    best, margin = F.get("t", F.lit(0)), F.get("t", F.lit(0)) - F.coalesce(F.get("t", F.lit(1)), F.lit(0.0))
    return top.select("query_id", best.alias("best"), margin.alias("margin"), S.localisation_gate(best, F.round(margin, 6), F.col("evidence")).alias("gate"))


SIGNALS = f"""WITH {EMB}, s AS (SELECT query_id, label = query_label AS hit, round(greatest(0, least(1, 0.20 * (item_id % 3 = 0)::INT + 0.15 * (item_id % 5 = query_id % 5)::INT + 0.15 * score + 0.25 * greatest(0, least(1, score * 1.2)) + 0.15 * (label = query_label)::INT + 0.10 / rank)), 6) AS s FROM ranks),
 t AS (SELECT query_id, max(s) AS best, list_sort(list(s), 'DESC')[2] AS second, sum(hit::INT) AS evidence FROM s GROUP BY 1), m AS (SELECT *, best - coalesce(second, 0) AS margin FROM t)
 SELECT query_id, best, margin, CASE WHEN best >= 0.6 AND round(margin, 6) >= 0.05 AND evidence >= 2 THEN 'confident' WHEN best >= 0.35 AND evidence >= 1 THEN 'review' ELSE 'insufficient' END AS gate FROM m"""


def score_blend(spark, sf):
    """Blend of three parts with weights renormalised over those present."""
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    parts = {
        "length": (S.clamp(F.col("n_chars") / 5000), 0.5), "quality": (F.col("quality").cast("double"), 0.3), "clean": (1 - F.col("toxic").cast("double"), 0.2)
    }
    return d.select("doc_id", S.weighted_blend(parts).alias("blend"))


BLEND = """SELECT doc_id, (0.5 * greatest(0, least(1, n_chars / 5000)) + coalesce(0.3 * quality, 0) + coalesce(0.2 * (1 - toxic), 0)) / (0.5 + CASE WHEN quality IS NULL THEN 0 ELSE 0.3 END + CASE WHEN toxic IS NULL THEN 0 ELSE 0.2 END) AS blend
 FROM documents LEFT JOIN labels USING (doc_id)"""


def component_thresholds(spark, sf):
    """Per language the threshold with the greatest coverage that keeps 70 % accuracy."""
    p = predictions(spark, sf).withColumn("ok", (F.col("quality") == 1).cast("int"))
    return constrained_thresholds(p, "lang", "p", "ok", least_accuracy=0.7)


THRESHOLDS = f"""WITH {PRED}, c AS (SELECT lang, least(floor(p * 60), 60) AS c, count(*) AS n, sum(quality) AS k FROM pred GROUP BY ALL),
 g AS (SELECT lang, c / 60 AS threshold, sum(n) OVER (PARTITION BY lang ORDER BY c DESC) AS answered, sum(k) OVER (PARTITION BY lang ORDER BY c DESC) AS good, sum(n) OVER (PARTITION BY lang) AS t FROM c)
 SELECT lang, threshold, answered / t AS coverage, good / answered AS accuracy FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY answered DESC, threshold) AS rn FROM g WHERE good >= 0.7 * answered) WHERE rn = 1"""


def sequential_exclusion(spark, sf):
    """Documents kept by id when a kept document blocks later ones of the same text or the same long first line; benchmark texts block too."""
    d = table(spark, sf, "documents").where("text is not null")
    line = F.regexp_extract("text", r"^([^\n]{40,})", 1)
    rows = d.select("doc_id", F.md5("text").alias("content"), F.when(line != "", F.md5(line)).alias("family"))
    b = table(spark, sf, "benchmark").select(F.md5("text").alias("content"))
    return exclude_sequential(rows, "doc_id", ["content", "family"], {"content": b}).select("doc_id")


QUERIES = {
    "time_features": time_features, "chunk_signals": chunk_signals, "score_blend": score_blend, "component_thresholds": component_thresholds, "sequential_exclusion": sequential_exclusion,
}
ORACLES = {"time_features": TIME, "chunk_signals": SIGNALS, "score_blend": BLEND, "component_thresholds": THRESHOLDS}
