"""Evaluation queries. Documents are scored by rules on their length, labels are gold; embeddings give rankings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallygrove.operators import metrics as M
from tallygrove.operators.vectors import VectorSearch
from tallygrove.plans.temporal import REPORTS, reports
from tallygrove.session import table

# A rule classifier of quality from n_chars, with a probability in [0, 1].
_P = "(least(n_chars, 4000)::DOUBLE / 4000)"


def predictions(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    p = F.least("n_chars", F.lit(4000)).cast("double") / 4000
    return table(spark, sf, "labels").join(docs, "doc_id").select(
        "doc_id", "lang", "source", "n_chars", "quality", "toxic", p.alias("p"), (p >= 0.3).cast("int").alias("said")
    )


PRED = f"pred AS (SELECT doc_id, lang, source, n_chars, quality, toxic, {_P} AS p, ({_P} >= 0.3)::INT AS said FROM labels JOIN documents USING (doc_id))"


def confusion_matrix(spark, sf):
    c = M.confusion(predictions(spark, sf), "quality", "said", [0, 1])
    return c.select("quality", F.col("0").alias("said_0"), F.col("1").alias("said_1"))


CONFUSION = f"WITH {PRED} SELECT quality, count(*) FILTER (said = 0) AS said_0, count(*) FILTER (said = 1) AS said_1 FROM pred GROUP BY quality"


def label_scores(spark, sf):
    return M.per_label(predictions(spark, sf), "quality", "said").select("label", "support", "tp", "fp", "fn", "precision", "recall", "f1")


LABELS = f"""WITH {PRED}, l AS (SELECT label, count(*) FILTER (quality = label) AS support, count(*) FILTER (quality = label AND said = label) AS tp,
 count(*) FILTER (said = label) AS said FROM pred, (SELECT DISTINCT quality AS label FROM pred UNION SELECT DISTINCT said FROM pred) GROUP BY label),
 s AS (SELECT label, support, tp, said - tp AS fp, support - tp AS fn, CASE WHEN said > 0 THEN tp / said ELSE 0 END AS precision,
 CASE WHEN support > 0 THEN tp / support ELSE 0 END AS recall FROM l)
 SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM s"""


def macro_scores(spark, sf):
    return M.macro(M.per_label(predictions(spark, sf), "quality", "said"))


MACRO = LABELS.replace(" SELECT *, CASE", ", f AS (SELECT *, CASE") + """)
 SELECT avg(f1) AS macro_f1, sum(f1 * support) / sum(support) AS weighted_f1, avg(recall) AS macro_recall, min(recall) AS min_recall, sum(tp) / sum(support) AS accuracy FROM f"""


def priority_metrics(spark, sf):
    """Priority predicted by the author's prior mean: accuracy, off-by-one, MAE, per-class recall."""
    from tallygrove.operators.temporal import prior_stats
    from tallygrove.plans.temporal import LEVELS

    r = prior_stats(reports(spark, sf), "author", ["created_at", "report_id"], "priority", LEVELS)
    r = r.withColumn("said", F.floor(F.coalesce("prior_mean", F.lit(3.0)) + 0.5).cast("int"))
    d = F.abs(F.col("said") - F.col("priority"))
    recall = [M.ratio(F.sum(((F.col("priority") == v) & (d == 0)).cast("long")), F.sum((F.col("priority") == v).cast("long"))).alias(f"recall_p{v}") for v in LEVELS]
    return r.agg(F.count("*").alias("n"), F.avg((d == 0).cast("double")).alias("accuracy"), F.avg((d <= 1).cast("double")).alias("off_by_one"), F.avg(d).alias("mae"), *recall)


PRIORITY = f"""WITH {REPORTS}, r AS (SELECT priority, floor(coalesce(avg(priority) OVER (PARTITION BY author ORDER BY created_at, report_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 3.0) + 0.5)::INT AS said FROM reports)
 SELECT count(*) AS n, avg((said = priority)::INT) AS accuracy, avg((abs(said - priority) <= 1)::INT) AS off_by_one, avg(abs(said - priority)) AS mae, """ + ", ".join(
    f"coalesce(avg((said = priority)::INT) FILTER (priority = {v}), 0) AS recall_p{v}" for v in range(1, 6)
) + " FROM r"


def threshold_sweep(spark, sf):
    return M.threshold_curve(predictions(spark, sf), "p", "quality")


SWEEP = f"""WITH {PRED}, g AS (SELECT p, count(*) AS n, sum(quality) AS y FROM pred GROUP BY p),
 c AS (SELECT p, sum(n) OVER (ORDER BY p DESC) AS said, sum(y) OVER (ORDER BY p DESC) AS tp, sum(y) OVER () AS pos, sum(n) OVER () AS total FROM g)
 SELECT p AS threshold, tp, said - tp AS fp, pos - tp AS fn, tp / said AS precision, CASE WHEN pos > 0 THEN tp / pos ELSE 0 END AS recall, 2 * tp / (said + pos) AS f1, (total - pos - (said - tp) + tp) / total AS accuracy FROM c"""


def best_threshold(spark, sf):
    return M.best_threshold(M.threshold_curve(predictions(spark, sf), "p", "quality"))


BEST = SWEEP.replace(" SELECT p AS threshold", ", s AS (SELECT p AS threshold") + """)
 SELECT f1, precision, recall, accuracy, threshold, tp, fp, fn FROM s ORDER BY f1 DESC, precision DESC, recall DESC, accuracy DESC, threshold DESC LIMIT 1"""


def auroc(spark, sf):
    return M.auroc(predictions(spark, sf), "p", "quality")


AUROC = f"""WITH {PRED}, r AS (SELECT quality, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2 AS rk FROM pred)
 SELECT sum(quality) AS positives, count(*) AS total, (sum(rk) FILTER (quality = 1) - sum(quality) * (sum(quality) + 1) / 2) / (sum(quality) * (count(*) - sum(quality))) AS auroc FROM r"""


def calibration_ece(spark, sf):
    return M.calibration_summary(predictions(spark, sf), "p", "quality")


ECE = f"""WITH {PRED}, b AS (SELECT least(floor(p * 10), 9) AS bin, count(*) AS n, avg(p) AS c, avg(quality) AS a, sum((p - quality) ** 2) AS sq FROM pred GROUP BY 1)
 SELECT sum(abs(a - c) * n) / sum(n) AS ece, max(abs(a - c)) AS mce, sum(sq) / sum(n) AS brier, sum(n) AS n FROM b"""


def psi_drift(spark, sf):
    """Drift of event values between the first and the last part of the period."""
    ev = table(spark, sf, "events").select("ts", "value").where("value is not null")
    old, new = ev.where("ts < timestamp '2024-01-16'"), ev.where("ts >= timestamp '2024-01-16'")
    edges = old.agg(F.percentile("value", F.array(*[F.lit(i / 10) for i in range(1, 10)])).alias("edges"))
    return M.psi(old, new, "value", edges)


PSI = """WITH ev AS (SELECT value, ts < TIMESTAMP '2024-01-16' AS old FROM events WHERE value IS NOT NULL),
 e AS (SELECT quantile_cont(value, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]) AS edges FROM ev WHERE old),
 b AS (SELECT len(list_filter(edges, lambda x: x <= value)) AS bin, old, count(*) AS n FROM ev, e GROUP BY ALL),
 p AS (SELECT range AS bin, coalesce((SELECT n FROM b WHERE b.bin = range AND old), 0) AS e, coalesce((SELECT n FROM b WHERE b.bin = range AND NOT old), 0) AS a FROM range(0, 10)),
 q AS (SELECT (e + 0.5) / ((SELECT sum(e) FROM p) + 5.0) AS pe, (a + 0.5) / ((SELECT sum(a) FROM p) + 5.0) AS pa FROM p)
 SELECT sum((pa - pe) * ln(pa / pe)) AS psi, count(*) AS bins FROM q"""


def wilson_by_group(spark, sf):
    g = predictions(spark, sf).groupBy("lang").agg(F.sum((F.col("said") == F.col("quality")).cast("long")).alias("k"), F.count("*").alias("n"))
    low, high = M.wilson(F.col("k"), F.col("n"))
    return g.select("lang", "k", "n", low.alias("low"), high.alias("high"))


WILSON = f"""WITH {PRED}, g AS (SELECT lang, sum((said = quality)::INT) AS k, count(*) AS n, {M.Z} AS z FROM pred GROUP BY lang)
 SELECT lang, k, n, greatest(0, (k/n + z*z/(2*n) - z*sqrt(k/n*(1-k/n)/n + z*z/(4*n*n))) / (1 + z*z/n)) AS low,
 least(1, (k/n + z*z/(2*n) + z*sqrt(k/n*(1-k/n)/n + z*z/(4*n*n))) / (1 + z*z/n)) AS high FROM g"""


def vector_search(spark, sf) -> VectorSearch:
    """Search of the neighbours of each vector whose id is divisible by 20 among all."""
    e = table(spark, sf, "embeddings").select("vec_id", "embedding", "label")
    return VectorSearch(e, e.where("vec_id % 20 = 0"), "vec_id", "embedding", "label")


def embedding_ranks(spark, sf, k=10):
    """The k nearest vectors (cosine, then id) of each vector whose id is divisible by 20."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id"))
    return vector_search(spark, sf).nearest(k).withColumn("rank", rank).where(F.col("rank") <= k)


EMB_ALL = """ranks AS (SELECT q.vec_id AS query_id, e.vec_id AS item_id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score,
 q.label AS query_label, e.label, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) DESC, e.vec_id) AS rank
 FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id WHERE q.vec_id % 20 = 0)"""
EMB = EMB_ALL.replace("ranks AS (", "ranks AS (SELECT * FROM (", 1) + " WHERE rank <= 10)"


def embedding_topk(spark, sf):
    return embedding_ranks(spark, sf).select("query_id", "item_id", "score", "rank")


def label_sizes(vectors):
    """(query_id, n): other vectors of the label of each vector whose id is divisible by 20, counted and not listed."""
    size = vectors.select("vec_id", "label").distinct().groupBy("label").agg((F.count("*") - 1).alias("n"))
    return vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "label").distinct().join(size, "label").select("query_id", "n").where("n > 0")


def map_mrr_recall(spark, sf):
    ranks = embedding_ranks(spark, sf)
    n = label_sizes(table(spark, sf, "embeddings")).withColumnRenamed("n", "n_relevant")
    return M.ranking_of_hits(n, ranks.where("label = query_label"), "query_id", "item_id", "rank", [1, 5, 10])


MAP = f"""WITH {EMB}, rel AS (SELECT q.vec_id AS query_id, e.vec_id AS item_id FROM embeddings q JOIN embeddings e ON q.label = e.label AND q.vec_id <> e.vec_id WHERE q.vec_id % 20 = 0),
 n AS (SELECT query_id, count(*) AS n_relevant FROM rel GROUP BY 1),
 h AS (SELECT query_id, rank, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS seen FROM ranks JOIN rel USING (query_id, item_id))
 SELECT n.query_id, n_relevant, min(rank) AS first_rank, coalesce(sum(seen / rank), 0) / n_relevant AS ap, coalesce(1 / min(rank), 0) AS rr, """ + ", ".join(
    f"(count(*) FILTER (rank <= {k}) > 0)::INT AS hit_{k}, count(*) FILTER (rank <= {k}) / n_relevant AS recall_{k}" for k in (1, 5, 10)
) + " FROM n LEFT JOIN h USING (query_id) GROUP BY n.query_id, n_relevant"


def owner_entropy(spark, sf):
    from tallygrove.plans.temporal import owner_history

    return M.entropy(owner_history(spark, sf), ["component"], "owner")


def latency_percentiles(spark, sf):
    """Nearest-rank p50 / p95 and the linear quantile grid of event values."""
    return table(spark, sf, "events").groupBy("event_type").agg(
        F.expr("percentile_disc(0.5) within group (order by value)").alias("p50"),
        F.expr("percentile_disc(0.95) within group (order by value)").alias("p95"),
        F.expr("percentile(value, 0.5)").alias("median"), F.avg("value").alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"),
    )


def sample_size_plan(spark, sf):
    """Fewest rows for which the lower Wilson bound is within 0.05 of an accuracy."""
    n = spark.range(1, 5001).select(F.col("id").alias("n"), F.explode(F.array(F.lit(0.9), F.lit(0.95), F.lit(0.98))).alias("p"))
    low, _ = M.wilson(F.col("p") * F.col("n"), F.col("n"))
    return n.groupBy("p").agg(F.min(F.when(low >= F.col("p") - 0.05, F.col("n"))).alias("n_needed"))


SIZES = f"""WITH w AS (SELECT n, p::DOUBLE AS p, {M.Z} AS z FROM range(1, 5001) t(n), (VALUES (0.9), (0.95), (0.98)) v(p)),
 l AS (SELECT n, p, (p + z*z/(2*n) - z*sqrt(p*(1-p)/n + z*z/(4.0*n*n))) / (1 + z*z/n) AS low FROM w) SELECT p, min(n) FILTER (low >= p - 0.05) AS n_needed FROM l GROUP BY p"""


def bootstrap_ci(spark, sf, samples=200):
    """Percentile interval of accuracy by hash-driven Poisson(1) resampling: one pass, no resampled copies are stored."""
    p = predictions(spark, sf).withColumn("ok", (F.col("said") == F.col("quality")).cast("long"))
    u = F.conv(F.substring(F.md5(F.concat_ws("|", "_s", "doc_id")), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)
    cdf = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119]
    weight = sum([(u >= c).cast("long") for c in cdf[1:]], (u >= cdf[0]).cast("long"))
    drawn = p.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(samples - 1)))).withColumn("w", weight)
    per = drawn.groupBy("_s").agg((F.sum(F.col("w") * F.col("ok")) / F.sum("w")).alias("a"))
    return per.agg(F.expr("percentile(a, 0.025)").alias("low"), F.expr("percentile(a, 0.975)").alias("high"), F.avg("a").alias("mean"))


BOOT = f"""WITH {PRED}, d AS (SELECT s, (said = quality)::INT AS ok, ('0x' || substr(md5(s || '|' || doc_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM pred, range(0, 200) t(s)),
 w AS (SELECT s, ok, len(list_filter([0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119]::DOUBLE[], lambda c: u >= c)) AS w FROM d),
 a AS (SELECT s, sum(w * ok) / sum(w) AS a FROM w GROUP BY s) SELECT quantile_cont(a, 0.025) AS low, quantile_cont(a, 0.975) AS high, avg(a) AS mean FROM a"""

QUERIES = {
    "confusion_matrix": confusion_matrix, "label_scores": label_scores, "macro_scores": macro_scores, "priority_metrics": priority_metrics,
    "threshold_sweep": threshold_sweep, "best_threshold": best_threshold, "auroc": auroc, "calibration_ece": calibration_ece, "psi_drift": psi_drift,
    "wilson_by_group": wilson_by_group, "embedding_topk": embedding_topk, "map_mrr_recall": map_mrr_recall, "owner_entropy": owner_entropy,
    "latency_percentiles": latency_percentiles,
    "sample_size_plan": sample_size_plan, "bootstrap_ci": bootstrap_ci,
}
ORACLES = {
    "confusion_matrix": CONFUSION, "label_scores": LABELS, "macro_scores": MACRO, "priority_metrics": PRIORITY, "threshold_sweep": SWEEP,
    "best_threshold": BEST, "auroc": AUROC, "calibration_ece": ECE, "psi_drift": PSI, "wilson_by_group": WILSON,
    "embedding_topk": f"WITH {EMB} SELECT query_id, item_id, score, rank FROM ranks", "map_mrr_recall": MAP,
    "owner_entropy": """WITH h AS (SELECT p_brand AS component, l_suppkey AS owner, count(*) AS c FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
 t AS (SELECT component, sum(c) AS n, count(*) AS "distinct", ln(sum(c)) - sum(c * ln(c)) / sum(c) AS entropy FROM h GROUP BY 1)
 SELECT *, CASE WHEN "distinct" > 1 THEN entropy / ln("distinct") ELSE 0 END AS normalised FROM t""",
    "latency_percentiles": """SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, median(value) AS median,
 avg(value) AS mean, min(value) AS least, max(value) AS most FROM events GROUP BY 1""",
   
    "sample_size_plan": SIZES, "bootstrap_ci": BOOT,
}
