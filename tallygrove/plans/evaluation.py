"""Evaluation summaries, gates and alignments."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallygrove.operators import evaluation as E
from tallygrove.session import table


def _labelled(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "n_chars", "lang", "source", (F.least("n_chars", F.lit(4000)) / 4000).alias("conf"))
    return table(spark, sf, "labels").join(d, "doc_id")


def weekly_shadow(spark, sf):
    error = F.when(F.col("event_type") == "error", 1.0).otherwise(0.0)
    return E.weekly_summary(table(spark, sf, "events"), "ts", {"n": F.count("*"), "owners": F.count_distinct("user_id"), "error_rate": F.avg(error)})


WEEKLY = """SELECT isoyear(ts) AS iso_year, weekofyear(ts) AS iso_week, count(*) AS n, count(DISTINCT user_id) AS owners,
 count(*) FILTER (event_type = 'error') / count(*) AS error_rate FROM events GROUP BY ALL"""


def field_accuracy(spark, sf):
    said = table(spark, sf, "documents").select("doc_id", (F.col("n_chars") >= 1200).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    return E.field_accuracy(table(spark, sf, "labels"), said, "doc_id", ["quality", "toxic"])


FIELD = """WITH m AS (SELECT l.doc_id AS gold, d.doc_id AS said, l.quality = (n_chars >= 1200)::INT AS q, l.toxic = 0 AS t FROM labels l FULL JOIN documents d USING (doc_id))
 SELECT count(*) AS n, count(*) FILTER (said IS NOT NULL AND q) / count(*) AS quality_accuracy, count(*) FILTER (said IS NOT NULL AND t) / count(*) AS toxic_accuracy,
 count(*) FILTER (said IS NOT NULL AND q AND t) / count(*) AS exact_match, count(*) FILTER (said IS NULL) AS missing_prediction, count(*) FILTER (gold IS NULL) AS extra_prediction FROM m"""


def risk_coverage(spark, sf):
    p = _labelled(spark, sf)
    return E.risk_coverage(p, "conf", F.col("quality") == 1, p.count())


RISK = """WITH p AS (SELECT least(n_chars, 4000) / 4000 AS conf, quality FROM labels JOIN documents USING (doc_id)), t AS (SELECT DISTINCT conf AS threshold FROM p),
 a AS (SELECT threshold, count(*) AS answered, count(*) FILTER (quality = 1) AS good FROM t JOIN p ON conf >= threshold GROUP BY 1)
 SELECT threshold, answered, answered / (SELECT count(*) FROM p) AS coverage, good / answered AS accuracy, 1 - good / answered AS risk FROM a"""


def confidence_bins(spark, sf):
    return E.confidence_bins(_labelled(spark, sf), "conf", "quality")


BINS = """WITH p AS (SELECT least(n_chars, 4000) AS c, quality FROM labels JOIN documents USING (doc_id))
 SELECT CASE WHEN c >= 4000 THEN 9 ELSE c // 400 END AS bin, count(*) AS n, sum(quality) / count(*) AS accuracy, sum(c) / 4000 / count(*) AS confidence FROM p GROUP BY 1"""


def group_macro(spark, sf):
    g = E.macro_of_groups(_labelled(spark, sf), "lang", "source", "quality", 3)
    return g.select("lang", F.col("groups").alias("sources"), "n", F.col("macro").alias("macro_accuracy"), "macro_min_rows")


GROUP = """WITH p AS (SELECT lang, source, avg(quality) OVER (PARTITION BY lang, source) AS a, count(*) OVER w AS n, row_number() OVER w AS rn FROM labels JOIN documents USING (doc_id)
  WINDOW w AS (PARTITION BY lang, source)) SELECT lang, count(*) FILTER (rn = 1) AS sources, count(*) AS n, avg(a) FILTER (rn = 1) AS macro_accuracy, avg(a) FILTER (rn = 1 AND n >= 3) AS macro_min_rows FROM p GROUP BY lang"""


def class_imbalance(spark, sf):
    return E.class_imbalance(table(spark, sf, "documents"), "source")


IMBALANCE = """WITH n AS (SELECT list(n) AS n FROM (SELECT count(*) AS n FROM documents GROUP BY source))
 SELECT len(n) AS classes, list_max(n) / list_min(n) AS imbalance, list_max(n) / list_sum(n) AS top_share, len(list_filter(n, lambda x: x = 1)) AS singletons FROM n"""


def top_values(spark, sf):
    return E.top_values(table(spark, sf, "events"), "event_type", 3)


TOP = """SELECT event_type, n, n / (SELECT count(*) FROM events) AS share FROM (SELECT event_type, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, event_type) AS rn FROM events GROUP BY 1) WHERE rn <= 3"""


def gold_alignment(spark, sf):
    said = table(spark, sf, "documents").where("lang <> 'fr'").select("doc_id", (F.col("n_chars") >= 1200).cast("int").alias("said"))
    return E.gold_alignment(table(spark, sf, "labels"), said, "doc_id", "quality", "said")


ALIGN = """SELECT quality, count(*) AS gold, count(*) FILTER (lang <> 'fr') AS answered, count(*) FILTER (lang <> 'fr' AND (n_chars >= 1200) = (quality = 1)) / count(*) AS accuracy
 FROM labels LEFT JOIN documents USING (doc_id) GROUP BY 1"""


def relevant_sets(spark, sf):
    return E.relevant_sets(table(spark, sf, "embeddings").select("vec_id", "label"), "label", "vec_id")


RELEVANT = """SELECT e.vec_id, least(e.vec_id, min(o.vec_id)) AS head, count(o.vec_id) AS n_relevant FROM embeddings e LEFT JOIN embeddings o ON o.label = e.label AND o.vec_id <> e.vec_id
 WHERE e.label IS NOT NULL GROUP BY e.vec_id"""


def run_status(spark, sf):
    """Orders as runs, line items as their stages, finished if their status is F."""
    return E.run_summary(table(spark, sf, "lineitem"), "l_orderkey", F.col("l_linestatus") == "F")


STATUS = """WITH t AS (SELECT l_orderkey, count(*) AS n, bool_and(l_linestatus = 'F') AS done, bool_or(l_linestatus = 'F') AS begun FROM lineitem GROUP BY 1)
 SELECT CASE WHEN done THEN 'done' WHEN begun THEN 'partial' ELSE 'open' END AS status, count(*) AS runs, avg(n) AS mean_stages, max(n) AS most_stages FROM t GROUP BY 1"""


def error_taxonomy(spark, sf):
    q, n = F.col("quality"), F.col("n_chars")
    kinds = {"short_but_good": (q == 1) & (n < 300), "long_but_bad": (q == 0) & (n > 5000), "toxic": F.col("toxic") == 1}
    return E.taxonomy(_labelled(spark, sf), kinds)


ERRORS = """SELECT unnest(['short_but_good', 'long_but_bad', 'toxic', 'regular']) AS kind, unnest([count(*) FILTER (s), count(*) FILTER (l), count(*) FILTER (toxic = 1 AND NOT s AND NOT l),
 count(*) FILTER (toxic <> 1 AND NOT s AND NOT l)]) AS n FROM (SELECT toxic, quality = 1 AND n_chars < 300 AS s, quality = 0 AND n_chars > 5000 AS l FROM labels JOIN documents USING (doc_id))"""
ERRORS = f"SELECT * FROM ({ERRORS}) WHERE n > 0"


def field_overlap(spark, sf):
    d = table(spark, sf, "documents")
    counts = E.distinct_counts(d, {"ids": F.col("doc_id"), "contents": F.md5("text"), "sources": F.col("source")})
    return counts.crossJoin(d.agg(F.count_if(F.col("text").isNull()).alias("empty")))


FIELDS = """SELECT (SELECT count(*) FROM documents) AS rows_, (SELECT count(*) FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)) AS ids,
 (SELECT count(*) FROM (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL)) AS contents, (SELECT count(*) FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL)) AS sources,
 (SELECT count(*) FROM documents WHERE text IS NULL) AS empty"""


def frequency_buckets(spark, sf):
    b = E.frequency_buckets(table(spark, sf, "orders"), "o_custkey", 20, 5)
    return b.select("bucket", F.col("keys").alias("authors"), F.col("rows").alias("reports"))


BUCKETS = """SELECT bucket, count(DISTINCT o_custkey) AS authors, count(*) AS reports FROM (SELECT o_custkey, CASE WHEN n >= 20 THEN 'head' WHEN n >= 5 THEN 'middle' ELSE 'tail' END AS bucket
 FROM (SELECT o_custkey, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)) GROUP BY 1"""


def leakage_audit(spark, sf):
    b, d = table(spark, sf, "benchmark").select("item_id", F.lower("text").alias("b")), table(spark, sf, "documents").select(F.lower("text").alias("d"))
    return E.equal_texts(b, d, F.col("b"), F.col("d")).groupBy("item_id").agg(F.count("*").alias("n"))


LEAK = "SELECT b.item_id, count(*) AS n FROM benchmark b JOIN documents d ON lower(b.text) = lower(d.text) GROUP BY b.item_id"


def partition_digest(spark, sf):
    d = table(spark, sf, "documents").select("lang", F.md5("text").alias("h"))
    return d.groupBy("lang").agg(F.count("*").alias("n"), F.min("h").alias("first_digest"), F.max("h").alias("last_digest"))


DIGEST = """SELECT lang, any_value(n) AS n, max(h) FILTER (up = 1) AS first_digest, max(h) FILTER (down = 1) AS last_digest FROM (SELECT lang, md5(text) AS h, count(*) OVER (PARTITION BY lang) AS n,
 row_number() OVER (PARTITION BY lang ORDER BY md5(text) NULLS LAST) AS up, row_number() OVER (PARTITION BY lang ORDER BY md5(text) DESC NULLS LAST) AS down FROM documents) GROUP BY lang"""


def readiness_gates(spark, sf):
    checks = {
        "enough_rows": F.count("*") >= 100, "balanced": F.avg("quality") >= 0.2, "has_toxic": F.max("toxic") == 1, "unique_ids": F.count_distinct("doc_id") == F.count("*"),
    }
    return E.gates(table(spark, sf, "labels"), checks)


GATES = """SELECT (SELECT count(*) FROM labels) >= 100 AS enough_rows, (SELECT count(*) FROM labels WHERE quality = 1) * 5 >= (SELECT count(quality) FROM labels) AS balanced,
 EXISTS (SELECT 1 FROM labels WHERE toxic = 1) AS has_toxic, NOT EXISTS (SELECT 1 FROM labels GROUP BY doc_id HAVING count(*) > 1) AS unique_ids"""


def latest_weeks_gate(spark, sf):
    return E.latest_weeks_gate(table(spark, sf, "events"), "event_type", "ts", F.coalesce("value", F.lit(0.0)), 10, 3)


WEEKS = """WITH w AS (SELECT event_type, isoyear(ts) * 100 + weekofyear(ts) AS wk, sum(coalesce(value, 0)) / count(*) AS v FROM events GROUP BY ALL),
 l AS (SELECT event_type, array_agg(v ORDER BY wk DESC)[1:3] AS v FROM w GROUP BY 1) SELECT event_type, list_min(v) > 10 AS passes, len(v) AS weeks FROM l"""


def paired_outcomes(spark, sf):
    before = table(spark, sf, "orders").select("o_orderkey", F.substring("o_orderpriority", 1, 1).cast("long").alias("x"))
    after = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("x"))
    return E.paired_outcomes(before, after, "o_orderkey", "x")


RUNS = """SELECT o_orderkey, CASE sign(coalesce(items, prio) - prio) WHEN 1 THEN 'better' WHEN -1 THEN 'worse' ELSE 'same' END AS outcome FROM (SELECT o_orderkey, left(o_orderpriority, 1)::INT AS prio,
 (SELECT nullif(count(*), 0) FROM lineitem WHERE l_orderkey = o_orderkey) AS items FROM orders)"""


def allowed_values(spark, sf):
    return E.allowed_values(table(spark, sf, "documents"), "source", "lang", 3)


ALLOWED = """SELECT DISTINCT lang, source AS value, n FROM (SELECT lang, source, count(*) OVER (PARTITION BY lang, source) AS n FROM documents WHERE source IS NOT NULL) WHERE n >= 3"""


def observable_fields(spark, sf):
    return E.observable_fields(table(spark, sf, "documents"), "text", ["lang", "source"])


_WORDS = "regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+')"
OBSERVED = " UNION ALL ".join(
    f"SELECT '{f}' AS field, count({f}) AS n, count(*) FILTER (list_contains({_WORDS}, lower({f}))) AS observed FROM documents HAVING count({f}) > 0" for f in ("lang", "source")
)

NAMES = (
    "weekly_shadow field_accuracy risk_coverage confidence_bins group_macro class_imbalance top_values gold_alignment relevant_sets run_status error_taxonomy "
    "field_overlap frequency_buckets leakage_audit partition_digest readiness_gates latest_weeks_gate paired_outcomes allowed_values observable_fields"
).split()
QUERIES = {name: globals()[name] for name in NAMES}
ORACLES = dict(
    zip(NAMES, [WEEKLY, FIELD, RISK, BINS, GROUP, IMBALANCE, TOP, ALIGN, RELEVANT, STATUS, ERRORS, FIELDS, BUCKETS, LEAK, DIGEST, GATES, WEEKS, RUNS, ALLOWED, OBSERVED])
)
