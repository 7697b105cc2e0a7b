"""Code-structure, streaming and model queries. Documents stand for files (path from source and id), pages for mentioned paths."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallygrove.operators import code as K
from tallygrove.operators import models as M
from tallygrove.operators.routing import hash_fold
from tallygrove.plans.metrics import EMB, embedding_ranks
from tallygrove.plans.temporal import reports
from tallygrove.session import table
from tallygrove.streaming import events as S


def code_windows(spark, sf):
    w = K.windows(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text", 12, 4)
    return w.select("doc_id", "start_line", "end_line", F.md5("chunk").alias("digest"))


WINDOWS = """WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
 w AS (SELECT doc_id, l, unnest(range(0, greatest(ceil((len(l) - 4) / 8) - 1, 0)::BIGINT + 1)) * 8 + 1 AS s FROM l)
 SELECT doc_id, s AS start_line, least(s + 11, len(l)) AS end_line, md5(array_to_string(l[s:s + 11], chr(10))) AS digest FROM w"""


def graph_one_hop(spark, sf):
    """Bonus of parts one edge from each customer's five dearest orders, edges being all line items; orders with more than six parts are hubs and give none."""
    o = table(spark, sf, "orders").select("o_custkey", F.col("o_orderkey").alias("file"), "o_totalprice")
    rank = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "file"))
    edges = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("source"), F.col("l_partkey").alias("target")).distinct()
    return K.one_hop(o.withColumn("rank", rank), edges, "o_custkey", "file", "rank", top=5, hub=6)


ONE_HOP = """WITH e AS (SELECT DISTINCT l_orderkey AS source, l_partkey AS target FROM lineitem), d AS (SELECT source FROM e GROUP BY 1 HAVING count(*) <= 6),
 r AS (SELECT o_custkey, o_orderkey AS file, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders)
 SELECT o_custkey, e.target AS file, least(0.08, 0.08 * max(1 - 0.08 * (rank - 1))) AS bonus FROM r JOIN e ON r.file = e.source JOIN d ON d.source = e.source WHERE rank <= 5 GROUP BY ALL"""


def path_suffix(spark, sf):
    """Page addresses with the documents whose path they end with."""
    p = table(spark, sf, "pages").select("page_id", F.concat(F.lit("src"), (F.col("page_id") % 20).cast("string"), F.lit("/"), F.col("page_id").cast("string"), F.lit(".txt")).alias("said"))
    f = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("tree/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"))
    return K.suffix_match(p, f, "said", "path").select("page_id", "doc_id", "path")


SUFFIX = """SELECT page_id, doc_id, path FROM (SELECT page_id, 'src' || page_id % 20 || '/' || page_id || '.txt' AS said FROM pages)
 JOIN (SELECT doc_id, 'tree/' || source || '/' || doc_id || '.txt' AS path FROM documents) ON path LIKE '%/' || said"""


def line_symbols(spark, sf):
    """Events as changed lines (minute of the day) of users' files, error events as symbols that span an hour."""
    ev = table(spark, sf, "events")
    minute = (F.hour("ts") * 60 + F.minute("ts")).cast("int")
    lines = ev.where("event_type <> 'error'").select("event_id", F.col("user_id").alias("path"), minute.alias("line"), F.lit(False).alias("new_file"))
    spans = ev.where("event_type = 'error'").select(F.col("user_id").alias("path"), minute.alias("line"), (minute + 20 + F.col("event_id") % 40).cast("int").alias("end_line"), F.col("event_id").cast("string").alias("symbol_id"))
    return K.lines_in_symbols(lines, spans, "event_id").groupBy("path", "state").agg(F.count("*").alias("n"), F.min("symbol_id").alias("first_symbol"))


LINES = """WITH l AS (SELECT event_id, user_id AS path, (hour(ts) * 60 + minute(ts))::INT AS line, event_type FROM events),
 s AS (SELECT path, line AS a, line + 20 + event_id % 40 AS b, event_id::VARCHAR AS sid FROM l WHERE event_type = 'error'),
 m AS (SELECT l.event_id, l.path, l.line, b - a AS n, sid, min(b - a) OVER (PARTITION BY l.event_id) AS mn FROM l LEFT JOIN s ON l.path = s.path AND l.line BETWEEN a AND b WHERE event_type <> 'error'),
 g AS (SELECT event_id, path, CASE WHEN max(mn) IS NULL THEN 'module' WHEN count(*) FILTER (n = mn) > 1 THEN 'ambiguous' ELSE 'symbol' END AS state, max(sid) FILTER (n = mn) AS sid FROM m GROUP BY ALL)
 SELECT path, state, count(*) AS n, min(CASE WHEN state = 'symbol' THEN sid END) AS first_symbol FROM g GROUP BY ALL"""


def file_aggregation(spark, sf):
    """Ranked vectors as chunks of files (id modulo 25): best chunk plus support, twenty files a query."""
    r = embedding_ranks(spark, sf).withColumn("file", F.col("item_id") % 25)
    return K.file_scores(r, "query_id", "file", "score")


FILES = f"""WITH {EMB}, g AS (SELECT query_id, item_id % 25 AS file, count(*) AS chunks, round(max(score) + least(0.04, 0.015 * (count(*) - 1)), 9) AS score FROM ranks GROUP BY ALL)
 SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, file) AS rank FROM g) WHERE rank <= 20"""


def coverage_quota(spark, sf):
    r = embedding_ranks(spark, sf).withColumn("file", F.col("item_id") % 4)
    return K.coverage_selection(r, "query_id", "item_id", "file", "score", 2, 6).select("query_id", "item_id", "place")


QUOTA = f"""WITH {EMB}, c AS (SELECT *, row_number() OVER (PARTITION BY query_id, item_id % 4 ORDER BY score DESC, item_id) AS n FROM ranks),
 p AS (SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY n, score DESC, item_id) AS place FROM c WHERE n <= 2) SELECT * FROM p WHERE place <= 6"""


def _stream(spark, sf):
    schema = table(spark, sf, "events").schema
    read = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(f"{sf}/events.parque[t]")
    return read.withColumn("ts", F.col("ts").cast("timestamp"))


def stream_replay(spark, sf):
    """Daily counts by type from a stream run to its end; days still open behind the watermark aren't given."""
    return S.replay(spark, _stream(spark, sf), S.windowed_counts).withColumn("day", F.col("day").cast("timestamp_ntz"))


STREAM = """WITH e AS (SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY ALL)
 SELECT day, event_type, n, total FROM e WHERE day + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 2 DAY FROM events)"""


def stream_latest(spark, sf):
    got = S.latest_state(spark, _stream(spark, sf), ["user_id"], ["ts", "event_id"])
    return got.select("user_id", "event_id", "event_type", "value")


LATEST = "SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1"


def stream_dedup(spark, sf):
    """Shadow events deduplicated by (user, payload) within a watermark longer than the period."""
    got = S.replay(spark, _stream(spark, sf), lambda s: S.deduplicated(s, ["user_id", "props"], "60 days"))
    return got.groupBy("user_id").agg(F.count("*").alias("n"), F.count_distinct("props").alias("payloads"))


DEDUP = "SELECT user_id, count(DISTINCT props) AS n, count(DISTINCT props) AS payloads FROM events GROUP BY 1"


def rolling_replay(spark, sf):
    """Weekly windows of all orders against line items shipped by each window's first order."""
    q = reports(spark, sf).select(F.col("report_id"), F.col("author").alias("key"), F.col("created_at").alias("at"))
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("key"))
    h = table(spark, sf, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("key", F.col("l_shipdate").alias("available_at"))
    first, last = (F.date_trunc("day", f("at")).cast("timestamp_ntz") for f in (F.min, F.max))
    span = q.agg(first.alias("first"), last.alias("last"))
    w = span.select("first", F.explode(F.sequence(F.lit(0), F.floor(F.datediff("last", "first") / 7).cast("int"))).alias("id")).select(
        F.concat(F.lit("w"), F.col("id").cast("string")).alias("name"), (F.col("first") + F.make_dt_interval(F.col("id") * 7)).alias("start"),
        (F.col("first") + F.make_dt_interval(F.col("id") * 7 + 7)).alias("end"),
    )
    return S.rolling_replay(h, q, w, "key").select("name", "queries", "usable", "overlapping")


ROLL = """WITH b AS (SELECT date_trunc('day', min(o_orderdate))::TIMESTAMP AS b, date_trunc('day', max(o_orderdate))::TIMESTAMP AS z FROM orders),
 w AS (SELECT 'w' || k AS name, b + to_days((k * 7)::INT) AS s, b + to_days((k * 7 + 7)::INT) AS e FROM (SELECT b, unnest(range(0, date_diff('day', b, z) // 7 + 1)) AS k FROM b)),
 q AS (SELECT name, o_custkey AS key, o_orderdate AS placed FROM orders JOIN w ON o_orderdate >= s AND o_orderdate < e), f AS (SELECT name, min(placed) AS first_at, count(*) AS queries FROM q GROUP BY 1),
 h AS (SELECT o_custkey AS key, l_shipdate AS shipped FROM lineitem JOIN orders ON l_orderkey = o_orderkey), k AS (SELECT key, min(shipped) AS shipped FROM h GROUP BY 1),
 u AS (SELECT name, count(*) AS usable FROM f JOIN h ON shipped <= first_at GROUP BY 1),
 o AS (SELECT name, count(*) AS overlapping FROM q JOIN f USING (name) JOIN k USING (key) WHERE shipped <= first_at GROUP BY 1)
 SELECT name, queries, coalesce(usable, 0) AS usable, coalesce(overlapping, 0) AS overlapping FROM f LEFT JOIN u USING (name) LEFT JOIN o USING (name)"""


def priority_fit(spark, sf):
    """Priority classifier on assembled features: confusion of held-out authors."""
    from tallygrove.plans.temporal import activity_features

    r = reports(spark, sf).join(activity_features(spark, sf).drop("author", "priority"), "report_id").na.fill(0)
    r = r.withColumns({"label": (F.col("priority") - 1).cast("double"), "fold": hash_fold(F.col("author"), 5)}).cache()
    train = M.balanced_weights(r.where("fold > 0"), "label")
    stages = M.assembly(["status"], ["cost", "prior_count", "prior_mean", "n_30d", "n_90d"])
    model = M.fit(train, stages, M.classifier("logistic"))
    said = model.transform(r.where("fold = 0"))
    return said.groupBy(F.col("priority").alias("actual"), (F.col("prediction") + 1).cast("int").alias("said")).agg(F.count("*").alias("n"))


def ltr_fit(spark, sf):
    """Pairwise ranker on neighbours: the fitted weights score every pair by a column expression."""
    r = embedding_ranks(spark, sf).withColumns({"rel": (F.col("label") == F.col("query_label")).cast("int"), "parity": (F.col("item_id") % 2 == F.col("query_id") % 2).cast("double")})
    names = ["score", "parity"]
    pairs = M.pair_differences(r, "query_id", names, "rel", "rank")
    model = M.fit(pairs, [_vector(names)], M.classifier("logistic"))
    fitted = model.stages[-1]
    s = M.portable(list(fitted.coefficients), 0.0, names)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("s"), "item_id"))
    return r.withColumn("s", s).select("query_id", "item_id", "rel", rank.alias("new_rank"))


def _vector(names):
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=names, outputCol="features")


def calibrated_scores(spark, sf):
    """Isotonic and logistic calibration of a rule's probability of quality, by ten bins."""
    from tallygrove.plans.metrics import predictions

    p = predictions(spark, sf).withColumn("y", F.col("quality").cast("double"))
    iso = M.isotonic(p, "p", "y").transform(p)
    both = M.positive(M.platt(p, "p", "y").transform(iso), "platt")
    return both.groupBy(F.least(F.floor(F.col("p") * 10), F.lit(9)).alias("bin")).agg(F.count("*").alias("n"), F.avg("calibrated").alias("isotonic"), F.avg("platt").alias("platt"), F.avg("y").alias("rate"))


QUERIES = {
    "code_windows": code_windows, "graph_one_hop": graph_one_hop, "path_suffix": path_suffix, "line_symbols": line_symbols, "file_aggregation": file_aggregation,
    "coverage_quota": coverage_quota, "stream_replay": stream_replay, "stream_latest": stream_latest, "stream_dedup": stream_dedup, "rolling_replay": rolling_replay,
    "priority_fit": priority_fit, "ltr_fit": ltr_fit, "calibrated_scores": calibrated_scores,
}
ORACLES = {
    "code_windows": WINDOWS, "graph_one_hop": ONE_HOP, "path_suffix": SUFFIX, "line_symbols": LINES, "file_aggregation": FILES, "coverage_quota": QUOTA,
    "stream_replay": STREAM, "stream_latest": LATEST, "stream_dedup": DEDUP, "rolling_replay": ROLL,
}
