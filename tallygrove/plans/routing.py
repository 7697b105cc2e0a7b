"""Owner routing over lineitem / part / orders (owner = supplier, component = brand, product = type), splits and feedback."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallygrove.operators import routing as R
from tallygrove.plans.metrics import EMB, EMB_ALL, embedding_ranks, vector_search
from tallygrove.plans.temporal import CUT, HISTORY, REPORTS, owner_history, reports
from tallygrove.session import materialize, table

_CUT = f"TIMESTAMP '{CUT}'"


def owner_counts(spark, sf):
    return R.owner_counts(owner_history(spark, sf))


OWNER_COUNTS = f"""WITH {HISTORY} SELECT CASE grouping(component) * 2 + grouping(product) WHEN 0 THEN 'pair' WHEN 1 THEN 'component' WHEN 2 THEN 'product' ELSE 'global' END AS level,
 owner, component, product, count(*) AS n FROM history GROUP BY GROUPING SETS ((owner, component, product), (owner, component), (owner, product), (owner))"""


def ownership_derive(spark, sf):
    return R.dominant_owner(owner_history(spark, sf), ["component", "product"], "owner", 2, 0.02)


OWNERSHIP = f"""WITH {HISTORY}, c AS (SELECT component, product, owner, count(*) AS n FROM history GROUP BY ALL),
 r AS (SELECT *, row_number() OVER (PARTITION BY component, product ORDER BY n DESC, owner) AS rn, sum(n) OVER (PARTITION BY component, product) AS t FROM c)
 SELECT component, product, owner, n AS support, n / t AS share FROM r WHERE rn = 1 AND n >= 2 AND n / t >= 0.02"""


def roster_snapshot(spark, sf):
    return R.roster(owner_history(spark, sf), "owner", "available_at", F.lit(CUT).cast("timestamp_ntz"))


_AGE = f"((epoch_us({_CUT}) - epoch_us(available_at)) // 86400000000)"
ROSTER = f"""WITH {HISTORY}, g AS (SELECT owner, count(*) AS n, count(*) FILTER ({_AGE} < 90) AS n_active, count(*) FILTER ({_AGE} < 365) AS n_dormant, max(available_at) AS last_seen
 FROM history WHERE available_at < {_CUT} GROUP BY owner)
 SELECT *, CASE WHEN n_active > 0 THEN 'active' WHEN n_dormant > 0 THEN 'inactive' ELSE 'dormant' END AS status FROM g"""


def owner_shares(spark, sf):
    """Component share of each owner smoothed to the owner's global share, with log features."""
    h = owner_history(spark, sf)
    g = h.groupBy("owner").agg(F.count("*").alias("n_all"))
    total = h.count()
    c = h.groupBy("component", "owner").agg(F.count("*").alias("n"))
    t = h.groupBy("component").agg(F.count("*").alias("t"))
    m = c.join(g, "owner").join(t, "component")
    return m.select("component", "owner", "n", R.smoothed_share(F.col("n"), F.col("t"), F.col("n_all") / total).alias("share"), F.log1p("n").alias("log_n"))


SHARES = f"""WITH {HISTORY}, g AS (SELECT owner, count(*) AS n_all FROM history GROUP BY 1), t AS (SELECT component, count(*) AS t FROM history GROUP BY 1), c AS (SELECT component, owner, count(*) AS n FROM history GROUP BY ALL)
 SELECT component, owner, n, (n + 5.0 * n_all / (SELECT count(*) FROM history)) / (t + 5.0) AS share, ln(1 + n) AS log_n FROM c JOIN g USING (owner) JOIN t USING (component)"""

QUOTAS = {"pair": 2, "component": 3, "recent": 2, "global": 1}


def _sources(spark, sf):
    """(query = component, owner, source, score) from four kinds of evidence."""
    h = owner_history(spark, sf)
    comp = h.groupBy("component", "owner").agg(F.count("*").alias("n"))
    recent = h.where(F.col("available_at") >= F.lit("1998-01-01").cast("timestamp_ntz")).groupBy("component", "owner").agg(F.count("*").alias("n"))
    pair = h.groupBy("component", "product", "owner").agg(F.count("*").alias("n")).groupBy("component", "owner").agg(F.max("n").alias("n"))
    every = h.groupBy("owner").agg(F.count("*").alias("n")).join(F.broadcast(h.select("component").distinct()))
    out = None
    for name, part in (("pair", pair), ("component", comp), ("recent", recent), ("global", every)):
        one = part.select("component", "owner", F.lit(name).alias("source"), F.col("n").cast("double").alias("score"))
        out = one if out is None else out.unionByName(one)
    return out


def quota_candidates(spark, sf):
    return R.quota_pool(_sources(spark, sf), "component", "owner", "source", "score", QUOTAS, 12)


QUOTA = f"""WITH {HISTORY}, s AS (
 SELECT component, owner, 'pair' AS source, 1 AS o, 2 AS q, max(n) AS score FROM (SELECT component, product, owner, count(*) AS n FROM history GROUP BY ALL) GROUP BY component, owner
 UNION ALL SELECT component, owner, 'component', 2, 3, count(*) FROM history GROUP BY component, owner
 UNION ALL SELECT component, owner, 'recent', 3, 2, count(*) FROM history WHERE available_at >= TIMESTAMP '1998-01-01' GROUP BY component, owner
 UNION ALL SELECT component, owner, 'global', 4, 1, n FROM (SELECT owner, count(*) AS n FROM history GROUP BY 1), (SELECT DISTINCT component FROM history)),
 r AS (SELECT *, row_number() OVER (PARTITION BY component, source ORDER BY score DESC, owner) AS rn FROM s),
 b AS (SELECT component, owner, max(score)::DOUBLE AS score, arg_min(source, o) FILTER (rn <= q) AS src FROM r GROUP BY ALL),
 p AS (SELECT *, row_number() OVER (PARTITION BY component ORDER BY src IS NULL, score DESC, owner) AS place FROM b)
 SELECT component, owner, score, coalesce(src, 'backfill') AS from_source, place FROM p WHERE place <= 12"""


def _scored(spark, sf):
    """Best and second owner of each (component, product), with signals and the share that the best has."""
    h = owner_history(spark, sf)
    c = h.groupBy("component", "product", "owner").agg(F.count("*").cast("double").alias("n"))
    one = F.struct("n", (-F.col("owner")).alias("o"))
    keys = ["component", "product"]
    best_ = c.groupBy(*keys).agg(F.max(one).alias("b"), F.sum("n").alias("total"), F.count("*").alias("owners"))
    # Two maxima, so that no group's owners are gathered.
    other = c.join(best_.select(*keys, F.col("b.o").alias("_o")), keys).where(-F.col("owner") != F.col("_o")).groupBy(*keys).agg(F.max(one).alias("s"))
    top = best_.join(other, keys, "left").withColumn("t", F.array("b", "s"))
    best, second = F.get("t", F.lit(0)), F.get("t", F.lit(1))
    return top.select(
        "component", "product", (-best["o"]).alias("owner"), best["n"].alias("s1"), second["n"].alias("s2"), "total", "owners",
        R.owner_confidence(best["n"], second["n"], F.least(F.col("owners"), F.lit(4))).alias("confidence"),
    )


SCORED = f"""{HISTORY}, oc AS (SELECT component, product, owner, count(*)::DOUBLE AS n FROM history GROUP BY ALL),
 rk AS (SELECT *, row_number() OVER (PARTITION BY component, product ORDER BY n DESC, owner) AS rn FROM oc),
 sc AS (SELECT component, product, max(owner) FILTER (rn = 1) AS owner, max(n) FILTER (rn = 1) AS s1, max(n) FILTER (rn = 2) AS s2, sum(n) AS total, count(*) AS owners FROM rk GROUP BY ALL),
 scored AS (SELECT *, least(0.95, greatest(0.35, 0.55 + 0.30 * (s1 - coalesce(s2, 0)) / s1 + least(0.20, 0.05 * least(owners, 4)))) AS confidence FROM sc)"""


def routing_ladder(spark, sf):
    s = _scored(spark, sf)
    status = R.route(F.col("confidence"), F.col("s1") >= 2, F.col("owners"), 0.85, 0.7)
    cal = R.piecewise(F.col("confidence"), [(0.35, 0.1), (0.6, 0.4), (0.8, 0.75), (0.95, 0.95)])
    risk = F.least(F.lit(1.0), F.when(F.col("s1") < 2, 0.25).otherwise(0.0) + F.when(F.col("owners") < 3, 0.15).otherwise(0.0))
    return s.select("component", "product", "owner", "confidence", cal.alias("calibrated"), risk.alias("novelty_risk"), status.alias("status"))


LADDER = f"""WITH {SCORED} SELECT component, product, owner, confidence, CASE WHEN confidence <= 0.35 THEN 0.1 WHEN confidence < 0.6 THEN 0.1 + (confidence - 0.35) * 0.3 / 0.25
 WHEN confidence < 0.8 THEN 0.4 + (confidence - 0.6) * 0.35 / 0.2 WHEN confidence < 0.95 THEN 0.75 + (confidence - 0.8) * 0.2 / 0.15 ELSE 0.95 END AS calibrated,
 least(1.0, CASE WHEN s1 < 2 THEN 0.25 ELSE 0 END + CASE WHEN owners < 3 THEN 0.15 ELSE 0 END) AS novelty_risk,
 CASE WHEN s1 < 2 THEN 'manual_unknown' WHEN owners < 2 THEN 'manual_thin' WHEN confidence >= 0.85 THEN 'auto' WHEN confidence >= 0.7 THEN 'confirm_top3' ELSE 'manual' END AS status FROM scored"""


def policy_grid(spark, sf):
    s = _scored(spark, sf).withColumn("ok", (F.col("s1") * 40 > F.col("total")).cast("int"))
    return R.policy_grid(s, "confidence", "ok", least_accuracy=0.5)


POLICY = f"""WITH {SCORED}, c AS (SELECT least(floor(confidence * 60), 60) AS c, count(*) AS n, sum((s1 * 40 > total)::INT) AS k FROM scored GROUP BY 1),
 g AS (SELECT c / 60 AS threshold, sum(n) OVER (ORDER BY c DESC) / sum(n) OVER () AS coverage, sum(k) OVER (ORDER BY c DESC) / sum(n) OVER (ORDER BY c DESC) AS accuracy FROM c)
 SELECT * FROM g WHERE accuracy >= 0.5 ORDER BY coverage DESC, threshold LIMIT 1"""


def routing_metrics(spark, sf):
    return routing_ladder(spark, sf).groupBy("status").agg(F.count("*").alias("n"), F.avg("confidence").alias("confidence"), F.avg("novelty_risk").alias("risk"))


METRICS = f"WITH l AS ({LADDER}) SELECT status, count(*) AS n, avg(confidence) AS confidence, avg(novelty_risk) AS risk FROM l GROUP BY 1"


def owner_known_groups(spark, sf):
    """Seen, rare and unseen owners of rows after the cut-off."""
    h = owner_history(spark, sf)
    cut = F.lit(CUT).cast("timestamp_ntz")
    train = h.where(F.col("available_at") < cut).groupBy("owner", "component").agg(F.count("*").alias("n"))
    m = h.where(F.col("available_at") >= cut).join(train, ["owner", "component"], "left")
    g = F.when(F.coalesce("n", F.lit(0)) == 0, "unseen").when(F.col("n") < 3, "rare").otherwise("seen")
    return m.groupBy(g.alias("known"), "component").agg(F.count("*").alias("rows"), F.countDistinct("owner").alias("owners"))


KNOWN = f"""WITH {HISTORY}, t AS (SELECT owner, component, count(*) AS n FROM history WHERE available_at < {_CUT} GROUP BY ALL)
 SELECT CASE WHEN coalesce(n, 0) = 0 THEN 'unseen' WHEN n < 3 THEN 'rare' ELSE 'seen' END AS known, component, count(*) AS rows, count(DISTINCT owner) AS owners
 FROM history LEFT JOIN t USING (owner, component) WHERE available_at >= {_CUT} GROUP BY ALL"""


def metadata_rerank(spark, sf):
    """Embedding ranks with a bonus for equal metadata (label parity as component, id group as product)."""
    r = embedding_ranks(spark, sf)
    bonus = F.when(F.col("label") == F.col("query_label"), 0.02).otherwise(0.0) + F.when(F.col("item_id") % 5 == F.col("query_id") % 5, 0.01).otherwise(0.0)
    s = r.withColumn("final", F.round(F.col("score") + bonus, 6))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("final"), "item_id"))
    return s.select("query_id", "item_id", "final", rank.alias("new_rank"))


RERANK = f"""WITH {EMB}, s AS (SELECT query_id, item_id, round(score + CASE WHEN label = query_label THEN 0.02 ELSE 0 END + CASE WHEN item_id % 5 = query_id % 5 THEN 0.01 ELSE 0 END, 6) AS final FROM ranks)
 SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final DESC, item_id) AS new_rank FROM s"""


def stable_rerank(spark, sf):
    r = embedding_ranks(spark, sf).withColumns({"lex": (F.col("item_id") * 7 % 101).cast("double"), "meta": (F.col("label") == F.col("query_label")).cast("double")})
    return R.stable_blend(r, "query_id", "item_id", "score", "lex", "meta").select("query_id", "item_id", "blend")


BLEND = f"""WITH {EMB}, x AS (SELECT *, (item_id * 7 % 101)::DOUBLE AS lex, (label = query_label)::INT AS meta FROM ranks),
 m AS (SELECT *, min(score) OVER w AS a, max(score) OVER w AS b, min(lex) OVER w AS c, max(lex) OVER w AS d, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS r1, row_number() OVER (PARTITION BY query_id ORDER BY lex DESC, item_id) AS r2 FROM x WINDOW w AS (PARTITION BY query_id))
 SELECT query_id, item_id, 0.54 * CASE WHEN b > a THEN (score - a) / (b - a) ELSE 1 END + 0.30 * CASE WHEN d > c THEN (lex - c) / (d - c) ELSE 1 END + 0.08 * meta + 0.08 * greatest(0, 1 - abs(r1 - r2) / 50) AS blend FROM m"""


def hash_folds(spark, sf):
    """Folds by author, so that a group is never split, and rollout buckets."""
    r = reports(spark, sf)
    return r.select("report_id", R.hash_fold(F.col("author"), 5).alias("fold"), R.hash_bucket(F.col("report_id")).alias("bucket"))


_HB = "('0x' || substr(sha256(trim({})), 1, 8))::BIGINT % {}"
FOLDS = f"WITH {REPORTS} SELECT report_id, ({_HB.format(chr(39) + 'fold|' + chr(39) + ' || author', 5)})::INT AS fold, {_HB.format('report_id::VARCHAR', 10000)} AS bucket FROM reports"


def stratified_holdout(spark, sf):
    return R.stratified_take(reports(spark, sf), "priority", "report_id", 100).select("report_id", "priority")


STRATIFIED = f"""WITH {REPORTS} SELECT report_id, priority FROM (SELECT report_id, priority, row_number() OVER (PARTITION BY priority ORDER BY sha256('take|' || report_id), report_id) AS rn FROM reports) WHERE rn <= 100"""


def triplets_hard(spark, sf):
    """Anchor, nearest positive and nearest negative of each query vector, of all vectors."""
    nearest = lambda cond: F.max(F.when(cond, F.struct("score", (-F.col("item_id")).alias("i"))))
    found = vector_search(spark, sf).nearest(1, by_label=True)
    best = found.groupBy("query_id").agg(nearest(F.col("same")).alias("p"), nearest(~F.col("same")).alias("n")).where("p IS NOT NULL AND n IS NOT NULL")
    return best.select(F.col("query_id").alias("anchor"), (-F.col("p.i")).alias("positive"), (-F.col("n.i")).alias("negative"))


TRIPLETS = f"""WITH {EMB_ALL} SELECT query_id AS anchor, arg_min(item_id, rank) FILTER (label = query_label) AS positive, arg_min(item_id, rank) FILTER (label <> query_label) AS negative
 FROM ranks GROUP BY 1 HAVING positive IS NOT NULL AND negative IS NOT NULL"""


def pairwise_rows(spark, sf):
    """The nearest positive with at most ten hardest negatives, of all vectors, mirrored, weighted by 1 / sqrt(rank among all)."""
    search = vector_search(spark, sf)
    found = search.nearest(10, by_label=True)
    best = found.where("same").groupBy("query_id").agg(F.max("score").alias("best"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id"))
    n = found.where("not same").withColumn("place", place).where("place <= 10").join(best.where("best is not null"), "query_id")
    n = materialize(n.select("query_id", "item_id", "score", "place", "best"), "negatives")
    # The rank among all counts the positives before each negative, wherever they are.
    m = n.join(search.ahead(n), ["query_id", "item_id"])
    m = m.select("query_id", "item_id", (F.col("best") - F.col("score")).alias("diff"), (1 / F.sqrt(F.col("place") + F.col("ahead"))).alias("weight"))
    one = m.select("query_id", "item_id", "diff", F.lit(1).alias("target"), "weight")
    return one.unionByName(m.select("query_id", "item_id", (-F.col("diff")).alias("diff"), F.lit(0).alias("target"), "weight"))


PAIRWISE = f"""WITH {EMB_ALL}, p AS (SELECT query_id, max(score) AS best FROM ranks WHERE label = query_label GROUP BY 1),
 n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM ranks WHERE label <> query_label),
 m AS (SELECT query_id, item_id, best - score AS diff, 1 / sqrt(rank) AS weight FROM n JOIN p USING (query_id) WHERE place <= 10)
 SELECT query_id, item_id, diff, 1 AS target, weight FROM m UNION ALL SELECT query_id, item_id, -diff, 0, weight FROM m"""


def latest_feedback(spark, sf):
    """Latest event of each user and type."""
    ev = table(spark, sf, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return R.latest_by_key(ev, ["user_id", "event_type"], ["ts", "event_id"])


LATEST = "SELECT user_id, event_type, ts, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1"


def feedback_override(spark, sf):
    """History of orders where line items' feedback replaces the customer by the supplier."""
    hist = table(spark, sf, "orders").select(F.col("o_orderkey").alias("ticket"), F.col("o_custkey").alias("owner"))
    fb = table(spark, sf, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("ticket")).agg(F.min("l_suppkey").alias("owner"))
    return R.override_union(hist, fb, "ticket")


OVERRIDE = """WITH fb AS (SELECT l_orderkey AS ticket, min(l_suppkey) AS owner FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
 SELECT o_orderkey AS ticket, o_custkey AS owner FROM orders WHERE o_orderkey NOT IN (SELECT ticket FROM fb) UNION ALL SELECT * FROM fb"""


def priority_score(spark, sf):
    """Six-factor priority score of orders and its P1-P5 band."""
    r = reports(spark, sf)
    clip = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    s = (
        0.24 * clip(F.col("cost") / 400000) + 0.10 * (F.month("created_at") / 12) + 0.08 * ((F.col("author") % 10) / 10)
        + 0.18 * ((F.col("report_id") % 7) / 7) + 0.28 * ((5 - F.col("priority")) / 4) + 0.12 * F.when(F.col("status") == "O", 1.0).otherwise(0.0)
    )
    band = F.when(s >= 0.85, "P1").when(s >= 0.65, "P2").when(s >= 0.40, "P3").when(s >= 0.20, "P4").otherwise("P5")
    return r.groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.avg(s).alias("score"))


SCORE6 = f"""WITH {REPORTS}, s AS (SELECT 0.24 * least(1.0, greatest(0.0, cost / 400000)) + 0.10 * (month(created_at)::DOUBLE / 12) + 0.08 * ((author % 10)::DOUBLE / 10) + 0.18 * ((report_id % 7)::DOUBLE / 7) + 0.28 * ((5 - priority)::DOUBLE / 4) + 0.12 * (status = 'O')::INT AS s FROM reports)
 SELECT CASE WHEN s >= 0.85 THEN 'P1' WHEN s >= 0.65 THEN 'P2' WHEN s >= 0.40 THEN 'P3' WHEN s >= 0.20 THEN 'P4' ELSE 'P5' END AS band, count(*) AS n, avg(s) AS score FROM s GROUP BY 1"""


def label_masking(spark, sf):
    from tallygrove.operators.cleaning import masked

    return table(spark, sf, "supplier").select("s_suppkey", masked(F.col("s_suppkey")).alias("masked"))


def rank_union(spark, sf):
    """Full outer union of the embedding ranking and its reverse by id, with labels of where a pair came from."""
    r = embedding_ranks(spark, sf)
    a = r.where("rank <= 6").select("query_id", "item_id", F.col("score").alias("a"))
    b = r.where("item_id % 2 = 0").select("query_id", "item_id", F.col("score").alias("b"))
    m = a.join(b, ["query_id", "item_id"], "full_outer")
    side = F.when(F.col("a").isNull(), "second").when(F.col("b").isNull(), "first").otherwise("both")
    return m.select("query_id", "item_id", F.coalesce("a", F.lit(0.0)).alias("a"), F.coalesce("b", F.lit(0.0)).alias("b"), side.alias("side"))


UNION = f"""WITH {EMB}, a AS (SELECT query_id, item_id, score AS a FROM ranks WHERE rank <= 6), b AS (SELECT query_id, item_id, score AS b FROM ranks WHERE item_id % 2 = 0)
 SELECT query_id, item_id, coalesce(a, 0) AS a, coalesce(b, 0) AS b, CASE WHEN a IS NULL THEN 'second' WHEN b IS NULL THEN 'first' ELSE 'both' END AS side FROM a FULL JOIN b USING (query_id, item_id)"""


def eviction_plan(spark, sf):
    """Documents beyond a budget of 50,000 characters of their source, newest first."""
    from tallygrove.operators.temporal import running_total

    d = table(spark, sf, "documents").select("doc_id", "source", "n_chars").withColumn("_new", -F.col("doc_id"))
    held = running_total(d, ["_new"], F.floor(F.col("_new") / 1000), {"held": F.col("n_chars")}, keys=["source"])
    return held.where("held > 50000").select("doc_id", "n_chars")


EVICT = """WITH s AS (SELECT doc_id, n_chars, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id DESC) AS held FROM documents) SELECT doc_id, n_chars FROM s WHERE held > 50000"""


QUERIES = {
    "owner_counts": owner_counts, "ownership_derive": ownership_derive, "roster_snapshot": roster_snapshot, "owner_shares": owner_shares,
    "quota_candidates": quota_candidates, "routing_ladder": routing_ladder, "policy_grid": policy_grid, "routing_metrics": routing_metrics,
    "owner_known_groups": owner_known_groups, "metadata_rerank": metadata_rerank, "stable_rerank": stable_rerank, "hash_folds": hash_folds,
    "stratified_holdout": stratified_holdout, "triplets_hard": triplets_hard, "pairwise_rows": pairwise_rows, "latest_feedback": latest_feedback,
    "feedback_override": feedback_override, "priority_score": priority_score, "label_masking": label_masking, "rank_union": rank_union,
    "eviction_plan": eviction_plan,
}
ORACLES = {
    "owner_counts": OWNER_COUNTS, "ownership_derive": OWNERSHIP, "roster_snapshot": ROSTER, "owner_shares": SHARES, "quota_candidates": QUOTA,
    "routing_ladder": LADDER, "policy_grid": POLICY, "routing_metrics": METRICS, "owner_known_groups": KNOWN, "metadata_rerank": RERANK,
    "stable_rerank": BLEND, "hash_folds": FOLDS, "stratified_holdout": STRATIFIED, "triplets_hard": TRIPLETS, "pairwise_rows": PAIRWISE,
    "latest_feedback": LATEST, "feedback_override": OVERRIDE, "priority_score": SCORE6,
    "label_masking": "SELECT s_suppkey, 'owner_' || substr(sha256('owner|' || s_suppkey), 1, 12) AS masked FROM supplier", "rank_union": UNION,
    "eviction_plan": EVICT,
}
