import datetime as dt
import random
import statistics

from pyspark.sql import functions as F

from tallygrove.operators import code, metrics, models, routing, temporal, text
from tallygrove.operators.cluster import connected_components
from tallygrove.streaming import events


def test_components_against_union_find(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(k, k + 1) for k in range(1000, 1060)] + [(5, 5), (None, 3)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_trailing_and_asof_with_ties_and_nulls(spark):
    rng = random.Random(1)
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, rng.choice("ab"), t0 + dt.timedelta(hours=rng.randrange(24 * 20)), rng.randrange(1, 6)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, k string, ts timestamp_ntz, v int")
    got = {r.id: r for r in temporal.trailing(df, "id", "ts", ["k"], [2], {"n": F.lit(1), "s": F.col("v")}).collect()}
    for i, k, ts, _ in rows:
        before = [v for _, k2, t, v in rows if k2 == k and t < ts]
        near = [v for _, k2, t, v in rows if k2 == k and ts - dt.timedelta(days=2) <= t < ts]
        assert (got[i].n_all, got[i].n_2d, got[i].s_2d) == (len(before), len(near), sum(near))
    prior = temporal.prior_stats(df, "k", ["ts", "id"], "v", [1, 2, 3, 4, 5]).collect()
    for r in prior:
        vs = [v for i, k, t, v in rows if k == r.k and (t, i) < (r.ts, r.id)]
        assert r.prior_count == len(vs) and r.prior_median == (statistics.median(vs) if vs else None)
    right = df.select("k", F.col("ts").alias("rts"), F.col("id").alias("rid"))
    for strict in (False, True):
        for r in temporal.asof_join(df, right, ["k"], "ts", "rts", ["rid"], strict).collect():
            best = max(((t, i) for i, k, t, _ in rows if k == r.k and (t < r.ts or (t == r.ts and not strict))), default=(None, None))
            assert r.rid == best[1]


def test_diffs_and_symbols(spark):
    diff = "diff --git a/x.py b/x.py\n--- a/x.py\n+++ b/x.py\n@@ -2,3 +2,3 @@ ctx\n keep\n-old\n+new\n@@ -20 +20 @@\n-gone\n--- /dev/null\n+++ b/n.py\n@@ -0,0 +1 @@\n+fresh"
    d = code.diff_lines(spark.createDataFrame([(1, diff)], "id int, diff string"), "id", "diff").collect()
    assert sorted((r.path, r.line, r.kind, r.new_file) for r in d) == [
        ("n.py", 0, "add", True), ("x.py", 3, "remove", False), ("x.py", 4, "add", False), ("x.py", 20, "remove", False),
    ]
    src = "import os\nfrom b.util import z\nclass A:\n    def f(self):\n        pass\ndef g():\n    pass"
    files = spark.createDataFrame([("a.py", src), ("b/util.py", "def z():\n    pass")], "path string, content string")
    s = {(r.path, r.symbol): (r.line, r.end_line) for r in code.symbols(files, "path", "content").collect()}
    assert s[("a.py", "f")] == (4, 5) and s[("a.py", "g")] == (6, 7) and s[("b/util.py", "z")] == (1, 2)
    assert [tuple(r) for r in code.import_edges(files, "path", "content").collect()] == [("a.py", "b/util.py")]


def test_metrics_edges(spark):
    empty = spark.createDataFrame([], "p double, y int")
    assert metrics.auroc(empty, "p", "y").first().auroc is None
    low, high = spark.range(1).select(*metrics.wilson(F.lit(0), F.lit(0))).first()
    assert (low, high) == (0.0, 1.0)
    r = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 10, 3)], "q int, i int, r int")
    rel = spark.createDataFrame([(1, 11), (1, 12), (2, 5)], "q int, i int")
    got = {x.q: x for x in metrics.ranking(r, rel, "q", "i", "r", [1]).collect()}
    assert got[1].ap == 0.25 and got[1].rr == 0.5 and got[2].ap == 0.0 and got[2].first_rank is None


def test_models_and_routing(spark):
    df = spark.range(200).select(F.col("id"), (F.col("id") % 2).cast("double").alias("label"), (F.col("id") % 2 + F.rand(1) * 0.5).alias("x"), F.lit("a").alias("c"))
    m = models.fit(models.balanced_weights(df, "label"), models.assembly(["c"], ["x"]), models.classifier("forest"))
    assert m.transform(df).where("prediction = label").count() > 190
    p = spark.range(1).select(models.portable([2.0], 1.0, ["id"])).first()[0]
    assert abs(p - 1 / (1 + 2.718281828459045**-1)) < 1e-9
    kept = routing.exclude_overlap(spark.createDataFrame([(1, "a"), (2, None)], "id int, k string"), spark.createDataFrame([(9, "a")], "id int, k string"), ["id", "k"])
    assert [r.id for r in kept.collect()] == [2]
    ttl = events.with_ttl(spark.createDataFrame([(1, dt.datetime(2024, 1, 1)), (2, dt.datetime(2024, 1, 9))], "k int, at timestamp"), "at", 3, F.lit("2024-01-10").cast("timestamp"))
    assert [r.k for r in ttl.collect()] == [2]
    j = spark.range(1).select(text.jaccard(F.array(F.lit(1), F.lit(2)), F.array(F.lit(2)))).first()[0]
    assert j == 0.5


def test_symbol_matches_and_scalars(spark):
    from tallygrove.functions import scalars

    schema = "q int, symbol_id string, file string, kind string, name string"
    gold = spark.createDataFrame([(1, "s1", "a.py", "def", "A.f"), (1, "s2", "a.py", "def", "A.g"), (1, "s3", "b.py", "def", "h"), (2, "s4", "c.py", "def", "k")], schema)
    said = spark.createDataFrame([(1, "s1", "z.py", "x", "f"), (1, "x", "a.py", "def", "A.g"), (1, "y", "b.py", "def", "M.h"), (2, None, "d.py", "def", "k")], schema)
    got = {r.symbol_id: r.match for r in code.match_symbols(gold, said, "q").collect()}
    assert got == {"s1": "id", "s2": "exact", "s3": "relaxed", "s4": None}
    df = spark.createDataFrame([("2024-01-01T00:00:00Z",), ("2024-01-01 02:00:00+02:00",), ("2024-01-01",), ("bad",), (None,)], "t string")
    times = [r[0] for r in df.select(scalars.parse_time(F.col("t")).cast("string")).collect()]
    assert times == ["2024-01-01 00:00:00"] * 3 + [None, None]
    nums = spark.createDataFrame([("3",), ("x",), ("NaN",), ("-9",), (None,)], "t string").select(scalars.number(F.col("t"), 1.0, 0, 2))
    assert [r[0] for r in nums.collect()] == [2.0, 1.0, 1.0, 0.0, 1.0]


def test_nearest_of_all_vectors(spark):
    """Triplets and pairs of every query vector against all others, where both labels may be far down the ranks."""
    from tallygrove.plans.metrics import embedding_pairs
    from tallygrove.plans.routing import pairwise_rows, triplets_hard
    from tests.conftest import TINY

    ranks = {}
    for r in embedding_pairs(spark, TINY).collect():
        ranks.setdefault(r.query_id, []).append((-r.score, r.item_id, r.label == r.query_label))
    triplets, pairs = set(), set()
    for q, every in ranks.items():
        every = [(s, i, same, n) for n, (s, i, same) in enumerate(sorted(every), 1)]
        pos, neg = [x for x in every if x[2]], [x for x in every if not x[2]]
        if pos and neg:
            triplets.add((q, pos[0][1], neg[0][1]))
            pairs |= {(q, i, round(s - pos[0][0], 6), round(n**-0.5, 6)) for s, i, _, n in neg[:10]}
    got = triplets_hard(spark, TINY).collect()
    assert len(got) == len(triplets) and {tuple(r) for r in got} == triplets
    rows = pairwise_rows(spark, TINY).collect()
    for sign, target in ((1, 1), (-1, 0)):
        mine = [(r.query_id, r.item_id, round(sign * r["diff"], 6), round(r.weight, 6)) for r in rows if r.target == target]
        assert len(mine) == len(pairs) and set(mine) == pairs


def test_trailing_sums_scan_moments_not_rows(spark):
    """Sums are made once for each (key, time): what is scanned in order doesn't grow with rows of one time; rows that share an id keep their own sums."""
    rows = [(i // 2, "ab"[i % 2], dt.datetime(2024, 1, 1 + i % 3), 1 + i % 4) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, key string, at timestamp_ntz, v int").repartition(3)
    got = temporal.trailing(df, ["id", "key", "at"], "at", ["key"], [1], {"s": F.col("v")})
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Explode" not in plan and "explode" not in plan
    before = lambda k, t, d: sum(r[3] for r in rows if r[1] == k and r[2] < t and (d is None or r[2] >= t - dt.timedelta(days=d)))
    want = sorted((i, k, t, before(k, t, None), before(k, t, 1)) for i, k, t, _ in rows)
    assert sorted((r.id, r.key, r["at"], r.s_all, r.s_1d) for r in got.collect()) == want


def test_owner_counts_deal_rows_out_by_their_number(spark, monkeypatch):
    """Tasks get a bounded number of rows, however large the table; nulls are values of their own."""
    from collections import Counter

    from tallygrove import session

    monkeypatch.setattr(session, "TASK_ROWS", 10)
    rng = random.Random(3)
    rows = [(rng.randrange(4), rng.choice(["a", "b", None]), rng.choice(["x", None])) for _ in range(400)]
    got = routing.owner_counts(spark.createDataFrame(rows, "owner long, component string, product string"))
    assert "RepartitionByExpression [level#" in (plan := got._jdf.queryExecution().optimizedPlan().toString()) and "], 40" in plan
    want = Counter()
    for o, c, p in rows:
        for level in (("pair", o, c, p), ("component", o, c, None), ("product", o, None, p), ("global", o, None, None)):
            want[level] += 1
    assert {(r.level, r.owner, r.component, r["product"]): r.n for r in got.collect()} == want and got.count() == len(want)


def test_shuffles_go_when_a_table_is_written(spark):
    """Shuffle files don't wait for the driver's garbage collection."""
    import glob
    import time

    from tallygrove.session import materialize

    def files():
        dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
        return {f for d in dirs for f in glob.glob(f"{d}/*/shuffle_*")}

    before = files()
    df = spark.range(5000).repartition(3, "id")
    out = materialize(df, "shuffled")
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before
    assert out.count() == 5000 and df.count() == 5000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_keyword_families_as_in_sql(spark):
    """Counts of RE2, with what stands before a match, on words beside letters beyond ASCII and on matches that touch."""
    import duckdb

    from tallygrove.operators import features as K

    texts = ["écrash crashé crashes", "error log.log a.log.log", "a.java:1/.java:5 b.java:2/c.xml:3", "at org.foo at org.", "", "Slow\nUI hangs, hung; locks up"]
    df = spark.createDataFrame([(i, t, t) for i, t in enumerate(texts)], "id long, s string, d string")
    got = {r.id: r for r in K.keyword_features(df, "id", F.col("s"), F.col("d")).collect()}
    con = duckdb.connect()
    for i, t in enumerate(texts):
        for name, p in K.FAMILIES.items():
            (want,) = con.execute("SELECT len(regexp_extract_all(lower(?), ?))", [f"{t}\n{t}", p]).fetchone()
            (flag,) = con.execute("SELECT regexp_matches(lower(?), ?)::INT", [t, p]).fetchone()
            assert (got[i][f"{name}_count"], got[i][name], got[i][f"summary_{name}"]) == (want, int(want > 0), flag), (t, name)
