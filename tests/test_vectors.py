"""Nearest vectors against a plain version: ties, copies, nulls, zero vectors and other lengths."""

import math
import random

from pyspark.sql import functions as F

from tallygrove.operators import vectors
from tallygrove.operators.vectors import VectorSearch, best_matches
from tallygrove.plans import routing
from tallygrove.plans.metrics import embedding_ranks
from tests.harness import compare, duck

SCHEMA = "vec_id long, embedding array<float>, label int"


def _rows(n):
    rng = random.Random(8)
    base = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(n // 4)]
    rows = [(i, [float(int(x * 8)) / 8 for x in rng.choice(base)], rng.choice([0, 1, 2, None])) for i in range(n)]
    rows[3] = (3, [0.0] * 6, 1)
    rows[4] = (4, None, 1)
    rows[7] = (7, [], 0)
    rows[20] = (20, [0.0] * 6, 1)
    rows[40] = (40, None, 2)
    return rows


def _score(a, b):
    if not a or not b or len(a) != len(b) or None in a or None in b:
        return -math.inf
    n = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
    return round(sum(x * y for x, y in zip(a, b)) / n, 6) if n else math.inf


def _brute(rows, k, keep=lambda q, r: True):
    out = {}
    for q in rows:
        if q[0] % 20 == 0:
            best = sorted((-_score(q[1], r[1]), r[0]) for r in rows if r[0] != q[0] and keep(q, r))[:k]
            out |= {(q[0], i): -s for s, i in best}
    return out


def _value(s):
    return -math.inf if s is None else math.inf if math.isnan(s) else s


def _held(spark, rows, tmp_path):
    path = str(tmp_path / "embeddings.parquet")
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(path)
    return str(tmp_path)


def test_ranks_with_zero_null_and_copied_vectors(spark, tmp_path):
    rows = _rows(900)
    rows += [(900, [1.0, None, 2.0, 3.0, 4.0, 5.0], 1), (901, [1.0, 2.0], 0)]
    got = embedding_ranks(spark, _held(spark, rows, tmp_path)).collect()
    want = _brute(rows, 10)
    assert {(r.query_id, r.item_id): _value(r.score) for r in got} == want


def test_best_by_label_and_rows_ahead(spark):
    rows = _rows(700)
    e = spark.createDataFrame(rows, SCHEMA)
    search = VectorSearch(e, e.where("vec_id % 20 = 0"), "vec_id", "embedding", "label")
    found = [r for r in search.nearest(3, by_label=True).orderBy("query_id", F.desc("score"), "item_id").collect()]
    for same in (True, False):
        keep = lambda q, r: None not in (q[2], r[2]) and (q[2] == r[2]) == same  # noqa: E731, B023
        held = {}
        for r in found:
            if r.same == same:
                held.setdefault(r.query_id, []).append((-_value(r.score), r.item_id))
        got = {(q, i): -s for q, rs in held.items() for s, i in sorted(rs)[:3]}
        assert got == _brute(rows, 3, keep)
    marks = spark.createDataFrame([(r.query_id, r.item_id, r.score) for r in found if not r.same], "query_id long, item_id long, score double")
    by = {r[0]: r for r in rows}
    for r in search.ahead(marks).collect():
        q = by[r.query_id]
        mark = (-_score(q[1], by[r.item_id][1]), r.item_id)
        assert r.ahead == sum((-_score(q[1], x[1]), x[0]) < mark for x in rows if x[0] != q[0] and None not in (q[2], x[2]) and q[2] == x[2])


def test_pairs_of_labels_far_down_the_ranking(spark, tmp_path):
    """Positives are the farthest vectors, so that no short list of neighbours holds them."""
    rows = [(i, [1.0, i / 4000, float(i >= 300)], int(i % 40 == 0 or i >= 300)) for i in range(600)]
    rows = [(i, v if i < 300 else [-1.0, i / 4000, 0.5], label) for i, v, label in rows]
    sf = _held(spark, rows, tmp_path)
    con = duck("/root/testdata/sf0.001")
    con.execute(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet/*.parquet'")
    for name in ("triplets_hard", "pairwise_rows"):
        assert compare(routing.QUERIES[name](spark, sf), con, routing.ORACLES[name]) > 0


def test_products_in_32_bits_lose_no_neighbour(monkeypatch):
    """Scores nearer to each other than 32 bits tell are ranked by their 64 bits; whole blocks have no products in 64."""
    import numpy as np

    def block(ids, x):
        none = np.zeros(len(ids), np.int64)
        return vectors._Block(len(ids), x.shape[1], np.array(ids).tobytes(), none.tobytes(), (none == 0).tobytes(), x.tobytes(), b"", b"")

    rng = np.random.default_rng(4)
    base = rng.normal(size=(3, 64))
    x = base[rng.integers(0, 3, 4000)] + rng.normal(size=(4000, 64)) * 1e-4 * rng.integers(1, 4, (4000, 1))
    q, whole = block(range(20), x[:20]), block(range(4000), x)
    s = np.round(q.scores(0, 20, whole), 6)
    want = [sorted((-s[i, j], j) for j in range(4000) if j != i)[:10] for i in range(20)]
    monkeypatch.setattr(vectors._Block, "scores", None)
    pairs = [(0, q, block(range(a, min(a + 900, 4000)), x[a : a + 900])) for a in range(0, 4000, 900)]
    monkeypatch.setattr(vectors, "_pairs", lambda batches: pairs)
    (got,) = vectors._search(10, False)([])
    found = {}
    for r in got.to_pylist():
        found.setdefault(r["query_id"], []).append((-r["score"], r["item_id"]))
    assert [sorted(found[i]) for i in range(20)] == want


def test_blocks_keep_ids_whole(monkeypatch):
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(vectors, "POSTINGS", 2)
    rng = random.Random(6)
    ids = np.array(sorted(rng.randrange(40) for _ in range(300)) + [50] * 40)
    batch = pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.arange(len(ids))), pa.array(np.ones(len(ids)))], names=["id", "t", "w"])
    for most in (None, 3):
        blocks = [b for out in vectors._postings(most)(batch.slice(i, 7) for i in range(0, len(ids), 7)) for b in out.to_pylist()]
        held = [set(np.frombuffer(b["ids"], np.int64).tolist()) for b in blocks]
        assert sum(map(len, held)) == len(set().union(*held)) == len(set(ids.tolist()))
        assert np.concatenate([np.frombuffer(b["tokens"], np.int64) for b in blocks]).tolist() == list(range(len(ids)))
        assert most is None or max(map(len, held)) <= most


def test_best_matches_with_ties_and_copies(spark):
    rng = random.Random(5)
    texts = [{rng.choice("abcdefghijklmnop") * rng.randrange(1, 9): rng.randrange(1, 4) / 2 for _ in range(rng.randrange(0, 9))} for _ in range(60)]
    docs = [(i, rng.choice(texts)) for i in range(1500)]
    rows = [(i, t, w) for i, d in docs for t, w in d.items()]
    df = spark.createDataFrame(rows, "id long, token string, w double").repartition(7)
    q = df.where("id % 5 = 0").withColumnRenamed("id", "qid")
    want = set()
    for i, x in docs[::5]:
        near = sorted((-round(sum(w * d[t] for t, w in x.items() if t in d), 6), j) for j, d in docs if j != i and x.keys() & d.keys())
        want |= {(i, j, -s) for s, j in near[:4]}
    # More than one batch to a partition.
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        found = [tuple(r) for r in best_matches(q, df, "qid", "id", 4, places=6, others=True).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    by = {}
    for r in found:
        by.setdefault(r[0], []).append((-r[2], r[1]))
    assert {(i, j, -s) for i, rs in by.items() for s, j in sorted(rs)[:4]} == want


def test_retrieval_makes_no_rows_of_pairs(spark):
    """Rankings come from packed blocks: no join on tokens pairs queries with documents."""
    from tests.conftest import TINY

    from tallygrove.plans import text as plans

    for name in ("title_similarity", "tfidf_topk", "bm25_topk", "bm25f_related"):
        assert "Join" not in plans.QUERIES[name](spark, TINY)._jdf.queryExecution().optimizedPlan().toString()


def test_jaccard_pairs_against_all_pairs(spark):
    """Near copies of long and short texts, and of sets at the threshold; sets are read for pairs that parities leave only."""
    from tallygrove.operators import text as X

    rng = random.Random(9)
    words = [f"w{i}" for i in range(900)]
    texts = []
    for n in (1, 4, 5, 9, 10, 40, 300, 700):
        for _ in range(4):
            base = rng.sample(words, n)
            texts += [base, base[: max(1, n - n // 10)] + ["x"] * (n % 2), base[n // 5 :] or base, base + ["y" + str(i) for i in range(n // 4)]]
    got = X.jaccard_pairs(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "id long, text string"), "id", F.col("text"))
    assert "regexp_extract_all" not in got._jdf.queryExecution().optimizedPlan().toString()
    sets = [frozenset(X_ for X_ in t if len(X_) > 1) for t in texts]
    least = {}
    for i, s in enumerate(sets):
        least.setdefault(s, i)
    ids = sorted(i for s, i in least.items() if s)
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in ids for b in ids if a < b}
    want = {k: v for k, v in want.items() if v >= 0.8} | {(least[s], i): 1.0 for i, s in enumerate(sets) if s and least[s] < i}
    found = {(r.a, r.b): r.jaccard for r in got.collect()}
    assert found.keys() == want.keys() and all(abs(found[k] - want[k]) < 1e-12 for k in want)


def test_shares_of_retrieval_tasks_are_bounded(spark, monkeypatch):
    """More text is counted and packed by more tasks, not by larger ones; the session's settings stay."""
    from tallygrove import session
    from tallygrove.operators import vectors
    from tallygrove.plans import text as plans
    from tests.conftest import TINY

    files = {}

    def noted(df, tag, *more):
        out = session.materialize(df, tag, *more)
        files[tag] = max(files.get(tag, 0), len(out.inputFiles()))
        return out

    monkeypatch.setattr(plans, "materialize", noted), monkeypatch.setattr(vectors, "materialize", noted)
    chars = spark.read.parquet(f"{TINY}/documents.parquet").selectExpr("sum(length(text))").first()[0]
    monkeypatch.setattr(session, "TASK_CHARS", chars // 30, raising=False)
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    try:
        before = spark.conf.get("spark.sql.shuffle.partitions")
        for name in ("tfidf_topk", "bm25_topk", "bm25f_related"):
            files.clear()
            plans.QUERIES[name](spark, TINY)
            assert files["terms"] > 20 and files["postings"] > 20
            assert spark.conf.get("spark.sql.shuffle.partitions") == before
    finally:
        spark.conf.unset(key)


def test_jaccard_sets_go_once_for_a_block(spark, monkeypatch):
    """Sets in several blocks and sketches of all widths, and one row of a set for its pairs in a block."""
    from tallygrove.operators import sets
    from tallygrove.operators import text as X

    monkeypatch.setattr(sets, "BLOCK", 3000, raising=False), monkeypatch.setattr(sets, "PAIRS", 7, raising=False)
    rng = random.Random(4)
    words = [f"w{i}" for i in range(3000)]
    texts = []
    for n in (30, 300, 900):
        base = rng.sample(words, n)
        texts += [base[i * n // 25 :] for i in range(6)] + [base + [f"z{n}q{i}"] for i in range(4)]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "id long, text string")
    found = {(r.a, r.b): r.jaccard for r in X.jaccard_pairs(df, "id", F.col("text")).collect()}
    s = [frozenset(t) for t in texts]
    want = {(a, b): len(s[a] & s[b]) / len(s[a] | s[b]) for a in range(len(s)) for b in range(a + 1, len(s))}
    want = {k: v for k, v in want.items() if v >= 0.8}
    assert found.keys() == want.keys() and all(abs(found[k] - want[k]) < 1e-12 for k in want)
    got = X.jaccard_pairs(df, "id", F.col("text"))
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
