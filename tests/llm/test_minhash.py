import random

import numpy as np
import pytest

from tallygrove.llm import minhash_dedup as M
from tests.conftest import SF
from tests.llm.brute import near_components


def _run(spark, rows, schema="doc_id long, text string"):
    df = spark.createDataFrame(rows, schema)
    return sorted(map(tuple, M.near_duplicates(df).collect()), key=repr)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_components_equal_brute_force(spark, documents):
    want = near_components([(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in M.near_duplicates(documents).collect()}
    assert got == want


def test_estimate_is_unbiased():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 4000, dtype=np.uint64)
    a, b = pool[:3000], pool[1000:]
    sig = M.pack(np.stack([M.minima_of(a), M.minima_of(b)])).view(np.uint64)
    assert abs(M.estimate(M.agreements(sig[0], sig[1])) - 0.5) < 0.2
    assert M.agreements(sig[0], sig[0]) == M.HASHES


def test_chain_of_near_copies_without_a_common_hub(spark):
    rng = random.Random(3)
    words = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    rows = []
    for k in range(40):
        words = words[:]
        for _ in range(4):
            words[rng.randrange(300)] = f"x{rng.randrange(10**6)}"
        rows.append((100 + k, " ".join(words)))
    rng.shuffle(rows)
    want = near_components(rows)
    assert {r[0]: (r[1], r[2]) for r in _run(spark, rows)} == want


def test_nulls_short_texts_and_repeats(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "A b"), (5, "a  B"), (None, "a b"), (6, "a b c"), (6, "a b c"), (7, " a")]
    got = _run(spark, rows)
    assert (4, 1, 4, True) in got and (5, 1, 4, False) in got
    assert (1, 0, 1, True) in got and (2, 0, 2, True) in got and (3, 0, 3, True) in got
    assert (None, 1, None, True) in got
    assert got.count((6, 1, 6, True)) == 2


def test_empty_and_clashing_columns(spark):
    assert _run(spark, []) == []
    df = spark.createDataFrame([(1, "a b", "x", "y"), (2, "a b", "x", None)], "doc_id long, text string, id string, bands string")
    left = M.drop_near_duplicates(df)
    assert left.columns == df.columns and [r.doc_id for r in left.collect()] == [1]


def test_blocks_of_a_large_bucket(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK", 8)
    rng = random.Random(5)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for k in range(60):
        w = base[:]
        for _ in range(rng.randrange(1, 5)):
            w[rng.randrange(120)] = f"y{rng.randrange(10**6)}"
        rows.append((k, " ".join(w)))
    assert {r[0]: (r[1], r[2]) for r in _run(spark, rows)} == near_components(rows)


def test_finished_phases_are_let_go(spark, monkeypatch):
    """The driver lets go of plans and shuffles between phases, not only when its heap is full."""
    from tallygrove.llm import minhash_dedup as M

    calls, free = [], M.free_shuffles
    monkeypatch.setattr(M, "free_shuffles", lambda s: (calls.append(1), free(s)))
    M._labelled(spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string"), "doc_id", "text")
    assert len(calls) >= 4


def test_joins_go_by_measured_sizes(spark, monkeypatch):
    """No estimate decides on a broadcast, as after an explode it is many times too low; the session's settings stay."""
    from tallygrove import session

    plans, key = {}, "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)

    def noted(df, tag, *more):
        plans[tag] = df._jdf.queryExecution().executedPlan().toString()
        return session.materialize(df, tag, *more)

    monkeypatch.setattr(M, "materialize", noted)
    rows = [(i, f"one two three four five {'six' * (i % 3)} seven eight nine ten eleven twelve thirteen fourteen") for i in range(30)]
    assert M.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).count() > 0
    for tag in ("minhash-nodes", "minhash-buckets", "minhash-star", "minhash-wanted", "minhash-met", "minhash-across", "minhash-labels"):
        assert "Join" in plans[tag] and "BroadcastHashJoin" not in plans[tag], tag
    assert spark.conf.get(key) == before and spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold", None) is None
