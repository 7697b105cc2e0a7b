import math

import pytest
from pyspark.sql import functions as F

from tallygrove.llm import exact_dedup, poisson_mix, quality_rules, snapshots
from tests.conftest import SF
from tests.harness import compare, duck

MODULES = (exact_dedup, poisson_mix, quality_rules, snapshots)


@pytest.mark.parametrize("name", [n for m in MODULES for n in m.QUERIES])
def test_equals_sql(spark, name):
    module = next(m for m in MODULES if name in m.QUERIES)
    assert compare(module.QUERIES[name](spark, SF), duck(SF), module.ORACLES[name]) > 0


def test_exact_edges(spark):
    rows = [(3, "a  b", "x"), (1, "a b", "y"), (1, "a b", "y"), (2, None, None), (4, "", "z"), (None, "a b", "q"), (5, " a b", "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, keep_id string").withColumns({"_digest": F.lit("mine"), "_i": F.lit(1)})
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.duplicate_report(df).collect()}
    assert got == {(3, 1, 4, False), (1, 1, 4, True), (None, 1, 4, False), (2, 2, 2, True), (4, 2, 2, False), (5, 5, 1, True)}
    left = exact_dedup.deduplicate(df)
    assert left.columns == df.columns and sorted(r.doc_id for r in left.collect()) == [1, 2, 5]
    assert {r._digest for r in left.collect()} == {"mine"}
    assert exact_dedup.deduplicate(df.limit(0)).count() == 0


def test_mixing_weights(spark):
    df = spark.range(4000).selectExpr("id as doc_id", "case when id % 4 = 0 then 'a' when id % 4 < 3 then 'b' end as source", "'t' as text", "1 as _n", "2 as _copy")
    df = df.withColumns({"_source": F.lit("x"), "_cdf": F.lit("y")})
    got = poisson_mix.mix(df.drop("_copy"), {"a": 3.0, "b": 1.0}).groupBy("source").count().collect()
    counts = {r["source"]: r["count"] for r in got}
    assert None not in counts and abs(counts["a"] - 3000) < 250 and abs(counts["b"] - 1000) < 150
    assert poisson_mix.mix(df.drop("_copy").limit(0)).count() == 0
    with pytest.raises(ValueError):
        poisson_mix.source_rates(df, {"a": -1.0})


def test_mixing_at_high_rates(spark):
    """Two hundred documents at a rate of 5,000, where exp(-rate) is 0 in a double."""
    rates = [0.0, 0.5, 30.0, 200.0, 746.0, 5000.0]
    df = spark.createDataFrame([(r,) for r in rates], "rate double")
    got = df.select("rate", poisson_mix._first(F.col("rate")).alias("least"), poisson_mix._distribution(F.col("rate")).alias("cdf")).collect()
    for r in got:
        p = [math.exp(-r.rate + k * math.log(r.rate) - math.lgamma(k + 1)) if r.rate else float(k == 0) for k in range(r.least + len(r.cdf))]
        total = 0.0
        for k, x in enumerate(p):
            total += x
            assert k < r.least and total < 1e-15 or k >= r.least and math.isclose(total, r.cdf[k - r.least], rel_tol=1e-9, abs_tol=1e-15)
    df = spark.range(20200).selectExpr("id as doc_id", "case when id < 200 then 'few' else 'many' end as source")
    few = poisson_mix.mix(df, {"few": 980.0, "many": 0.0}, epochs=49.5, shuffle=False).groupBy("doc_id").count().collect()
    n = [r["count"] for r in few]
    mean = sum(n) / len(n)
    assert len(n) == 200 and abs(mean - 4999.5) < 25 and 3500 < sum((x - mean) ** 2 for x in n) / len(n) < 7000


def test_snapshot_edges(spark):
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (2, 0, "user", "hi"), (3, 0, "user", "hi"), (3, 1, "assistant", "yes"), (3, 2, "user", "more"),
        (4, 0, "user", "hi"), (4, 1, "assistant", "yes"), (4, 2, "user", "more"), (5, 0, None, None), (6, 0, "", ""), (7, 1, "b", "2"), (7, 0, "a", "1"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: (r.n_turns, r.n_copies, r.text) for r in snapshots.format_chats(df).collect()}
    assert set(got) == {3, 5, 6, 7} and got[3][:2] == (3, 2)
    assert got[7][2] == "<|a|>\n1<|end|>\n<|b|>\n2<|end|>\n"
    assert snapshots.format_chats(df.limit(0)).count() == 0


def test_quality_edges(spark):
    text = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
    rows = [(1, None, "en", 1), (2, text, "en", 1), (2, text, "en", 1), (3, "x " * 40, None, 1), (4, text, "xx", 1), (5, "### $$$ %%% " * 30, "en", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_words long")
    got = sorted((r.doc_id, r.kept) for r in quality_rules.judge(df.drop("n_words")).collect())
    assert got == [(1, False), (2, True), (2, True), (3, False), (4, True), (5, False)]
    kept = quality_rules.keep_good(df)
    assert kept.columns == df.columns and kept.count() == 3 and quality_rules.keep_good(df.limit(0)).count() == 0
