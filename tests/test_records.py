import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallygrove.operators import cleaning, records, routing


def test_parsing(spark):
    df = spark.createDataFrame([("Here: ```json\n{\"a\": 1, \"b\": [1,2,],}\n``` done",), ("no json",), (None,)], "t string")
    got = [r.p for r in df.select(records.repaired_json(F.col("t"), "a int, b array<int>").alias("p")).collect()]
    assert (got[0].a, got[0].b) == (1, [1, 2]) and (got[1] is None or got[1].a is None)
    text = spark.createDataFrame([("Title: Crash \n  标题：死机\nOS : n/a",)], "t string")
    r = text.select(
        records.labelled_field(F.col("t"), ["title"]).alias("a"), records.labelled_field(F.col("t"), ["标题"]).alias("b"), records.labelled_field(F.col("t"), ["os"]).alias("c")
    ).first()
    assert tuple(r) == ("Crash", "死机", None)
    v = spark.createDataFrame([("ui ",), ("the Core part",), ("UI and Core",), (None,)], "v string")
    assert [x[0] for x in v.select(records.allowed_value(F.col("v"), ["UI", "Core"], "other")).collect()] == ["UI", "Core", "other", "other"]


def test_aliases_imports_and_snapshots(spark):
    a = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "x"), (None, "q")], "n string, t string")
    assert {r.n: r.final for r in records.resolve_aliases(a, "n", "t").collect()} == {"a": "d", "b": "d", "c": "d"}
    for loop in ([("a", "b"), ("b", "a")], [("a", "b"), ("b", "c"), ("c", "a")]):
        with pytest.raises(ValueError):
            records.resolve_aliases(spark.createDataFrame(loop, "n string, t string"), "n", "t")
    old, new = spark.createDataFrame([(1, "o"), (2, "o")], "k int, v string"), spark.createDataFrame([(2, "n"), (3, "n")], "k int, v string")
    assert sorted(tuple(r) for r in records.merge_records(old, new, "k").collect()) == [(1, "o"), (2, "n"), (3, "n")]
    assert records.merge_records(old, new, "k", "replace").count() == 2
    t = dt.datetime(2024, 1, 1)
    rows = spark.createDataFrame([(1, t)], "id int, ts timestamp_ntz")
    spans = spark.createDataFrame([("s", t, t + dt.timedelta(days=2)), ("u", t, t + dt.timedelta(days=1))], "name string, a timestamp_ntz, b timestamp_ntz")
    with pytest.raises(Exception, match="more than one snapshot"):
        records.one_snapshot(rows, spans, "id", "ts", "a", "b").collect()
    assert records.one_snapshot(rows, spans.where("name = 's'"), "id", "ts", "a", "b").first().name == "s"


def test_cleaning(spark):
    df = spark.createDataFrame([("See https://a.b/c mail X@y.org 0xFF ===== " + "q" * 40,)], "t string")
    assert df.select(cleaning.clean_text(F.col("t"))).first()[0] == "see <URL> mail <EMAIL> <HEX>"
    md = spark.createDataFrame([("# Head\nuse `x` ```\ncode\n``` [link](http://z)",)], "t string")
    assert md.select(cleaning.strip_markdown(F.col("t"))).first()[0] == "Head use x link"
    assert spark.range(1).select(cleaning.first_present(F.lit("--"), F.lit(" b "))).first()[0] == "b"


def test_sequential_exclusion(spark):
    rows = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, "b", "y"), (4, "b", "z"), (5, "c", None), (6, "d", None)], "id int, k1 string, k2 string")
    hist = spark.createDataFrame([("c",)], "k1 string")
    got = routing.exclude_sequential(rows, "id", ["k1", "k2"], {"k1": hist})
    # 2 is blocked by 1; 3 shares y with 2, which was dropped, so 3 stays and blocks 4; 5 is in history.
    assert sorted(r.id for r in got.collect()) == [1, 3, 6]


def test_sufficiency_of_placeholders_and_blanks(spark, tmp_path):
    """Empty and placeholder values aren't missing, blanks of Unicode make no title; as in the SQL."""
    import duckdb

    from tallygrove.plans import records as plans
    from tests.harness import compare

    titles = [None, "", "n/a", "None", "-", "--", "unknown", "null", " ", "\t", "\r", "\x0b", "\u00a0", "\u2003 ", "\u3000", "\u200b", "\u0085", " \u1680n/a"]
    texts = [t and t + rest for t in titles for rest in ("", "\n", "\nrest", "\n" + "\U0001f468" * 200, "x" * 199)]
    rows = [(i, t, lang) for i, t in enumerate(texts) for lang in (None, "", " ", "en", "n/a", "none")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert compare(plans.ticket_sufficiency(spark, str(tmp_path)), con, plans.SUFFICIENT) > 8
