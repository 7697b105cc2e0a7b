import json

import pytest
from pyspark.sql import functions as F

from tallygrove.sources import rest, sinks, tickets


def test_csv_with_aliases(spark, tmp_path):
    (tmp_path / "t.csv").write_text('bug_id,summary,description,dupe_of,extra\n1,"Crash, ""bad""","two\nlines",--,x\n2,Slow,,1,\n')
    rows = tickets.read_csv(spark, str(tmp_path / "t.csv")).orderBy("ticket_id").collect()
    assert (rows[0].title, rows[0].description, rows[0].duplicate_of, rows[0].fields) == ('Crash, "bad"', "two\nlines", None, {"extra": "x"})
    assert rows[1].duplicate_of == "1" and rows[1].fields == {}


def test_jsonl_modes(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text('{"id": "1"}\nnot json\n\n{"id": "2"}\n')
    path = str(tmp_path / "t.jsonl")
    assert tickets.read_jsonl(spark, path, "id string").count() == 2
    assert tickets.read_jsonl(spark, path, "id string", "audit").where("_corrupt is not null").count() == 1
    with pytest.raises(Exception):
        tickets.read_jsonl(spark, path, "id string", "fail").collect()


@pytest.mark.parametrize("body", ['[{"id":"1"},{"id":"2"}]', '{"results":[{"id":"1"},{"id":"2"}]}', '{"id":"1"}\n{"id":"2"}'])
def test_record_forms(spark, tmp_path, body):
    (tmp_path / "r.json").write_text(body)
    assert sorted(r.id for r in tickets.read_records(spark, str(tmp_path / "r.json"), "id string").collect()) == ["1", "2"]


def test_pretty_printed_record_with_a_list(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"id": "1", "steps": [{"n": "a"}, {"n": "b"}], "to": {"x": "y"}}, indent=2))
    got = tickets.read_records(spark, str(tmp_path / "r.json"), "id string, steps array<struct<n:string>>").collect()
    assert [(r.id, [x.n for x in r.steps]) for r in got] == [("1", ["a", "b"])]


def test_source_tree(spark, tmp_path):
    for p, text in (("src/a.py", "x = 1"), ("node_modules/b.py", "y"), ("src/c.bin", "z"), ("src/big.py", "q" * 50)):
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_text(text)
    got = tickets.read_source_tree(spark, str(tmp_path), [".py"], ["node_modules"], 40).collect()
    assert [(r.path.rsplit("/", 1)[1], r.content) for r in got] == [("a.py", "x = 1")]


def test_structured_history_and_trackers(spark):
    df = spark.createDataFrame(
        [("1", "Crash on save", "ValueError: bad\nmore", "me", "2024-01-01T00:00:00Z", None, "a|b"), ("2", "x", None, None, "bad", None, "")],
        "id string, title string, description string, owner string, created string, last_change_time string, steps_to_reproduce string",
    )
    s = tickets.structured(df).orderBy("ticket_id").collect()
    assert (s[0].bug_type, s[0].error_message, s[0].steps_to_reproduce) == ("crash", "ValueError: bad", ["a", "b"])
    h = tickets.history(df).collect()
    assert [(r.ticket_id, r.label_availability_source) for r in h] == [("1", "created")]
    pages = spark.createDataFrame([(json.dumps({"bugs": [{"id": 5, "summary": "s"}]}),)], "json string")
    assert tickets.tracker_records(pages, "bug_list").first().ticket_id == "5"
    pages = spark.createDataFrame([(json.dumps([{"number": 7, "title": "t"}, {"number": 8, "pull_request": "x"}]),)], "json string")
    assert [r.ticket_id for r in tickets.tracker_records(pages, "issue_list").collect()] == ["7"]
    pages = spark.createDataFrame([(json.dumps({"issues": [{"key": "A-1", "fields": {"summary": "s"}}]}),)], "json string")
    assert tickets.tracker_records(pages, "search").first().title == "s"
    with pytest.raises(Exception):
        tickets.require(spark.createDataFrame([(None,)], "ticket_id string"), "ticket_id").collect()


def test_rest_pages(spark, tmp_path):
    for i in (0, 2):
        (tmp_path / f"p{i}.json").write_text(json.dumps({"bugs": [{"id": i}, {"id": i + 1}]}))
    rest.register(spark)
    got = spark.read.format("paged_rest").options(url=f"file://{tmp_path}/p{{offset}}.json", limit=2, total=4).load()
    assert sorted(r.ticket_id for r in tickets.tracker_records(got, "bug_list").collect()) == ["0", "1", "2", "3"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("1", "t", {"b": "2", "a": "1"})], "ticket_id string, title string, fields map<string,string>")
    sinks.write_csv(df, str(tmp_path / "c"), ["title", "ticket_id"])
    assert spark.read.csv(str(tmp_path / "c"), header=True).columns == ["title", "ticket_id", "a", "b"]
    sinks.write_stage(df, str(tmp_path / "s"), "dedup")
    sinks.write_stage(df, str(tmp_path / "s"), "route")
    assert spark.read.parquet(str(tmp_path / "s")).count() == 2
    assert "| 1 | t |" in sinks.markdown(df.drop("fields"), "x")
    cache = spark.createDataFrame([], "key string, vector array<double>")
    texts = spark.createDataFrame([("a",), ("a",), (None,)], "text string")
    out, new = sinks.cache_embeddings(texts, cache, lambda d: d.withColumn("vector", F.array(F.length("key").cast("double"))))
    assert new.count() == 2 and out.where("vector is null").count() == 0
    assert sinks.cache_embeddings(texts, new, lambda d: d.withColumn("vector", F.array(F.lit(0.0))))[1].count() == 0
