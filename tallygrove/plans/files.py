"""Scans, sinks and parsing: tables are written as files of each form and read back, or text is made of their columns and parsed."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallygrove.functions.scalars import parse_time
from tallygrove.operators import code, records
from tallygrove.session import table, temporary
from tallygrove.sources import sinks, tickets


def csv_tickets(spark, sf):
    """Pages as tickets of a CSV file under alias names, with extra columns in ``fields``."""
    path = temporary(spark, "csv")
    p = table(spark, sf, "pages").select(
        F.col("page_id").alias("bug_id"), F.concat(F.lit('Page "'), "url", F.lit('", first\nline')).alias("summary"), F.lit("--").alias("dupe_of"), F.length("html").alias("size")
    )
    sinks.write_csv(p, path, ["bug_id", "summary"])
    t = tickets.read_csv(spark, path)
    return t.select("ticket_id", "title", "duplicate_of", F.element_at("fields", F.lit("size")).cast("int").alias("size"))


CSV = """SELECT page_id::VARCHAR AS ticket_id, 'Page "' || url || '", first' || chr(10) || 'line' AS title, NULL::VARCHAR AS duplicate_of, length(html) AS size FROM pages"""


def jsonl_scan(spark, sf):
    """Documents as JSON lines, with a broken line for each language, which the audit keeps."""
    path = temporary(spark, "jsonl")
    d = table(spark, sf, "documents").select("doc_id", "text", "lang")
    sinks.write_jsonl(d, path)
    d.groupBy("lang").count().select(F.concat(F.lit('{"doc_id": '), F.coalesce("lang", F.lit("none"))).alias("value")).write.mode("append").text(path)
    schema = "doc_id bigint, text string, lang string"
    good = tickets.read_jsonl(spark, path, schema)
    bad = tickets.read_jsonl(spark, path, schema, "audit").where("_corrupt is not null")
    return good.select("doc_id", F.md5("text").alias("digest"), F.lit(False).alias("broken")).unionByName(
        bad.select(F.lit(None).cast("bigint").alias("doc_id"), F.md5("_corrupt").alias("digest"), F.lit(True).alias("broken"))
    )


JSONL = """SELECT doc_id, md5(text) AS digest, false AS broken FROM documents
 UNION ALL SELECT NULL, md5('{"doc_id": ' || coalesce(lang, 'none')), true FROM (SELECT DISTINCT lang FROM documents)"""


def _one_file(spark, df, tag: str) -> str:
    path = temporary(spark, tag)
    df.coalesce(1).write.text(path)
    return path


def record_scan(spark, sf):
    """Nations in a wrapped, pretty-printed list, a small file by definition."""
    n = table(spark, sf, "nation").select(F.to_json(F.struct(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name"))).alias("j"))
    body = n.agg(F.concat(F.lit('{\n  "results": [\n'), F.array_join(F.array_sort(F.collect_list("j")), ",\n"), F.lit("\n]}")).alias("value"))
    return tickets.read_records(spark, _one_file(spark, body, "records"), "id string, name string")


RECORDS = "SELECT n_nationkey::VARCHAR AS id, n_name AS name FROM nation"


def tracker_pages(spark, sf):
    """Customers as landed pages of the three kinds of tracker interfaces."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("n"))
    bugs = F.to_json(F.struct(F.array(F.struct(F.col("k").alias("id"), F.col("n").alias("summary"))).alias("bugs")))
    issue = F.to_json(F.array(F.struct(F.col("k").alias("number"), F.col("n").alias("title"), F.when(F.col("k") % 5 == 0, "x").alias("pull_request"))))
    found = F.to_json(F.struct(F.array(F.struct(F.concat(F.lit("A-"), "k").alias("key"), F.struct(F.col("n").alias("summary")).alias("fields"))).alias("issues")))
    out = None
    for kind, body in (("bug_list", bugs), ("issue_list", issue), ("search", found)):
        one = tickets.tracker_records(c.select(body.alias("json")), kind).select(F.lit(kind).alias("kind"), "ticket_id", "title")
        out = one if out is None else out.unionByName(one)
    return out


TRACKER = """SELECT 'bug_list' AS kind, c_custkey::VARCHAR AS ticket_id, c_name AS title FROM customer UNION ALL SELECT 'issue_list', c_custkey::VARCHAR, c_name FROM customer WHERE c_custkey % 5 <> 0
 UNION ALL SELECT 'search', 'A-' || c_custkey, c_name FROM customer"""


def structured_tickets(spark, sf):
    """Orders as raw tickets with steps and an error; kinds are inferred where none is given."""
    o = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.concat(F.when(F.col("o_orderkey") % 3 == 0, "Slow page ").when(F.col("o_orderkey") % 3 == 1, "Crash of ").otherwise("Wrong sum "), F.col("o_orderpriority")).alias("title"),
        F.concat(F.lit("seen\nStateError: code "), "o_custkey", F.lit("\nmore")).alias("description"), F.when(F.col("o_orderkey") % 4 == 0, "ui").alias("bug_type"),
        F.lit("open | save||close ").alias("steps_to_reproduce"),
    )
    s = tickets.structured(o)
    return s.select("ticket_id", "bug_type", "error_message", F.array_join("steps_to_reproduce", ">").alias("steps"))


STRUCTURED = """SELECT o_orderkey::VARCHAR AS ticket_id, CASE WHEN o_orderkey % 4 = 0 THEN 'ui' WHEN o_orderkey % 3 = 1 THEN 'crash' WHEN o_orderkey % 3 = 0 THEN 'performance' ELSE 'functional' END AS bug_type,
 'StateError: code ' || o_custkey AS error_message, 'open>save>close' AS steps FROM orders"""


def history_records(spark, sf):
    """Orders as history: labels known at a recorded time, at the last change, or at creation; those without an owner are dropped."""
    o = table(spark, sf, "orders")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    k = F.col("o_orderkey")
    raw = o.select(
        k.alias("id"), F.lit("t").alias("title"), F.when(k % 7 != 0, F.col("o_custkey")).alias("owner"), F.concat(day, F.lit("T00:00:00Z")).alias("created"),
        F.when(k % 3 == 0, F.concat(F.date_format(F.date_add("o_orderdate", 1), "yyyy-MM-dd"), F.lit("T12:00:00Z"))).alias("last_change_time"),
        F.when(k % 5 == 0, F.concat(F.date_format(F.date_add("o_orderdate", 2), "yyyy-MM-dd"), F.lit("T12:00:00+02:00"))).alias("label_available_at"),
    )
    return tickets.history(raw).select("ticket_id", F.col("label_available_at").cast("timestamp_ntz").alias("known_at"), "label_availability_source")


HISTORY_ROWS = """SELECT o_orderkey::VARCHAR AS ticket_id, CASE WHEN o_orderkey % 5 = 0 THEN date_trunc('day', o_orderdate)::TIMESTAMP + INTERVAL 58 HOUR
 WHEN o_orderkey % 3 = 0 THEN date_trunc('day', o_orderdate)::TIMESTAMP + INTERVAL 36 HOUR ELSE date_trunc('day', o_orderdate)::TIMESTAMP END AS known_at,
 CASE WHEN o_orderkey % 5 = 0 THEN 'recorded' WHEN o_orderkey % 3 = 0 THEN 'last_change' ELSE 'created' END AS label_availability_source FROM orders WHERE o_orderkey % 7 <> 0"""


def record_import(spark, sf):
    """Customers with a negative balance imported over all."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("v"))
    return records.merge_records(c, c.where("v < 0").withColumn("v", F.lit(0.0)), "id")


IMPORT = "SELECT c_custkey AS id, CASE WHEN c_acctbal < 0 THEN 0 ELSE c_acctbal END AS v FROM customer"


def labelled_text(spark, sf):
    """Suppliers as labelled free text in two languages."""
    s = table(spark, sf, "supplier")
    t = F.concat(F.lit("title: "), "s_name", F.lit(" \n操作系统：os"), F.col("s_nationkey"), F.lit("\nVersion : n/a"))
    field = lambda *names: records.labelled_field(t, list(names))
    return s.select("s_suppkey", field("title", "标题").alias("title"), field("os", "操作系统").alias("os"), field("version").alias("version"))


LABELLED = "SELECT s_suppkey, trim(s_name) AS title, 'os' || s_nationkey AS os, NULL::VARCHAR AS version FROM supplier"


def vocabulary(spark, sf):
    """Order priorities as said, converted to an allowed vocabulary."""
    o = table(spark, sf, "orders")
    said = F.concat(F.lit(" the "), F.upper("o_orderpriority"), F.lit(" one"))
    return o.groupBy(records.allowed_value(said, ["urgent", "high", "medium", "low"], "unknown").alias("value")).agg(F.count("*").alias("n"))


VOCABULARY = """SELECT CASE WHEN o_orderpriority LIKE '%URGENT%' THEN 'urgent' WHEN o_orderpriority LIKE '%HIGH%' THEN 'high' WHEN o_orderpriority LIKE '%MEDIUM%' THEN 'medium'
 WHEN o_orderpriority LIKE '%LOW%' THEN 'low' ELSE 'unknown' END AS value, count(*) AS n FROM orders GROUP BY 1"""


def json_repair(spark, sf):
    """Parts as replies of a model: fenced JSON with trailing commas, every fourth without any."""
    p = table(spark, sf, "part")
    reply = F.when(F.col("p_partkey") % 4 != 0, F.concat(F.lit('Sure: ```json\n{"size": '), "p_size", F.lit(', "tags": ["a", "b",],}\n``` done'))).otherwise("I can't say")
    got = records.repaired_json(reply, "size int, tags array<string>")
    return p.select("p_partkey", got["size"].alias("size"), F.array_join(got["tags"], "|").alias("tags"))


REPAIR = "SELECT p_partkey, CASE WHEN p_partkey % 4 <> 0 THEN p_size END AS size, CASE WHEN p_partkey % 4 <> 0 THEN 'a|b' END AS tags FROM part"


def symbol_spans(spark, sf):
    """Suppliers as source files of one class and a function."""
    s = table(spark, sf, "supplier").select(
        F.concat(F.lit("src/"), "s_suppkey", F.lit(".py")).alias("path"), F.concat(F.lit("import os\nclass S"), "s_suppkey", F.lit(":\n    x = 1\n    def run"), "s_nationkey", F.lit("(self):\n        pass\n")).alias("content")
    )
    return code.symbols(s, "path", "content").select("path", "symbol", "line", "end_line", F.length("symbol_id").alias("id_length"))


SYMBOLS = """SELECT 'src/' || s_suppkey || '.py' AS path, 'S' || s_suppkey AS symbol, 2 AS line, 3 AS end_line, 16 AS id_length FROM supplier
 UNION ALL SELECT 'src/' || s_suppkey || '.py', 'run' || s_nationkey, 4, 6, 16 FROM supplier"""


def diff_hunks(spark, sf):
    """Suppliers as unified diffs of two hunks."""
    d = table(spark, sf, "supplier").select(
        "s_suppkey", F.concat(F.lit("diff --git a/f b/f\n--- a/src/"), "s_nationkey", F.lit(".py\n+++ b/src/"), "s_nationkey", F.lit(".py\n@@ -"), F.col("s_suppkey"), F.lit(",3 +1,3 @@\n keep\n-old\n+new\n@@ -900,2 +900,1 @@\n-gone\n keep")).alias("diff")
    )
    return code.diff_lines(d, "s_suppkey", "diff").select("s_suppkey", "path", "line", "kind")


DIFF = """SELECT s_suppkey, 'src/' || s_nationkey || '.py' AS path, unnest([s_suppkey + 1, s_suppkey + 2, 900]) AS line, unnest(['remove', 'add', 'remove']) AS kind FROM supplier"""


def stage_checkpoints(spark, sf):
    """Results of two stages, kept in one table and read back."""
    path = temporary(spark, "stages")
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("ticket_id"), "n_name")
    sinks.write_stage(n, path, "parse")
    sinks.write_stage(n.where("ticket_id < 10"), path, "route")
    return spark.read.parquet(path).select("stage", "ticket_id", F.get_json_object("payload", "$.n_name").alias("name"))


STAGES = """SELECT 'parse' AS stage, n_nationkey::VARCHAR AS ticket_id, n_name AS name FROM nation UNION ALL SELECT 'route', n_nationkey::VARCHAR, n_name FROM nation WHERE n_nationkey < 10"""


def feedback_log(spark, sf):
    """Events appended in two writes, read back by day."""
    path = temporary(spark, "log")
    ev = table(spark, sf, "events").select("event_id", F.col("ts").alias("created_at"))
    for part in (0, 1):
        sinks.append_events(ev.where(F.col("event_id") % 2 == part), path)
    return spark.read.parquet(path).groupBy(F.col("day").cast("string").alias("day")).agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


LOG = "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, min(event_id) AS first_event FROM events GROUP BY 1"


def embedding_cache(spark, sf):
    """Sources of documents encoded once each; half of the languages are in the cache already."""
    d = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("text"))
    encode = lambda rows: rows.select("key", F.array(F.length("text").cast("double")).alias("vector"))
    cache = encode(d.where("text in ('en', 'de')").select(F.sha2("text", 256).alias("key"), "text").dropDuplicates(["key"]))
    got, new = sinks.cache_embeddings(d, cache, encode)
    return got.groupBy("text").agg(F.count("*").alias("n"), F.sum(F.get("vector", F.lit(0))).alias("total")).crossJoin(new.agg(F.count("*").alias("encoded")))


CACHE = """SELECT lang AS text, count(*) AS n, sum(length(lang))::DOUBLE AS total, (SELECT count(DISTINCT lang) FROM documents WHERE lang NOT IN ('en', 'de')) AS encoded FROM documents WHERE lang IS NOT NULL GROUP BY 1"""


def time_forms(spark, sf):
    """Event times as text in three forms, and one that isn't a time."""
    ev = table(spark, sf, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("t"))
    k = F.col("event_id") % 4
    said = F.when(k == 0, F.concat("t", F.lit("Z"))).when(k == 1, F.concat("t", F.lit("+02:00"))).when(k == 2, F.replace("t", F.lit("T"), F.lit(" "))).otherwise("soon")
    return ev.select("event_id", parse_time(said).cast("timestamp_ntz").alias("at"))


TIMES = """SELECT event_id, CASE event_id % 4 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('second', ts) - INTERVAL 2 HOUR WHEN 2 THEN date_trunc('second', ts) END AS at FROM events"""


def resume_ids(spark, sf):
    """Orders still to fetch when those with returned items are done."""
    done = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("ticket_id"))
    return tickets.to_fetch(table(spark, sf, "orders").select(F.col("o_orderkey").alias("ticket_id")), done)


RESUME = "SELECT o_orderkey AS ticket_id FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')"


def symbol_match(spark, sf):
    """Parts as gold symbols, said by id, by place and name, by a suffix of the name, or not at all."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.concat(F.lit("f"), F.col("p_size")).alias("file"))
    k = F.col("k") % 4
    text = lambda head: F.concat(F.lit(head), F.col("k").cast("string"))
    gold = p.select("k", text("s").alias("symbol_id"), "file", F.lit("def").alias("kind"), text("A.m").alias("name"))
    said = p.select(
        "k", F.when(k == 0, text("s")).otherwise(text("z")).alias("symbol_id"), F.when(k == 3, "other").otherwise(F.col("file")).alias("file"),
        F.lit("def").alias("kind"), F.when(k == 2, text("m")).otherwise(text("A.m")).alias("name"),
    )
    return code.match_symbols(gold, said, "k").select("k", "match")


MATCH = "SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN 'id' WHEN 1 THEN 'exact' WHEN 2 THEN 'relaxed' END AS match FROM part"

NAMES = (
    "csv_tickets jsonl_scan record_scan tracker_pages structured_tickets history_records record_import labelled_text vocabulary json_repair symbol_spans diff_hunks "
    "stage_checkpoints feedback_log embedding_cache time_forms resume_ids symbol_match"
).split()
QUERIES = {name: globals()[name] for name in NAMES}
ORACLES = dict(
    zip(NAMES, [CSV, JSONL, RECORDS, TRACKER, STRUCTURED, HISTORY_ROWS, IMPORT, LABELLED, VOCABULARY, REPAIR, SYMBOLS, DIFF, STAGES, LOG, CACHE, TIMES, RESUME, MATCH])
)
