"""Ticket scans: CSV, JSON lines with bad lines set apart, wrapper records, alias columns, source trees, small tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallygrove.operators.cleaning import canonical

#: Columns that may hold a field, the first non-empty one counts.
ALIASES = {
    "ticket_id": ["ticket_id", "id", "bug_id", "issue_id", "key"],
    "title": ["title", "summary", "short_desc"],
    "description": ["description", "body", "content", "text"],
    "duplicate_of": ["duplicate_of", "dupe_of", "dup_id", "master_id"],
    "product": ["product", "project"],
    "component": ["component", "module"],
    "priority": ["priority"],
    "severity": ["severity"],
    "assignee": ["assignee", "assigned_to", "owner"],
    "created_at": ["created_at", "creation_time", "created"],
}


def aliased(df: DataFrame, fields: dict[str, list[str]] | None = None, keep_rest: bool = True) -> DataFrame:
    """Canonical columns by alias; what is left goes into a map column ``fields``. All cells as trimmed text."""
    fields = fields or ALIASES
    have = {c.lower(): c for c in df.columns}
    text = lambda c: canonical(F.col(f"`{have[c]}`").cast("string"))
    out, used = [], set()
    for name, names in fields.items():
        found = [n for n in names if n in have]
        used |= set(found)
        out.append((F.coalesce(*[text(n) for n in found]) if found else F.lit(None).cast("string")).alias(name))
    rest = [c for c in have if c not in used and have[c] != "_corrupt"]
    if keep_rest:
        pairs = [x for c in rest for x in (F.lit(have[c]), F.col(f"`{have[c]}`").cast("string"))]
        kept = F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull()) if pairs else F.expr("cast(map() as map<string,string>)")
        out.append(kept.alias("fields"))
    return df.select(*out)


def require(df: DataFrame, column: str, what: str = "row without") -> DataFrame:
    """Fails the query if column is null in any row."""
    return df.withColumn(column, F.coalesce(F.col(column), F.raise_error(F.lit(f"{what} {column}")).cast(df.schema[column].dataType)))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Tickets of a CSV file: quoted cells of any length and with line breaks, all as text."""
    raw = spark.read.options(header=True, multiLine=True, quote='"', escape='"', maxCharsPerColumn=-1).csv(path)
    return aliased(raw)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str, mode: str = "skip") -> DataFrame:
    """JSON lines. mode 'skip' drops bad lines, 'audit' keeps them in _corrupt, 'fail' stops at one."""
    options = {"multiLine": False, "columnNameOfCorruptRecord": "_corrupt"}
    if mode == "fail":
        return spark.read.options(**options, mode="FAILFAST").schema(schema).json(path)
    fields = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    held = T.StructType([*fields.fields, T.StructField("_corrupt", T.StringType())])
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select("value", F.from_json("value", held, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r")).select("r.*")
    return parsed if mode == "audit" else parsed.where("_corrupt is null").drop("_corrupt")


def read_records(spark: SparkSession, path: str, schema: str, wrappers: tuple[str, ...] = ("results", "records", "tickets", "data")) -> DataFrame:
    """Records of a JSON file that is a list, an object with a list in it, one object, or JSON lines."""
    text = spark.read.text(path, wholetext=True).select(F.trim("value").alias("v"))
    listed = F.from_json("v", f"array<struct<{schema}>>")
    wrapped = F.coalesce(*[F.from_json(F.get_json_object("v", f"$.{w}"), f"array<struct<{schema}>>") for w in wrappers])
    lines = F.filter(F.transform(F.split("v", "\n"), lambda x: F.from_json(x, f"struct<{schema}>")), lambda x: x.isNotNull())
    single = F.array(F.from_json("v", f"struct<{schema}>"))
    has_wrapper = F.coalesce(*[F.get_json_object("v", f"$.{w}") for w in wrappers]).isNotNull()
    # Each line an object of its own; a pretty-printed object has lines that aren't.
    filled = F.filter(F.transform(F.split("v", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    many = (F.size(filled) > 1) & F.forall(filled, lambda x: x.startswith("{") & x.endswith("}"))
    rows = F.when(F.col("v").startswith("["), listed).when(has_wrapper, wrapped).when(many, lines).otherwise(single)
    return text.select(F.explode(rows).alias("r")).select("r.*")


def read_source_tree(spark: SparkSession, path: str, extensions: list[str], ignored: list[str], most: int = 400_000) -> DataFrame:
    """(path, size, content) of the text files of a tree, ignored folders and large files left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = F.col("path")
    skip = "|".join(f"/{d}/" for d in ignored) or "$^"
    ends = "|".join(e.lstrip(".") for e in extensions)
    good = files.where(name.rlike(rf"\.(?:{ends})$") & ~name.rlike(skip) & (F.col("length") <= most))
    return good.select(name, F.col("length").alias("size"), F.decode("content", "UTF-8").alias("content"))


def structured(df: DataFrame) -> DataFrame:
    """The structured ticket: defaults filled, steps as an array, missing fields inferred by keyword."""
    t = aliased(df, {**ALIASES, **{k: [k] for k in ("bug_type", "os", "version", "error_message", "expected_behavior", "actual_behavior", "logs")}})
    text = F.lower(F.concat_ws(" ", "title", "description"))
    kind = F.when(text.rlike("crash|segfault|hang"), "crash").when(text.rlike("slow|performance|memory"), "performance").when(
        text.rlike("ui|button|layout|display"), "ui"
    ).otherwise("functional")
    error = F.nullif(F.regexp_extract(F.coalesce("description", F.lit("")), r"([A-Za-z]+(?:Error|Exception)[^\n]*)", 1), F.lit(""))
    steps = F.filter(F.transform(F.split(F.coalesce(F.element_at("fields", F.lit("steps_to_reproduce")), F.lit("")), r"\||\n"), lambda s: F.trim(s)), lambda s: s != "")
    return t.withColumns(
        {"bug_type": F.coalesce("bug_type", kind), "error_message": F.coalesce("error_message", error), "steps_to_reproduce": steps}
    )


def history(df: DataFrame) -> DataFrame:
    """History records with the time their label was available and where that time is from; unusable rows are dropped."""
    t = aliased(df, {**ALIASES, "label_available_at": ["label_available_at"], "last_change_time": ["last_change_time"]})
    when = lambda c: F.try_to_timestamp(F.col(c))
    at = F.coalesce(when("label_available_at"), when("last_change_time"), when("created_at"))
    origin = F.when(when("label_available_at").isNotNull(), "recorded").when(when("last_change_time").isNotNull(), "last_change").otherwise("created")
    out = t.withColumns({"created_at": when("created_at"), "label_available_at": at, "label_availability_source": origin})
    return out.where("ticket_id is not null and title is not null and assignee is not null and label_available_at is not null")


def tracker_records(pages: DataFrame, kind: str) -> DataFrame:
    """One record form from landed pages (a column ``json``) of three kinds of tracker interfaces."""
    if kind == "bug_list":
        rows = pages.select(F.explode(F.from_json("json", "bugs array<map<string,string>>")["bugs"]).alias("r"))
        pick = lambda *names: F.coalesce(*[F.element_at("r", F.lit(n)) for n in names])
    elif kind == "issue_list":
        rows = pages.select(F.explode(F.from_json("json", "array<map<string,string>>")).alias("r"))
        rows = rows.where(F.element_at("r", F.lit("pull_request")).isNull())
        pick = lambda *names: F.coalesce(*[F.element_at("r", F.lit(n)) for n in names])
    elif kind == "search":
        rows = pages.select(F.explode(F.from_json("json", "issues array<struct<key:string,fields:map<string,string>>>")["issues"]).alias("i"))
        rows = rows.select(F.map_concat(F.create_map(F.lit("key"), F.col("i.key")), F.coalesce("i.fields", F.expr("cast(map() as map<string,string>)"))).alias("r"))
        pick = lambda *names: F.coalesce(*[F.element_at("r", F.lit(n)) for n in names])
    else:
        raise ValueError(kind)
    return rows.select(
        pick("id", "number", "key").alias("ticket_id"), pick("summary", "title").alias("title"), pick("description", "body").alias("description"),
        pick("priority").alias("priority"), pick("component").alias("component"), pick("creation_time", "created_at", "created").alias("created_at"),
        pick("dupe_of").alias("duplicate_of"),
    )


def first_comments(comments: DataFrame) -> DataFrame:
    """The earliest comment of each ticket: (ticket_id, time, text)."""
    best = comments.groupBy("ticket_id").agg(F.min(F.struct("time", "text")).alias("c"))
    return best.select("ticket_id", "c.time", "c.text")


def to_fetch(wanted: DataFrame, have: DataFrame, key: str = "ticket_id") -> DataFrame:
    """Ids still to fetch, or work not yet done."""
    return wanted.select(key).where(F.col(key).isNotNull()).distinct().join(have.select(key).distinct(), key, "left_anti")


def active_interval(start: Column, end: Column, at: Column) -> Column:
    """Whether start <= at < end; a null end is open."""
    return (start <= at) & (end.isNull() | (at < end))
