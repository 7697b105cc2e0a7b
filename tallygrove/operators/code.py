"""Code structure as tables: chunks, symbols, imports, diffs, path and line joins, localisation evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weights of the chunk signals; they add up to one.
CHUNK_WEIGHTS = {"stack": 0.20, "path": 0.15, "identifier": 0.15, "keyword": 0.25, "symbol": 0.15, "proximity": 0.10}
SYMBOL = r"(?m)^[ \t]*(?:async\s+)?(?:def|class|function|func|interface|struct)\s+([A-Za-z_][A-Za-z0-9_]*)"
IMPORT = r"(?m)^[ \t]*(?:from\s+([A-Za-z_][A-Za-z0-9_.]*)\s+import|import\s+([A-Za-z_][A-Za-z0-9_.]*))"


def windows(df: DataFrame, id_col: str, text: str, size: int = 40, overlap: int = 10) -> DataFrame:
    """Fixed windows of lines: (id, start_line, end_line, chunk)."""
    step = size - overlap
    lines = df.select(id_col, F.split(F.coalesce(text, F.lit("")), "\n").alias("_l"))
    last = F.greatest(F.ceil((F.size("_l") - overlap) / step) - 1, F.lit(0)).cast("int")
    at = lines.withColumn("_i", F.explode(F.sequence(F.lit(0), last)))
    start = F.col("_i") * step + 1
    return at.select(
        id_col, start.alias("start_line"), F.least(start + size - 1, F.size("_l")).alias("end_line"),
        F.array_join(F.slice("_l", start, size), "\n").alias("chunk"),
    )


def symbols(df: DataFrame, path: str, content: str) -> DataFrame:
    """(path, symbol, line, end_line, symbol_id): definitions by line; a span ends before the next definition."""
    rows = df.select(path, F.posexplode(F.split(F.coalesce(content, F.lit("")), "\n")).alias("_i", "_line"))
    found = rows.withColumn("symbol", F.regexp_extract("_line", SYMBOL, 1)).where("symbol <> ''").withColumn("line", F.col("_i") + 1)
    total = df.select(F.col(path).alias("_p"), F.size(F.split(F.coalesce(content, F.lit("")), "\n")).alias("_n"))
    after = F.lead("line").over(Window.partitionBy(path).orderBy("line"))
    out = found.withColumn("_next", after).join(total, F.col(path) == F.col("_p"))
    sid = F.substring(F.sha2(F.concat_ws("|", path, "symbol", F.col("line").cast("string")), 256), 1, 16)
    return out.select(path, "symbol", "line", F.coalesce(F.col("_next") - 1, F.col("_n")).alias("end_line"), sid.alias("symbol_id"))


def imports(df: DataFrame, path: str, content: str) -> DataFrame:
    """(path, module) of import lines."""
    a = F.regexp_extract_all(content, F.lit(IMPORT), F.lit(1))
    b = F.regexp_extract_all(content, F.lit(IMPORT), F.lit(2))
    return df.select(path, F.explode(F.array_distinct(F.filter(F.concat(a, b), lambda m: m != ""))).alias("module"))


def import_edges(df: DataFrame, path: str, content: str) -> DataFrame:
    """(source, target): imports resolved to files of the tree by module name, longest suffix first."""
    bare = F.regexp_replace(F.regexp_replace(path, r"\.[a-z]+$", ""), "/", ".")
    parts = F.split(bare, r"\.")
    names = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    files = df.select(F.col(path).alias("target"), F.explode(names).alias("module"))
    best = files.groupBy("module").agg(F.min("target").alias("target"), F.count("*").alias("n")).where("n = 1")
    return imports(df, path, content).join(best, "module").where(F.col(path) != F.col("target")).select(F.col(path).alias("source"), "target").distinct()


def one_hop(ranked: DataFrame, edges: DataFrame, query: str, file: str, rank: str, top: int = 5, bonus: float = 0.08, hub: int = 8) -> DataFrame:
    """(query, file, bonus) for files one edge from the top files; the bonus decays with rank, hubs give none."""
    degree = edges.groupBy("source").agg(F.count_distinct("target").alias("_d")).where(F.col("_d") <= hub)
    e = edges.join(degree, "source").select("source", "target")
    seeds = ranked.where(F.col(rank) <= top).select(query, F.col(file).alias("source"), F.col(rank).alias("_r"))
    met = seeds.join(e, "source").groupBy(query, F.col("target").alias(file)).agg(F.max(1 - 0.08 * (F.col("_r") - 1)).alias("_s"))
    return met.select(query, file, F.least(F.lit(bonus), bonus * F.col("_s")).alias("bonus"))


def suffix_match(mentioned: DataFrame, files: DataFrame, said: str, path: str) -> DataFrame:
    """Mentioned paths with the files they are a suffix of: an equi-join on the base name, then the suffix test."""
    base = lambda c: F.element_at(F.split(F.col(c), "/"), -1)
    a, b = mentioned.withColumn("_base", base(said)), files.withColumn("_base", base(path))
    ok = (F.col(path) == F.col(said)) | F.col(path).endswith(F.concat(F.lit("/"), F.regexp_replace(said, "^[./]+", "")))
    return a.join(b, "_base").where(ok).drop("_base")


def diff_lines(diffs: DataFrame, id_col: str, diff: str) -> DataFrame:
    """(id, path, line, kind) of the added and removed lines of unified diffs, lines numbered in the old file."""
    rows = diffs.select(id_col, F.posexplode(F.split(F.coalesce(diff, F.lit("")), "\n")).alias("_i", "_l"))
    w = Window.partitionBy(id_col).orderBy("_i")
    past = w.rowsBetween(Window.unboundedPreceding, 0)
    old = F.regexp_extract("_l", r"^@@ -([0-9]+)", 1)
    rows = rows.withColumns(
        {
            "path": F.last(F.nullif(F.regexp_extract("_l", r"^(?:---|\+\+\+) [ab]/([^\t]+)", 1), F.lit("")), True).over(past),
            "_new": F.last(F.when(F.col("_l").startswith("--- "), F.col("_l") == "--- /dev/null"), True).over(past),
            "_hunk": F.sum(F.when(F.col("_l").startswith("@@"), 1).otherwise(0)).over(past),
            "_head": F.col("_l").startswith("--- ") | F.col("_l").startswith("+++ ") | F.col("_l").startswith("diff "),
        }
    )
    h = Window.partitionBy(id_col, "_hunk").orderBy("_i")
    start = F.first(F.when(old != "", old.cast("int")), True).over(h.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    kind = F.when(F.col("_head"), None).when(F.col("_l").startswith("+"), "add").when(F.col("_l").startswith("-"), "remove").when(F.col("_l").startswith(" "), "keep")
    rows = rows.withColumns({"kind": kind, "_s": start})
    before = F.coalesce(F.sum(F.when(F.col("kind").isin("keep", "remove"), 1).otherwise(0)).over(h.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = rows.withColumn("line", F.col("_s") + before).where("_hunk > 0 and kind in ('add', 'remove')")
    return out.select(id_col, "path", "line", "kind", F.coalesce("_new", F.lit(False)).alias("new_file"))


def lines_in_symbols(lines: DataFrame, spans: DataFrame, id_col: str, path: str = "path", cell: int = 64) -> DataFrame:
    """Lines with their innermost symbol: unique, 'ambiguous' on a tie, 'module' without one. Spans go by cells of lines."""
    s = spans.withColumn("_c", F.explode(F.sequence(F.floor(F.col("line") / cell), F.floor(F.col("end_line") / cell))))
    s = s.select(F.col(path).alias("_p"), "_c", F.col("line").alias("_a"), F.col("end_line").alias("_b"), "symbol_id")
    at = lines.where("not new_file").withColumn("_c", F.floor(F.col("line") / cell))
    met = at.join(s, (F.col(path) == F.col("_p")) & (at["_c"] == s["_c"]) & F.col("line").between(F.col("_a"), F.col("_b")), "left")
    size = F.col("_b") - F.col("_a")
    g = met.groupBy(id_col, path, "line").agg(F.min(size).alias("_m"), F.collect_list(F.struct(size.alias("n"), "symbol_id")).alias("_s"))
    inner = F.filter("_s", lambda x: x["n"] == F.col("_m"))
    state = F.when(F.col("_m").isNull(), "module").when(F.size(inner) > 1, "ambiguous").otherwise("symbol")
    return g.select(id_col, path, "line", state.alias("state"), F.when(state == "symbol", F.get(inner, F.lit(0))["symbol_id"]).alias("symbol_id"))


def chunk_score(signals: dict[str, Column]) -> Column:
    """Weighted sum of signals in [0, 1], clamped."""
    total = F.lit(0.0)
    for name, c in signals.items():
        total = total + CHUNK_WEIGHTS[name] * F.coalesce(c.cast("double"), F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))


def file_scores(chunks: DataFrame, query: str, file: str, score: str, k: int = 20) -> DataFrame:
    """Best chunk plus a support bonus of min(0.04, 0.015 * (chunks - 1)); the k best files of a query."""
    g = chunks.groupBy(query, file).agg(F.max(score).alias("_b"), F.count("*").alias("chunks"))
    g = g.select(query, file, "chunks", F.round(F.col("_b") + F.least(F.lit(0.04), 0.015 * (F.col("chunks") - 1)), 9).alias("score"))
    rank = F.row_number().over(Window.partitionBy(query).orderBy(F.desc("score"), file))
    return g.withColumn("rank", rank).where(F.col("rank") <= k)


def coverage_selection(candidates: DataFrame, query: str, item: str, file: str, score: str, per_file: int, size: int) -> DataFrame:
    """At most per_file items of a file, files taken in turn by their best item, up to size."""
    in_file = F.row_number().over(Window.partitionBy(query, file).orderBy(F.desc(score), item))
    c = candidates.withColumn("_n", in_file).where(F.col("_n") <= per_file)
    place = F.row_number().over(Window.partitionBy(query).orderBy("_n", F.desc(score), item))
    return c.withColumn("place", place).where(F.col("place") <= size).drop("_n")


def match_symbols(gold: DataFrame, said: DataFrame, query: str) -> DataFrame:
    """Gold symbols with how a prediction meets them: 'id', 'exact' (file, kind, name), 'relaxed' (name a suffix of the other), or null.

    Both sides have symbol_id, file, kind and name. Joined on the last part of the name, the best way wins.
    """
    leaf = lambda c: F.element_at(F.split(F.col(c), r"[.:/]+"), -1)
    g = gold.select(query, F.col("symbol_id").alias("g_id"), F.col("file").alias("g_file"), F.col("kind").alias("g_kind"), F.col("name").alias("g_name"), leaf("name").alias("_leaf"))
    p = said.select(query, F.col("symbol_id").alias("p_id"), F.col("file").alias("p_file"), F.col("kind").alias("p_kind"), F.col("name").alias("p_name"), leaf("name").alias("_leaf"))
    ends = F.col("g_name").endswith(F.concat(F.lit("."), F.col("p_name"))) | F.col("p_name").endswith(F.concat(F.lit("."), F.col("g_name"))) | (F.col("g_name") == F.col("p_name"))
    way = (
        F.when(F.col("g_id") == F.col("p_id"), 1)
        .when((F.col("g_file") == F.col("p_file")) & (F.col("g_kind") == F.col("p_kind")) & (F.col("g_name") == F.col("p_name")), 2)
        .when((F.col("g_file") == F.col("p_file")) & ends, 3)
    )
    met = g.join(p, [query, "_leaf"], "left").groupBy(query, "g_id", "g_file", "g_name").agg(F.min(way).alias("_w"))
    return met.select(query, F.col("g_id").alias("symbol_id"), F.col("g_file").alias("file"), F.col("g_name").alias("name"), F.element_at(F.create_map(F.lit(1), F.lit("id"), F.lit(2), F.lit("exact"), F.lit(3), F.lit("relaxed")), F.col("_w")).alias("match"))
