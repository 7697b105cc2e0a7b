"""Cleaning and canonical values of ticket text. Patterns read alike in Java and RE2: no look-around, no back-reference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values, applied in this order to lower-cased text with line breaks as spaces.
CLEANING = (
    (r"https?://\S+|www\.\S+", " <URL> "),
    (r"\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\b", " <EMAIL> "),
    (r"\b0x[0-9a-fA-F]+\b", " <HEX> "),
    (r"\b[a-zA-Z0-9_./\\:-]{40,}\b", " "),
    (r"={4,}|-{4,}|_{4,}|\*{4,}|#{4,}", " "),
    (r"\s+", " "),
)
#: Placeholder values that count as empty.
EMPTY = ["", "--", "---", "n/a", "na", "none", "null", "unknown", "unspecified"]
PRIORITY_WORDS = {
    "P1": ["p1", "blocker", "critical", "urgent", "highest"],
    "P2": ["p2", "high", "major"],
    "P3": ["p3", "medium", "normal", "not specified"],
    "P4": ["p4", "low", "minor"],
    "P5": ["p5", "lowest", "trivial"],
}


def clean_text(text: Column, most: int = 5000) -> Column:
    out = F.lower(F.translate(F.coalesce(text, F.lit("")), "\r\n", "  "))
    for pattern, by in CLEANING:
        out = F.regexp_replace(out, pattern, by)
    return F.substring(F.trim(out), 1, most)


def strip_markdown(text: Column) -> Column:
    out = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?s)```.*?```", " ")
    for pattern in ("`", r"!?\[([^\]]*)\]\([^)]*\)", r"(?m)^#+\s*"):
        out = F.regexp_replace(out, pattern, "$1" if "(" in pattern and "[" in pattern else "")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def strip_html(html: Column) -> Column:
    out = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<script.*?</script>|<style.*?</style>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"(?s)<[^>]*>", " "), r"\s+", " "))


def canonical(value: Column) -> Column:
    """Trimmed value, null if it is a placeholder."""
    v = F.trim(value)
    return F.when(F.lower(v).isin(EMPTY), None).otherwise(v)


def canonical_priority(value: Column) -> Column:
    v = F.lower(F.trim(F.regexp_replace(value, r"^[0-9]+-", "")))
    out = F.lit(None).cast("string")
    for name, words in PRIORITY_WORDS.items():
        out = F.when(v.isin(words), name).otherwise(out)
    return out


def first_present(*columns: Column) -> Column:
    return F.coalesce(*[canonical(c) for c in columns])


def fold_rare(df: DataFrame, col: str, least: int = 5, other: str = "other") -> DataFrame:
    """Values seen fewer than ``least`` times become ``other``; counts are joined, so a hot value isn't one task's."""
    rare = df.groupBy(col).agg(F.count("*").alias("_n")).where(F.col("_n") < least).select(F.col(col).alias("_rare"))
    met = df.join(rare, df[col].eqNullSafe(rare["_rare"]) & rare["_rare"].isNotNull(), "left")
    return met.withColumn(col, F.when(F.col("_rare").isNotNull(), other).otherwise(F.col(col))).drop("_rare")


def first_by_key(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key; rows are packed so that a partial aggregation replaces a window."""
    rest = [c for c in df.columns if c not in key and c not in order]
    least = df.groupBy(*key).agg(F.min(F.struct(*order, *rest)).alias("_r"))
    return least.select(*key, *[F.col(f"_r.{c}").alias(c) for c in [*order, *rest]])


def extract_paths(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9_./-]+\.(?:py|java|js|ts|go|rb|c|cpp|h|html|css|json|md)"), F.lit(0)))


def extract_urls(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"https?://[A-Za-z0-9._/?=&%-]+"), F.lit(0)))


def extract_identifiers(text: Column) -> Column:
    """snake_case and camelCase names; possessive groups keep long runs off the stack."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"[A-Za-z]+(?:_[A-Za-z0-9]+)++|[a-z]+(?:[A-Z][a-z0-9]+)++"), F.lit(0)))


def masked(value: Column, seed: str = "owner") -> Column:
    """Stable anonymous name."""
    return F.concat(F.lit(seed + "_"), F.substring(F.sha2(F.concat_ws("|", F.lit(seed), value.cast("string")), 256), 1, 12))
