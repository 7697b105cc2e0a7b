"""Secret scan with a random forest for the removal of false positives. DataFrame functions and Spark ML only.

Candidates are runs of key-like characters that hold a digit or start like a
known key, and values after a word such as password in any case, = or :, and an
optional quote; values have six characters or more and hold no blank, quote or
=. Features of a candidate: its length, transitions
between character classes, shares of classes, whether it is hexadecimal,
coverage by dictionary words and by repeats of one letter, hints in its path
and its neighbouring words. The dictionary is the corpus: words of letters in
``DOCUMENTS`` documents or more. The forest is fitted on labelled findings: a
table (before, candidate, after, path, is_secret) of the caller's, or the
built-in ones, ``FINDINGS`` rows by rule from hashes of the row number and half
of those written by hand, which is the documented bound of the sample; the
other half measures it.

Defined results: null texts and paths count as empty; a text without
candidates has no findings; rows are scanned one by one, so repeated rows
repeat their findings; of overlapping candidates the first counts; texts of any
length are scanned whole; an empty table gives no rows; further columns are not
read.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallygrove.llm.findings import HAND_WRITTEN
from tallygrove.llm.spans import matches
from tallygrove.session import materialize, small_side

#: Rows of the built-in labelled findings.
FINDINGS = 3000
#: Documents that hold a word of the dictionary at least.
DOCUMENTS = 5
TREES, DEPTH, SEED = 25, 8, 11
#: Characters on either side that count as neighbouring words.
NEAR = 32
THRESHOLD = 0.5

#: A run of key-like characters with a digit, or of any after a known prefix.
RUN = (
    r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9]|A[KS]IA[0-9A-Z]{16}|gh[pousr]_)[A-Za-z0-9+/_-]{16,}={0,2}"
)
RUN_GUARD = r"[A-Za-z0-9+/_-]{16}"
#: A keyword in any case and = or :, with blanks and quotes around; the value follows and isn't consumed, as it can hold a keyword.
ASSIGNED = (
    r"(?i:password|passwd|secret|api_key|apikey|token|access_key)[\"'`]?[\x20\x09]*+[=:][\x20\x09]*+[\"'`]?"
    r"(?=([^\x20\x09-\x0D\"'=]{6,}))"
)
ASSIGNED_GUARD = r"(?i:password|passwd|secret|api_key|apikey|token|access_key)[\"'`]?[\x20\x09]*+[=:]"

SECRET_WORDS = "password|passwd|pwd|secret|token|api_?key|apikey|auth|bearer|credential|private|access_key|akia"
DIGEST_WORDS = "commit|sha1|sha256|sha512|md5|checksum|digest|etag|hash|uuid|guid|revision|blob|build|trace|request|session_count"
HARMLESS_PATHS = "test|mock|fixture|example|sample|doc|lock|vendor|spec"
FEATURES = [
    "f_length", "f_transitions", "f_lower", "f_upper", "f_digit", "f_other", "f_distinct", "f_hex", "f_dictionary",
    "f_repeat", "f_path", "f_secret_word", "f_digest_word", "f_assigned", "f_quoted", "f_aws",
]


def _left(candidate: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(candidate, pattern, ""))


def _runs(candidate: Column) -> Column:
    """The words that a candidate may be made of: runs of three letters or more, cut at capitals."""
    return F.transform(F.regexp_extract_all(candidate, F.lit("[A-Z]?[a-z]{2,}+|[A-Z]{3,}+"), F.lit(0)), lambda w: F.lower(w))


def dictionary(docs: DataFrame, candidates: DataFrame, text_col: str = "text") -> DataFrame:
    """(word): the words of candidates that DOCUMENTS or more rows of docs hold between other characters than letters."""
    wanted = small_side(candidates.select(F.explode(_runs(F.col("candidate"))).alias("word")).where(F.length("word") >= 3).distinct())
    held = F.array_distinct(F.split(F.lower(F.col(f"`{text_col}`")), "[^a-z]++"))
    words = docs.select(F.explode(held).alias("word")).join(wanted, "word", "left_semi")
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= DOCUMENTS).select("word")


def with_coverage(rows: DataFrame, words: DataFrame) -> DataFrame:
    """rows with _covered, the letters of the candidate in words of the dictionary."""
    each = rows.select("candidate").distinct().select("candidate", F.explode(_runs(F.col("candidate"))).alias("word"))
    known = each.join(words, "word", "left_semi").groupBy("candidate").agg(F.sum(F.length("word")).alias("_covered"))
    known = known.withColumnRenamed("candidate", "_of")
    return rows.join(known, F.col("candidate") == F.col("_of"), "left").drop("_of").fillna(0, ["_covered"])


def features(rows: DataFrame) -> DataFrame:
    """rows (before, candidate, after, path, _covered) with the numeric columns FEATURES."""
    c, n = F.col("candidate"), F.greatest(F.length("candidate"), F.lit(1)).cast("double")
    low, before, after = F.lower("candidate"), F.lower(F.coalesce("before", F.lit(""))), F.coalesce("after", F.lit(""))
    share = lambda p: (F.length(c) - _left(c, p)) / n
    flag = lambda cond: F.coalesce(cond, F.lit(False)).cast("double")
    # Each run of one class becomes one letter, so lengths count the transitions.
    runs = c
    for pattern, letter in (("[a-z]+", "a"), ("[A-Z]+", "B"), ("[0-9]+", "1"), ("[^a-zA-Z0-9]+", "-")):
        runs = F.regexp_replace(runs, pattern, letter)
    return rows.withColumns(
        {
            "f_length": n,
            "f_transitions": F.length(runs) / n,
            "f_lower": share("[a-z]+"),
            "f_upper": share("[A-Z]+"),
            "f_digit": share("[0-9]+"),
            "f_other": share("[^a-zA-Z0-9]+"),
            "f_distinct": F.size(F.array_distinct(F.split(c, ""))) / F.least(n, F.lit(64.0)),
            "f_hex": flag(low.rlike("^[0-9a-f-]+$")),
            "f_dictionary": F.col("_covered") / n,
            "f_repeat": (F.length(low) - _left(low, r"(.)\1{2,}")) / n,
            "f_path": flag(F.lower(F.coalesce("path", F.lit(""))).rlike(HARMLESS_PATHS)),
            "f_secret_word": flag(before.rlike(SECRET_WORDS)),
            "f_digest_word": flag(before.rlike(DIGEST_WORDS)),
            "f_assigned": flag(before.rlike(r"[=:][\x20\"'`]*$")),
            "f_quoted": flag(before.rlike("[\"'`]$") & after.rlike("^[\"'`]")),
            "f_aws": flag(c.rlike("^(?:AKIA|ASIA)[0-9A-Z]{16}$") | c.rlike("^gh[pousr]_[A-Za-z0-9]{30,}$")),
        }
    )


def proposed(text: Column) -> Column:
    """array<struct<start, end, hit>> of runs and assigned values; of overlapping ones the first, of those at one start the run."""
    none = F.expr("cast(array() as array<struct<start: int, last: int, end: int, hit: string>>)")

    def value(m, hit):
        return F.struct(m["end"].alias("start"), F.lit(1).alias("last"), (m["end"] + F.length(hit)).alias("end"), hit.alias("hit"))

    runs = F.transform(
        matches(text, RUN, RUN_GUARD), lambda m: F.struct(m["start"].alias("start"), F.lit(0).alias("last"), m["end"].alias("end"), m["hit"].alias("hit"))
    )
    values = F.zip_with(matches(text, ASSIGNED, ASSIGNED_GUARD), F.regexp_extract_all(text, F.lit(ASSIGNED), F.lit(1)), value)
    values = F.when(text.rlike(ASSIGNED_GUARD), values).otherwise(none)
    apart = lambda kept, m: F.when((F.size(kept) > 0) & (F.element_at(kept, -1)["end"] > m["start"]), kept).otherwise(F.array_append(kept, m))
    return F.aggregate(F.array_sort(F.concat(runs, values)), none, apart)


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """One row for each candidate: id, path, start, end, candidate, before, after."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    held = docs.select(F.col(id_col).alias("_id"), F.col(path_col).cast("string").alias("path"), text.alias("_text"))
    found = held.withColumn("_found", proposed(F.col("_text"))).where(F.size("_found") > 0)
    m = F.col("_m")
    cut = F.transform(
        "_found",
        lambda x: F.struct(
            x["start"].alias("start"),
            x["end"].alias("end"),
            x["hit"].alias("candidate"),
            F.substr(F.col("_text"), F.greatest(x["start"] - NEAR, F.lit(0)) + 1, F.least(x["start"], F.lit(NEAR))).alias("before"),
            F.substr(F.col("_text"), x["end"] + 1, F.lit(NEAR)).alias("after"),
        ),
    )
    rows = found.select("_id", "path", F.explode(cut).alias("_m"))
    return rows.select(
        F.col("_id").alias(id_col), "path", *[m[x].alias(x) for x in ("start", "end", "candidate", "before", "after")]
    )


def hand_written(spark, part: int) -> DataFrame:
    """(before, candidate, after, path, is_secret) of every second pair of hand-written findings, part 0 or 1; the last mark of a text counts."""
    rows = []
    for text, path, label in (x for k, x in enumerate(HAND_WRITTEN) if k // 2 % 2 == part):
        head, _, rest = text.rpartition("[[")
        candidate, _, after = rest.partition("]]")
        before = head.replace("[[", "").replace("]]", "")
        rows.append((before[-NEAR:], candidate, after[:NEAR], path, float(label)))
    names = ("before", "candidate", "after", "path", "is_secret")
    listed = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row)]) for row in rows])
    return spark.range(1).select(F.explode(listed).alias("r")).select("r.*")


#: Words that the generated findings are made of.
NAMES = "example test user name config server client manager factory handler request value index table file main class method release image".split()


def labelled_findings(spark, n: int = FINDINGS, seed: int = SEED) -> DataFrame:
    """(before, candidate, after, path, is_secret): findings made by rule from hashes of their number."""
    h = lambda k: F.sha2(F.concat_ws("|", F.lit(seed), F.lit(k), F.col("id")), 512)
    pick = lambda k, m: F.conv(F.substring(h(f"pick{k}"), 1, 6), 16, 10).cast("int") % m
    take = lambda k, values: F.element_at(F.array(*[F.lit(v) for v in values]), pick(k, len(values)) + 1)
    b64 = F.regexp_replace(F.base64(F.unhex(h("b"))), "[=\\r\\n]", "")
    upper = F.upper(F.translate(h("u"), "abcdef", "qxkzvt"))
    key = take("key", ["password", "secret", "token", "api_key", "auth_token", "passwd", "access_key"])
    joiner = take("join", ['="', ' = "', ": ", "=", ":", ": '"])
    filler = take("fill", ["the build of ", "see here ", "", "and then in ", "with all of ", "was found by "])
    word = lambda k: F.initcap(take(k, NAMES))
    name = F.concat(F.lower(word("w1")), word("w2"), word("w3"), word("w4"), pick("num", 90).cast("string"))
    digest = take("dig", ["commit", "sha256", "md5", "checksum", "etag", "revision", "uuid", "digest"])
    size = lambda s, lo, m: F.substr(s, F.lit(1), pick("len", m) + lo)
    kinds = [
        (1, F.concat(filler, key, joiner), size(h("a"), 16, 30)),
        (1, F.concat(filler, key, joiner), size(b64, 16, 40)),
        (1, filler, F.concat(F.lit("AKIA"), F.substr(upper, F.lit(1), F.lit(16)))),
        (1, F.concat(filler, key, joiner), F.substr(h("c"), F.lit(1), F.lit(40))),
        (1, filler, F.concat(F.lit("ghp_"), F.substr(F.regexp_replace(b64, "[+/]", "x"), F.lit(1), F.lit(36)))),
        (0, F.concat(filler, digest, take("sep", [" ", ": ", "=", "/"])), F.substr(h("d"), F.lit(1), F.lit(40))),
        (0, F.concat(filler, digest, take("sep", [" ", ": ", "=", "/"])), F.substr(h("e"), F.lit(1), F.lit(64))),
        (0, filler, name),
        (0, F.concat(filler, take("num", ["call ", "card ", "order ", "id ", ""])), size(F.translate(h("f"), "abcdef", "123456"), 16, 8)),
        (0, F.concat(filler, key, joiner), F.concat(take("ph", ["your_", "example", "changeme_", "placeholder", "xxxxxxxxxxxx", "000000000000"]), name)),
        (0, filler, F.concat(F.lit("src/main/"), F.lower(word("w5")), F.lit("/"), name)),
        (0, F.concat(filler, digest, F.lit(" ")), F.regexp_replace(h("g"), "^(.{8})(.{4})(.{4})(.{4})(.{12}).*$", "$1-$2-$3-$4-$5")),
    ]
    which = pick("kind", len(kinds))
    row = F.lit(None)
    for i, (label, before, candidate) in enumerate(kinds):
        one = F.struct(F.lit(label).alias("is_secret"), before.alias("before"), candidate.alias("candidate"))
        row = one if i == 0 else F.when(which == i, one).otherwise(row)
    quoted = F.when(F.col("_k.before").rlike("[\"']$"), F.substring(F.col("_k.before"), -1, 1)).otherwise(take("end", [" and", ".", "", " the"]))
    path = take("path", ["app/settings.py", "deploy/prod.yml", "src1", "src7", "tests/test_app.py", "package.lock", "docs/guide.md"])
    made = spark.range(n).withColumn("_k", row).withColumn("path", path)
    return made.select("_k.before", "_k.candidate", quoted.alias("after"), "path", F.col("_k.is_secret").cast("double").alias("is_secret"))


def fit(findings: DataFrame, trees: int = TREES, depth: int = DEPTH, seed: int = SEED):
    """A forest on labelled findings with their coverage."""
    stages = [
        VectorAssembler(inputCols=FEATURES, outputCol="_features"),
        RandomForestClassifier(
            featuresCol="_features", labelCol="is_secret", numTrees=trees, maxDepth=depth, seed=seed,
            probabilityCol="_probability", predictionCol="_prediction", rawPredictionCol="_raw",
        ),
    ]
    return Pipeline(stages=stages).fit(features(findings).select("is_secret", *FEATURES))


def scan(
    docs: DataFrame,
    model=None,
    id_col: str = "doc_id",
    text_col: str = "text",
    path_col: str = "source",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """One row for each candidate: id, path, start, end, candidate, score, is_secret."""
    spark = docs.sparkSession
    found = materialize(candidates(docs, id_col, text_col, path_col).withColumnRenamed(id_col, "_id"), "secret-candidates")
    # Written, as a fit reads its few rows many times.
    findings = materialize(labelled_findings(spark).unionByName(hand_written(spark, 0)), "secret-findings")
    # The generated findings' own words count as words too.
    own = spark.range(1).select(F.explode(F.array(*[F.lit(w) for w in NAMES])).alias("word"))
    words = dictionary(docs, found.select("candidate").unionByName(findings.select("candidate")), text_col)
    words = small_side(words.unionByName(own).distinct())
    if model is None:
        model = fit(materialize(with_coverage(findings, words), "secret-findings"))
    scored = model.transform(features(with_coverage(found, words)))
    score = F.get(vector_to_array("_probability"), F.lit(1))
    return scored.select(
        F.col("_id").alias(id_col), "path", "start", "end", "candidate", score.alias("score"), (score >= threshold).alias("is_secret")
    )


def op2_secret_forest(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scan(docs)


QUERIES = {"op2_secret_forest": op2_secret_forest}
ORACLES: dict = {}
