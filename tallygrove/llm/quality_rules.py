"""Quality rules by distribution divergence, in DataFrame functions only.

Base rules count words, word characters, symbols, repeated lines and words in
eight-word windows that occur twice or more. The method compares each
document's histogram of character classes, and of common words, with that of
its language, by the Jensen-Shannon distance (base 2, so between 0 and 1).

The language references are the sums of both histograms over all documents of
a language that pass the base rules, and over all of them. Characters are held
against the nearest reference, as documents carry wrong languages too; words
against the document's own language, unless it isn't in ``COMMON``. Guards: a
document of fewer than ``LEAST_WORDS`` words, or a language with fewer than
``LEAST_REFERENCE`` words, isn't judged by divergence. A document is kept if it
passes the base rules and no judged distance is above its limit.

Defined results: a null text has no words and fails the base rules; rows are
judged one by one, so repeated rows repeat their verdict; an empty table gives
no rows. Windows are compared by 64-bit hashes of their words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallygrove.session import materialize, release, small_side

WINDOW = 8
LEAST_WORDS = 50
LEAST_REFERENCE = 1000
#: Distances above which a document is rejected.
CHAR_LIMIT, WORD_LIMIT = 0.28, 0.35

#: Function words of each language.
COMMON = {
    "de": "der die und in den von zu das mit ist".split(),
    "en": "the of and to in a is that for it".split(),
    "es": "de la que el en y los se del un".split(),
    "fr": "de la le et les des en un du que".split(),
}
_BLANK, _SYMBOLS = r"[\x20\x09-\x0D]+", "[#*$%&|<>]+"
#: Java patterns of the character classes; what none matches is the last class.
CLASSES = ("[a-z]+", "[A-Z]+", "[0-9]+", _BLANK, r"[.,;:!?'\"()-]+", _SYMBOLS, r"[^\x00-\x7F]+")


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeated(hashes: Column) -> Column:
    """Words covered by windows that occur twice or more, of an array of word hashes."""
    return _let(hashes, _repeated_bound)


def _doubled(keys: Column, width: int) -> Column:
    """Keys of windows twice as wide: each with the key ``width`` words on. The last ``width`` keys lack words."""
    return F.zip_with(keys, F.slice(keys, width + 1, F.size(keys)), lambda a, b: F.xxhash64(a, b))


def _repeated_bound(hashes: Column) -> Column:
    # Three doublings make keys of eight words.
    wide = _let(_doubled(hashes, 1), lambda k2: _let(_doubled(k2, 2), lambda k4: _doubled(k4, 4)))
    keys = F.slice(wide, 1, F.size(hashes) - WINDOW + 1)

    def covered(ks: Column) -> Column:
        pairs = F.array_sort(F.transform(ks, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))

        def twice(ps: Column) -> Column:
            last = F.size(ps) - 1
            alike = F.filter(
                ps,
                lambda p, j: (
                    F.coalesce(F.get(ps, j - 1)["k"] == p["k"], F.lit(False))
                    | ((j < last) & F.coalesce(F.get(ps, j + 1)["k"] == p["k"], F.lit(False)))
                ),
            )
            at = F.array_sort(F.transform(alike, lambda p: p["i"]))
            steps = lambda a: F.aggregate(
                F.transform(a, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(a, j + 1) - x, F.lit(WINDOW)))),
                F.lit(0),
                lambda s, x: s + x,
            )
            return _let(at, steps)

        return F.when(F.size(F.array_distinct(ks)) == F.size(ks), 0).otherwise(_let(pairs, twice))

    return F.when(F.size(hashes) < WINDOW + 1, 0).otherwise(_let(keys, covered)).cast("long")


def _words(text: Column) -> Column:
    return F.filter(F.split(text, _BLANK), lambda w: w != "")


def _counter(common: list[str]):
    """How often each of the words is in an array."""
    return lambda a: F.array(*[(F.size(a) - F.size(F.array_remove(a, w))).cast("long") for w in common])


def _common_counts(words: Column, common: list[str]) -> Column:
    """Counts of the common words, as listed or with a capital."""
    own = F.filter(words, lambda w: w.isin(*common, *[w.capitalize() for w in common]))
    return _let(F.transform(own, lambda w: F.lower(w)), _counter(common))


def measured(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs with the base counts and both histograms (_chars, _common)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    chars = [(F.length("_text") - F.length(F.regexp_replace("_text", c, ""))).cast("long") for c in CLASSES]
    found = F.lit(None).cast("array<long>")
    for lang, words in COMMON.items():
        found = F.when(F.col(lang_col) == lang, _common_counts(F.col("_words"), words)).otherwise(found)
    out = docs.withColumn("_text", text).withColumn("_words", _words(F.col("_text")))
    out = out.withColumns(
        {
            "_lines": lines,
            "_counts": F.array(*chars),
            "_found": found,
            "_total": F.length("_text").cast("long"),
            "n_words": F.size("_words").cast("long"),
            "n_repeat_words": _repeated(F.transform("_words", lambda w: F.xxhash64(w))),
        }
    )
    rest = lambda a, whole: F.concat(a, F.array(whole - F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)))
    out = out.withColumns(
        {
            "word_chars": F.col("_total") - F.get("_counts", F.lit(CLASSES.index(_BLANK))),
            "n_symbols": F.get("_counts", F.lit(CLASSES.index(_SYMBOLS))),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_chars": rest(F.col("_counts"), F.col("_total")),
            "_common": rest(F.col("_found"), F.col("n_words")),
            "base_failed": (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")),
        }
    )
    return out.drop("_text", "_words", "_lines", "_counts", "_found", "_total")


def _known(lang_col: str) -> Column:
    return F.when(F.col(lang_col).isin(*COMMON), F.col(lang_col)).otherwise("")


def references(docs: DataFrame, lang_col: str = "lang") -> DataFrame:
    """(_ref, _ref_chars, _ref_common): sums over the documents of each language that pass the base rules; '' sums over all.

    At most one row for each language of ``COMMON`` and one for all, of 19 numbers each, whatever the input.
    """
    good = docs.where("not base_failed").select(
        _known(lang_col).alias("_ref"), F.posexplode(F.concat("_chars", F.coalesce("_common", F.array()))).alias("_i", "_v")
    )
    by = good.groupBy("_ref", "_i").agg(F.sum("_v").alias("_v"))
    width = len(CLASSES) + 1
    whole = by.where(F.col("_i") < width).groupBy("_i").agg(F.sum("_v").alias("_v"))
    cells = by.where("_ref <> ''").unionByName(whole.withColumn("_ref", F.lit("")))
    rows = cells.groupBy("_ref").agg(F.array_sort(F.collect_list(F.struct("_i", "_v"))).alias("_a"))
    sums = F.transform("_a", lambda x: x["_v"])
    return rows.select(
        "_ref",
        F.slice(sums, 1, width).alias("_ref_chars"),
        F.when(F.size("_a") > width, F.slice(sums, width + 1, 999)).alias("_ref_common"),
    )


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def distance(a: Column, b: Column) -> Column:
    """Jensen-Shannon distance, base 2, of two arrays of counts; null if either is null or empty of counts."""
    as_double = lambda x: F.transform(x, lambda v: v.cast("double"))
    na, nb = _sum(as_double(a)), _sum(as_double(b))
    part = lambda p, m: F.when(p > 0, p * F.log2(p / m)).otherwise(0.0)

    def joint(x, y, n1, n2):
        p, q = x / n1, y / n2
        m = (p + q) / 2
        return (part(p, m) + part(q, m)) / 2

    inner = _let(
        F.struct(na.alias("n"), nb.alias("m")),
        lambda t: _sum(F.zip_with(as_double(a), as_double(b), lambda x, y: joint(x, y, t["n"], t["m"]))),
    )
    return F.when((na > 0) & (nb > 0), F.sqrt(F.greatest(inner, F.lit(0.0))))


#: Columns that judge() adds.
RESULTS = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "char_distance", "word_distance", "kept",
]


def _judged(m: DataFrame, char_limit: float, word_limit: float) -> DataFrame:
    """Written measures, with the distances and kept."""
    refs = references(m, "_lang")
    # One row of at most one array for each language.
    nearest = refs.agg(F.collect_list("_ref_chars").alias("_all_chars"))
    own = refs.select("_ref", "_ref_common")
    met = m.withColumn("_own", _known("_lang")).join(F.broadcast(own), F.col("_own") == F.col("_ref"), "left")
    met = met.crossJoin(F.broadcast(nearest))
    enough = F.col("n_words") >= LEAST_WORDS
    large = _sum(F.transform("_ref_common", lambda v: v.cast("double"))) >= LEAST_REFERENCE
    met = met.withColumn("char_distance", F.when(enough, F.array_min(F.transform("_all_chars", lambda r: distance(F.col("_chars"), r)))))
    met = met.withColumn("word_distance", F.when(enough & large, distance(F.col("_common"), F.col("_ref_common"))))
    far = F.coalesce(F.col("char_distance") > char_limit, F.lit(False)) | F.coalesce(
        F.col("word_distance") > word_limit, F.lit(False)
    )
    return met.withColumn("kept", ~F.col("base_failed") & ~far)


def _packed(docs: DataFrame, columns: list[str], text_col: str, lang_col: str) -> DataFrame:
    row = F.struct(*[F.col(f"`{c}`") for c in columns]) if columns else F.lit(None)
    return docs.select(row.alias("_row"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("_lang"))


def judge(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    char_limit: float = CHAR_LIMIT,
    word_limit: float = WORD_LIMIT,
    columns: list[str] | None = None,
) -> DataFrame:
    """docs, or its ``columns``, with the base counts, base_failed, char_distance, word_distance and kept, which replace columns of these names.

    Texts are measured once and written with those columns to the shared folder,
    as both the references and the verdicts read the measures.
    """
    columns = [c for c in (docs.columns if columns is None else columns) if c.lower() not in RESULTS]
    m = materialize(measured(_packed(docs, columns, text_col, lang_col), "text", "_lang").drop("text"), "quality-measured")
    return _judged(m, char_limit, word_limit).select(*[F.col(f"_row.`{c}`") for c in columns], *RESULTS)


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs that are kept, with their own columns.

    Only ids, text hashes and languages of rejected rows are joined with docs;
    rows that share all three have one text and one verdict.
    """
    keys = {"_i": F.col(f"`{id_col}`"), "_h": F.xxhash64(F.col(f"`{text_col}`")), "_l": F.col(f"`{lang_col}`")}
    keyed = docs.select(*[c.alias(k) for k, c in keys.items()], F.col(f"`{text_col}`").alias("text"))
    m = materialize(measured(_packed(keyed, list(keys), "text", "_l"), "text", "_lang").drop("text"), "quality-measured")
    gone = _judged(m, CHAR_LIMIT, WORD_LIMIT).where("not kept").select([F.col(f"_row.{k}").alias(f"_gone{k}") for k in keys])
    gone = small_side(gone.distinct())
    release(m)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    left = docs.select(row, *[c.alias(k) for k, c in keys.items()])
    same = [F.col(k).eqNullSafe(F.col(f"_gone{k}")) for k in keys]
    return left.join(gone, same, "left_anti").select("_row.*")


def op4_divergence(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judge(docs, columns=["doc_id"]).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def _oracle() -> str:
    classes = [c.replace("\\'", "'").replace("'", "''") for c in CLASSES[:6]]
    counts = [f"(length(t) - length(regexp_replace(t, '{c}', '', 'g')))" for c in classes]
    # RE2 reads [^\x00-\x7F] by code points as Java does.
    counts.append("(length(t) - length(regexp_replace(t, '[^\\x00-\\x7F]+', '', 'g')))")
    common = " ".join(
        f"WHEN lang = '{k}' THEN [" + ", ".join(f"len(list_filter(ws, lambda x: x = '{w}' OR x = '{w.capitalize()}'))" for w in ws) + "]"
        for k, ws in COMMON.items()
    )
    known = ", ".join(f"'{k}'" for k in COMMON)

    def js(a: str, b: str) -> str:
        term = lambda p, m: f"CASE WHEN {p} > 0 THEN {p} * log2({p} / {m}) ELSE 0 END"
        p, q = f"({a}[i] / list_sum({a})::DOUBLE)", f"({b}[i] / list_sum({b})::DOUBLE)"
        m = f"(({p} + {q}) / 2)"
        return f"sqrt(greatest(0.0, list_sum(list_transform(range(1, len({a}) + 1), lambda i: ({term(p, m)} + {term(q, m)}) / 2))))"

    return rf"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM d
),
g AS (
  SELECT doc_id, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {WINDOW} + 2)) AS i FROM w WHERE len(ws) > {WINDOW})
),
c AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM c, range(0, {WINDOW}) t(k) GROUP BY doc_id),
b AS (
  SELECT doc_id, CASE WHEN lang IN ({known}) THEN lang ELSE '' END AS ref, len(ws)::BIGINT AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(r.n, 0)::BIGINT AS n_repeat_words,
         [{", ".join(counts)}] AS ch0, length(t) AS n_chars,
         CASE {common} ELSE NULL END AS wo0
  FROM w LEFT JOIN r USING (doc_id)
),
m AS (
  SELECT * EXCLUDE (ch0, wo0), list_append(ch0, n_chars - list_sum(ch0)::BIGINT) AS ch,
         list_append(wo0, n_words - list_sum(wo0)::BIGINT) AS wo,
         n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed
  FROM b
),
e AS (
  SELECT ref, [{", ".join(f"sum(ch[{i + 1}])" for i in range(len(CLASSES) + 1))}] AS rc,
         [{", ".join(f"sum(wo[{i + 1}])" for i in range(11))}] AS rw
  FROM m WHERE NOT base_failed GROUP BY ref
),
f AS (
  SELECT * FROM e WHERE ref <> '' UNION ALL
  SELECT '', [{", ".join(f"sum(rc[{i + 1}])" for i in range(len(CLASSES) + 1))}], NULL FROM e
),
j AS (
  SELECT m.*, CASE WHEN n_words >= {LEAST_WORDS} THEN list_min(list_transform((SELECT list(rc) FROM f), lambda r: {js("ch", "r")})) END AS cd,
         CASE WHEN n_words >= {LEAST_WORDS} AND list_sum(rw) >= {LEAST_REFERENCE} THEN {js("wo", "rw")} END AS wd
  FROM m LEFT JOIN f USING (ref)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(cd > {CHAR_LIMIT}, false) AND NOT coalesce(wd > {WORD_LIMIT}, false) AS kept
FROM j
"""


QUERIES = {"op4_divergence": op4_divergence}
ORACLES = {"op4_divergence": _oracle()}
