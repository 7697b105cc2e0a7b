"""Cleaning and retrieval over documents, pages, benchmark and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallygrove.operators import cleaning as C
from tallygrove.operators import features as K
from tallygrove.operators import text as X
from tallygrove.operators.cluster import connected_components
from tallygrove.operators.vectors import best_matches
from tallygrove.session import materialize, small_side, table, text_shares

_TOK = "list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z][A-Za-z0-9_]{1,}'), lambda t: lower(t))"
_TF = f"""tf AS (SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest({_TOK}) AS token FROM documents) GROUP BY ALL),
 qtf AS (SELECT item_id, token, count(*) AS tf FROM (SELECT item_id, unnest({_TOK}) AS token FROM benchmark) GROUP BY ALL),
 df AS (SELECT token, count(*) AS df FROM tf GROUP BY 1), nd AS (SELECT count(*) AS n FROM documents)"""


def _size(docs):
    """(rows, characters) of documents."""
    n, chars = docs.agg(F.count("*"), F.sum(F.length("text"))).first()
    return n, chars or 0


def _index(spark, docs, sf):
    # Written, as frequencies, norms and postings all read it.
    tf = materialize(X.text_terms(docs, "doc_id", F.col("text")), "terms")
    q = materialize(X.term_counts(table(spark, sf, "benchmark"), "item_id", F.col("text")), "terms")
    return tf, q, X.document_frequencies(tf)


def _clean_sql(col):
    out = f"lower(translate(coalesce({col}, ''), chr(13) || chr(10), '  '))"
    for pattern, by in C.CLEANING:
        out = f"regexp_replace({out}, '{pattern}', '{by}', 'g')"
    return f"substr(trim({out}), 1, 5000)"


def clean_documents(spark, sf):
    """Cleaned texts of at most 5,000 characters, as the rule has it, of 20 or more; rare sources folded."""
    d = C.fold_rare(table(spark, sf, "documents").where("text is not null"), "source", 40)
    # Behind a generator, below which no filter is pushed: the text is cleaned once.
    t = d.select("doc_id", "source", F.explode(F.array(C.clean_text(F.col("text")))).alias("text"))
    return t.withColumn("text_len", F.length("text")).where("text_len >= 20")


CLEAN = f"""WITH c AS (SELECT source, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1),
 t AS (SELECT doc_id, CASE WHEN n < 40 THEN 'other' ELSE source END AS source, {_clean_sql('text')} AS text FROM documents JOIN c USING (source) WHERE text IS NOT NULL)
 SELECT *, length(text) AS text_len FROM t WHERE length(text) >= 20"""


def page_text(spark, sf):
    t = C.strip_html(F.col("html"))
    return table(spark, sf, "pages").select("page_id", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), t.alias("text"), F.length(t).alias("n"))


PAGES = r"""WITH p AS (SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, trim(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''),
 '(?is)<script.*?</script>|<style.*?</style>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM pages) SELECT *, length(text) AS n FROM p"""


def canonical_priority(spark, sf):
    o = table(spark, sf, "orders")
    p = C.canonical_priority(F.col("o_orderpriority"))
    return o.groupBy("o_orderpriority", p.alias("priority")).agg(F.count("*").alias("n"))


PRIO = "SELECT o_orderpriority, CASE lower(trim(regexp_replace(o_orderpriority, '^[0-9]+-', ''))) " + " ".join(
    f"WHEN '{w}' THEN '{k}'" for k, ws in C.PRIORITY_WORDS.items() for w in ws
) + " END AS priority, count(*) AS n FROM orders GROUP BY ALL"


def extract_references(spark, sf):
    p = table(spark, sf, "pages")
    return p.select(
        "page_id", F.array_sort(C.extract_urls(F.col("html"))).alias("urls"), F.array_sort(C.extract_paths(F.col("html"))).alias("paths"),
        F.array_sort(C.extract_identifiers(F.col("html"))).alias("names"),
    )


REFS = r"""SELECT page_id, list_sort(list_distinct(regexp_extract_all(html, 'https?://[A-Za-z0-9._/?=&%-]+'))) AS urls,
 list_sort(list_distinct(regexp_extract_all(html, '[A-Za-z0-9_./-]+\.(?:py|java|js|ts|go|rb|c|cpp|h|html|css|json|md)'))) AS paths,
 list_sort(list_distinct(regexp_extract_all(html, '[A-Za-z]+(?:_[A-Za-z0-9]+)+|[a-z]+(?:[A-Z][a-z0-9]+)+'))) AS names FROM pages"""


def first_comment(spark, sf):
    t = table(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn", "text")
    return C.first_by_key(t, ["conv_id"], ["turn"])


FIRST = """SELECT conv_id, turn, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS rn FROM conversations WHERE role = 'user') WHERE rn = 1"""


def tfidf_topk(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    n, chars = _size(docs)
    with text_shares(spark, chars):
        tf, q, dfs = _index(spark, docs, sf)
        dfs = materialize(dfs, "terms")
        w = X.tfidf(tf, dfs, F.lit(n), "doc_id", q.select("token").distinct())
        qw = X.tfidf(q, dfs, F.lit(n), "item_id")
        best = best_matches(qw, w, "item_id", "doc_id", 10)
    return X.top_k(best, "item_id", "doc_id", 10)


_WT = "(1 + ln(tf)) * (ln((n + 1) / (df + 1)) + 1)"
TFIDF = f"""WITH {_TF}, w0 AS (SELECT doc_id, token, {_WT} AS w FROM tf JOIN df USING (token), nd), w AS (SELECT doc_id, token, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM w0),
 q0 AS (SELECT item_id, token, {_WT} AS w FROM qtf JOIN df USING (token), nd), q AS (SELECT item_id, token, w / sqrt(sum(w * w) OVER (PARTITION BY item_id)) AS w FROM q0),
 s AS (SELECT item_id, doc_id, round(sum(q.w * w.w), 9) AS score FROM q JOIN w USING (token) GROUP BY ALL)
 SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 10"""


def bm25_topk(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    n, chars = _size(docs)
    with text_shares(spark, chars):
        tf, q, dfs = _index(spark, docs, sf)
        lengths = tf.groupBy("doc_id").agg(F.sum("tf").alias("length"))
        mean = lengths.agg(F.avg("length")).first()[0] or 1.0
        # Only tokens of queries have to be weighed.
        asked = q.select("token").distinct()
        w = X.bm25_weights(tf.join(asked, "token", "left_semi"), dfs.join(asked, "token", "left_semi"), lengths, F.lit(n), F.lit(mean), "doc_id")
        best = best_matches(q.select("item_id", "token", F.lit(1.0).alias("w")), w, "item_id", "doc_id", 10)
    return X.top_k(best, "item_id", "doc_id", 10)


BM25 = f"""WITH {_TF}, ln_ AS (SELECT doc_id, sum(tf) AS length FROM tf GROUP BY 1), m AS (SELECT avg(length) AS mean FROM ln_),
 s AS (SELECT item_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf.tf * 2.5 / (tf.tf + 1.5 * (0.25 + 0.75 * length / mean))), 9) AS score
 FROM qtf JOIN tf USING (token) JOIN df USING (token) JOIN ln_ USING (doc_id), nd, m GROUP BY ALL)
 SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 10"""


def bm25f_related(spark, sf):
    """Two-field BM25F (title = first line, weight 2; body, weight 1) of benchmark items against documents."""
    docs = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n, chars = _size(docs)
    with text_shares(spark, chars):
        best = _field_matches(spark, sf, docs, n)
    return X.top_k(best, "item_id", "doc_id", 5)


def _field_matches(spark, sf, docs, n):
    title = F.regexp_extract("text", r"^([^\n]*)", 1)
    parts = {"t": (title, 2.0), "b": (F.col("text"), 1.0)}
    q = materialize(X.term_counts(table(spark, sf, "benchmark"), "item_id", F.col("text")), "terms")
    asked = q.select("token").distinct()
    tf = None
    for name, (text, weight) in parts.items():
        # Written, as its sum, lengths and postings all read it; only tokens of queries have to be weighed.
        one = materialize(X.text_terms(docs, "doc_id", text), "terms")
        mean = (one.agg(F.sum("tf")).first()[0] or 0) / max(n, 1) or 1.0
        length = one.groupBy("doc_id").agg(F.sum("tf").alias("length"))
        norm = 0.25 + 0.75 * F.col("length") / mean
        one = one.join(asked, "token", "left_semi").join(length, "doc_id").select("doc_id", "token", (weight * F.col("tf") / norm).alias("x"))
        tf = one if tf is None else tf.unionByName(one)
    tf = materialize(tf.groupBy("doc_id", "token").agg(F.sum("x").alias("x")), "terms")
    dfs = X.document_frequencies(tf)
    w = tf.join(dfs, "token").select("doc_id", "token", (F.log((F.lit(n) + 1) / (F.col("df") + 1)) * F.col("x") / (1.2 + F.col("x"))).alias("w"))
    q = q.select("item_id", "token", (101 * F.col("tf") / (100 + F.col("tf"))).alias("w"))
    return best_matches(q, w, "item_id", "doc_id", 5)


def _field_sql(name, expr, weight):
    return f"""{name}0 AS (SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest({_TOK.replace("coalesce(text, '')", expr)}) AS token FROM documents) GROUP BY ALL),
 {name}l AS (SELECT doc_id, sum(tf) AS length FROM {name}0 GROUP BY 1), {name} AS (SELECT doc_id, token, {weight} * tf / (0.25 + 0.75 * length / ((SELECT sum(length) FROM {name}l) / (SELECT count(*) FROM documents))) AS x FROM {name}0 JOIN {name}l USING (doc_id))"""


BM25F = f"""WITH {_field_sql('ti', "regexp_extract(coalesce(text, ''), '^([^" + chr(92) + "n]*)', 1)", 2.0)}, {_field_sql('bo', "coalesce(text, '')", 1.0)},
 x AS (SELECT doc_id, token, sum(x) AS x FROM (SELECT * FROM ti UNION ALL SELECT * FROM bo) GROUP BY ALL), df AS (SELECT token, count(*) AS df FROM x GROUP BY 1), nd AS (SELECT count(*) AS n FROM documents),
 q AS (SELECT item_id, token, 101 * count(*) / (100 + count(*)) AS w FROM (SELECT item_id, unnest({_TOK}) AS token FROM benchmark) GROUP BY ALL),
 s AS (SELECT item_id, doc_id, round(sum(q.w * ln((n + 1) / (df + 1)) * x / (1.2 + x)), 9) AS score FROM q JOIN x USING (token) JOIN df USING (token), nd GROUP BY ALL)
 SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 5"""


def simhash_near_dups(spark, sf):
    h = materialize(X.simhash(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", F.col("text")), "simhash")
    return X.simhash_pairs(h, "doc_id")


SIMHASH = f"""WITH t AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]+') AS t FROM documents), g AS (SELECT doc_id, array_to_string(t[i:i + 2], ' ') AS g FROM (SELECT doc_id, t, unnest(range(1, len(t) - 1)) AS i FROM t WHERE len(t) >= 5)),
 h AS (SELECT doc_id, ('0x' || substr(sha256(g), 1, 16))::UBIGINT AS h FROM g),
 s AS (SELECT doc_id, sum(CASE WHEN b >= 0 THEN (1::HUGEINT << i) ELSE 0 END)::UBIGINT AS s FROM (SELECT doc_id, i, sum(CASE WHEN (h >> i) & 1 = 1 THEN 1 ELSE -1 END) AS b FROM h, range(0, 64) r(i) GROUP BY ALL) GROUP BY 1),
 f AS (SELECT s, min(doc_id) AS a FROM s GROUP BY 1)
 SELECT x.a, y.a AS b, bit_count(xor(x.s, y.s))::BIGINT AS distance FROM f x JOIN f y ON x.a < y.a AND bit_count(xor(x.s, y.s)) <= 3
 UNION ALL SELECT f.a, s.doc_id, 0 FROM s JOIN f USING (s) WHERE s.doc_id > f.a"""


def jaccard_near_dups(spark, sf):
    """Documents whose token sets have a Jaccard similarity of 0.8 or more."""
    return X.jaccard_pairs(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", F.col("text"))


JACCARD = f"""WITH s AS (SELECT doc_id, list_sort(list_distinct({_TOK})) AS s FROM documents), k AS (SELECT doc_id, s, min(doc_id) OVER (PARTITION BY s) AS a FROM s WHERE len(s) > 0),
 t AS (SELECT doc_id, len(s) AS n, unnest(s) AS token FROM k WHERE doc_id = a),
 p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) / (x.n + y.n - count(*)) AS jaccard FROM t x JOIN t y ON x.token = y.token AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id, x.n, y.n)
 SELECT * FROM p WHERE jaccard >= 0.8 UNION ALL SELECT a, doc_id, 1.0 FROM k WHERE doc_id > a"""


def duplicate_components(spark, sf):
    """Components over equal texts (as a star to the least id) and shared URLs-free first lines of 40 characters or more."""
    d = table(spark, sf, "documents").where("text is not null")
    first = F.regexp_extract("text", r"^([^\n]{40,})", 1)
    keys = d.select("doc_id", F.explode(F.array(F.md5("text"), F.when(first != "", F.md5(F.concat(F.lit("line|"), first))))).alias("k")).where("k is not null")
    hub = keys.groupBy("k").agg(F.min("doc_id").alias("hub"))
    edges = keys.join(hub, "k").where("doc_id <> hub").select(F.col("doc_id").alias("a"), F.col("hub").alias("b"))
    comp = connected_components(edges)
    return d.select("doc_id").join(comp, d.doc_id == comp.id, "left").select("doc_id", F.coalesce("component", "doc_id").alias("component"))


COMPONENTS = r"""WITH RECURSIVE k AS (SELECT doc_id, md5(text) AS k FROM documents WHERE text IS NOT NULL
 UNION ALL SELECT doc_id, md5('line|' || regexp_extract(text, '^([^\n]{40,})', 1)) FROM documents WHERE regexp_extract(text, '^([^\n]{40,})', 1) <> ''),
 e AS (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM k x JOIN k y USING (k) WHERE x.doc_id <> y.doc_id),
 r AS (SELECT doc_id AS a, doc_id AS c FROM documents WHERE text IS NOT NULL UNION SELECT e.b, r.c FROM r JOIN e USING (a) WHERE e.b > r.c)
 SELECT a AS doc_id, min(c) AS component FROM r GROUP BY 1"""


def overlap_audit(spark, sf):
    """Benchmark items contained in documents, found by shared eight-word keys and confirmed on the text."""
    words = lambda c: F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    b = table(spark, sf, "benchmark").select("item_id", words(F.col("text")).alias("bw")).where(F.size("bw") >= 8)
    b = b.select("item_id", F.array_join(F.slice("bw", 1, 8), " ").alias("k"), F.concat(F.lit(" "), F.array_join("bw", " "), F.lit(" ")).alias("bt"))
    b = materialize(b, "overlap")
    keys = small_side(b.select("item_id", "k"))
    d = table(spark, sf, "documents").select("doc_id", words(F.col("text")).alias("w")).where(F.size("w") >= 8)
    grams = F.array_distinct(F.transform(F.sequence(F.lit(0), F.size("w") - 8), lambda i: F.array_join(F.slice("w", i + 1, 8), " ")))
    hits = materialize(d.select("doc_id", F.explode(grams).alias("k")).join(keys, "k").select("doc_id", "item_id").distinct(), "overlap")
    # Whole texts are read for hits only.
    texts = d.select("doc_id", F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" ")).alias("dt"))
    met = hits.join(texts, "doc_id").join(b.select("item_id", "bt"), "item_id").where(F.col("dt").contains(F.col("bt")))
    return met.groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_docs"), F.min("doc_id").alias("first_doc"))


OVERLAP = r"""WITH b AS (SELECT item_id, ' ' || array_to_string(w, ' ') || ' ' AS bt FROM (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM benchmark) WHERE len(w) >= 8),
 d AS (SELECT doc_id, ' ' || array_to_string(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> ''), ' ') || ' ' AS dt FROM documents)
 SELECT item_id, count(DISTINCT doc_id) AS n_docs, min(doc_id) AS first_doc FROM b JOIN d ON contains(dt, bt) GROUP BY 1"""


def missing_masters(spark, sf):
    """Customers named by orders but absent as suppliers' keys: ids to fetch (anti-join)."""
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("id")).distinct()
    return o.join(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id")), "id", "left_anti")


def title_similarity(spark, sf):
    """Weighted duplicate score of conversations: cosine of the first turn's counts blended with that of all others."""
    t = table(spark, sf, "conversations").select((F.col("conv_id") * 2 + F.least("turn", F.lit(1))).alias("id"), "text")
    with text_shares(spark, _size(t)[1]):
        s = _title_matches(t)
    return X.top_k(s.withColumn("score", F.least(F.lit(1.0), "score")), "query_id", "item_id", 5, digits=6)


def _title_matches(t):
    tf = materialize(X.term_counts(t, "id", F.col("text")), "terms")
    norm = tf.groupBy("id").agg(F.sqrt(F.sum(F.col("tf") * F.col("tf"))).alias("norm"))
    w = tf.join(norm, "id").select("id", "token", (F.col("tf") / F.col("norm")).alias("w"))
    # The turn's kind is part of the token, so that first turns meet first turns only; its share is part of the query's weight.
    w = w.select(F.floor(F.col("id") / 2).alias("item_id"), F.concat(F.col("id") % 2, F.lit(" "), "token").alias("token"), "w")
    share = F.when(F.col("token").startswith("0"), 0.4).otherwise(0.55)
    q = w.where("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), "token", (F.col("w") * share).alias("w"))
    return best_matches(q, w, "query_id", "item_id", 5, places=6, others=True)


TITLE = f"""WITH c AS (SELECT conv_id * 2 + least(turn, 1) AS id, text FROM conversations),
 tf AS (SELECT id, token, count(*) AS tf FROM (SELECT id, unnest({_TOK}) AS token FROM c) GROUP BY ALL), w AS (SELECT id, token, tf / sqrt(sum(tf * tf) OVER (PARTITION BY id)) AS w FROM tf),
 s AS (SELECT q.id // 2 AS query_id, w.id // 2 AS item_id, CASE WHEN q.id % 2 = 0 THEN 0.4 ELSE 0.55 END * sum(q.w * w.w) AS part FROM w q JOIN w USING (token) WHERE q.id % 40 < 2 AND q.id % 2 = w.id % 2 AND q.id <> w.id GROUP BY q.id, w.id),
 g AS (SELECT query_id, item_id, round(least(1.0, sum(part)), 6) AS score FROM s GROUP BY ALL)
 SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM g) WHERE rank <= 5"""


def keyword_features(spark, sf):
    """All families of terms in documents and pages of markup: the first line is the summary, the rest the description."""
    d = table(spark, sf, "documents").select("doc_id", F.regexp_extract("text", r"^([^\n]*)", 1).alias("s"), F.regexp_extract("text", r"^[^\n]*\n((?s:.*))", 1).alias("d"))
    return K.keyword_features(d, "doc_id", F.col("s"), F.col("d"))


def _keyword_sql() -> str:
    q = lambda p: p.replace("'", "''")
    n = lambda t, p: f"len(regexp_extract_all({t}, '{q(p)}'))"
    flag = lambda t, p: f"regexp_matches({t}, '{q(p)}')::INT"
    cols = [x for f, p in K.FAMILIES.items() for x in (f"{flag('t', p)} AS {f}", f"{flag('s', p)} AS summary_{f}", f"{n('t', p)} AS {f}_count")]
    words = lambda t: f"len(list_filter(regexp_split_to_array({t}, '\\s+'), lambda w: w <> ''))"
    cols += [
        "length(s) AS summary_char_len", "length(d) AS description_char_len", f"{words('s')} AS summary_word_count", f"{words('d')} AS description_word_count",
        "length(d) - length(replace(d, chr(10), '')) + 1 AS description_line_count", f"{n('d', K.STACK_LINE)} AS stack_trace_line_count",
        "length(s) - length(replace(s, '!', '')) AS summary_exclamation_count", f"{flag('t', K.BUILD_ID)} AS contains_build_id", f"{flag('t', K.VERSION)} AS contains_version_number",
    ]
    total = lambda names, head="": " + ".join(head + x for x in names)
    sums = [f"{total(v)} AS {k}_signal_count" for k, v in K.SIGNALS.items()]
    sums += [f"{total(K.SIGNALS[k], 'summary_')} AS summary_{k}_signal_count" for k in ("high_priority", "p2_boundary")]
    sums.append(f"{total(K.SIGNALS['high_priority'])} - ({total(K.SIGNALS['low_priority'])}) AS priority_signal_balance")
    return (
        "WITH l AS (SELECT doc_id, lower(coalesce(text, '')) AS x, position(chr(10) IN coalesce(text, '')) AS p FROM documents), "
        "r AS (SELECT doc_id, CASE WHEN p = 0 THEN x ELSE left(x, p - 1) END AS s, CASE WHEN p = 0 THEN '' ELSE substr(x, p + 1) END AS d FROM l), "
        f"t AS (SELECT *, s || chr(10) || d AS t FROM r), f AS (SELECT doc_id, {', '.join(cols)} FROM t) SELECT *, {', '.join(sums)} FROM f"
    )


KEYWORDS = _keyword_sql()

QUERIES = {
    "clean_documents": clean_documents, "page_text": page_text, "canonical_priority": canonical_priority, "extract_references": extract_references,
    "first_comment": first_comment, "tfidf_topk": tfidf_topk, "bm25_topk": bm25_topk, "bm25f_related": bm25f_related, "simhash_near_dups": simhash_near_dups, "jaccard_near_dups": jaccard_near_dups,
    "duplicate_components": duplicate_components, "overlap_audit": overlap_audit, "missing_masters": missing_masters, "title_similarity": title_similarity,
    "keyword_features": keyword_features,
}
ORACLES = {
    "clean_documents": CLEAN, "page_text": PAGES, "canonical_priority": PRIO, "extract_references": REFS, "first_comment": FIRST, "tfidf_topk": TFIDF,
    "bm25_topk": BM25, "bm25f_related": BM25F, "simhash_near_dups": SIMHASH, "jaccard_near_dups": JACCARD, "duplicate_components": COMPONENTS, "overlap_audit": OVERLAP,
    "missing_masters": "SELECT DISTINCT o_custkey AS id FROM orders WHERE o_custkey NOT IN (SELECT s_suppkey FROM supplier)", "title_similarity": TITLE,
    "keyword_features": KEYWORDS,
}
