"""Text retrieval on inverted indexes: tokens, TF-IDF, BM25, BM25F, SimHash.

All similarities are equi-joins on tokens with a sum, never a comparison of all
pairs. Weights of a query are joined with postings of the same token only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallygrove.operators.sets import confirmed, indexed, meeting
from tallygrove.session import free_shuffles, materialize, release, small_side, text_batches

#: The token pattern and the BM25 constants.
TOKEN = "[A-Za-z][A-Za-z0-9_]{1,}"
K1, B = 1.5, 0.75


def tokens(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0)), lambda t: F.lower(t))


def term_counts(df: DataFrame, id_col: str, text: Column) -> DataFrame:
    """(id, token, tf), counted within each map task first."""
    return df.select(id_col, F.explode(tokens(text)).alias("token")).groupBy(id_col, "token").agg(F.count("*").alias("tf"))


def text_terms(df: DataFrame, id_col: str, text: Column) -> DataFrame:
    """The same of ids that have a text each or few: texts are dealt out by id, so that a task counts the words of its share of texts and no word is shuffled."""
    dealt = df.select(id_col, text.alias("_t")).repartition(id_col)
    return term_counts(dealt, id_col, F.col("_t"))


def document_frequencies(tf: DataFrame) -> DataFrame:
    return tf.groupBy("token").agg(F.count("*").alias("df"))


def tfidf(tf: DataFrame, dfs: DataFrame, n: Column, id_col: str, only: DataFrame | None = None) -> DataFrame:
    """(id, token, w): (1 + ln tf) * (ln((n + 1) / (df + 1)) + 1), L2-normalised by document over all its tokens; rows of the tokens of ``only`` if given."""
    w = (1 + F.log("tf")) * (F.log((n + 1) / (F.col("df") + 1)) + 1)
    raw = tf.join(dfs, "token").select(id_col, "token", w.alias("w"))
    norm = raw.groupBy(id_col).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("_norm"))
    if only is not None:
        raw = tf.join(only, "token", "left_semi").join(dfs, "token").select(id_col, "token", w.alias("w"))
    return raw.join(norm, id_col).select(id_col, "token", (F.col("w") / F.col("_norm")).alias("w"))


def dot(queries: DataFrame, docs: DataFrame, query_id: str, doc_id: str) -> DataFrame:
    """(query, doc, score) of pairs that share a token, from (id, token, w) on both sides."""
    q = queries.select(query_id, "token", F.col("w").alias("_qw"))
    return q.join(docs, "token").groupBy(query_id, doc_id).agg(F.sum(F.col("_qw") * F.col("w")).alias("score"))


def bm25_weights(tf: DataFrame, dfs: DataFrame, lengths: DataFrame, n: Column, mean_length: Column, id_col: str, k1: float = K1, b: float = B) -> DataFrame:
    """(id, token, w) with idf * tf (k1 + 1) / (tf + k1 (1 - b + b length / mean))."""
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = k1 * (1 - b + b * F.col("length") / mean_length)
    met = tf.join(dfs, "token").join(lengths, id_col)
    return met.select(id_col, "token", (idf * F.col("tf") * (k1 + 1) / (F.col("tf") + norm)).alias("w"))


def top_k(scored: DataFrame, query: str, item: str, k: int, score: str = "score", digits: int = 9) -> DataFrame:
    """The k best items of each query by rounded score, then id. Spark keeps k rows for each group before the shuffle."""
    s = scored.withColumn(score, F.round(score, digits))
    rank = F.row_number().over(Window.partitionBy(query).orderBy(F.desc(score), item))
    return s.withColumn("rank", rank).where(F.col("rank") <= k)


def simhash(df: DataFrame, id_col: str, text: Column, width: int = 3, least: int = 5) -> DataFrame:
    """(id, simhash): 64 bits over all shingles of words; texts of fewer than ``least`` tokens have none."""
    t = df.select(id_col, F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9_]+"), F.lit(0)).alias("_t")).where(F.size("_t") >= least)
    grams = F.transform(F.sequence(F.lit(0), F.size("_t") - width), lambda i: F.array_join(F.slice("_t", i + 1, width), " "))
    g = t.select(id_col, F.explode(grams).alias("g"))
    h = F.conv(F.substring(F.sha2("g", 256), 1, 16), 16, -10).cast("bigint")
    bits = [F.sum(F.shiftrightunsigned("h", i).bitwiseAND(F.lit(1)) * 2 - 1).alias(f"b{i}") for i in range(64)]
    s = g.select(id_col, h.alias("h")).groupBy(id_col).agg(*bits)
    value = F.lit(0).cast("bigint")
    for i in range(64):
        value = value.bitwiseOR(F.when(F.col(f"b{i}") >= 0, F.shiftleft(F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint")))
    return s.select(id_col, value.alias("simhash"))


def simhash_pairs(hashes: DataFrame, id_col: str, most: int = 3) -> DataFrame:
    """(a, b, distance) within ``most`` bits. Pairs that near agree in one of four 16-bit bands; equal hashes are paired with their least id only."""
    least = hashes.groupBy("simhash").agg(F.min(id_col).alias("a"))
    copies = hashes.join(least, "simhash").where(F.col(id_col) > F.col("a")).select("a", F.col(id_col).alias("b"), F.lit(0).cast("long").alias("distance"))
    bands = F.array(*[F.struct(F.lit(i).alias("i"), F.shiftrightunsigned("simhash", 16 * i).bitwiseAND(F.lit(0xFFFF)).alias("v")) for i in range(4)])
    x = least.select(F.col("a").alias("id"), "simhash", F.explode(bands).alias("band"))
    y = x.select(F.col("id").alias("b"), F.col("simhash").alias("_y"), "band")
    d = F.bit_count(F.col("simhash").bitwiseXOR(F.col("_y"))).cast("long")
    near = x.join(y, "band").where(F.col("id") < F.col("b")).select(F.col("id").alias("a"), "b", d.alias("distance")).where(F.col("distance") <= most)
    return near.distinct().unionByName(copies)


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def jaccard_pairs(df: DataFrame, id_col: str, text: Column, least: float = 0.8) -> DataFrame:
    """(a, b, jaccard) of texts whose token sets reach ``least``, exactly, by an index on rare tokens.

    Two such sets share one of their rarest tokens: of n tokens the first
    n - ceil(least * n) + 1, rarest first, are indexed, with a sketch of the set that
    leaves pairs out where they meet (``operators/sets``). Equal sets are paired
    with their least id only; texts without tokens have no pairs. Texts are read again
    rather than written as sets, but for those of pairs that are left. Tokens go by
    64-bit hashes.
    """
    spark = df.sparkSession
    text_batches(spark)
    named = df.select(F.col(id_col).cast("long").alias("_id"), text.alias("_t"))
    sets = lambda rows: rows.select("_id", F.array_sort(F.array_distinct(tokens(F.col("_t")))).alias("_s")).where(F.size("_s") > 0)
    hashes = F.array_distinct(F.transform("_s", lambda t: F.xxhash64(t))).alias("_h")
    hashed = sets(named).select("_id", F.md5(F.array_join("_s", " ")).alias("_k"), hashes)
    index = indexed(hashed, least)
    hub = materialize(index.groupBy("_k").agg(F.min("_id").alias("a"), F.count("*").alias("c")).where("a is not null"), "jaccard-hubs")
    copies = index.select("_id", "_k").join(hub.where("c > 1").select("_k", "a"), "_k").where(F.col("_id") > F.col("a")).select("a", F.col("_id").alias("b"), F.lit(1.0).alias("jaccard"))
    copies = materialize(copies, "jaccard")
    one = materialize(index.join(hub.select(F.col("a").alias("_id"), "_k"), ["_id", "_k"], "left_semi"), "jaccard-one")
    for done in (index, hub):
        release(done)
    free_shuffles(spark)
    pairs = meeting(one, least)
    release(one)
    free_shuffles(spark)
    wanted = small_side(pairs.select(F.explode(F.array("a", "b")).alias("_w")).distinct())
    met = confirmed(pairs, sets(named.join(wanted, F.col("_id") == F.col("_w"), "left_semi")).select("_id", hashes), least)
    for done in (wanted, pairs):
        release(done)
    free_shuffles(spark)
    return met.unionByName(copies)
