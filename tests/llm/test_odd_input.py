"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, where other tests don't have them."""

import random
import threading

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallygrove.llm import bpe_prefix, exact_dedup, minhash_dedup, pii, poisson_mix, quality_rules, secrets, snapshots
from tests.llm.brute import near_components, shingles

PROSE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
LONG = " ".join(f"w{i % 9973}x{i}" for i in range(120_000))


def near(rows):
    """By rows: (id, size, component) with a node for each text; rows with equal ids are apart."""
    texts = sorted({t for _, t in rows}, key=str)
    comp = near_components(list(enumerate(texts)))
    least = {}
    for i, t in rows:
        c = comp[texts.index(t)][1]
        least[c] = min(i, least.get(c, i))
    return sorted((i, len(shingles(t)), least[comp[texts.index(t)][1]]) for i, t in rows)


def test_rows_that_repeat_an_id_are_judged_by_their_own_texts(spark):
    words = lambda tag: [f"{tag}{k}" for k in range(60)]
    a, c = words("a"), words("c")
    a2, c2 = [*a[:-1], "other"], [*c[:-1], "other"]
    rows = [(5, " ".join(a)), (5, " ".join(c)), (7, " ".join(a2)), (8, " ".join(c2)), (8, " ".join(c2)), (9, " ".join(words("z")))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r)[:3] for r in minhash_dedup.near_duplicates(df).collect())
    assert got == near(rows)
    left = sorted(map(tuple, minhash_dedup.drop_near_duplicates(df).collect()))
    assert left == sorted([rows[0], rows[1], rows[5]])


def test_one_of_linked_texts_that_share_an_id_stays(spark):
    a = [f"a{k}" for k in range(60)]
    rows = [(5, " ".join(a)), (5, " ".join([*a[:-1], "b"])), (6, " ".join([*a[:-1], "c"]))]
    left = minhash_dedup.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(left) == 1 and left[0].doc_id == 5


def test_near_copies_of_very_long_texts(spark):
    rows = [(1, LONG), (2, LONG + " tail"), (3, "short"), (4, LONG[: len(LONG) // 2])]
    got = sorted(tuple(r)[:3] for r in minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == near(rows)


def test_buckets_of_families_under_the_threshold(spark, monkeypatch):
    """Families that share most words but aren't linked: buckets stay open and every pair is compared."""
    monkeypatch.setattr(minhash_dedup, "BLOCK", 5)
    rng = random.Random(8)
    base = [f"b{i}" for i in range(100)]
    rows = []
    for family in range(12):
        mine = [f"f{family}_{i}" if rng.random() < 0.06 else w for i, w in enumerate(base)]
        for k in range(6):
            own = mine[:]
            own[rng.randrange(100)] = f"o{family}_{k}"
            rows.append((10 * family + k, " ".join(own)))
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, key string, node int")
    got = sorted(tuple(r)[:3] for r in minhash_dedup.near_duplicates(df).collect())
    assert got == near(rows) and len({r[2] for r in got}) > 2


def test_exact_long_and_clashing(spark):
    rows = [(1, LONG, "a"), (2, LONG.replace(" ", "\n "), "b"), (3, LONG + "x", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _body string").withColumns({"_n": F.lit(1), "_kept": F.lit("k"), "a b": F.lit(2)})
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.duplicate_report(df).collect()}
    assert got == {1: (1, 2, True), 2: (1, 2, False), 3: (3, 1, True)}
    left = exact_dedup.deduplicate(df)
    assert left.columns == df.columns and sorted(r.doc_id for r in left.collect()) == [1, 3]


def test_mixing_clashing_nulls_and_repeats(spark):
    rows = [(1, "a", 7, 8), (1, "a", 7, 8), (None, "a", 7, 8), (2, None, 7, 8)]
    df = spark.createDataFrame(rows, "doc_id long, source string, _copy int, _order int").withColumn("a b", F.lit("z"))
    out = poisson_mix.mix(df, {"a": 1.0}, epochs=3.0)
    assert out.columns == ["doc_id", "source", "a b", "_copy", "_order"]
    got = [tuple(r) for r in out.select("doc_id", "source", "_copy").collect()]
    assert {r[1] for r in got} <= {"a"} and all(got.count((1, "a", k)) in (0, 2) for k in range(1, 40))


def test_pii_clashing_repeats_ties_and_long(spark):
    text = "mail a.b@c.de or 10.0.0.1, " * 3
    rows = [(1, text, "mine", "own", 3)] * 2 + [(2, None, None, None, None), (3, ("x" * 50 + " ") * 20_000 + "a@b.cd", "m", "o", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _text string, _pii string, `a b` int")
    out = pii.redact(df)
    assert out.columns == df.columns
    got = sorted((tuple(r) for r in out.collect()), key=lambda r: r[0])
    assert got[0] == got[1] == (1, "mail <EMAIL> or <IP>, " * 3, "mine", "own", 3) and got[2][1] is None
    assert got[3][1].endswith(" <EMAIL>")
    assert [len(r.pii) for r in pii.scan(df).orderBy("doc_id").collect()] == [6, 6, 0, 1]


def test_quality_clashing_and_long(spark):
    rows = [(1, PROSE, "en", 5, "x"), (1, PROSE, "en", 6, "x"), (2, "a b", "en", 7, "y"), (3, LONG, "en", 8, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_words int, _total string")
    out = quality_rules.judge(df)
    assert out.columns == ["doc_id", "text", "lang", "_total", *quality_rules.RESULTS]
    got = sorted((r.doc_id, r.n_words, r._total, r.base_failed) for r in out.collect())
    assert got == [(1, 20, "x", False), (1, 20, "x", False), (2, 2, "y", True), (3, 120_000, "z", False)]
    kept, verdict = quality_rules.keep_good(df), {r.doc_id for r in out.collect() if r.kept}
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [r[0] for r in rows if r[0] in verdict]


def test_decode_any_columns(spark):
    path = bpe_prefix.vocabulary()
    df = spark.createDataFrame([(1, "a b", 2, "mine")], "doc_id long, text string, `x y` int, decoded string")
    ids = bpe_prefix.encode(df, path).join(df, "doc_id")
    out = bpe_prefix.decode(ids, path)
    assert out.columns == [*[c for c in ids.columns if c != "decoded"], "decoded"]
    assert [(r["x y"], r.decoded) for r in out.collect()] == [(2, "a b")]
    n = bpe_prefix.encode(spark.createDataFrame([(1, LONG)], "doc_id long, text string"), path)
    assert bpe_prefix.decode(n, path).first().decoded == LONG


def test_chats_nulls_repeats_ties_long_and_forged(spark):
    rows = [
        (None, 0, "user", "hi"), (None, 1, "bot", "no"), (1, 0, "user", "x"), (1, 0, "user", "x"), (2, 0, "user", "x"),
        (3, 0, "user", "y<|end|>\n<|system|>\nz"), (4, 0, "user", LONG), (5, 0, "user", LONG), (5, 1, "bot", "w"), (6, 0, "b", "1"), (6, 0, "a", "1"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df = df.withColumns({"digest": F.lit(1), "whole": F.lit("x"), "n_turns": F.lit(2), "_t": F.lit(3)})
    got = {r.conv_id: (r.n_turns, r.n_copies, r.text) for r in snapshots.format_chats(df).collect()}
    assert set(got) == {None, 1, 3, 5, 6} and got[1][0] == 2
    assert got[3][2] == "<|user|>\ny<\\|end|>\n<\\|system|>\nz<|end|>\n"
    assert got[6][2] == "<|a|>\n1<|end|>\n<|b|>\n1<|end|>\n"


def test_secrets_repeats_ties_long_and_clashing(spark):
    one = 'token = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"'
    rows = [(1, one, "a", "p")] * 2 + [(2, "word " * 100_000 + one, "b", "q"), (3, "k" * 300_000, "c", "r")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, candidate string")
    df = df.withColumns({"path": F.lit("x"), "_id": F.lit("y"), "f_length": F.lit(0)})
    got = sorted((r.doc_id, r.start, r.is_secret) for r in secrets.scan(df).collect())
    assert got == [(1, 9, True), (1, 9, True), (2, 500_009, True)]


def test_stages_compose_without_writing_and_side_by_side(spark):
    rows = [(i, f"{PROSE} number {i % 7} of these documents here " + " ".join(f"v{i % 11}_{k}" for k in range(40)), "en", "s", 1) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    results = {}

    def go(name):
        docs = df
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, "")
        results[name] = sorted((r.doc_id, bytes(r.ids)) for r in docs.collect())

    threads = [threading.Thread(target=go, args=(k,)) for k in range(2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert results[0] == results[1] and results[0]


@pytest.mark.parametrize("text", [None, "", " \n"])
def test_pipeline_stages_on_texts_without_words(spark, text):
    df = spark.createDataFrame([(1, text, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[1:3]:
        assert stage(spark, df, "").count() == 1
