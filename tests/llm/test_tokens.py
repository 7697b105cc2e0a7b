import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tallygrove.llm import bpe_prefix as B
from tallygrove.llm import token_store as S
from tests.conftest import SF

public_tokenizers = pytest.importorskip("public_tokenizers")
BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")

ODD = [
    "", " ", "  ", "   a", "a  b", "a   b", "a \n b", "a\n \nb", "\n\n  x", "x\t y", "tail  ", "é ü ß 你好 мир", "<|endoftext|>",
    "a<|endoftext|> b<|endoftext|><|endoftext|>", "it's they'LL don't 's", " x y　 z", "a\x1cb\x85c", "😀👩‍👩‍👧 é",
    "####### !!!! 1234567 ١٢٣", "\x00\x01\x7f", "x" * 3000, "ab" * 2000, "​﻿᠎ q",
]


@pytest.fixture(scope="module")
def exact():
    t = Tokenizer.from_file(BYTE)
    t.no_truncation(), t.no_padding()
    return t


def test_prefix_bpe_equals_the_library(exact):
    bpe = B.PrefixBPE(BYTE)
    for text in ODD:
        ids = exact.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(bpe.encode(text), "<u4").tolist() == ids, text[:40]
        assert bpe.decode(bpe.encode(text)) == exact.decode(ids, skip_special_tokens=False) == text


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\tabcethinrs'.,#1<|>"), st.characters(codec="utf-8")), max_size=60))
def test_prefix_bpe_on_any_text(text):
    bpe, t = B.load(BYTE), _library()
    assert np.frombuffer(bpe.encode(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids
    assert bpe.decode(bpe.encode(text)) == text


_held = {}


def _library():
    if "t" not in _held:
        _held["t"] = Tokenizer.from_file(BYTE)
    return _held["t"]


def test_op9_on_all_documents(spark, exact):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = B.op9_prefix_bpe(spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = exact.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def test_op9_nulls_repeats_and_empty(spark):
    df = spark.createDataFrame([(1, None, "x"), (1, None, "x"), (None, "a b", "y")], "doc_id long, text string, ids string")
    got = B.decode(B.encode(df, BYTE), BYTE).collect()
    assert sorted((r.doc_id or 0, r.n_tokens, r.decoded) for r in got) == [(0, 2, "a b"), (1, 0, ""), (1, 0, "")]
    assert B.encode(df.limit(0), BYTE).count() == 0


def plain_repair(ids, base, end=2):
    """Rounds of a plain Re-Pair: frequent pairs in order, each replaced from left to right or, if left with too few places, not at all."""
    seq, rules, rounds = list(ids), [], []
    while True:
        pairs = Counter(p for p in zip(seq, seq[1:]) if end not in p)
        good = sorted((p for p in pairs if pairs[p] >= S.LEAST_COUNT), key=lambda p: (-pairs[p], p))
        if not good:
            return seq, rules, rounds
        taken, at = {}, {}
        for p in good:
            places, i = [], 0
            for i in range(len(seq) - 1):
                if (seq[i], seq[i + 1]) == p and not (i - 1 in taken or i in taken or i + 1 in taken):
                    places.append(i)
                    taken[i] = p
            at[p] = places
        made = [p for p in sorted(good) if len(at[p]) >= S.LEAST_USES]
        symbol = {i: base + len(rules) + k for k, p in enumerate(made) for i in at[p]}
        seq = [symbol.get(i, x) for i, x in enumerate(seq) if i - 1 not in symbol]
        rules += made
        rounds.append(len(made))


def as_block(symbols, rules, rounds, base):
    width = (base + len(rules) - 1).bit_length()
    return {
        "rules": S.pack(rules.T.ravel(), width), "symbols": S.pack(symbols, width), "n_symbols": len(symbols), "rounds": rounds,
        "base": base, "lengths": S.expansion_lengths(rules, rounds, base).astype("<u4").tobytes(),
    }


@pytest.mark.parametrize("base", [12, 49408, 65530, 200_000])
def test_grammar_equals_a_plain_one(base):
    rng = np.random.default_rng(base)
    for n, kinds in ((0, 1), (1, 1), (2, 1), (90, 1), (91, 2), (700, 3), (4000, 9)):
        ids = rng.integers(base - kinds, base, n).astype(np.uint32)
        ids[rng.random(n) < 0.05] = 2
        if n == 4000:
            ids[1000:2000] = ids[3000:] = ids[:1000]
        symbols, rules, rounds = S.compress(ids, base)
        assert (symbols.tolist(), list(map(tuple, rules.tolist())), rounds) == plain_repair(ids.tolist(), base)
        left = Counter(p for p in zip(symbols.tolist(), symbols[1:].tolist()) if 2 not in p)
        assert max(left.values(), default=0) < S.LEAST_COUNT
        block = as_block(symbols, rules, rounds, base)
        assert (S.decode_block(block) == ids).all()
        for a, b in ((0, n), (n // 3, n // 2), (n - 1, n)):
            assert n == 0 or (S.decode_range(block, a, b - a) == ids[a:b]).all()


def test_grammar_folds_copies_of_a_long_text():
    text = np.random.default_rng(1).permutation(40_000)[:1000].astype(np.uint32) + 3
    symbols, rules, rounds = S.compress(np.tile(np.append(text, 2).astype(np.uint32), 500), 49408)
    assert len(symbols) == 1000 and len(rounds) >= 10
    assert S.expansion_lengths(rules, rounds, 49408).max() == 1000


def test_grammar_random_access():
    rng = np.random.default_rng(4)
    words = [rng.integers(0, 49408, rng.integers(1, 5)) for _ in range(300)]
    docs = [np.concatenate([words[i] for i in rng.integers(0, 300, n)] + [np.array([2])]) for n in (0, 1, 2, 7, 5000, 30_000)]
    ids = np.concatenate(docs).astype(np.uint32)
    symbols, rules, rounds = S.compress(ids, 49408)
    assert len(symbols) < 0.6 * len(ids)
    block, start = as_block(symbols, rules, rounds, 49408), 0
    for d in docs:
        assert (S.decode_range(block, start, len(d)) == d).all()
        start += len(d)


def test_packed_symbols():
    rng = np.random.default_rng(6)
    for width in (3, 16, 17, 21, 32):
        x = rng.integers(0, 1 << width, 1003).astype(np.uint32)
        for lo, hi in ((0, 1003), (5, 900), (8, 16), (1002, 1003), (7, 7)):
            assert (S.unpack(S.pack(x, width), len(x), lo, hi) == x[lo:hi]).all()


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_any_vocabulary(path):
    t, enc = Tokenizer.from_file(path), S.PieceEncoder(path)
    assert enc.by_pieces == (path == WORD)
    ids, sizes = enc.encode(pa.array(ODD + [None]))
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [t.encode(x or "", add_special_tokens=False).ids for x in [*ODD, None]]


def test_pieces_equal_whole_texts():
    rng = random.Random(2)
    t = Tokenizer.from_file(WORD)
    enc = S.PieceEncoder(WORD)
    texts = ODD + [None] + ["".join(rng.choice(" \n\taÉéΣς.<|#1") for _ in range(40)) for _ in range(300)] + ["a<|startoftext|>b c"]
    texts += ["W\u030a E\u0301. Ǆ, İ. abc., ab.c,", "\u1100\u1161, x"]
    ids, sizes = enc.encode(pa.array(texts))
    ends = np.cumsum(sizes)
    for text, a, b in zip(texts, ends - sizes, ends):
        assert ids[a:b].tolist() == t.encode(text or "", add_special_tokens=False).ids, text


def test_op8_on_all_documents(spark):
    t = Tokenizer.from_file(WORD)
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    want, at = [], 0
    for i, text in docs:
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(tuple, S.op8_repair(spark, SF).collect())) == want


def test_op8_nulls_ties_and_empty(spark):
    rows = [(2, None, 1), (1, "b", 2), (1, "a", 3), (None, "c", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _id int")
    got = sorted(tuple(r)[:3] for r in S.read_shards(spark, S.write_shards(df, WORD)).fillna(-1).collect())
    assert got == [(-1, 0, 2), (1, 2, 2), (1, 4, 2), (2, 6, 1)]
    assert S.read_shards(spark, S.write_shards(df.limit(0), WORD)).count() == 0


def test_op8_repeated_rows_and_a_very_long_text(spark):
    df = spark.createDataFrame([(5, "a b", "x")] * 700 + [(7, "ab " * 600_000, "y")], "doc_id long, text string, part string")
    got = sorted(tuple(r) for r in S.read_shards(spark, S.write_shards(df, WORD)).select("doc_id", "start", "n_tokens").collect())
    n = 600_000 * len(Tokenizer.from_file(WORD).encode("ab", add_special_tokens=False).ids) + 1
    assert got == [(5, 3 * k, 3) for k in range(700)] + [(7, 2100, n)]


def test_encoder_holds_a_word_once_and_nothing_after_a_task():
    """A word that is both a piece and a pre-token is held once; an idle worker holds no words."""
    from pyspark.sql import functions as F

    from tallygrove.llm import bpe_prefix

    bpe = bpe_prefix.PrefixBPE(bpe_prefix.vocabulary())
    text = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(600))
    first = bpe.encode(text)
    assert sum(len(x) for c in vars(bpe).values() if isinstance(c, bpe_prefix.Recent) for x in (c.new, c.old)) == 600
    assert bpe.encode(text) == first
    run = {}

    class Docs:
        sparkSession = None

        def select(self, *cols):
            return self

        def mapInArrow(self, f, schema):
            run["f"] = f
            return self

        def withColumnRenamed(self, *names):
            return self

    import pyarrow as pa
    import pytest

    path = bpe_prefix.vocabulary()
    with pytest.MonkeyPatch.context() as m:
        m.setattr(bpe_prefix, "text_batches", lambda spark: None)
        m.setattr(F, "col", lambda name: type("C", (), {"cast": lambda self, t: self, "alias": lambda self, n: self})())
        bpe_prefix.encode(Docs(), path)
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text])], ["_id", "_text"])
    (out,) = run["f"]([batch])
    assert out["ids"][0].as_py() == first
    held = bpe_prefix.load(path)
    assert not any(c.new or c.old for c in vars(held).values() if isinstance(c, bpe_prefix.Recent)) and not held.may_follow
