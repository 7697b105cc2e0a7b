import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tallygrove.llm import quality_rules as Q
from tests.conftest import SF
from tests.llm.brute import near_components

public_tokenizers = pytest.importorskip("public_tokenizers")


def distance(a, b):
    p, q = np.array(a, float) / sum(a), np.array(b, float) / sum(b)
    m = (p + q) / 2
    part = lambda x: sum(u * math.log2(u / v) for u, v in zip(x, m) if u > 0)
    return math.sqrt(max(0.0, (part(p) + part(q)) / 2))


def quality(docs):
    """Ids of kept documents."""
    rows = {}
    for i, text, lang in docs:
        ws = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        windows = [tuple(ws[k : k + 8]) for k in range(len(ws) - 7)]
        twice = Counter(windows)
        covered = {k + d for k, w in enumerate(windows) if twice[w] > 1 for d in range(8)}
        failed = len(ws) < 20 or 100 * len(covered) > 30 * len(ws)
        chars = [sum(len(x) for x in re.findall(c, text or "")) for c in Q.CLASSES]
        chars.append(len(text or "") - sum(chars))
        common = None
        if lang in Q.COMMON:
            common = [sum(w in (c, c.capitalize()) for w in ws) for c in Q.COMMON[lang]]
            common.append(len(ws) - sum(common))
        rows[i] = (failed, len(ws), lang if lang in Q.COMMON else "", chars, common)
    refs, words = {}, {}
    for failed, _, lang, chars, common in rows.values():
        if not failed:
            for key in {lang, ""}:
                refs[key] = np.array(chars) + refs.get(key, 0)
            if common:
                words[lang] = np.array(common) + words.get(lang, 0)
    kept = set()
    for i, (failed, n, lang, chars, common) in rows.items():
        far = False
        if not failed and n >= Q.LEAST_WORDS:
            far = bool(refs) and min(distance(chars, r) for r in refs.values()) > Q.CHAR_LIMIT
            if common and lang in words and words[lang].sum() >= Q.LEAST_REFERENCE and sum(common):
                far |= distance(common, words[lang]) > Q.WORD_LIMIT
        if not failed and not far:
            kept.add(i)
    return kept


def copies(docs):
    """(id, text) repeated to tempered source weights."""
    n = Counter(s for _, _, s in docs)
    total_w, total = sum(math.sqrt(v) for v in n.values()), len(docs)
    out = []
    for i, text, source in docs:
        rate = total * math.sqrt(n[source]) / total_w / n[source]
        u = int(hashlib.md5(f"17|{i}".encode()).hexdigest()[:13], 16) / 16**13
        k, p = 0, math.exp(-rate)
        c = p
        while c <= u:
            k += 1
            p *= rate / k
            c += p
        out += [(i, text)] * k
    return out


def test_run_equals_brute_force(spark):
    docs = [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    good = quality([d[:3] for d in docs])
    docs = [d for d in docs if d[0] in good]
    first = {}
    for i, text, *_ in sorted(docs):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", text), i)
    docs = [d for d in docs if first[re.sub(r"[\x20\x09-\x0D]+", " ", d[1])] == d[0]]
    comp = near_components([d[:2] for d in docs])
    docs = [d for d in docs if comp[d[0]][1] == d[0]]
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter((i, tuple(t.encode(x, add_special_tokens=False).ids)) for i, x in copies([(d[0], d[1], d[3]) for d in docs]))
    got = corpus_pipeline.run(spark, SF).collect()
    assert Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in got) == want


def test_stages_keep_columns_and_take_odd_rows(spark):
    rows = [(1, None, None, None, None), (None, "x " * 30, "en", None, 3), (2, "", "fr", "s", 0), (2, "", "fr", "s", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for docs in (df, df.limit(0)):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, "")
            assert k == 4 or out.columns == corpus_pipeline.COLUMNS
            out.collect()
