import hashlib
import random
import re

from pyspark.sql import functions as F

from tallygrove.llm import pii as P
from tests.conftest import SF

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def good(kind, hit):
    d = re.sub("[^0-9]", "", hit)
    if kind == "ip":
        return all(int(x) <= 255 for x in hit.split("."))
    if kind == "card":
        return 13 <= len(d) <= 19 and luhn(d)
    return 9 <= len(d) <= 15 if kind == "phone" else True


def base(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in PLAIN.items() for m in re.finditer(p, text or "") if good(k, m[0])]


def check(rows):
    for r, text in rows:
        want = base(text)
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), (want, r.spans, text[:200])
        for k in PLAIN:
            assert r[f"n_{k}"] == sum(x.startswith(k + ":") for x in want)
        assert [s for s in r.spans.split(",") if s.split(":")[0] in PLAIN] == want


def test_all_documents(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = P.op3_pii(spark, SF).collect()
    assert len(got) == len(docs)
    check([(r, docs[r.doc_id]) for r in got])


def _apply(spark, texts, tmp_path):
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    got = sorted(P.op3_pii(spark, str(tmp_path)).collect())
    return [(r, texts[r.doc_id]) for r in got]


def test_odd_texts(spark, tmp_path):
    rng = random.Random(1)
    texts = [
        None, "", "a@b", "a@b.c", "a@b.c_x@d.e", "x@y@z.com", "a.b@c..d", "é a@b.cé @b.c", "1.2.3.4.5.6.7.8", "256.1.1.1 0001.002.3.255 000.0.0.0",
        "4111 1111 1111 1111", "4111-1111-1111-1111 1", "+1 (212) 555-0199", "+12", "++1 234 567 89 0", "9" * 30000, "1 " * 8000, "a" * 30000 + "@",
        "4111111111111111\n4111111111111112", "😀 4111111111111111 a@b.co",
    ]
    texts += ["".join(rng.choice("0123456789 -.+@()aB_%\n😀") for _ in range(80)) for _ in range(400)]
    texts += ["".join(rng.choice("012 .-@+a") for _ in range(3000)) for _ in range(5)]
    check(_apply(spark, texts, tmp_path))


def test_added_kinds_and_redaction(spark):
    text = "IBAN DE89 3704 0044 0532 0130 00, bad DE89 3704 0044 0532 0130 01. SSN 123-45-6789, part 123-45-6789 and 123-45-6780. mail a@b.co"
    df = spark.createDataFrame([(1, text, "z"), (2, None, "z")], "doc_id long, text string, pii string")
    found = {r.doc_id: r.s for r in P.scan(df, out_col="s").collect()}
    assert [(s.kind, s.hit) for s in found[1]][:2] == [("email", "a@b.co"), ("iban", "DE89 3704 0044 0532 0130 00")]
    assert sum(s.kind == "national_id" for s in found[1]) >= 1 and found[2] == []
    out = P.redact(df).orderBy("doc_id").collect()
    assert out[0].text.startswith("IBAN <IBAN>, bad DE89") and out[0].text.endswith("mail <EMAIL>") and out[1].text is None
    assert P.scan(df.limit(0), out_col="s").count() == 0
    assert P.scan(df, out_col="s").columns == ["doc_id", "text", "pii", "s"]
    assert spark.range(1).select(P.mod97(F.lit("GB82WEST12345698765432"))).first()[0]


def test_ibans_before_other_words(spark):
    texts = {
        "IBAN DE89370400440532013000 BIC COBADEFFXXX": ["DE89370400440532013000"],
        "IBAN DE89 3704 0044 0532 0130 00 2024-01-01": ["DE89 3704 0044 0532 0130 00"],
        "DE89370400440532013000 GB82 WEST 1234 5698 7654 32 NO93 8601 1117 947 X": ["DE89370400440532013000", "GB82 WEST 1234 5698 7654 32", "NO93 8601 1117 947"],
        "NO93 1234 567 DE89 3704 0044 0532 0130 00 A": ["DE89 3704 0044 0532 0130 00"],
        "DE89370400440532013000A DE8937040044053201300 xDE89370400440532013000": [],
    }
    rows = P.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), out_col="s").orderBy("doc_id").collect()
    for r in rows:
        found = [s for s in r.s if s.kind == "iban"]
        assert [s.hit for s in found] == texts[r.text] and all(r.text[s.start : s.end] == s.hit for s in found)
