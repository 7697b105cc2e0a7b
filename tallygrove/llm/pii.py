"""Personal data: patterns propose, checksums confirm, context words adjust. DataFrame functions only.

Base kinds, leftmost and non-overlapping for each kind, failing matches dropped:
email, ip (parts at most 255), card (13 to 19 digits, Luhn), phone (9 to 15
digits). Added kinds: iban (length of its country, mod-97), national_id and local_phone, which count
only if a context word before them lifts their score to ``LIMIT``. Base spans
always stay; their scores are adjusted and returned too.

The patterns are the plain ones with possessive quantifiers and a guard against
starting inside a run, which finds the same matches in linear time and without
deep recursion on long runs.

Defined results: a null text has no spans; rows are scanned one by one, so
repeated rows repeat their spans; an empty table gives no rows. Nothing is
shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallygrove.llm.spans import let, matches

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "national_id", "local_phone")
LIMIT = 0.5
#: Characters before a span that are searched for context words.
NEAR = 48

_USER = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{_USER})|\G){_USER}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}",
    "national_id": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "local_phone": r"[0-9]{3}[\x20.-][0-9]{3}[\x20.-][0-9]{4}",
}
#: Countries by the length of their IBANs.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
#: The start of an IBAN that stands alone, and the whole of it: as long as its country has it, else as long as it goes.
IBAN_HEAD = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=\x20?[A-Z0-9])"
_LONG = "|".join(rf"(?:{c.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items())
IBAN = rf"^(?:{_LONG}|(?!(?:{'|'.join(IBAN_LENGTHS.values()).replace(' ', '|')})){PATTERNS['iban']})"
#: Characters that may not stand before or after an added span.
BESIDE = {"iban": "[A-Za-z0-9]", "national_id": "[0-9-]", "local_phone": "[0-9A-Za-z+.-]"}
GUARDS = {
    "email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9]", "phone": r"\+[0-9]", "iban": "[A-Z]{2}[0-9]{2}",
    "national_id": "-[0-9]{2}-", "local_phone": r"[0-9]{3}[\x20.-][0-9]{4}",
}
SCORES = {"email": 0.9, "ip": 0.5, "card": 0.8, "phone": 0.6, "iban": 0.9, "national_id": 0.3, "local_phone": 0.3}
#: Words that raise a score by 0.3, and words that lower it by 0.2.
RAISE = {
    "email": "mail|contact|write", "ip": "ip|host|server|address", "card": "card|visa|mastercard|amex|payment",
    "phone": "phone|tel|call|mobile|fax", "iban": "iban|account|bank|konto|cuenta|compte",
    "national_id": "ssn|social|security|national|passport", "local_phone": "phone|tel|call|mobile|fax",
}
LOWER = {"ip": "version|release|section", "card": "order|invoice|tracking|serial", "local_phone": "order|invoice|serial|isbn"}


def luhn(digits: Column) -> Column:
    """Whether at most 20 digits pass the Luhn check."""
    plain = F.lpad(digits, 20, "0")
    twice = F.translate(plain, "0123456789", "0246813579")
    digit = lambda i: F.ascii(F.substr(F.when(i % 2 == 1, twice).otherwise(plain), i, F.lit(1))) - 48
    return F.aggregate(F.sequence(F.lit(1), F.lit(20)), F.lit(0), lambda s, i: s + digit(i)) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN without spaces passes its check."""
    turned = F.concat(F.substr(iban, F.lit(5)), F.substr(iban, F.lit(1), F.lit(4)))

    def step(r, c):
        v = F.ascii(c)
        return F.when(v < 58, (r * 10 + v - 48) % 97).otherwise((r * 100 + v - 55) % 97)

    return F.aggregate(F.split(turned, ""), F.lit(0), lambda r, c: F.when(c == "", r).otherwise(step(r, c))) == 1


def _ibans(text: Column) -> Column:
    """Candidates from every head, so that neither what follows an IBAN nor a failing candidate hides one."""

    def whole(m):
        hit = F.regexp_extract(F.substr(text, m["start"] + 1, F.lit(64)), IBAN, 0)
        return F.struct(m["start"].alias("start"), (m["start"] + F.length(hit)).alias("end"), hit.alias("hit"))

    heads = F.transform(matches(text, IBAN_HEAD, GUARDS["iban"]), whole)
    good = F.filter(heads, lambda m: (m["hit"] != "") & _confirmed("iban", text, m))
    return F.aggregate(
        good,
        F.expr("cast(array() as array<struct<start: int, end: int, hit: string>>)"),
        lambda kept, m: F.when((F.size(kept) > 0) & (F.element_at(kept, -1)["end"] > m["start"]), kept).otherwise(F.array_append(kept, m)),
    )


def _confirmed(kind: str, text: Column, m: Column) -> Column:
    hit = m["hit"]
    alone = F.lit(True)
    if kind in BESIDE:
        around = F.concat(F.when(m["start"] > 0, F.substr(text, m["start"], F.lit(1))).otherwise(""), F.substr(text, m["end"] + 1, F.lit(1)))
        alone = ~around.rlike(BESIDE[kind])
    digits = F.regexp_replace(hit, "[^0-9]", "")
    if kind == "ip":
        part = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
        some = "(?:0++(?=[.]|$)|" + part + ")"
        return hit.rlike(rf"^{some}\.{some}\.{some}\.{some}$")
    if kind == "card":
        return let(digits, lambda d: F.when(F.length(d).between(13, 19), luhn(d)).otherwise(F.lit(False)))
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "iban":
        return alone & mod97(F.regexp_replace(hit, " ", ""))
    return alone


def find_spans(text: Column) -> Column:
    """array<struct<kind, start, end, hit, score>> by kind as listed, then start; base kinds first."""
    kinds = []
    for kind in BASE + ADDED:

        def scored(m, kind=kind):
            near = F.lower(F.substr(text, F.greatest(m["start"] - NEAR, F.lit(0)) + 1, F.least(m["start"], F.lit(NEAR))))
            score = F.lit(SCORES[kind]) + F.when(near.rlike(f"(?:^|[^a-z])(?:{RAISE[kind]})"), 0.3).otherwise(0.0)
            if kind in LOWER:
                score = score - F.when(near.rlike(f"(?:^|[^a-z])(?:{LOWER[kind]})"), 0.2).otherwise(0.0)
            score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.round(score, 2)))
            return F.struct(
                F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), m["hit"].alias("hit"), score.alias("score")
            )

        good = _ibans(text) if kind == "iban" else F.filter(matches(text, PATTERNS[kind], GUARDS[kind]), _checker(kind, text))
        spans = F.transform(good, _one_argument(scored))
        kinds.append(spans if kind in BASE else F.filter(spans, lambda s: s["score"] >= LIMIT))
    return F.concat(*kinds)


def _checker(kind: str, text: Column):
    return lambda m: _confirmed(kind, text, m)


def _one_argument(f):
    return lambda m: f(m)


def scan(docs: DataFrame, text_col: str = "text", out_col: str = "pii") -> DataFrame:
    """docs with an array of spans."""
    return docs.withColumn(out_col, find_spans(F.coalesce(F.col(text_col), F.lit(""))))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with every span of the text replaced by <KIND>; of overlapping spans the one that starts first, then the longer."""
    spans = F.array_sort(
        F.transform("_pii", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("stop"), s["kind"].alias("kind")))
    )
    folded = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda t, s: F.when(s["start"] < t["at"], t).otherwise(
            F.struct(
                (-s["stop"]).alias("at"),
                F.concat(
                    t["out"], F.substr(F.col("_text"), t["at"] + 1, s["start"] - t["at"]), F.lit("<"), F.upper(s["kind"]), F.lit(">")
                ).alias("out"),
            )
        ),
        lambda t: F.concat(t["out"], F.substr(F.col("_text"), t["at"] + 1)),
    )
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    held = docs.select(row, F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text"))
    held = held.withColumn("_pii", find_spans(F.col("_text")))
    held = held.withColumn("_out", F.when(F.col(f"_row.`{text_col}`").isNotNull(), folded))
    return held.select(*[F.col("_out").alias(c) if c == text_col else F.col(f"_row.`{c}`") for c in docs.columns])


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op3_pii(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan(docs, out_col="_pii").drop("text")
    counts = [F.size(F.filter("_pii", _is(kind))).cast("long").alias(f"n_{kind}") for kind in BASE]
    base = F.filter("_pii", lambda s: s["kind"].isin(*BASE))
    scores = F.array_join(F.transform("_pii", lambda s: s["score"].cast("string")), ",").alias("scores")
    return found.select("doc_id", *counts, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("_pii")).alias("spans"), scores)


def _is(kind: str):
    return lambda s: s["kind"] == kind



#: The base patterns as the contract has them, for an engine with RE2.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": PATTERNS["phone"],
} | {k: PATTERNS[k] for k in ADDED}


def _oracle() -> str:
    digits = "regexp_replace(h, '[^0-9]', '', 'g')"
    luhn = (
        f"list_sum(list_transform(range(1, length({digits}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN substr(reverse({digits}), i, 1)::INT "
        f"ELSE (substr(reverse({digits}), i, 1)::INT * 2) // 10 + (substr(reverse({digits}), i, 1)::INT * 2) % 10 END)) % 10 = 0"
    )
    turned = "(substr(replace(h, ' ', ''), 5) || substr(replace(h, ' ', ''), 1, 4))"
    mod97 = (
        f"list_reduce(list_prepend(0::BIGINT, list_transform(range(1, length({turned}) + 1), lambda i: (CASE WHEN ascii(substr({turned}, i, 1)) < 58 "
        f"THEN ascii(substr({turned}, i, 1)) - 48 ELSE ascii(substr({turned}, i, 1)) - 55 END)::BIGINT)), "
        "lambda r, v: CASE WHEN v < 10 THEN (r * 10 + v) % 97 ELSE (r * 100 + v) % 97 END) = 1"
    )
    valid = {
        "email": "true",
        "ip": "list_max(list_transform(string_split(h, '.'), lambda x: coalesce(try_cast(ltrim(x, '0') || CASE WHEN ltrim(x, '0') = '' THEN '0' ELSE '' END AS HUGEINT), 999))) <= 255",
        "card": f"length({digits}) BETWEEN 13 AND 19 AND {luhn}",
        "phone": f"length({digits}) BETWEEN 9 AND 15",
        "iban": mod97,
        "national_id": "true",
        "local_phone": "true",
    }
    near = "lower(substr(t, greatest(s - 48, 0) + 1, least(s, 48)))"
    parts = []
    for k, kind in enumerate(BASE + ADDED):
        p = PLAIN[kind]
        cond = valid[kind]
        score = f"{SCORES[kind]} + CASE WHEN regexp_matches({near}, '(?:^|[^a-z])(?:{RAISE[kind]})') THEN 0.3 ELSE 0 END"
        if kind in LOWER:
            score += f" - CASE WHEN regexp_matches({near}, '(?:^|[^a-z])(?:{LOWER[kind]})') THEN 0.2 ELSE 0 END"
        score = f"round(least(1.0, greatest(0.0, ({score})::DOUBLE)), 2)"
        if kind in BESIDE:
            cond += f" AND NOT regexp_matches(CASE WHEN s > 0 THEN substr(t, s, 1) ELSE '' END || substr(t, s + length(h) + 1, 1), '{BESIDE[kind]}')"
            cond += f" AND {score} >= {LIMIT}"
        parts.append(
            f"SELECT doc_id, {k} AS k, '{kind}' AS kind, s, s + length(h) AS e, {score} AS score FROM (SELECT doc_id, t, h[i] AS h, "
            "(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(h[1:i - 1], lambda x: length(x))), 0))::BIGINT AS s "
            f"FROM (SELECT *, unnest(range(1, len(h) + 1)) AS i FROM (SELECT doc_id, t, regexp_extract_all(t, '{p}') AS h, regexp_split_to_array(t, '{p}') AS g "
            f"FROM d WHERE regexp_matches(t, '{p}')))) WHERE {cond}"
        )
    listed = "string_agg(kind || ':' || s || ':' || e, ',' ORDER BY k, s)"
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE)
    return (
        "WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS (" + " UNION ALL ".join(parts) + f") SELECT d.doc_id, {counts}, "
        f"sha256(coalesce({listed} FILTER (k < {len(BASE)}), '')) AS base_sha256, coalesce({listed}, '') AS spans, coalesce(string_agg(score::VARCHAR, ',' ORDER BY k, s), '') AS scores FROM d LEFT JOIN f USING (doc_id) GROUP BY d.doc_id"
    )


QUERIES = {"op3_pii": op3_pii}
ORACLES = {"op3_pii": _oracle()}
