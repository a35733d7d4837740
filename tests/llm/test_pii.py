"""The PII operator against a plain Python version."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from colophon.llm import pii

#: The contract's patterns, and plain forms of the added kinds.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "secret": r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}",
}


def luhn(d):
    total = 0
    for k, c in enumerate(reversed(d)):
        x = int(c) * (2 if k % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def valid(kind, m):
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 9 <= len(digits) <= 15
    if kind == "iban":
        p = m.replace(" ", "")
        return 15 <= len(p) <= 34 and int("".join(str(int(c, 36)) for c in p[4:] + p[:4])) % 97 == 1
    return kind != "secret" or bool(re.search("[0-9]", m) and re.search("[A-Za-z]", m))


def brute(text):
    text, out = text or "", []
    for rank, kind in enumerate(PLAIN):
        for m in re.finditer(PLAIN[kind], text):
            a, b = m.span()
            near = text[max(0, a - 40) : a] + "\n" + text[b : b + 40]
            score = pii.KINDS[kind][1]
            score += 0.3 if re.search(pii.CONTEXT[kind], near, re.I | re.A) else 0
            score -= 0.4 if re.search(pii.AGAINST[kind], near, re.I | re.A) else 0
            score = round(min(max(score, 0), 1), 2)
            if valid(kind, m.group()) and (rank < 4 or score >= 0.5):
                out.append((a, rank, kind, b, score))
    out.sort()
    spans = [f"{k}:{a}:{b}" for a, _, k, b, _ in out]
    base = ",".join(s for s, o in zip(spans, out, strict=True) if o[1] < 4)
    n = [sum(o[1] == r for o in out) for r in range(4)]
    return (*n, hashlib.sha256(base.encode()).hexdigest(), ",".join(spans), [o[4] for o in out])


def check(df):
    got = pii.digest(pii.find_spans(df))
    for r in got.join(df.select("doc_id", "text"), "doc_id").collect():
        want = brute(r.text)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256, r.spans) == want[:6], r.doc_id
        assert [float(x) for x in r.scores.split(",") if x] == pytest.approx(want[6]), r.doc_id
        assert r.n_spans == len(want[6])


def test_documents(spark):
    check(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text"))


def test_fuzzed(spark):
    rng = random.Random(8)
    parts = ["a.b@c.de", "@", "x_%+@y-z.a.b", "1.2.3.4", "300.1.1.1", "0001.2.3.255", ".", "..", "4111 1111 1111 1111", "4111-1111-1111-1112", "+49 (30) 1234-5678", "+1", "+", "(", ")", "-", " ",
             "DE89370400440532013000", "GB82 WEST 1234 5698 7654 32", "DE00370400440532013000", "123-45-6789", "ssn", "Tax", "version", "example", "token = \"", "24be64439e3e49cf46b2d7c90f3602a3d0b907ff",
             "é漢\U0001f600", "x" * 45, "\n", "card", "iban ", "12", "7"]
    rows = [(i, "".join(rng.choices(parts, k=rng.randrange(1, 40)))) for i in range(1500)]
    rows += [(9000, None), (9001, "")] + [(9100 + i, (p + " ") * 200) for i, p in enumerate(parts)]
    check(spark.createDataFrame(rows, "doc_id long, text string"))


def test_long_texts_in_linear_time(spark):
    """Texts of 300,000 characters: plain Python is quadratic here, so the counts are stated."""
    want = {"DE89 ": 0, "1.1": 25_000, "1": 0, "1 ": 0, "a.b": 0, "a@b.c ": 50_000, "1.2.3.4 ": 37_500, "+1": 0, "+1 234567890 ": 23_076, "123-45-6789 tax ": 18_750, "a@": 0}
    rows = [(i, p * (300_000 // len(p))) for i, p in enumerate(want)]
    got = pii.digest(pii.find_spans(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    assert {list(want)[r.doc_id]: len(r.spans.split(",")) if r.spans else 0 for r in got} == want


def test_context_moves_scores_both_ways(spark):
    texts = ["iban DE89370400440532013000", "serial DE89370400440532013000", "at DE89370400440532013000", "my key token 24be64439e3e49cf46b2", "commit token 24be64439e3e49cf46b2", "version 10.0.0.1"]
    rows = pii.find_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [[(s.kind, s.score) for s in r.spans] for r in rows] == [[("iban", 1.0)], [], [("iban", 0.8)], [("secret", 0.6)], [], [("ip", 0.2)]]


def test_other_columns_and_rows(spark):
    df = spark.createDataFrame([(1, "a@b.cd"), (1, "a@b.cd"), (None, "a@b.cd")], "doc_id long, text string").withColumn("_t", F.lit(1)).withColumn("spans", F.lit(2))
    assert [r.n_email for r in pii.digest(pii.find_spans(df)).collect()] == [1, 1, 1]
    assert pii.digest(pii.find_spans(df.limit(0))).collect() == []
