import hashlib
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from marlstone.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    own = [int(c) for c in reversed(d)]
    return sum(own[::2] + [2 * x - 9 * (x > 4) for x in own[1::2]]) % 10 == 0


def holds(kind, found):
    d = re.sub("[^0-9]", "", found)
    return {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in found.split(".")), "card": lambda: 13 <= len(d) <= 19 and luhn(d), "phone": lambda: 9 <= len(d) <= 15}[kind]()


def brute(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if holds(k, m.group())]


def spans(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string").repartition(2)
    got = {r["doc_id"]: [(x["kind"], x["start"], x["end"]) for x in r["_pii"]] for r in pii.with_spans(df).collect()}
    return [got[i] for i in range(len(texts))]


def base(found):
    return [s for s in found if s[0] in pii.BASE]


CASES = [
    None, "", "é😀 mail a.b@c-d.example.com_x@y.org end", "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.255", "card 4111 1111 1111 1111, 4111-1111-1111-1112 and 4111111111111111",
    "+1 (555) 123-4567 ( +12 +123456789 +1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6", "a@b.c@d.e", "@@..", "+" * 50, "1 " * 40, "9" * 60, "a@b" + ".c" * 3000, "a" * 20000 + "@", "1.2.3.4 " * 700, "10.0.0.1 0.0.0.0 00.1.01.000 1.1.1.0256 0255.1.1.1 1.300.1.1",
]


def test_base_spans_equal_brute_force(spark):
    for text, found in zip(CASES, spans(spark, CASES)):
        assert base(found) == brute(text), (text or "")[:80]


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("0159.@+- ()ab", max_size=60), min_size=20, max_size=20))
def test_any_text(spark, texts):
    for text, found in zip(texts, spans(spark, texts)):
        assert base(found) == brute(text), text


def test_added_kinds_need_checksum_or_context(spark):
    a, b, c, d = spans(spark, ["iban DE89 3704 0044 0532 0130 00.", "iban DE89 3704 0044 0532 0130 01.", "my SSN: 123-45-6789", "part 123-45-6789"])
    assert [s[0] for s in a if s[0] not in pii.BASE] == ["iban"] and not [s for s in b if s[0] == "iban"]
    assert [s[0] for s in c] == ["ssn"] and d == []
    e, f = spans(spark, ["call 555-123-4567 now", "code 555-123-4567 now"])
    assert [s[0] for s in e] == ["national_phone"] and f == []


def test_iban_ends_by_its_country(spark):
    own = "GB82WEST12345698765432"
    texts = ["IBAN GB82 WEST 1234 5698 7654 32 Thanks", f"{own} The rest", f"{own} 2024 paid", f"pay {own} NOW", f"{own} DE89 3704 0044 0532 0130 00 A", f"{own}7", f"x{own}", "NO93 8601 1117 947 Oslo"]
    found = [[(x[1], x[2]) for x in s if x[0] == "iban"] for s in spans(spark, texts)]
    assert found == [[(5, 32)], [(0, 22)], [(0, 22)], [(4, 26)], [(0, 22), (23, 50)], [], [], [(0, 18)]]


def test_redaction(spark):
    df = spark.createDataFrame([(1, "mail é a@b.com or 1.2.3.4.", 5), (2, None, 5), (3, "clean 12 text", 5)], "doc_id int, text string, start int")
    got = {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}
    assert got == {1: "mail é <email> or <ip>.", 2: None, 3: "clean 12 text"} and pii.redact(df).columns == df.columns
    assert pii.redact(df.limit(0)).count() == 0


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in pii.op5_pii(spark, sf).collect():
        want = brute(texts[r["doc_id"]])
        line = ",".join("%s:%d:%d" % s for s in want)
        assert r["base_sha256"] == hashlib.sha256(line.encode()).hexdigest() and [r[f"n_{k}"] for k in PATTERNS] == [sum(s[0] == k for s in want) for k in PATTERNS]


def test_clashing_columns_and_very_long_texts(spark):
    long = "nothing to see " * 100_000 + "mail a.b@c.de now"
    df = spark.createDataFrame([(1, long, 5, "x", "y"), (2, None, 6, None, None)], "doc_id bigint, text string, _s_email int, _row string, _t string")
    got = pii.redact(df)
    assert got.columns == df.columns and [tuple(r) for r in got.orderBy("doc_id").collect()] == [(1, long.replace("a.b@c.de", "<email>"), 5, "x", "y"), (2, None, 6, None, None)]
    assert {r["doc_id"]: len(r["_pii"]) for r in pii.with_spans(df).select("doc_id", "_pii").collect()} == {1: 1, 2: 0}


ADDED = {
    "national_phone": r"(?<![0-9A-Za-z+().-])(?<![0-9+)] )\(?[0-9]{3}\)?[ .-][0-9]{3}[.-][0-9]{4}(?![0-9A-Za-z])",
    "ssn": r"(?<![0-9A-Za-z-])(?!000|666|9[0-9][0-9])[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9A-Za-z-])",
}


def brute_added(text):
    """Every match of the kinds that need a word nearby, every base span looked at for each."""
    context = {k.name: (k.context, k.score) for k in pii.KINDS}
    out = []
    for kind, pattern in ADDED.items():
        words, score = context[kind]
        for m in re.finditer(pattern, text):
            near = text[max(0, m.start() - pii.NEARBY) : m.start()]
            if score + pii.CONTEXT * bool(re.search(words.removeprefix("(?i)"), near, re.I)) >= pii.LEAST_SCORE and not any(a < m.end() and m.start() < b for _, a, b in brute(text)):
                out.append((kind, m.start(), m.end()))
    return out


PIECES = ["call ", "555-123-4567 ", "ssn ", "123-45-6789 ", "(555) 123-4567 ", "tax id: ", "+1 555 123 4567 ", "a@b.org ", "4111 1111 1111 1111 ", "123-45-6789@b.org ", "é😀 ", "1.2.3.4 ", "so it goes on and on with many words ", "\n"]


def test_added_spans_equal_brute_force(spark, monkeypatch):
    import random

    rng = random.Random(8)
    texts = ["".join(rng.choices(PIECES, k=rng.choice([3, 30, 300]))) for _ in range(60)]
    for block in (256, 7):
        monkeypatch.setattr(pii, "BLOCK", block)
        for text, found in zip(texts, spans(spark, texts)):
            assert base(found) == brute(text) and [x for x in found if x[0] in ADDED] == brute_added(text), text


def test_time_grows_with_the_spans(spark):
    import time

    def took(n):
        text = "".join(f"mail a{k}@b.org and call 555-123-4567, iban DE89 3704 0044 0532 0130 00.\n" for k in range(n))
        df = spark.createDataFrame([(1, text)], "doc_id int, text string")
        began = time.perf_counter()
        assert pii.with_spans(df).selectExpr("size(_pii)").first()[0] >= 3 * n
        return time.perf_counter() - began

    took(500)
    few, many = took(4_000), took(16_000)
    assert many < 9 * few + 2  # in proportion 4 times
