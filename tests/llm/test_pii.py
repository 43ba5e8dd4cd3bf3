import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from priorkit.llm.pii import BASE, find_pii, redact

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def stands(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        twice = [int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))]
        return 16 <= len(digits) <= 19 and sum(twice) % 10 == 0
    return 8 <= len(digits) <= 15 if kind == "phone" else True


def brute(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if stands(k, m.group())]


def base_of(df):
    rows = df.select("key", F.filter("pii", lambda s: s["kind"].isin(*BASE)).alias("pii")).collect()
    return {r.key: [(s.kind, s.start, s.end) for s in r.pii] for r in rows}


def check(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "key int, text string")
    got = base_of(find_pii(df))
    for i, t in enumerate(texts):
        assert got[i] == brute(t), t


def test_known_cases(spark):
    check(spark, [
        None, "", "mail a@b.c_d@e.f, x@y", "a@b.c@d.e", "..@a.b", "1.2.3.4.5.6.7.8", "256.1.1.1 0255.1.1.1 00000.0.0.1", "1.2.3", "4539 1488 0343 6467 and 4539148803436468",
        "+1 (974) 555-3436, +12, ++49 30 1234567-", "😀 ü a.b+c@d-e.fg 😀 10.0.0.1", "1 2 3 4 5 6 7 8 9 0", "a" * 20_000 + "@b.c", "1" * 20_000, "1-" * 20_000, "a@" + "b." * 10_000, "a@b.cd 10.0.0.1 " * 1_000,
    ])


@settings(max_examples=25, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="ab@.+-_% 0123456789()😀", max_size=60), min_size=1, max_size=40))
def test_against_brute_force(spark, texts):
    check(spark, texts)


def test_added_kinds_and_context(spark):
    texts = ["iban DE89 3704 0044 0532 0130 00 ok", "DE88 3704 0044 0532 0130 00", "call 555 123 4567 now", "number 555 123 4567 now"]
    df = spark.createDataFrame(list(enumerate(texts)), "key int, text string")
    kinds = {r.key: {s.kind for s in r.pii} for r in find_pii(df).collect()}
    assert "iban" in kinds[0] and "iban" not in kinds[1]
    assert "local_phone" in kinds[2] and "local_phone" not in kinds[3]


def test_redaction(make, odd):
    docs = make([(1, "write to a@b.cd or +1 (974) 555-3436."), (2, None), (3, ""), (4, "10.0.0.1"), (5, "x 4539 1488 0343 6467 y"), *[(100 + i, r[1]) for i, r in enumerate(odd)]])
    redacted = redact(docs.withColumn("pii", F.lit("clash")))
    assert redacted.columns == [*docs.columns, "pii"]
    out = {r.doc_id: r for r in redacted.collect()}
    assert {r.pii for r in out.values()} == {"clash"}
    assert out[1].text == "write to [EMAIL] or [PHONE]." and out[1].n_chars == len(out[1].text)
    assert out[2].text is None and out[3].text == "" and out[4].text == "[IP]"
    assert out[5].text == "x [CARD] y"
    assert out[104].text == odd[4][1]
    assert redact(make([])).count() == 0


def test_many_spans_are_redacted_whole(make):
    text = "write a@b.cd or 10.0.0.1, " * 700
    row = redact(make([(1, text), (2, "x a@b.cd")])).orderBy("doc_id").collect()
    assert row[0].text == "write [EMAIL] or [IP], " * 700 and row[1].text == "x [EMAIL]"
