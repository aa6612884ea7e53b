"""Personal data: base spans against plain Python, contexts that add identifiers, edge cases."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from estima.llm.pii import find_pii, redact

KINDS = ("email", "ip", "card", "phone")
PATTERNS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def plain(text):
    found = []
    for k, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = (True, all(int(x) <= 255 for x in m[0].split(".")) if k == 1 else True,
                  12 <= len(digits) <= 19 and luhn(digits), 9 <= len(digits) <= 15)[k]
            if ok:
                found.append((m.start(), k, m.end()))
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(found))


def run(spark, texts, **options):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: r for r in find_pii(rows, **options).collect()}


def test_base_spans_equal_plain_patterns(spark):
    rng = random.Random(5)
    pieces = ["a@b.c", "x.y@z-1.org.", "@", "1.2.3.4", "256.1.1.1", "007.0.0.255", "1.2.3.4.5.6.7.8", "4539 1488 0343 6467", "4539148803436467",
              "4539-1488-0343-6467", "4539  1488", "+1 (555) 555-1234", "+12", "+1", "+49-30-123456-7.", "é", "日本", "😀", " ", "\n", "5", "12", "-", ".",
              "word", "_c@d.e", "a@b", "%+-@q.r-"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 14))) for _ in range(600)]
    alphabet = "019 .@+-()a"
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(600)]
    got = run(spark, texts)
    for i, text in enumerate(texts):
        want = plain(text)
        assert got[i]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest(), (text, want, got[i]["spans"])


def test_long_texts_nulls_and_empty(spark):
    texts = [None, "", "12" * 1500, "1 " * 2000, "a." * 1500 + "@", "+1" + "2 " * 1500, "x" * 3000 + " me@here.org"]
    long = ["12" * 60_000, "1 " * 30_000, "a." * 40_000 + "@", "+1" + "2 " * 20_000]
    got = run(spark, texts + long)
    assert got[0]["spans"] == got[1]["spans"] == ""
    for i, text in enumerate(texts):
        assert got[i]["base_sha256"] == hashlib.sha256(plain(text or "").encode()).hexdigest()
    assert [got[len(texts) + i]["spans"] for i in range(len(long))] == [""] * len(long)
    assert run(spark, []) == {}


def phone_texts():
    seeds = [f"please call phone: +1 555 010 {1000 + i} today {i}a" for i in range(30)]
    return seeds + ["please call phone: 555-867-5309 today", "the number 555-867-5310 is no phone", "phone: nobody", "phone: abc1"]


def test_contexts_add_identifiers(spark):
    texts = phone_texts()
    got = run(spark, texts)
    assert got[30]["spans"] == "phone:19:31" and got[30]["n_discovered"] == 1 and got[30]["n_phone"] == 0
    assert all(got[i]["n_discovered"] == 0 for i in (31, 32, 33))
    assert all(got[i]["n_phone"] == 1 and got[i]["n_discovered"] == 0 for i in range(30))


def test_an_ambiguous_context_adds_nothing(spark):
    texts = [f"at +1 555 010 {1000 + i} end" for i in range(10)] + [f"at 10.0.0.{i} end" for i in range(10)] + ["at 555-867-5309 end", "at 1.2.3.999 end"]
    assert all(r["n_discovered"] == 0 for r in run(spark, texts).values())


def test_redact_keeps_rows_and_columns(spark):
    texts = [*phone_texts(), None, "", "mail a@b.org and 1.2.3.4!", "mail a@b.org and 1.2.3.4!"]
    rows = spark.createDataFrame([(i, t, i, f"s{i}") for i, t in enumerate(texts)], "doc_id long, text string, n_chars long, spans string")
    rows = rows.withColumn("row", F.lit(7))
    out = redact(rows)
    assert out.columns == rows.columns and out.dtypes == rows.dtypes
    got = {r["doc_id"]: r for r in out.collect()}
    assert len(got) == len(texts)
    assert got[30]["text"] == "please call phone: [PHONE] today" and got[30]["n_chars"] == 32
    assert got[37]["text"] == got[36]["text"] == "mail [EMAIL] and [IP]!"
    assert got[31]["text"] == texts[31] and got[35]["text"] == "" and got[34]["text"] == "" and got[31]["spans"] == "s31"


@pytest.mark.parametrize("text,want", [("+1 5 a@b.c 4539148803436467", "4539148803436467"), ("4539148803436467+1 2345678901", "4539148803436467")])
def test_overlapping_spans_are_cut_once(spark, text, want):
    rows = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = redact(rows).first()["text"]
    assert want not in got and "[CARD]" in got


def test_a_text_of_very_many_identifiers(spark):
    """50,000 identifiers in one text: positions, candidates and the cleaned text stay linear."""
    n = 50_000
    text = " ".join(f"word u{i}@mail.example.com ," for i in range(n))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    [row] = find_pii(docs).collect()
    assert row["n_email"] == n and row["n_discovered"] == 0
    first = text.index(f"u{n - 1}@")
    assert row["spans"].endswith(f"email:{first}:{first + len(str(n)) + len("u@mail.example.com")}")
    [clean] = redact(docs).collect()
    assert clean["text"] == " ".join(["word [EMAIL] ,"] * n)
