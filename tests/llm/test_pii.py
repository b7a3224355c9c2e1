"""Surrogates: nothing original is left, formats hold, the same gets the same and different gets different."""

import re

import pytest
from pyspark.sql import functions as F

from carespend.llm import pii
from carespend.llm.pii import pseudonymise, surrogates

CASES = [
    (1, "Mail Bob.X@Mail6.Example.com or bob.x@mail6.example.com, 10.2.33.254; +1 (543) 555-1435 / 4785380592391135, 4111-1111-1111-1111 123-45-6789."),
    (2, "Mr John Smith met Mrs. Anna SMITH-Jones and Dr Smith. Госпожа Анна Иванова; Mr Anna Lee; Κύριος Νίκος"),
    (3, None), (4, ""), (2, "plain 1.2.3.4.5 999.1.1.1 v2.0. 12-34"), (5, "bob.x@mail6.example.com"), (5, "bob.x@mail6.example.com"), (None, "call +1 (543) 555-1435"),
    (6, "x " * 100_000 + "10.2.33.254"),
]


@pytest.fixture(scope="module")
def done(spark):
    docs = spark.createDataFrame([(*r, 1, "k") for r in CASES], "doc_id long, text string, at int, kind string")
    return pseudonymise(docs, "key").collect()


def luhn(digits):
    return sum(d if k % 2 == 0 else 2 * d % 10 + d // 5 for k, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def test_cases(done):
    assert len(done) == len(CASES)
    rows = {(r["doc_id"], r["n_entities"]): r["text"] for r in done}
    one = rows[1, 7]
    m = re.fullmatch(
        r"Mail (\S+)@(\S+)\.com or (\S+)@(\S+)\.com, (\d\d)\.(\d)\.(\d\d)\.(\d{3}); \+1 \((\d{3})\) (\d{3})-(\d{4}) / (\d{16}), (\S+) (\d{3}-\d\d-\d{4})\.", one
    )
    assert m, one
    assert m[1].lower() == m[3] and m[2].lower() == m[4] and m[1][0].isupper()
    assert re.fullmatch(r"\d{4}(-\d{4}){3}", m[13]) and luhn(m[13].replace("-", ""))
    assert "bob" not in one.lower() and "4785380592391135" not in one and "555-1435" not in one and "10.2.33.254" not in one and m[14] != "123-45-6789"
    two = rows[2, 6]
    n = re.fullmatch(r"Mr (\w+) (\w+) met Mrs\. (\w+) (\w+)-(\w+) and Dr (\w+)\. Госпожа ([а-яА-Я]+) ([а-яА-Я]+); Mr (\w+) (\w+); Κύριος ([α-ωΑ-Ωί]+)", two)
    assert n, two
    assert n[1].endswith("n") and n[3].endswith("nia") and n[9].endswith("n") and n[7].endswith("ния")
    assert n[2] == n[6] and n[4].isupper() and "Smith" not in two and n[3] != n[9]
    assert rows[2, 0] == "plain 1.2.3.4.5 999.1.1.1 v2.0. 12-34" and rows[3, 0] == rows[4, 0] == ""
    assert [r["text"] for r in done if r["doc_id"] == 5] == [f"{m[3]}@{m[4]}.com"] * 2
    assert rows[None, 1] == f"call +1 ({m[9]}) {m[10]}-{m[11]}"
    assert rows[6, 1].endswith(f"{m[5]}.{m[6]}.{m[7]}.{m[8]}")


def test_collisions_are_drawn_again(spark):
    ips = [("ip", f"{a}.{b}.1.1") for a in range(1, 10) for b in range(1, 10)]
    names = [("name-latin-family", f"n{k}") for k in range(3000)]
    mails = [("email", f"{a}@b.c") for a in "abcdefghijklmnopqrstuvwxyz"]
    table = spark.createDataFrame(ips + names + mails, "kind string, canonical string")
    got = surrogates(table, "k").collect()
    assert sorted((r["kind"], r["canonical"]) for r in got) == sorted(ips + names + mails)
    assert len({(r["kind"], r["surrogate"]) for r in got}) == len(got)
    assert all(r["surrogate"] != r["canonical"] for r in got)
    again = surrogates(table, "k").collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))
    assert sorted(map(tuple, surrogates(table, "other").collect())) != sorted(map(tuple, got))


def test_empty(spark):
    assert pseudonymise(spark.createDataFrame([], "doc_id long, text string"), "k").collect() == []


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    old, new = docs.select("doc_id", "text"), pseudonymise(docs, "k")
    assert new.count() == docs.count()
    found = lambda df: {x for r in df.select(F.regexp_extract_all("text", F.lit(pii.ANY), F.lit(0)).alias("m")).collect() for x in (r["m"] or [])}
    before, after = found(old), found(new)
    assert len(before) > 10 and len(before) == len(after) and not before & after
