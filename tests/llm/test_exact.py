"""Exact deduplication against a plain grouping in Python."""

import hashlib
from collections import defaultdict

from carespend.llm.exact import exact_dedup, frequent

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def expected(rows):
    groups = defaultdict(list)
    for i, text in rows:
        groups[(text or "").encode().translate(LOWER)].append(i)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known, default=None)
        out += [(i, keep, len(ids), i == keep, hashlib.sha256(text).hexdigest()) for i in ids]
    return sorted(out, key=str)


def check(spark, rows, **options):
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, digest string, keep_id string")
    got = exact_dedup(docs, **options)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == expected(rows)


CASES = [
    (1, "A b"), (2, "a B"), (3, None), (4, ""), (5, "É"), (6, "é"), (7, "x" * 300_000), (8, "X" * 300_000),
    (9, "one"), (9, "one"), (None, "one"), (None, "lost"), (10, " one"),
]


def test_cases(spark):
    check(spark, CASES)


def test_few_counters_change_nothing(spark):
    rows = CASES + [(100 + i, f"t{i % 7}") for i in range(300)] + [(1000 + i, "hot") for i in range(200)]
    check(spark, rows, capacity=2)


def test_empty(spark):
    check(spark, [])


def test_frequent_digests_are_found(spark):
    keys = spark.createDataFrame([(b"hot",)] * 400 + [(b"%d" % i,) for i in range(500)], "digest binary").repartition(7)
    assert b"hot" in {bytes(r[0]) for r in frequent(keys, 3).collect()}
    assert frequent(keys, 3).count() <= 3
