"""Suffix sorting and removal of repeats against dictionaries of all strings."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from carespend.llm import suffix
from carespend.llm.suffix import common_prefixes, first_windows, suffix_dedup, suffix_order, word_ranks


def expected(rows, length):
    """``doc_id``: kept bytes and spans."""
    first, out = set(), {}
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for a in range(len(data) - length + 1):
            piece = data[a : a + length]
            if piece in first:
                gone[a : a + length] = b"\1" * length
            first.add(piece)
        spans, a = [], 0
        while a < len(data):
            b = a
            while b < len(data) and gone[b]:
                b += 1
            if b > a:
                spans.append((a, b))
            a = b + 1
        out[i] = (len(data), bytes(x for x, g in zip(data, gone, strict=True) if not g), spans)
    return out


def check(spark, rows, length=100, gram=32):
    docs = spark.createDataFrame([(*r, "k", 1) for r in rows], "doc_id long, text string, key string, start int").repartition(4)
    got = suffix_dedup(docs, length=length, gram=gram).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"]: (r["n_bytes"], bytes(r["kept"]), [tuple(s) for s in r["spans"]]) for r in got} == expected(rows, length)


@given(st.lists(st.binary(max_size=60), min_size=1, max_size=5), st.integers(8, 20))
@settings(deadline=None)
def test_order(texts, depth):
    small = [bytes(b % 3 + 97 for b in t) for t in texts] + texts
    codes = np.concatenate([np.append(np.frombuffer(t, np.uint8).astype(np.uint16) + 1, 0) for t in small]).astype(np.uint16)
    ranks = word_ranks(codes)
    order = suffix_order(codes, depth, ranks)
    assert sorted(order.tolist()) == list(range(len(codes)))

    def key(i):  # what follows a separator does not count
        out = codes[i : i + depth].tolist()
        return out[: out.index(0) + 1] if 0 in out else out

    keys = [key(i) for i in order.tolist()]
    assert keys == sorted(keys)
    inside = np.array([i for i, k in zip(order.tolist(), keys, strict=True) if len(k) == depth and 0 not in k], np.int64)
    same = common_prefixes(inside, ranks, depth)
    assert same.tolist() == [k > 0 and key(inside[k]) == key(inside[k - 1]) for k in range(len(inside))]


def test_first_windows():
    texts = [b"aaaaaaaaaaaa", b"xaaaaaaaaay", b"short", b"aaaaaaaaaaaa"]
    got = first_windows(texts, np.array([50, 0, 90, 100]), 8)
    assert [g.tolist() for g in got] == [[True] * 5, [False, False, True, False], [], [True] * 5]


def passages(rng):
    words = [f"w{rng.randrange(2000)}" for _ in range(4000)]
    shared = [" ".join(rng.choices(words, k=rng.randrange(15, 60))) for _ in range(8)]
    texts = []
    for _ in range(150):
        parts = [" ".join(rng.choices(words, k=rng.randrange(0, 50))) for _ in range(3)]
        parts.insert(rng.randrange(4), rng.choice(shared))
        texts.append(" é ".join(parts))
    return texts + texts[:20] + [t[:300] + "!" + t[300:] for t in texts[20:40]]


CASES = ["", None, "short", "a" * 99, "a" * 100, "a" * 101, "ab" * 3000, "é" * 260, "x" + "a" * 250 + "y", "\0\0" * 80, "Z" * 700]


@pytest.mark.parametrize("variants", [2000, 3])
def test_texts(spark, monkeypatch, variants):
    monkeypatch.setattr(suffix, "VARIANTS", variants)
    rng = random.Random(5)
    texts = passages(rng) + CASES
    rng.shuffle(texts)
    check(spark, list(enumerate(texts)) + [(None, texts[3])])


def test_long_text_in_parts(spark, monkeypatch):
    rng = random.Random(6)
    text = " ".join(f"w{rng.randrange(10_000)}" for _ in range(30_000))
    monkeypatch.setattr(suffix, "PART", 1500)
    check(spark, [(1, text), (2, text[5000:90_000] + "?" + text[:4000])])


def test_repeated_ids(spark):
    text = "".join(f"{i} " for i in range(200))
    docs = spark.createDataFrame([(1, text), (1, text), (2, text)], "doc_id long, text string")
    got = sorted((r["doc_id"], len(r["kept"])) for r in suffix_dedup(docs).collect())
    assert got == [(1, len(text)), (1, len(text)), (2, 0)]


@pytest.mark.parametrize("seed", range(3))
def test_texts_of_an_id_are_documents_of_their_own(spark, seed):
    """In the order of ids, and of a hash within an id; no other id is spoilt by them."""
    rng = random.Random(seed)
    p, q, fill = ("".join(rng.choice("abcdefgh ") for _ in range(n)) for n in (400, 400, 90))
    rows = [(1, p), (1, q + p), (1, q[:200]), (2, "five " + p[:250]), (3, q[:130] + "!"), (4, p + q), (1, q[:200]), (None, fill + q[300:]), (None, fill), (5, fill + fill)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    told = {r["text"]: r["h"] for r in docs.select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, told[r[1]]))
    want = expected([(k, t) for k, (_, t) in enumerate(order)], 100)
    kept = {r: want[k][1] for k, r in enumerate(order)}
    got = sorted((str(r["doc_id"]), bytes(r["kept"])) for r in suffix_dedup(docs).collect())
    assert got == sorted((str(i), kept[i, t]) for i, t in rows)


def test_empty(spark):
    assert suffix_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    check(spark, [tuple(r) for r in docs.select("doc_id", "text").collect()])
