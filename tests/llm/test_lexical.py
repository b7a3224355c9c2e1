"""Ranked search against scores of every document, term by term."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from carespend.llm import lexical

WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def ranked(docs, items, k):
    counts = [(i, Counter(words(t))) for i, t in docs]
    n_docs = sum(1 for _, c in counts if c)
    n_words = sum(sum(c.values()) for _, c in counts)
    df = Counter(w for _, c in counts for w in c)
    out = []
    for item, text in dict.fromkeys(items):
        rows = []
        for i, c in counts:
            m = 25 + 75 * sum(c.values()) * n_docs // max(1, n_words)
            score = 0
            for w in words(text):
                if w in c:
                    weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1)))
                    score += weight * (1_000_000_000 * c[w] // (1000 * c[w] + 8 * m))
            if score > 0:
                rows.append((i, score))
        rows.sort(key=lambda r: (-r[1], r[0] is None, r[0] or 0))
        out += [(item, rank, *r) for rank, r in enumerate(rows[:k], 1)]
    return out


def frame(spark, rows, names):
    a, b = names.split()
    return spark.createDataFrame([(*r, 1, 2) for r in rows], f"{a} long, {b} string, score int, rank int")


def check(spark, docs, items, k=10, **options):
    got = lexical.search(frame(spark, docs, "doc_id text"), frame(spark, items, "item_id text"), k, **options)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(ranked(docs, items, k), key=str)


DOCS = [
    (1, "The cat sat, the CAT ran."), (2, None), (3, ""), (4, "  \t"), (5, "dog " * 3000 + "cat"), (6, "dog"), (6, "dog cat"), (7, "dog"),
    (None, "dog"), (8, "Éa éa ÉA x\x00y 3.14 a_b"), (9, "dog"), (10, "cat dog bird"), (11, "bird"),
]
ITEMS = [(1, "cat"), (2, None), (3, ""), (4, "dog dog cat"), (4, "bird"), (5, "nothing"), (6, "Éa 14 b x"), (7, "the"), (7, "the"), (None, "bird cat")]


@pytest.mark.parametrize("k", [1, 3, 10])
def test_cases(spark, k):
    check(spark, DOCS, ITEMS, k)


@pytest.mark.parametrize("terms", [1, 4])
def test_items_in_blocks(spark, terms):
    check(spark, DOCS, ITEMS, block_terms=terms)


def test_empty_tables(spark):
    check(spark, [], ITEMS)
    check(spark, DOCS, [])
    check(spark, [(1, None)], [(1, "a")])


def test_term_of_every_document_counts_for_nothing_when_its_weight_is_nothing(spark):
    check(spark, [(i, "common") for i in range(2000)] + [(5000, "common rare")], [(1, "common"), (2, "common rare")])


def test_ties_are_ranked_by_id_over_many_partitions(spark):
    docs = [(i, f"same words here {'x' if i % 7 else 'y'}") for i in range(500, 0, -1)]
    check(spark, docs, [(1, "same"), (2, "x words"), (3, "y")])


def test_documents(spark, sf, monkeypatch):
    monkeypatch.setattr(lexical, "STRIDE", 16)
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    check(spark, docs, items)


@settings(max_examples=200, deadline=None)
@given(st.data())
def test_index_finds_the_best(data):
    """Short and long lists, several indexes in a row, small strides and many ties."""
    n_terms, k = data.draw(st.integers(1, 8)), data.draw(st.integers(1, 4))
    rng = np.random.default_rng(data.draw(st.integers(0, 10_000)))
    factor = rng.integers(1, 4, n_terms)
    best = lexical.Best(k, np.zeros(0, np.int64), np.zeros(0, np.int64))
    every = {}
    old, lexical.STRIDE = lexical.STRIDE, data.draw(st.integers(1, 40))
    try:
        for part in range(data.draw(st.integers(1, 3))):
            n = data.draw(st.integers(1, 120))
            held = rng.random((n, n_terms)) < rng.choice([0.02, 0.05, 0.4, 0.9], n_terms)
            tf = rng.integers(1, 4, held.sum())
            ids = rng.permutation(n) * 3 + part
            length = rng.integers(25, 30, n)
            doc, term = np.nonzero(held)
            index = lexical.Index.of(ids, length, held.sum(axis=1), term, tf, n_terms)
            index.search(np.arange(n_terms), factor, best)
            for d, t, f in zip(doc, term, tf, strict=True):
                every[ids[d]] = every.get(ids[d], 0) + int(factor[t] * (1_000_000_000 * f // (1000 * f + 8 * length[d])))
    finally:
        lexical.STRIDE = old
    want = sorted(every.items(), key=lambda r: (-r[1], r[0]))[:k]
    assert list(zip(best.ids.tolist(), best.scores.tolist(), strict=True)) == want
