"""Spelling variants against a comparison of all pairs of words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from carespend.llm import spelling


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def expected(counts, ratio=10):
    out = {}
    for w, n in counts.items():
        close = sorted(((-m, v) for v, m in counts.items() if near(w, v)))
        has = close and -close[0][0] >= ratio * n
        out[w] = (close[0][1] if has else None, n, len(close), -close[0][0] if has else None)
    rows = []
    for w, (form, n, n_near, form_n) in out.items():
        root = w
        while out[root][0] is not None:
            root = out[root][0]
        rows.append((w, form, root, n, n_near, form_n))
    return sorted(rows, key=str)


def got(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(map(tuple, df.collect()), key=str)


def vocabulary(seed, size=150):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abÿ" if k % 2 else "aÀzc") for _ in range(rng.choice([7, 7, 8, 9, 12]))) for k in range(size)]
    for w in list(words):
        k = rng.randrange(len(w))
        words += [w[:k] + w[k + 1 :] + "q" * 2, w[:k] + rng.choice("abé") + w[k:], w[:k] + "x" + w[k + 1 :]]
    return {w: rng.choice([2, 2, 3, 20, 30, 300, 3000, 40000]) for w in words}


@pytest.mark.parametrize("block", [spelling.BLOCK, 3])
@pytest.mark.parametrize("seed", range(2))
def test_words(spark, monkeypatch, seed, block):
    """Also with tiles cut into finer ones, and a few rows at a time."""
    if block == 3:
        monkeypatch.setattr(spelling, "ROWS", 5)
        monkeypatch.setattr(spelling, "CELLS", 40)
    counts = vocabulary(seed)
    df = spark.createDataFrame(list(counts.items()), "word string, n int")
    assert got(spelling.spelling_variants(df, block=block)) == expected(counts)


def test_a_tile_of_very_many_words(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    counts = {f"prefi{a}{b}{c}suffix": 2 + 30 * (a == b) + 1000 * (a == b == c) for a in letters[:12] for b in letters[:12] for c in letters[:12]}
    df = spark.createDataFrame(list(counts.items()), "word string, n int")
    assert got(spelling.spelling_variants(df)) == expected(counts)


def test_chain_of_forms(spark):
    counts = {"aaaaaaaaaaaa"[: 12 - k] + "bbbbbbbbbbbb"[:k]: 2 * 10**k for k in range(9)}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert got(spelling.spelling_variants(df)) == expected(counts)


@pytest.mark.parametrize("gap", [1, 3, 5])
@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("abé", min_size=7, max_size=9), min_size=2, max_size=12, unique=True))
def test_pairs_are_found_in_one_tile(gap, words):
    """Each near pair is in exactly one of the tiles that hold both its words."""
    want = sorted((a, b) for a in words for b in words if a < b and near(a, b))
    found = []
    for longer in range(7, 11):
        for place in range(0, longer, gap):
            groups = {}
            for w in words:
                if len(w) in (longer, longer - 1):
                    rest = max(0, longer - place - gap)
                    groups.setdefault((w[:place], w[len(w) - rest :]), []).append(w)
            for held in groups.values():
                if len(held) > 1:
                    a, b = spelling.near_pairs(pa.array(held), np.array([0]), np.array([len(held)]), longer, np.array([place]), np.array([gap]))
                    found += [tuple(sorted((held[x], held[y]))) for x, y in zip(a, b, strict=True) if max(len(held[x]), len(held[y])) == longer]
    assert sorted(found) == want


def counted(rows, slips, least_length=7):
    out = Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if slips and h % slips == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= least_length:
                out[w] += 1
    return out


TEXTS = [
    (1, "Grandmother grandmother GRANDMOTHER's grandmothér, grandmothÉr"), (2, None), (3, ""), (4, " \n\t"), (5, "short words only"), (-6, "naïveté×÷naïveté Ærøskøbing ĀbcdefghĀ"),
    (7, "Grandmothers " * 3000), (7, "grandmother"), (None, "grandmother grandfather"), (8, "w" * 20_000 + " " + "w" * 19_999 + "x"), (9, ("v" * 300 + " ") * 3 + ("v" * 299 + " ") * 40),
    (10, "abcdefg1abcdefg_abcdefg"),
]


@pytest.mark.parametrize("slips", [None, 1, 2, 31])
def test_texts(spark, slips):
    docs = spark.createDataFrame([(*r, "a", 2, 3) for r in TEXTS], "doc_id long, text string, word string, n int, tile long")
    counts = {w: n for w, n in counted(TEXTS, slips).items() if n >= 2}
    assert got(spelling.group_spellings(docs, slips=slips)) == expected(counts)


def test_empty_table(spark):
    assert got(spelling.group_spellings(spark.createDataFrame([], "doc_id long, text string"), slips=31)) == []


def test_counts_of_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    want = counted([tuple(r) for r in docs.collect()], 31)
    assert {r["word"]: r["n"] for r in spelling.word_counts(docs, 31).collect()} == want
