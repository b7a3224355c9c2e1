"""Substring deduplication against a comparison of all windows."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from carespend.llm import substring
from carespend.llm.queries import queries
from carespend.llm.text import WordRuns, column_bytes


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def expected(rows, window):
    """``doc_id, n_words, kept, spans`` of every row."""
    least, order = {}, [(i is not None, i or 0) for i, _ in rows]
    for key, (_, t) in zip(order, rows, strict=True):
        ws = words(t)
        for s in range(len(ws) - window + 1):
            w = tuple(ws[s : s + window])
            least[w] = min(least.get(w, key), key)
    out = []
    for key, (i, t) in zip(order, rows, strict=True):
        ws = words(t)
        gone = set()
        for s in range(len(ws) - window + 1):
            if least[tuple(ws[s : s + window])] < key:
                gone.update(range(s, s + window))
        spans = [(k, next(e for e in range(k, len(ws) + 1) if e not in gone)) for k in sorted(gone) if k - 1 not in gone]
        out.append((i, len(ws), " ".join(w for k, w in enumerate(ws) if k not in gone).encode(), spans))
    return sorted(out, key=str)


def got(spark, rows, window):
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, key int, at int, print string")
    found = substring.substring_dedup(docs, window=window)
    assert found.columns == ["doc_id", "n_words", "kept", "spans"]
    return sorted([(r["doc_id"], r["n_words"], bytes(r["kept"]), [(s["begin"], s["end"]) for s in r["spans"]]) for r in found.collect()], key=str)


@pytest.mark.parametrize("period", [1, 3, 7, 13, 21, 31, 57])
def test_cover_has_every_distance_once(period):
    places = substring.difference_cover(period)
    assert sorted((a - b) % period for a in places for b in places if a != b) == list(range(1, period))


@pytest.mark.parametrize("window", [1, 2, 5, 12, 50, 100])
def test_equal_windows_share_an_anchor(window):
    width, cover = substring.cover_of(window)
    n = len(cover)
    for a in range(n):
        for b in range(n):
            assert any(cover[(a + d) % n] and cover[(b + d) % n] for d in range(window - width + 1))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "ab", "é"]), min_size=1, max_size=60), st.integers(1, 30))
def test_runs_are_told_apart(ws, n):
    from carespend.llm.text import SPACED_WORD, word_hashes, word_spans

    data, offsets = column_bytes(pa.array([" ".join(ws)]))
    _, starts, ends = word_spans(data, offsets, SPACED_WORD)
    at = np.arange(max(0, len(ws) - n + 1))
    values = WordRuns(word_hashes(data, starts, ends), n, substring._FIRST).of(at, np.array(n)).tolist()
    runs = [tuple(ws[k : k + n]) for k in at]
    assert len(set(zip(values, runs, strict=True))) == len(set(runs)) == len(set(values))


def passage(seed, n=80):
    rng = random.Random(seed)
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


P, Q = passage(1), passage(2)


def join(*parts):
    return " ".join(w for p in parts for w in p)


CASES = [
    (1, join(passage(10, 33), P, passage(11, 7))),
    (2, join(passage(12, 5), P[:50], passage(13, 5))),  # one window
    (3, join(passage(14, 9), P[:49], passage(15, 9))),  # none
    (4, join(P[20:], Q)), (5, join(Q, P, Q)), (6, join(Q, Q, passage(16, 3), Q)),  # repeats inside
    (7, None), (8, ""), (9, " \t\n "), (10, "short one"), (11, "short one"),
    (12, join(P[:30], ["X"], P[31:])), (13, join(P, Q)), (14, join(P, Q)), (14, join(P, Q)), (15, join(P, Q).replace(" ", " \n")),
    (16, join(passage(17, 60))), (16, join(passage(17, 60), passage(18, 60))), (17, join(passage(18, 60))), (16, join(passage(18, 55))),
    (None, join(Q[:60])), (None, join(passage(19, 70))), (18, join(passage(19, 70))), (19, join(["long"] * 3000)), (20, join(["long"] * 70)), (21, join(["é\xa0ü"] * 52)),
    (22, join(["É\xa0ü"] * 52)), (0, join(["long"] * 51)),
]


@pytest.mark.parametrize("window", [50, 5])
def test_cases(spark, window):
    assert got(spark, CASES, window) == expected(CASES, window)


def test_empty_table(spark):
    assert got(spark, [], 50) == []
    assert got(spark, [(1, None)], 50) == [(1, 0, b"", [])]


@pytest.mark.parametrize("seed", range(3))
def test_pieces_of_common_passages(spark, seed):
    """Cuts of a few passages between other words, with ids that repeat."""
    rng = random.Random(seed)
    base = [[f"p{k}w{rng.randrange(3 if k else 50)}" for _ in range(60)] for k in range(4)]
    rows = []
    for _ in range(120):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            p = rng.choice(base)
            a = rng.randrange(len(p))
            parts += [p[a : a + rng.randrange(1, 60)], [f"u{rng.randrange(10**9)}"] * rng.randrange(3)]
        rows.append((rng.randrange(60), join(*parts)))
    assert got(spark, rows, 12) == expected(rows, 12)


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_documents(spark, size):
    folder = f"/root/testdata/{size}"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    want = [(i, n, sum(b - a for a, b in spans), hashlib.sha256(kept).hexdigest()) for i, n, kept, spans in expected(rows, 50)]
    found = queries()["op11_substring_dedup"](spark, folder)
    assert found.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    assert sorted(map(tuple, found.collect())) == sorted(want)
    assert sum(w[2] for w in want) > 0
