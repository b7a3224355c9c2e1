"""Kneser-Ney models against a plain implementation, and held-out accuracy."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from carespend.llm import toxicity
from carespend.llm.queries import toxicity_scores
from carespend.llm.text import column_bytes
from carespend.llm.toxicity import DISCOUNT, ORDER, fit, score, text_grams


def plain_grams(text):
    data = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    words = bytes(b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in data).split()
    out = []
    for word in words:
        word = b" " + word + b" "
        out += [word[max(0, k - ORDER + 1) : k + 1] for k in range(1, len(word))]
    return out


@given(st.lists(st.text(alphabet="aB é.,\n9ß", max_size=25), min_size=1, max_size=6))
@settings(deadline=None)
def test_grams(texts):
    data, offsets = column_bytes(pa.array(texts, pa.string()))
    text, grams = text_grams(data, offsets)
    got = defaultdict(list)
    for t, g in zip(text.tolist(), grams.tolist(), strict=True):
        got[t].append(int(g).to_bytes(8, "big").lstrip(b"\0"))
    assert [got[k] for k in range(len(texts))] == [plain_grams(t) for t in texts]


def plain_shared(grams):
    """Chance of the last byte after the context less one byte, from distinct grams."""
    levels = [set(grams)]
    counts = []
    for _ in range(ORDER - 1):
        counts.append(Counter(g[1:] for g in levels[-1] if len(g) > 1))
        levels.append(set(counts[-1]))

    def chance(g, level):
        table = counts[level]
        total = sum(n for x, n in table.items() if x[:-1] == g[:-1])
        kinds = sum(1 for x in table if x[:-1] == g[:-1])
        if len(g) == 1:
            return table[g] / total
        return max(table[g] - DISCOUNT, 0) / total + DISCOUNT * kinds / total * chance(g[1:], level + 1)

    return {g: chance(g[1:], 0) for g in grams}


TEXTS = [(1, "abca abd", 1), (2, "abca abca xyz", 0), (3, "bad word bad", 1), (4, "abd word", 0), (5, None, 0), (6, "été ÉTÉ", 1)]


def test_chances(spark):
    rows = spark.createDataFrame([(t or "", y, 1) for _, t, y in TEXTS], "text string, toxic int, fit int").withColumn("fit", toxicity.F.col("fit") == 1)
    counts = toxicity.gram_counts(rows).cache()
    shared = toxicity.shared_backoff(counts)
    name = lambda g: (g & (2**64 - 1)).to_bytes(8, "big").lstrip(b"\0")
    table = {0: Counter(), 1: Counter()}
    for _, t, y in TEXTS:
        table[y].update(plain_grams(t))
    every = set(table[0]) | set(table[1])
    want = plain_shared(every)
    got = {name(r["gram"]): r["shared"] for r in shared.collect()}
    assert got.keys() == want.keys()
    assert all(math.isclose(got[g], want[g]) for g in want)

    llr = {name(r["gram"]): r["llr"] for r in toxicity.contrasts(counts, shared, "toxic", "ordinary", -1.0).collect()}

    def chance(g, y):
        total = sum(n for x, n in table[y].items() if x[:-1] == g[:-1])
        kinds = sum(1 for x in table[y] if x[:-1] == g[:-1])
        return (max(table[y][g] - DISCOUNT, 0) + DISCOUNT * kinds * want[g]) / total if total else want[g]

    assert llr.keys() == every
    assert all(math.isclose(llr[g], math.log(chance(g, 1) / chance(g, 0)), abs_tol=1e-9) for g in every)


def corpus(spark, n=400):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(n):
        words = [f"w{k}" for k in rng.integers(0, 80, 60)]
        if i % 4 == 0:
            words[7] = words[30] = "nasty"
        rows.append((i, " ".join(words), "x", 0.5))
    docs = spark.createDataFrame([*rows, (9001, None, "x", 0.1), (9002, "", "x", 0.1), (9003, "w1 " * 100_000 + "nasty", "x", 0.1), (None, "nasty", "x", 0.1), (0, "again", "x", 0.1)], "doc_id long, text string, toxic string, score double")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(0, n, 2)] + [(1, None), (2, 7), (None, 1), (4, 1)], "doc_id long, toxic int")
    return docs, labels


def test_scores(spark, monkeypatch):
    docs, labels = corpus(spark)
    model = fit(docs, labels)
    got = score(docs, model).collect()
    assert len(got) == docs.count()
    by_id = {r["doc_id"]: r for r in got if r["doc_id"] != 0}
    assert all(by_id[i]["predicted"] == int(i % 4 == 0) for i in range(1, 400))
    assert by_id[9001]["ratio"] == by_id[9002]["ratio"] == 0 and by_id[9001]["predicted"] == 0
    assert by_id[9003]["ratio"] < by_id[None]["ratio"]
    monkeypatch.setattr(toxicity, "MODEL_ROWS", 0)
    joined = sorted((str(r["doc_id"]), round(r["ratio"], 9)) for r in score(docs, model).collect())
    assert joined == sorted((str(r["doc_id"]), round(r["ratio"], 9)) for r in got)


def test_no_labels(spark):
    docs, labels = corpus(spark, 20)
    got = score(docs, fit(docs, labels.where("false"))).collect()
    assert len(got) == 25 and not any(r["predicted"] for r in got)


def test_empty(spark):
    docs, labels = corpus(spark, 60)
    assert score(docs.where("false"), fit(docs, labels)).collect() == []


@pytest.mark.parametrize("size, accuracy, area", [("sf0.1", 0.93, 0.72)])
def test_held_out(spark, size, accuracy, area):
    folder = f"/root/testdata/{size}"
    scored = toxicity_scores(spark, folder)
    rows = scored.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["predicted"] == r["toxic"] for r in held]) >= accuracy
    ones, zeros = ([r["score"] for r in held if r["toxic"] == k] for k in (1, 0))
    assert np.mean([(a > b) + 0.5 * (a == b) for a in ones for b in zeros]) >= area
    assert np.mean([r["predicted"] for r in held if r["toxic"] == 0]) <= 0.01
