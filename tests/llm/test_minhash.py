"""Near-duplicate groups against all pairs of full shingle sets."""

import math
import random

import pytest

from carespend.llm import minhash
from carespend.llm.components import components
from carespend.llm.minhash import least_matches, near_dedup

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingles(text, k):
    words = (text or "").encode().translate(LOWER).split()
    if len(words) < k:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def expected(rows, k, percent):
    sets = {i: shingles(t, k) for i, t in rows}
    root = {i: i for i in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    met = {(a, b) for ids in holders.values() for a in ids for b in ids if a < b}
    for a, b in met:
        inter = len(sets[a] & sets[b])
        if 100 * inter >= percent * (len(sets[a]) + len(sets[b]) - inter):
            x, y = top(a), top(b)
            root[max(x, y)] = min(x, y)
    return sorted((i, len(sets[i]), top(i), top(i) == i) for i in sets)


def check(spark, rows, k=3, percent=85):
    docs = spark.createDataFrame([(*r, "a", 1) for r in rows], "doc_id long, text string, signature string, rep int").repartition(5)
    got = near_dedup(docs, k=k, percent=percent)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted(map(tuple, got.collect())) == expected(rows, k, percent)


def edited(words, n, rng):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"w{rng.randrange(400)}"
    return " ".join(words)


def family(rng, copies, length, most):
    base = [f"v{rng.randrange(500)}" for _ in range(length)]
    return [edited(base, rng.randrange(most), rng) for _ in range(copies)]


def test_cases(spark):
    long = " ".join(f"t{i}" for i in range(30_000))
    texts = [None, "", " \n\t", "one", "ONE", "one two", "One  two", "two one", "É a b c", "é a b c", "a b c d", "A\tb\x0bc\nd", long, long + " end", long]
    check(spark, list(enumerate(texts)))


@pytest.mark.parametrize("k, percent", [(3, 85), (5, 80)])
def test_families_with_members_that_link_with_few(spark, k, percent):
    rng = random.Random(k)
    texts = [t for _ in range(6) for t in family(rng, 25, 120, 14)] + family(rng, 150, 90, 12)
    texts += [f"{a} common words in the middle of many texts {b}" for a in range(40) for b in range(2)]
    rng.shuffle(texts)
    check(spark, list(enumerate(texts)), k, percent)


def test_small_blocks_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 7)
    rng = random.Random(3)
    check(spark, list(enumerate(family(rng, 120, 100, 14))))


def test_repeated_and_missing_ids(spark):
    rows = [(5, "a b c d e"), (5, "a b c d e"), (9, "A b c d e"), (None, "a b c d e"), (7, "other words here now")]
    got = near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), k=3).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(5, 3, 5, True)] * 2 + [(9, 3, 5, False), (None, 3, None, True), (7, 2, 7, True)], key=str)


def test_empty(spark):
    assert near_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert sorted(map(tuple, near_dedup(docs, k=3, percent=85).collect())) == expected(rows, 3, 85)


def test_components(spark):
    path = [(i, i + 1) for i in range(60)]
    rng = random.Random(1)
    rng.shuffle(path)
    links = [(b, a) if rng.random() < 0.5 else (a, b) for a, b in path] + [(100, 107), (107, 103), (200, 200)] + [(300, 301 + i) for i in range(50)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "u long, v long")).collect()))
    assert got == {i: 0 for i in range(61)} | dict.fromkeys((100, 103, 107), 100) | {300 + i: 300 for i in range(51)}


def test_matches_asked_for():
    """The largest counts that a linked pair falls short of with a chance of 1e-9 at most."""
    for percent in (80, 85, 100):
        p, m = percent / 100, least_matches(percent)
        below = lambda n: sum(math.comb(64, k) * p**k * (1 - p) ** (64 - k) for k in range(n))
        assert below(m) <= 1e-9 and (m == 64 or below(m + 1) > 1e-9)


def test_words_with_the_same_polynomial(spark):
    """The Thue-Morse word and its complement collide in polynomials modulo a power of two."""
    word = "a"
    while len(word) < 2048:
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    check(spark, [(1, word), (2, other), (3, f"{word} x y z"), (4, f"{other} x y z")])


def test_texts_of_an_id_keep_their_links(spark):
    """An id with several texts is one document; each text links it with others."""
    rng = random.Random(8)
    a, b, c = (family(rng, 3, 120, 2) for _ in range(3))
    rows = [(5, a[0]), (5, b[0]), (2, b[1]), (9, a[1]), (9, a[1]), (7, c[0]), (8, c[1]), (8, "nothing like it"), (3, a[2]), (11, c[2]), (11, None)]
    got = near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), k=3).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(2, 2), (3, 2), (5, 2), (5, 2), (7, 7), (8, 7), (8, 7), (9, 2), (9, 2), (11, 7), (11, 11)]


@pytest.mark.parametrize("k, percent", [(3, 85), (5, 80)])
def test_recall_on_more_documents(spark, k, percent):
    """Every group that all pairs give, on a thousand documents."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert sorted(map(tuple, near_dedup(docs, k=k, percent=percent).collect())) == expected(rows, k, percent)
