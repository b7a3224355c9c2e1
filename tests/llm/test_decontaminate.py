"""Winnowing against a comparison of all windows."""

import random
import re

from carespend.llm.decontaminate import decontaminate

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").encode().translate(LOWER))


def expected(docs, items, window=10):
    held = {}
    for item, text in items:
        w = words(text)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            held.setdefault(tuple(w[k : k + n]), set()).add(item)
    sizes = {len(k) for k in held}
    out = set()
    for i, text in docs:
        w = words(text)
        hit, found = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in held:
                    hit |= set(range(k, k + n))
                    found |= held[tuple(w[k : k + n])]
        out.add((i, len(w), len(hit), tuple(sorted(found)), bool(hit)))
    return out


def check(spark, docs, items, **options):
    d = spark.createDataFrame([(*r, 1, "p") for r in docs], "doc_id long, text string, length int, print string").repartition(3)
    b = spark.createDataFrame([(*r, 2) for r in items], "item_id long, text string, doc_id int")
    got = decontaminate(d, b, **options).collect()
    rows = {(r["doc_id"], r["n_words"], r["n_hit"], tuple(sorted(r["items"])), r["contaminated"]) for r in got}
    assert rows == expected(docs, items)
    assert len(got) == len({(i, t or "") for i, t in docs})


def passages(rng):
    pool = [f"w{k}" for k in range(60)]
    items = [(k, " ".join(rng.choices(pool, k=rng.randrange(10, 40)))) for k in range(12)]
    items += [(20, items[0][1]), (21, items[1][1].upper()), (22, items[2][1] + " more words"), (23, "short É item"), (24, "one"), (25, ""), (26, None), (27, "a b c d e f g h i")]
    docs = []
    for k in range(60):
        parts = rng.choices(pool, k=rng.randrange(0, 60))
        for _ in range(rng.randrange(3)):
            source = rng.choice(items)[1] or ""
            cut = source.split()
            a = rng.randrange(len(cut) + 1)
            at = rng.randrange(len(parts) + 1)
            parts[at:at] = cut[a : a + rng.randrange(5, 30)]
        docs.append((k, rng.choice([" ", ", ", "--\n"]).join(parts)))
    docs += [(100, None), (101, ""), (102, "..."), (103, "SHORT É item"), (104, "short é item"), (105, "One, two"), (106, " ".join(rng.choices(pool, k=30_000)))]
    docs += [docs[0], docs[0], (None, docs[1][1]), (0, "another text, one"), (107, "a B c d e f g h i j")]
    return docs, items


def test_passages(spark):
    check(spark, *passages(random.Random(4)))


def test_no_benchmark_and_no_documents(spark):
    docs, items = passages(random.Random(5))
    check(spark, docs[:5], [(1, None), (2, "")])
    check(spark, docs[:5], [])
    check(spark, [], items)
