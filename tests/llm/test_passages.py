"""Repeated passages against a plain pass over lines in Python."""

import random

from carespend.llm import line_chunks
from carespend.llm.line_chunks import line_dedup, passage_dedup


def pairs(text):
    full = [(k, x) for k, x in enumerate((text or "").split("\n")) if x.strip(" \t\n\x0b\f\r")]
    return [(a, b, x + "\n" * (b - a) + y) for (a, x), (b, y) in zip(full, full[1:], strict=False)]


def expected(rows):
    first = {}
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        for a, _, pair in pairs(text):
            first[pair] = min(first.get(pair, (i, a)), (i, a), key=lambda p: (p[0] is not None, p[0] or 0, p[1]))
    out = []
    for i, text in rows:
        gone = set()
        for a, b, pair in pairs(text):
            j, at = first[pair]
            if j != i or a > at + b - a:
                gone |= set(range(a, b + 1))
        lines = (text or "").split("\n")
        out.append((i, "\n".join(x for k, x in enumerate(lines) if k not in gone), len(lines), len(gone), text is None))
    return sorted(out, key=str)


def check(spark, rows):
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, row int, at int").repartition(3)
    assert sorted(map(tuple, passage_dedup(docs).collect()), key=str) == expected(rows)


def passage(name, n):
    return [f"{name} line {k} " + " ".join(f"{name}{k}word{j}" for j in range(60 // n + 1)) for k in range(n)]


def test_passages_between_other_neighbours(spark):
    """Passages of over 50 words and 1 to 10 lines: all go at their second place but for the single line."""
    every = [passage(f"p{n}", n) for n in range(1, 11)] + [["same line"] * 6]
    rows = [(100 * r + k, "\n".join([f"before {r} {k}", *p, f"after {r} {k}"])) for r in range(2) for k, p in enumerate(every)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in passage_dedup(docs).collect()}
    assert all(got[k] == dict(rows)[k] for k in range(10))
    assert got[100] == dict(rows)[100]
    assert [got[100 + k] for k in range(1, 11)] == [f"before 1 {k}\nafter 1 {k}" for k in range(1, 11)]
    whole = {r["doc_id"]: r["text"] for r in line_dedup(docs).collect()}
    assert any(whole[100 + k] != got[100 + k] for k in range(1, 11))  # what whole chunks alone leave
    check(spark, rows)


def texts(rng):
    pool = [[f"line {rng.randrange(60)} é" if rng.random() < 0.8 else "" for _ in range(rng.randrange(2, 25))] for _ in range(6)]
    out = []
    for _ in range(50):
        lines = [f"own {rng.randrange(10**6)}" if rng.random() < 0.8 else " " for _ in range(rng.randrange(12))]
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(lines) + 1)
            lines[at:at] = rng.choice(pool)
        out.append("\n".join(lines))
    return out


def odd(rng):
    rows = list(enumerate(texts(rng)))
    twice = "\n".join(f"t{k}" for k in range(40))
    rows += [(100, None), (101, ""), (102, "\n\n\n\n"), (103, "\n\n\n\n"), (104, twice + "\n" + twice), (105, rows[0][1]), (105, rows[0][1]), (None, rows[1][1])]
    return [*rows, (106, "one line"), (107, "one line"), (108, "one line\n\n"), (109, "x\n" * 3000), (110, "y\ny\ny"), (111, "a\n\n\nb\na\nb"), (112, "a\n\n\nb")]


def test_texts(spark):
    check(spark, odd(random.Random(8)))


def test_hashes_that_collide(spark, monkeypatch):
    plain = line_chunks._pairs

    def colliding(*args):
        out = plain(*args)
        return out.withColumns({"high": out["high"] % 5, "low": out["low"] * 0})

    monkeypatch.setattr(line_chunks, "_pairs", colliding)
    check(spark, odd(random.Random(9)))


def test_empty(spark):
    check(spark, [])


def test_carried_columns(spark):
    docs = spark.createDataFrame([(1, "a\nb", "de", 3)], "doc_id long, text string, lang string, n_lines int")
    row = passage_dedup(docs, carry=["lang", "n_lines"]).first()
    assert row["carried"].asDict() == {"lang": "de", "n_lines": 3} and row["n_lines"] == 2
