"""Line chunks against a plain pass in Python."""

import hashlib
import random

from carespend.llm import line_chunks
from carespend.llm.line_chunks import line_dedup


def chunks(text):
    out, held, before = [], [], 0
    lines = (text or "").split("\n")
    for k, line in enumerate(lines):
        h = int(hashlib.md5(line.encode()).hexdigest()[:8], 16)
        held.append(line)
        if (before * 31 + h) % 4 == 0 or k == len(lines) - 1:
            out.append(held)
            held = []
        before = h
    return out


def expected(rows):
    seen, order = {}, sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0]))
    for k in order:
        for at, c in enumerate(chunks(rows[k][1])):
            if len(c) >= 2 and "".join(c).strip(" \t\n\x0b\f\r"):
                seen.setdefault("\n".join(c), (rows[k][0], at))
    out = []
    for i, text in rows:
        own = chunks(text)
        gone = [at for at, c in enumerate(own) if seen.get("\n".join(c), (i, at)) != (i, at)]
        kept = "\n".join("\n".join(c) for at, c in enumerate(own) if at not in gone)
        out.append((i, kept, sum(map(len, own)), len(own), len(gone), sum(len(own[at]) for at in gone), text is None))
    return sorted(out, key=str)


def check(spark, rows):
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, row int, at int").repartition(3)
    assert sorted(map(tuple, line_dedup(docs).collect()), key=str) == expected(rows)


def texts(rng):
    passages = [[f"line {rng.randrange(500)} é" for _ in range(rng.randrange(3, 25))] for _ in range(6)]
    out = []
    for _ in range(50):
        lines = [f"own {rng.randrange(10**6)}" for _ in range(rng.randrange(12))]
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(lines) + 1)
            lines[at:at] = rng.choice(passages)
        out.append("\n".join(lines))
    return out


def test_texts(spark):
    rows = list(enumerate(texts(random.Random(8))))
    twice = "\n".join(f"t{k}" for k in range(40))
    rows += [(100, None), (101, ""), (102, "\n\n\n\n"), (103, "\n\n\n\n"), (104, twice + "\n" + twice), (105, rows[0][1]), (105, rows[0][1]), (None, rows[1][1])]
    rows += [(106, "one line"), (107, "one line"), (108, "\x01" + twice), (109, "x\n" * 3000)]
    check(spark, rows)


def test_hashes_that_collide(spark, monkeypatch):
    rows = list(enumerate(texts(random.Random(9))))
    plain = line_chunks._occurrences

    def colliding(*args):
        out = plain(*args)
        return out.withColumns({"high": out["high"] % 5, "low": out["low"] * 0})

    monkeypatch.setattr(line_chunks, "_occurrences", colliding)
    check(spark, rows)


def test_empty(spark):
    check(spark, [])


def test_carried_columns(spark):
    docs = spark.createDataFrame([(1, "a\nb", "de", 3)], "doc_id long, text string, lang string, n_lines int")
    row = line_dedup(docs, carry=["lang", "n_lines"]).first()
    assert row["carried"].asDict() == {"lang": "de", "n_lines": 3} and row["n_lines"] == 2
