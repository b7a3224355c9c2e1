"""Packing against the tokenizer run on whole texts, and the plan against sequence-by-sequence best fit."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from carespend.llm.packing import Encoder, pack, plan_slots, ranked
from carespend.llm.text import column_bytes

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")

CASES = [
    (1, "Plain words, and a stop."), (2, None), (3, ""), (4, "3.14... it's (a.b), foo's. É, é."), (5, "tab\tand\x0bmore\xa0space"),
    (6, "a<|endoftext|>b <|ENDOFTEXT|>"), (7, "ΑΣ İstanbul é. 中文，字。 ﬁ"), (8, "word, " * 9000), (9, "x" * 20_000), (9, "again"),
    (10, "..,,.a.,b,.1,\n\n.c  d ,e"), (11, "́a.́ b,̧"), (12, "İ KK ʼn."),
]


def tokens(rows):
    t = Tokenizer.from_file(VOCABULARY)
    return [(i, [*t.encode(x or "", add_special_tokens=False).ids, 0]) for i, x in rows]


def check(rows, got, size):
    want = []
    for i, ids in tokens(rows):
        for piece, a in enumerate(range(0, len(ids), size)):
            cut = ids[a : a + size]
            want.append((i, piece, a, len(cut), zlib.crc32(np.array(cut, "<u4").tobytes())))
    assert sorted([(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got], key=str) == sorted(want, key=str)
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= size
    return len(sequences)


@pytest.mark.parametrize("size", [2048, 16])
def test_cases(spark, size):
    docs = spark.createDataFrame([(*r, 1, 2) for r in CASES], "doc_id long, text string, length int, rank int")
    check(CASES, pack(docs, VOCABULARY, size).collect(), size)


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    n = check(rows, pack(docs, VOCABULARY).collect(), 2048)
    total = sum(len(ids) for _, ids in tokens(rows))
    assert n <= 1.05 * total / 2048 + 1


def test_empty(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string"), VOCABULARY).collect() == []


@given(st.lists(st.text(alphabet=" \n\t.,'sabAÉé<|>0²_-#́中İΣ", max_size=30), max_size=8))
@settings(deadline=None)
def test_forms_encode_like_whole_texts(texts):
    import pyarrow as pa

    global ENCODER
    data, offsets = column_bytes(pa.array(texts, pa.string()))
    assert list(ENCODER.encode(data, offsets)) == [ENCODER.whole(x.encode()) for x in texts]


ENCODER = Encoder(open(VOCABULARY).read())


def one_by_one(counts, size):
    spaces = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fit = min((s for s in spaces if s >= length), default=None)
            if fit is None:
                fit = size
            else:
                spaces.remove(fit)
            spaces.append(fit - length)
    return len(spaces)


@given(st.dictionaries(st.integers(1, 30), st.integers(1, 40), min_size=1), st.integers(30, 50))
@settings(deadline=None)
def test_plan(counts, size):
    used, taken = defaultdict(list), Counter()
    for length, rank, count, each, sequence, offset in plan_slots(counts, size):
        assert rank == taken[length]
        taken[length] += count
        for k in range(count):
            used[sequence + k // each].append((offset + k % each * length, length))
    assert taken == counts
    for held in used.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= size
    assert len(used) == one_by_one(counts, size)


def test_rank_over_buckets(spark):
    cut = spark.range(500).selectExpr("id AS doc_id", "0 AS piece", "id AS ids_crc32", "5L + id % 2 AS length")
    got = ranked(cut, {5: 250, 6: 250}, per_task=30).collect()
    for length in (5, 6):
        assert sorted(r["rank"] for r in got if r["length"] == length) == list(range(250))


def test_forms_outlive_their_generation():
    """Forms that are still used move on to the new generation; the others go with the second change."""
    import pyarrow as pa

    encoder, plain = Encoder(open(VOCABULARY).read(), 3), Encoder(open(VOCABULARY).read())
    for k in range(12):
        texts = pa.array([f"always word{k} other{k}", f"word{k} again{k // 2}"])
        data, offsets = column_bytes(texts)
        assert list(encoder.encode(data, offsets)) == [plain.whole(t.encode()) for t in texts.to_pylist()]
        assert b"always" in encoder.known
    assert b"word0" not in encoder.known and b"word0" not in encoder.older


def test_a_worker_keeps_its_encoder():
    from carespend.llm.packing import encoder_of

    text = open(VOCABULARY).read()
    assert encoder_of(text) is encoder_of(text)
