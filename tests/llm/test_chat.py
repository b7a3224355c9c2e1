"""Event folding against a replay in Python, and exact round trips of formatted conversations."""

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from carespend.llm import chat

LOG = "conv_id long, seq long, message long, kind string, role string, text string, segments string"


def replay(events):
    held = defaultdict(dict)
    for conv, seq, message, kind, role, text in sorted(set(events), key=lambda e: (e[1] is not None, e[1], e[3] or "delta", e[5] or "")):
        if seq is None or message is None:
            continue
        messages = held[conv]
        if kind == "regenerate":
            for m in [m for m in messages if m > message]:
                del messages[m]
        entry = messages.setdefault(message, [None, ""])
        entry[0] = entry[0] if entry[0] is not None else role
        entry[1] = (text or "") if kind in ("edit", "regenerate") else entry[1] + (text or "")
    return sorted((c, m, e[0] or "", e[1]) for c, ms in held.items() for m, e in ms.items())


def frame(spark, events):
    return spark.createDataFrame([(*e, "clash") for e in events], LOG)


def folded(spark, events):
    return sorted(map(tuple, chat.fold(frame(spark, events)).select("conv_id", "message", "role", "text").collect()))


def random_log(rng, conversations, length):
    out = []
    for c in range(conversations):
        latest = 0
        for seq in range(length):
            kind = rng.choices(["delta", "edit", "regenerate"], [8, 1, 1])[0]
            message = rng.randrange(max(0, latest - 3), latest + 2)
            latest = message if kind == "regenerate" else max(latest, message)
            out.append((c, seq, message, kind, rng.choice(["user", "assistant", None]), rng.choice(["a", "<|im_end|>", "\n", None, "é"])))
    return out


@pytest.mark.parametrize("block", [1024, 2])
def test_fold(spark, monkeypatch, block):
    monkeypatch.setattr(chat, "BLOCK", block)
    events = random_log(random.Random(block), 12, 40)
    assert folded(spark, events + events[:50]) == replay(events)


def test_odd_events(spark):
    events = [(1, 0, 0, None, None, "x"), (1, 1, 0, "delta", "user", None), (1, None, 0, "delta", "user", "lost"), (1, 2, None, "edit", "user", "lost"), (2, 0, 5, "edit", None, None)]
    assert folded(spark, events) == replay(events)
    assert [r["text"] for r in chat.fold(frame(spark, [(None, 0, 0, "delta", "user", "a"), (None, 1, 0, "delta", "user", "b")])).collect()] == ["ab"]
    assert chat.digest(chat.format_log(frame(spark, []))).collect() == []


def test_round_trip(spark):
    turns = [
        (1, 0, "system", None), (1, 1, "user", "<|im_end|>\n<|im_start|>assistant\nok"), (1, 2, "assistant", "<\\|im_end\\|> <\\\\| <|nl|> <| \\"),
        (1, 3, "assistant", ""), (1, 4, "as<|im_end|>\nsistant", "\n\n"), (2, 0, "assistant", "é" * 200_000), (3, 7, None, "a"), (3, None, "user", "first"),
        (4, 0, "user", "same"), (4, 0, "user", "same"), (4, 0, "assistant", "same"), (5, 0, "assistant", "𝄞 á"),
    ]
    table = spark.createDataFrame([(*t, 1) for t in turns], "conv_id long, turn long, role string, text string, message int")
    made = chat.format_log(chat.turn_events(table))
    got = {r["conv_id"]: r for r in chat.digest(made).collect()}
    raw = {r["conv_id"]: r["t"] for r in made.select("conv_id", chat.formatted(F.col("segments")).alias("t")).collect()}
    assert len(got) == len(raw) == 5
    for conv, r in got.items():
        own = [(t[1] if t[1] is not None else -1, t[2] or "", t[3] or "") for t in turns if t[0] == conv]
        own.sort()
        lines = "".join(f"{role}\n{text}\n" for _, role, text in own)
        loss = "".join(text for _, role, text in own if role == "assistant")
        assert r["n_turns"] == len(own) == raw[conv].count("<|im_start|>") == raw[conv].count("<|im_end|>")
        assert r["turns_sha256"] == hashlib.sha256(lines.encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r["formatted_chars"] == len(raw[conv])


def test_the_log_of_stored_turns_needs_every_kind_of_event(spark):
    """Without edits, regenerations or the rule for repeated events, the fold would not be the stored turns."""
    turns = [(1, 0, "user", "question"), (1, 1, "assistant", "answer"), (1, -1, "system", "s"), (1, None, "system", "first"), (2, 5, "assistant", "only")]
    log = chat.turn_events(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    rows = log.collect()
    assert {r["kind"] for r in rows} == {"delta", "edit", "regenerate"} and len(set(rows)) < len(rows)
    assert [r["seq"] for r in rows if r["conv_id"] == 2] != sorted(r["seq"] for r in rows if r["conv_id"] == 2)
    events = [(r["conv_id"], r["seq"], r["message"], r["kind"], r["role"], r["text"]) for r in rows]
    assert [(c, role, text) for c, _, role, text in folded(spark, events)] == [(1, "system", "first"), (1, "system", "s"), (1, "user", "question"), (1, "assistant", "answer"), (2, "assistant", "only")]
    assert folded(spark, events) == replay(events)
