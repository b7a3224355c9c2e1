"""Native operators on texts with very many lines or matches: work grows with the text, not with its square."""

import time

import pytest

from carespend.llm import chat, decontaminate, line_chunks, secret_scan


def seconds(df):
    start = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


@pytest.mark.parametrize("name", ["lines", "secrets", "words", "turns"])
def test_long_texts(spark, name):
    def run(n):
        if name == "lines":
            return line_chunks.line_dedup(spark.createDataFrame([(1, "\n".join(f"line {i}" for i in range(n)))], "doc_id long, text string"))
        if name == "secrets":
            return secret_scan.scan(
                spark.createDataFrame([(1, " ".join(f"token={i:012d}" for i in range(n)), "s")], "doc_id long, text string, source string")
            )
        if name == "words":
            items = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(12)))], "item_id long, text string")
            return decontaminate.decontaminate(spark.createDataFrame([(1, " ".join(f"w{i % 5000}" for i in range(n)))], "doc_id long, text string"), items)
        turns = spark.createDataFrame([(1, i, "user" if i % 2 else "assistant", f"text {i}") for i in range(n)], "conv_id long, turn long, role string, text string")
        return chat.digest(chat.format_log(chat.turn_events(turns)))

    assert run(40).count() == 1
    assert seconds(run(20_000)) < 30
