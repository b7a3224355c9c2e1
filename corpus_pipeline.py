"""From raw documents to packed training sequences, a stage at a time."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carespend.llm import decontaminate, line_chunks, minhash, packing, toxicity
from carespend.llm.joins import sized
from carespend.sources.io import stage

#: Word forms that packing remembers, twice over; fewer than by default, as workers also hold what earlier stages left.
REMEMBERED = 150_000
#: Rows that go to a worker at a time in the stages; its memory, and that of the buffers on the way, is kept from stage to stage.
BATCH = 2_000
#: SQL has neither the language models nor the tokenizer.
ORACLE_SQL = None


@contextmanager
def _few_rows(spark: SparkSession) -> Iterator[None]:
    """Batches of at most ``BATCH`` rows for what is written meanwhile."""
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(batch)
    spark.conf.set(batch, str(min(BATCH, int(before)) if int(before) > 0 else BATCH))
    try:
        yield
    finally:
        spark.conf.set(batch, before)


def _without(docs: DataFrame, lost: DataFrame, *keys: str) -> DataFrame:
    """The rows of ``docs`` whose key columns are not among ``lost``; null keys are equal."""
    lost = sized(lost.select(*(F.col(k).alias(f"_lost_{k}") for k in keys)).distinct(), "rejected")
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_lost_{k}"))
    return docs.join(lost, same, "left_anti")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language models, fitted on all labelled ones, do not call toxic."""
    with _few_rows(spark):
        model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
        keyed = docs.withColumn("_key", F.xxhash64("doc_id", "text"))
        rejected = toxicity.score(keyed.select("_key", "text"), model, id_col="_key").where("predicted = 1")
        return _without(keyed, rejected.select(F.col("doc_id").alias("_key")), "_key").select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the multi-line chunks that occur earlier; one that has nothing left goes."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    cut = line_chunks.line_dedup(docs, carry=rest).where((F.col("n_removed_chunks") == 0) | F.col("text").rlike(r"\S"))
    cut = cut.select("doc_id", F.when((F.col("n_removed_chunks") == 0) & F.col("was_null"), F.lit(None)).otherwise(F.col("text")).alias("text"), "n_removed_chunks", "carried.*") if rest else cut
    length = F.when(F.col("n_removed_chunks") == 0, F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType))
    return cut.withColumn("n_chars", length).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, a similarity of 0.8."""
    with _few_rows(spark):
        found = minhash.near_dedup(docs, k=5, percent=80)
        return _without(docs, found.where("NOT kept"), "doc_id")


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of a benchmark item."""
    found = decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    keyed = docs.withColumn("row", F.xxhash64(F.coalesce("text", F.lit(""))))
    return _without(keyed, found.where("contaminated"), "doc_id", "row").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences of 2048 tokens."""
    import public_tokenizers  # where the vocabulary files lie; no other stage needs it

    with _few_rows(spark):
        return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), remembered=REMEMBERED)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_copies),
    ("decontaminate", drop_benchmark),
    ("pack", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of a folder; each one's result is written and read again by the next.

    Documents without text, without id, or repeated pass like any other, as the operators say.
    No documents give no rows. Columns besides ``doc_id``, ``text`` and ``n_chars`` are carried along.
    """
    out = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with _few_rows(spark):
        for name, step in STAGES[:-1]:
            out = stage(step(spark, out, sf_dir), name)
    return STAGES[-1][1](spark, out, sf_dir)
