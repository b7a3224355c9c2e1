"""The pipeline, stage by stage, against brute force on its own inputs."""

import corpus_pipeline
import pyarrow as pa
import pytest
from test_decontaminate import expected as hits
from test_line_chunks import expected as lines
from test_minhash import expected as groups
from test_packing import check as check_packing

from carespend.llm import toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


def follow(spark, docs, folder, benchmark):
    """Runs all stages and compares each with what plain Python keeps of its input."""
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["toxicity", "line_dedup", "near_dedup", "decontaminate", "pack"]

    clean = steps["toxicity"](spark, docs, folder).cache()
    model = toxicity.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    toxic = {(r["doc_id"], r["text"]) for r in docs.join(toxicity.score(docs, model).where("predicted = 1").select("doc_id").distinct(), "doc_id").collect()}
    assert rows_of(clean) == [r for r in rows_of(docs) if r[:2] not in toxic]

    cut = steps["line_dedup"](spark, clean, folder).cache()
    before = rows_of(clean)
    after = {(r[0], r[1]): r for r in lines([r[:2] for r in before])}
    want = []
    for i, text, lang, source, n in before:
        kept = next(r for r in after.values() if r[0] == i and r[6] == (text is None) and (r[4] or r[1] == (text or "")))
        if kept[4] == 0:
            want.append((i, text, lang, source, n))
        elif kept[1].strip():
            want.append((i, kept[1], lang, source, len(kept[1])))
    assert rows_of(cut) == sorted(want, key=str)

    single = steps["near_dedup"](spark, cut, folder).cache()
    first = {r[0] for r in groups([r[:2] for r in rows_of(cut) if r[0] is not None], 5, 80) if r[3]}
    assert rows_of(single) == [r for r in rows_of(cut) if r[0] is None or r[0] in first]

    own = steps["decontaminate"](spark, single, folder).cache()
    leaked = {r[0] for r in hits([r[:2] for r in rows_of(single)], benchmark) if r[4]}
    assert rows_of(own) == [r for r in rows_of(single) if r[0] not in leaked]

    packed = steps["pack"](spark, own, folder).collect()
    check_packing([r[:2] for r in rows_of(own)], packed, 2048)
    return [len(rows_of(x)) for x in (docs, clean, cut, single, own)]


@pytest.mark.parametrize("size", ["sf0.001"])
def test_documents(spark, size):
    folder = f"/root/testdata/{size}"
    benchmark = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()]
    counts = follow(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder, benchmark)
    assert counts == sorted(counts, reverse=True)
    got = corpus_pipeline.run(spark, folder)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert got.select("doc_id").distinct().count() == counts[-1]


def test_odd_documents(spark, tmp_path):
    passage = " ".join(f"p{k}" for k in range(30))
    block = "\n".join(f"line {k}" for k in range(60))
    rows = [(k, f"document {k} " + " ".join(f"w{(k * 37 + j * 11) % 211}" for j in range(80)), "en", "s", 1) for k in range(30)]
    rows += [(100, None, None, None, None), (101, "", "en", "s", 0), (102, "x " + passage, "en", "s", 9), (103, block, "en", "s", 9), (104, block + "\nmore", "en", "s", 9)]
    rows += [(105, rows[0][1].upper(), "en", "s", 9), (106, rows[1][1] + " end", "en", "s", 9), (None, "a text without an id", "en", "s", 9), rows[2]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 0) for k in range(20)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    counts = follow(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path), [(1, passage)])
    assert counts[-1] < counts[0]


def test_no_documents(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_no_sql():
    assert corpus_pipeline.ORACLE_SQL is None


def test_workers_get_few_rows_at_a_time_while_stages_are_written(spark, tmp_path, monkeypatch):
    """Batches of 10,000 texts left the workers too large for the stages after them."""
    docs = spark.range(0, 9000, 1, 1).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    docs.write.parquet(str(tmp_path / "documents.parquet"))

    def sizes(spark, docs, folder):
        def run(batches):
            for batch in batches:
                yield batch.append_column("n", pa.array([batch.num_rows] * batch.num_rows))

        return docs.mapInArrow(run, "doc_id long, text string, n long")

    monkeypatch.setattr(corpus_pipeline, "STAGES", [("sizes", sizes), ("all", lambda spark, docs, folder: docs)])
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 9000 and out.agg({"n": "max"}).first()[0] <= corpus_pipeline.BATCH
    assert spark.conf.get(key) == before


def test_a_stage_by_itself_gives_workers_few_rows_at_a_time(spark, monkeypatch):
    """Stages are also run one by one; batches were small only where ``run`` ran them all."""
    key, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    before = spark.conf.get(key)
    docs = spark.createDataFrame([(1, "a text")], "doc_id long, text string")

    def asked(*args, **options):
        seen.append(int(spark.conf.get(key)))
        return docs.selectExpr("doc_id", "text", "true AS kept", "0 AS predicted")

    monkeypatch.setattr(corpus_pipeline.toxicity, "fit", lambda *args: None)
    monkeypatch.setattr(corpus_pipeline.toxicity, "score", asked)
    monkeypatch.setattr(corpus_pipeline.minhash, "near_dedup", asked)
    monkeypatch.setattr(corpus_pipeline.packing, "pack", asked)
    for step in (corpus_pipeline.drop_toxic, corpus_pipeline.drop_near_copies, corpus_pipeline.pack):
        step(spark, docs, "/root/testdata/sf0.001")
    assert seen == [corpus_pipeline.BATCH] * 3 and spark.conf.get(key) == before
