import random
from pathlib import Path

import corpus_pipeline
from quire.runtime import shared_dir
from tests.llm.helpers import CLASHING, DOCS, corpus, wide, words
from tests.llm.test_toxicity import labelled


def test_stages_work_on_what_is_kept(spark, tmp_path):
    rng = random.Random(7)
    docs, labels = labelled(5, 600)
    base = words(rng, 200)
    docs = [(i, t, lang, f"s{i % 5}", n) for i, t, lang, _, n in docs]
    docs += [(1000 + i, docs[1][1].replace(" ", "  "), "en", "s0", 0) for i in range(5)] + [(1100 + i, base + f" tail{i}", "en", "s1", 0) for i in range(20)]
    spark.createDataFrame(docs, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    rows = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, sizes = rows.columns, [rows.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, rows, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        rows = spark.read.parquet(str(tmp_path / name))
        sizes.append(rows.count())
        assert name == "packing" or rows.columns == columns
    toxic = {i for i, _, t in labels if t}
    clean = spark.read.parquet(str(tmp_path / "toxicity"))
    assert sizes[1] == clean.count() and len(toxic & {r.doc_id for r in clean.select("doc_id").collect()}) <= 5
    ids = [r.doc_id for r in spark.read.parquet(str(tmp_path / "exact_dedup")).select("doc_id").collect()]
    assert len(ids) == len(set(ids)) and len({1, *range(1000, 1005)} & set(ids)) == 1
    near = {r.doc_id for r in spark.read.parquet(str(tmp_path / "simhash_near_dedup")).select("doc_id").collect()}
    assert near < set(ids)
    mixed = spark.read.parquet(str(tmp_path / "source_mix"))
    assert {r.doc_id for r in mixed.select("doc_id").collect()} <= near and mixed.count() > 0
    assert rows.groupBy("sequence_id").sum("length").agg({"sum(length)": "max"}).first()[0] <= 2048


def test_run(spark, tmp_path):
    docs, labels = labelled(6, 200)
    spark.createDataFrame(docs, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_empty_tables_and_clashing_columns(spark, tmp_path):
    spark.createDataFrame([], CLASHING).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    odd = wide([r for r in corpus(5) if r[0] is None or r[0] < 60 or r[0] >= 300]) + [(None,) * len(CLASHING.split(","))]
    spark.createDataFrame(odd, CLASHING).write.parquet(str(tmp_path / "odd" / "documents.parquet"))
    for name in ("none", "odd"):
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / name / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
    got = corpus_pipeline.run(spark, str(tmp_path / "odd"))
    # stages hand on what they don't know, as it came
    rows = spark.read.parquet(str(tmp_path / "odd" / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert {r._held for r in stage(spark, rows, str(tmp_path / "odd")).collect()} <= {"held", None}, name
    assert got.count() > 0 and got.groupBy("sequence_id").sum("length").agg({"sum(length)": "max"}).first()[0] <= 2048


def test_intermediate_tables_are_deleted(spark, tmp_path):
    docs, labels = labelled(9, 150)
    spark.createDataFrame(docs, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    folder = Path(shared_dir(spark).removeprefix("file:")) / "quire"
    before = set(folder.iterdir()) if folder.exists() else set()
    got = corpus_pipeline.run(spark, str(tmp_path))
    left = set(folder.iterdir()) - before
    assert len(left) == 1 and got.count() > 0
