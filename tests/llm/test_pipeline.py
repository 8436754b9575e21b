from collections import Counter

import corpus_pipeline


def test_stages_keep_columns_and_take_effect(spark, docs, corpus, tmp_path):
    frame = docs.select("doc_id", "text", "source")
    counts = {}
    labels = [(k, int(k < 50)) for k in [*range(30), 50, 51, 52, 54, 57]]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, frame, str(tmp_path)).write.parquet(str(tmp_path / name))
        frame = spark.read.parquet(str(tmp_path / name))
        counts[name] = Counter(r[0] for r in frame.select("doc_id").collect())
        assert name == corpus_pipeline.STAGES[-1][0] or frame.columns == ["doc_id", "text", "source"]
    assert 57 not in counts["quality_rules"] and 8 in counts["quality_rules"]
    assert 44 not in counts["simhash_near_dedup"] and counts["simhash_near_dedup"][8] == 1
    assert counts["secret_scan"] == counts["simhash_near_dedup"]
    assert set(counts["best_fit_packing"]) == set(counts["source_mixing"])


def test_run_reads_documents(spark, docs, tmp_path):
    docs.select("doc_id", "text", "source").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(3, 1), (57, 0)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_every_stage_on_nothing(spark, nothing):
    frame = nothing
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, frame, None)
        assert made.count() == 0, name
