"""The pipeline's stages on corner cases, and that each stage's decisions take effect."""

import corpus_pipeline as P
from vigilmill.llm import simhash_dedup


def test_stages_keep_columns(spark, corners, corner_dir, empty, empty_dir):
    for docs, d in ((corners, corner_dir), (empty, empty_dir)):
        for name, stage in P.STAGES:
            out = stage(spark, docs, d)
            if name != "packing":
                assert out.columns == docs.columns
                assert [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
            out.collect()


def test_run(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    ids = {r[0] for r in docs.select("doc_id").collect()}
    clean = P.drop_toxic(spark, docs, d)
    assert 0.8 * len(ids) < clean.count() <= len(ids)
    lines = P.drop_lines(spark, clean, d)
    assert lines.count() == clean.count()
    kept = P.drop_near_duplicates(spark, lines, d)
    again = simhash_dedup.near_duplicates(kept)
    assert again.select("component_id").distinct().count() == kept.count() == kept.select("doc_id").distinct().count()
    mixed = P.mix_sources(spark, kept, d)
    assert set(r[0] for r in mixed.select("doc_id").collect()) <= {r[0] for r in kept.select("doc_id").collect()}
    assert P.run(spark, d).count() > 0
