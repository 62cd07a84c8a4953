"""What a task or the driver holds at most: learned languages, decoded files."""

import numpy as np
from pyspark.sql import functions as F

from vigilmill.llm import language_id, tiff


def test_many_languages_are_bounded(spark):
    """Ten thousand values of lang: the most frequent are learned, the sample keeps to its total, copies count once."""
    docs = spark.range(30_000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "en").when(F.col("id") % 3 == 1, "de").otherwise(F.concat(F.lit("junk"), F.col("id") % 10_000)).alias("lang"),
        F.when(F.col("id") % 3 == 0, F.concat(F.lit("the of and to "), F.col("id"))).when(F.col("id") % 3 == 1, F.lit("der die und ist ein")).otherwise("xx yy").alias("text"),
    )
    net = language_id.fit(docs, F.lit(True), sample_rows=40, languages=5, sample_total=100)
    assert {"en", "de"} <= set(net.languages) and len(net.languages) == 5
    found = language_id.predict(spark.createDataFrame([(1, "and of the to to")], "doc_id bigint, text string"), net).first()
    assert found["lang_pred"] == "en"


def test_decoded_files_are_passed_on(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "x" * (i * 100)) for i in range(40)], "doc_id bigint, text string").coalesce(1)
    media = tiff.encode_texts(docs)
    whole = tiff.decode_pages(media).select("doc_id", F.size("pages").alias("n")).collect()
    monkeypatch.setattr(tiff, "DECODED_BYTES", 1)
    assert tiff.decode_pages(media).select("doc_id", F.size("pages").alias("n")).collect() == whole and np.all([r["n"] > 0 for r in whole])
