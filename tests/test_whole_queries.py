"""Whole forms return rows beyond the caps and subsets of the registered queries."""

import pytest

from vigilmill import plans

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("whole, capped", [("all_approvals_with_request", "approvals_with_request"), ("all_versions_in_order", "version_order"), ("full_newest_bounded_set", "newest_bounded_set")])
def test_more_rows(spark, whole, capped):
    assert plans.QUERIES[whole](spark, SF).count() > plans.QUERIES[capped](spark, SF).count()


def test_every_injection_vector_is_judged(spark, tmp_path):
    rows = [(i, [1.0, i / 1000], 0) for i in range(1, 200)] + [(500, [1.0, 0.05], 3), (777, [-1.0, 2.0], 0)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert [r[0] for r in plans.QUERIES["kept_injection_vectors"](spark, str(tmp_path)).collect()] == [777]


def test_text_under_limit_is_whole(spark, tmp_path):
    texts = [(1, "a" * 15_000 + "b" * 4_000), (2, "c" * 20_001)]
    spark.createDataFrame(texts, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    seen = {r[0]: r[1] for r in plans.QUERIES["full_head_tail_window"](spark, str(tmp_path)).collect()}
    assert seen[1] == texts[0][1] and len(seen[2]) == 20_001 and "\n" in seen[2]


def test_source_quota(spark, tmp_path):
    spark.createDataFrame([(i, "s", i) for i in range(250)], "doc_id bigint, source string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    assert plans.QUERIES["full_source_quota_keep"](spark, str(tmp_path)).count() == 200
