"""Lines that differ in digits: proposed by their normal form, removed only if their edit similarity with digits allows it."""

import random

from vigilmill.llm import line_dedup


def test_data_rows_stay(spark):
    r = random.Random(13)
    rows = ["Order 4821 total 1204", "Order 9377 total 8319", "order 4821, total: 1204!", *{f"{r.randrange(10**6):06d} {r.randrange(10**6):06d}" for _ in range(30)}]
    rows += ["a long line of words that ends with one number in year 2023", "a long line of words that ends with one number in year 2024"]
    forms = [line_dedup.plain_lines(x)[0].decode() for x in rows]
    wanted = {j for j in range(len(rows)) if any(line_dedup.similar(forms[i], forms[j], 0.9) for i in range(j))}
    got = {x["doc_id"] for x in line_dedup.repeated_lines(spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")).collect()}
    assert got == wanted and 1 not in got and {2, len(rows) - 1} <= got
