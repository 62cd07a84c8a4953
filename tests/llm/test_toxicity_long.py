"""Long texts full of exception phrases, and clashing column names."""

import time

from vigilmill.llm import toxicity


def test_many_exceptions_are_linear():
    model = toxicity.Model(((" trash ", 2.0), (" idiot ", 3.0)))
    automaton = toxicity.matcher(model)
    took = []
    for n in (20_000, 200_000):
        began = time.process_time()
        folded = toxicity.fold("trash can idiot " * n)
        strength, matched = toxicity.strength(folded, automaton)
        took.append(time.process_time() - began)
        assert matched == n and strength > 0
    assert took[1] < 40 * max(took[0], 0.02)


def test_overlapping_exceptions():
    model = toxicity.Model(((" a ", 1.0), (" b ", 1.0), (" c ", 1.0), (" d ", 1.0)), exceptions=(" a b c ", " c ", " b "))
    assert toxicity.strength(" a b c d a ", toxicity.matcher(model))[1] == 2
    assert toxicity.strength(" d a b d ", toxicity.matcher(model))[1] == 3


def test_columns_of_the_same_names_are_replaced(spark):
    docs = spark.createDataFrame([(1, "idiot", "x", 5)], "doc_id int, text string, __SCORE string, __matches int")
    found = toxicity.score_documents(docs, toxicity.seed_model())
    assert found.columns == ["doc_id", "text", "__score", "__matches"] and found.first()["__matches"] == 1
