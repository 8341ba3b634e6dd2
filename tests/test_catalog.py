from pyspark.sql import functions as F

from hopmill.operators import catalog


def test_owners_in_turn_with_a_null_family(spark):
    rows = [(None if f == 3 else f, k) for f in range(600) for k in range(f % 4)]
    got = catalog.assign_owners(spark.createDataFrame(rows, "f long, k long").repartition(3), "f", "k", ("A", "B", "C")).collect()
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    assert {(r.f, r.k): r.owner for r in got} == {r: "ABC"[i % 3] for i, r in enumerate(order)} and len(got) == len(rows)
    assert catalog.assign_owners(spark.createDataFrame([], "f long, k long"), "f", "k").count() == 0


def test_sibling_counts_are_those_of_pairs(spark):
    rows = [(i % 40 if i % 9 else None, i % 2, [None, "m", "n"][i % 3]) for i in range(80)]
    df = spark.createDataFrame(rows, "key long, cohort long, mother string")
    want = {r.key: r.n for r in catalog.siblings(df).groupBy("key").agg(F.count("*").alias("n")).collect()}
    assert {r.key: r.siblings for r in catalog.sibling_counts(df).collect()} == want and want


def test_questions_without_an_answer_do_not_parse(spark):
    questions = spark.createDataFrame([("a",), ("b",), ("c",)], "key string")
    answers = spark.createDataFrame([("a", "m", '{"x": NaN}'), ("b", "m", None)], "key string, model string, raw_response string")
    got = catalog.attach_answers(questions, answers).select("key", "model", "parses").collect()
    assert sorted(map(tuple, got), key=str) == [("a", "m", True), ("b", "m", False), ("c", None, False)]
