import random

import pytest
from pyspark.sql import functions as F

from hopmill.operators.ranks import page, pages_from, positions

ROWS = [(None if i % 11 == 0 else 7 if i % 3 else i % 40, i) for i in range(700)]  # a hot key and a null one


def _key(r):
    return (r[0] is not None, r[0] or 0, r[1])


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(random.Random(3).sample(ROWS, len(ROWS)), "a long, b long").repartition(5).cache()


@pytest.mark.parametrize("range_rows", [20, 300, 1000])
@pytest.mark.parametrize("number", [0, 1, 2, 30, 58, 59, 1000])
def test_pages_are_slices_of_the_order(df, number, range_rows):
    at = max(1, min(number, -(-len(ROWS) // 12)))
    want = [(i + 1, *r) for i, r in enumerate(sorted(ROWS, key=_key))][(at - 1) * 12 : at * 12]
    got = page(df, [F.col("a"), F.col("b")], number, range_rows=range_rows).select("position", "a", "b").collect()
    assert sorted(map(tuple, got)) == want


def test_pages_of_ties_and_of_nothing(spark, df):
    same = spark.range(50).select(F.lit("x").alias("a"), "id")
    got = page(same, [F.col("a")], 3, range_rows=5).collect()
    assert sorted(r.position for r in got) == list(range(25, 37))
    assert page(df.where("false"), [F.col("a")], 2).count() == 0


def test_positions_split_a_hot_key(spark, df):
    got = positions(df, [F.col("a").asc_nulls_last(), F.col("b").desc()], "at", range_rows=50)
    order = sorted(ROWS, key=lambda r: (r[0] is None, r[0] or 0, -r[1]))
    assert {(r.a, r.b): r["at"] for r in got.collect()} == {r: i for i, r in enumerate(order)}
    same = positions(spark.range(40).select(F.lit(1).alias("a")), [F.col("a")], range_rows=3)
    assert sorted(r.position for r in same.collect()) == list(range(40))
    assert positions(df.where("false"), [F.col("a")]).count() == 0


@pytest.mark.parametrize("range_rows", [20, 300, 1000])
@pytest.mark.parametrize("number", [0, 2, 30, 59, 1000])
def test_pages_from_one_on_are_the_rest_of_the_order(df, number, range_rows):
    at = max(1, min(number, -(-len(ROWS) // 12)))
    want = [(i + 1, *r) for i, r in enumerate(sorted(ROWS, key=_key))][(at - 1) * 12 :]
    got = pages_from(df, [F.col("a"), F.col("b")], number, range_rows=range_rows).select("position", "a", "b").collect()
    assert sorted(map(tuple, got)) == want


def test_a_deep_page_of_more_rows_than_it_has_pages_for(spark, tmp_path):
    from hopmill.plans.integrity_queries import c09_deep

    rows = spark.range(1_200_030).select(F.col("id").alias("o_orderkey"), F.lit("O").alias("o_orderstatus"), F.lit(1).cast("long").alias("o_custkey"))
    rows.write.parquet(f"{tmp_path}/orders.parquet")
    got = c09_deep(spark, str(tmp_path)).select("position", "o_orderkey").collect()
    assert sorted(map(tuple, got)) == [(i + 1, i) for i in range(1_199_988, 1_200_030)]
