from pyspark.sql import functions as F

from hopmill.operators import families as V

VARIANTS = "family_id string, variant_index int, fact_ids array<string>, unit_ids array<string>, answers array<string>, status string"


def test_records_and_their_changes(spark):
    rows = [
        ("f", 0, ["a", "b"], ["u", "w"], ["x"], "answerable"), ("f", 1, ["b", "c"], ["u", "w"], ["x"], "answerable"), ("f", 2, None, None, None, None),
        ("g", 1, ["a"], [], ["y"], "answerable"), ("h", 0, ["a"], None, [], None), ("h", 1, ["a"], ["u"], None, None),
    ]
    df = spark.createDataFrame(rows, VARIANTS)
    got = {r.record_id: (r.control_id, r.challenge_id, r.added, r.removed, r.answers_changed, r.status_changed) for r in V.variant_records(df).collect()}
    f, g, h = (tuple(f"{n}-0{i}" for i in (0, 1)) for n in "fgh")
    assert got == {
        "f-00": (*f, None, None, None, None), "f-01": (*f, ["c"], ["a"], False, False), "f-02": (*f, [], ["a", "b"], True, True),
        "g-01": (*g, None, None, None, None), "h-00": (*h, None, None, None, None), "h-01": (*h, [], [], False, False),
    }
    supports = spark.createDataFrame([("f", "a", "u"), ("f", "b", "w"), ("f", "b", "u"), ("f", "b", "u"), ("f", "c", "gone"), ("g", "a", "u"), ("h", "a", None)], "family_id string, fact_id string, unit_id string")
    docs = {(r.family_id, r.variant_index, r.fact_id): (r.document, r.documents) for r in V.fact_documents(df, supports).collect()}
    assert docs == {("f", 0, "a"): ("u", ["u"]), ("f", 0, "b"): ("u", ["u", "w"]), ("f", 1, "b"): ("u", ["u", "w"]), ("f", 1, "c"): (None, []), ("g", 1, "a"): (None, []), ("h", 0, "a"): (None, []), ("h", 1, "a"): (None, [])}
    assert V.variant_records(df.limit(0)).count() == V.fact_documents(df.limit(0), supports).count() == 0


def test_kinds_of_corruptions_go_by_index(spark):
    fam = spark.createDataFrame([(f"f{i}", "a", "answerable", ["1", "2"], 1, i) for i in range(10)], "family_id string, answer string, status string, proof array<string>, deletions int, index long")
    kinds = {r["index"]: r.category for r in V.corruptions(fam, index=F.col("index")).where("copy = 'bad'").collect()}
    assert kinds == {i: ("wrong_answer", "wrong_status", "reversed_proof", "fake_deletion")[i % 4] for i in range(10)}


def test_variants_dealt_by_family_are_not_shuffled_again(spark):
    df = spark.createDataFrame([("f", 0, ["a"], ["u"], ["x"], "answerable")], VARIANTS).repartition("family_id")
    supports = spark.createDataFrame([("f", "a", "u")], "family_id string, fact_id string, unit_id string").repartition("family_id")
    packets = spark.createDataFrame([("f", ["u"], [], ["w"], [])], "family_id string, base_unit_ids array<string>, distractor_ids array<string>, irrelevant_ids array<string>, deletions array<struct<condition string, unit_id string, quote string>>").repartition("family_id")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        rows, _ = V.expand_conditions(packets, supports.select("family_id", "unit_id").repartition("family_id"))
        for out in (rows, V.fact_documents(df, supports), V.variant_records(df)):
            plan = out._jdf.queryExecution().executedPlan().toString()
            assert "REPARTITION_BY_COL" in plan and "ENSURE_REQUIREMENTS" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
