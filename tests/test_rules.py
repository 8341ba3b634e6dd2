from hopmill.operators import families as V


def _records(spark, rows):
    return spark.createDataFrame(rows, "family_id string, combination_id string, variant string, values map<string,string>")


def test_rules_of_a_combination(spark):
    rules = (("", "none", "status", "is", "", "no"), ("C1 C2", "control", "answers", "equal", "challenge", "answers"), ("C2", "a", "documents", "equal", "challenge", "reversed"), ("C3", "control", "answers", "differs", "challenge", "answers"))
    rows = [
        ("f", "C1", "none", {"status": "no"}), ("f", "C1", "control", {"answers": "x"}), ("f", "C1", "challenge", {"answers": "x"}),
        ("g", "C2", "none", {"status": "yes"}), ("g", "C2", "control", {"answers": "x"}), ("g", "C2", "challenge", {"answers": "y", "reversed": "ba"}), ("g", "C2", "a", {"documents": "ba"}),
        ("h", "C3", "control", {"answers": "x"}), ("i", "C3", "none", {}), ("i", "C3", "control", {"answers": "x"}), ("i", "C3", "challenge", {"answers": "x"}), ("i", "C3", "challenge", {"answers": "y"}),
        ("j", None, "none", {"status": "no"}),
    ]
    got = V.rule_violations(_records(spark, rows), rules)
    assert sorted(map(tuple, got.collect())) == [("g", 1, "relation"), ("g", 2, "relation"), ("h", 1, "missing"), ("h", 4, "missing_other"), ("i", 1, "relation"), ("i", 4, "relation")]
    assert V.rule_violations(_records(spark, []), rules).count() == 0


def test_rules_of_the_library(spark):
    v = {"answers": "x", "documents": "ab", "reversed_documents": "ba", "status": "answerable", "proofs": "2"}
    rows = [("f", "C04", n, v | more) for n, more in (("no_context", {"status": "insufficient"}), ("anonymous_challenge", {}), ("unfamiliar_challenge", {}), ("control", {}), ("challenge", {}), ("delete_one_support", {"proofs": "1"}), ("delete_all_bridge_supports", {"status": "insufficient"}), ("delete_irrelevant", {"answers": "z"}))]
    got = V.rule_violations(_records(spark, rows)).collect()
    assert [(V.FAMILY_RULES[r.rule - 1][1], r.check) for r in got] == [("delete_irrelevant", "relation")]


def test_uncovered_scenes(spark):
    plans = spark.createDataFrame([("C1", ["a", "b", "b"]), ("C2", ["a"]), ("C3", None)], "c string, planned array<string>")
    records = spark.createDataFrame([("C1", ["a", None]), ("C2", None)], "c string, scenes array<string>")
    assert sorted(map(tuple, V.uncovered(records, plans, "c", "planned", "scenes").collect())) == [("C1", "b"), ("C2", "a")]
