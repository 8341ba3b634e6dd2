"""Operators that no query calls, on fixtures."""

from hopmill.operators import catalog, families, metrics, text


def test_shortcut_candidates(spark):
    contexts = spark.createDataFrame([("q", "c1", "贾政的父亲是谁。无关的句子。"), ("q", "c2", "贾政离开了很久很久以后才见父亲。"), ("other", "c3", "贾政的父亲。")], "owner_id string, context_id string, text string")
    starts = spark.createDataFrame([("q", "q1", "贾政", "r")], "owner_id string, query_id string, start_name string, roles string")
    terms = spark.createDataFrame([("r", "父亲"), ("s", "母亲")], "roles string, term string")
    got = text.shortcut_candidates(contexts, starts, terms).collect()
    assert [(r.owner_id, r.context_id, r.query_id, r.term) for r in got] == [("q", "c1", "q1", "父亲")]
    assert "贾政的父亲" in got[0].sentence and "无关" not in got[0].sentence


def test_attach_grades(spark):
    dims = list(metrics.DIMENSIONS)
    slots = spark.createDataFrame([("a",), ("b",), ("c",)], "trial_id string")
    grades = spark.createDataFrame([("a", *["P"] * len(dims)), ("b", *[None] * len(dims)), ("x", *["F"] * len(dims))], "trial_id string, " + ", ".join(f"{d} string" for d in dims))
    got = {r.trial_id: [r[d] for d in dims] for r in metrics.attach_grades(slots, grades).collect()}
    assert got == {"a": ["P"] * len(dims), "b": ["U"] * len(dims), "c": ["U"] * len(dims)}


def test_flatten_proofs(spark):
    paths = spark.createDataFrame([("q", 1, ["e0", "e1", "e2"], ["7", "9"])], "query_id string, path_no int, entities array<string>, facts array<string>")
    facts = spark.createDataFrame([(7, "father", "d1")], "fact_id long, parent_role string, document_id string")
    got = sorted(((r.node_id, r.dependency, r.fact_id, r.relation, r.value, r.document_id) for r in families.flatten_proofs(paths, facts).collect()), key=lambda r: r[0])
    assert got == [("n1", None, "7", "father", "e1", "d1"), ("n2", "n1", "9", None, "e2", None)]


def test_import_entries(spark):
    schema = "k string, value string"
    new, skipped = catalog.import_entries(spark.createDataFrame([("a", "1"), ("b", None), ("c", "3")], schema), spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "4"), ("d", "5")], schema), ["k"])
    assert [tuple(r) for r in new.collect()] == [("d", "5")]
    assert sorted(r.k for r in skipped.collect()) == ["b", "c"]
