from hopmill.operators import reviews as R

C = "struct<context_id string, quote string>"
REVIEW = f"review_id string, owner_id string, verdict string, flags array<boolean>, findings array<string>, two_hop_verdict string, two_hop_evidence array<{C}>, step_reviews array<struct<step int, supported boolean, evidence array<{C}>>>, candidate_status string, n_steps int, structural_valid boolean, review_required boolean"


def test_review_gate(spark):
    ctx = spark.createDataFrame([("o", "c", "the river is long")], "owner_id string, context_id string, text string")
    ok = [(0, True, [("c", "river")]), (1, True, [("c", "long")])]
    rows = [
        ("good", "o", "pass", [True, True], [], "necessary", [], ok, "answerable", 2, True, False),
        ("lost", "o", "revise", [], [], None, [("c", "sea")], [], "answerable", 2, True, False),
        ("flags", "o", "pass", [True, None], ["major"], "shortcut", [], ok[:1], "answerable", None, True, False),
        ("bare", "o", "pass", [True], [], "necessary", None, [(0, True, []), (1, False, [("c", "long")])], "ambiguous", 2, True, True),
        ("none", "o", "pass", [True], [], "necessary", [], [], "insufficient_evidence", 2, False, False),
    ]
    got = {r.review_id: (set(r.errors), r.disposition) for r in R.review_gate(spark.createDataFrame(rows, REVIEW), ctx).collect()}
    assert got == {
        "good": (set(), "pass"),
        "lost": ({"review_evidence_not_in_current_member"}, "needs_adjudication"),
        "flags": ({"pass_contradicts_support_flags", "pass_contradicts_findings", "pass_without_two_hop_necessity", "step_review_coverage", "shortcut_claim_without_location"}, "needs_adjudication"),
        "bare": ({"step_review_missing_support"}, "needs_adjudication"),
        "none": ({"insufficient_claim_necessity_not_applicable"}, "needs_revision_structural"),
    }


def test_answer_checks(spark):
    step = f"struct<from_name string, relation string, to_name string, evidence array<{C}>>"
    sub = spark.createDataFrame([
        ("i1", "o", "answerable", ["Cy"], [("Al", "father", "Bo", [("c", "Bo, Al's")]), ("Bo", "mother", "Cyn", [("c", "Cyn")])], []),
        ("i2", "o", "answerable", ["Cyn"], [("Al", "mother", "Bo", [("c", "nowhere")]), ("Bo", "mother", "Cyn", [])], []),
        ("i3", "o", "insufficient_evidence", [], [], []),
    ], f"item_id string, owner_id string, status string, answers array<string>, steps array<{step}>, evidence array<{C}>")
    gold = spark.createDataFrame([("i1", "answerable", ["3"]), ("i2", "answerable", ["3"]), ("i3", "insufficient_evidence", [])], "item_id string, status string, answer_ids array<string>")
    proofs = spark.createDataFrame([(i, 1, ["1", "2", "3"], ["father", "mother"], ["f1", "f2"]) for i in ("i1", "i2")], "item_id string, proof_no int, entities array<string>, relations array<string>, facts array<string>")
    names = spark.createDataFrame([("o", "1", "Al"), ("o", "2", "Bo"), ("o", "3", "Cyn"), ("o", "3", "Cy")], "owner_id string, entity_id string, surface string")
    ctx = spark.createDataFrame([("o", "c", "Bo, Al's father. Cyn, Bo's mother.")], "owner_id string, context_id string, text string")
    refs = spark.createDataFrame([("o", "f1", 1, 1, "c", "Al's father"), ("o", "f2", 1, 1, "c", "Cyn, Bo's mother")], "owner_id string, fact_id string, group_no int, cite_no int, context_id string, quote string")
    got = {r.item_id: r for r in R.answer_checks(sub, gold, proofs, names, ctx, refs).collect()}
    assert got["i1"].strict and got["i3"].strict
    assert (got["i2"].answer_correct, got["i2"].path_correct, got["i2"].quotes_located, got["i2"].strict) == (True, False, False, False)
    shapes = spark.createDataFrame([("i1", "correct"), ("i2", "needs_semantic_review")], "item_id string, shape string")
    a = {r.item_id: r.provisional for r in R.assessment(R.answer_checks(sub, gold, proofs, names, ctx, refs), shapes).collect()}
    assert a == {"i1": "structurally_correct", "i2": "needs_semantic_review", "i3": "needs_semantic_review"}


def test_step_reviews_registrations_and_lists(spark):
    steps = spark.createDataFrame([("i", "s1", ["a"]), ("i", "s2", ["b"])], "item_id string, step_id string, submitted array<string>")
    rev = spark.createDataFrame([("i", "s1", "supported", ["b"]), ("i", "s3", "supported", None)], "item_id string, step_id string, support string, used array<string>")
    assert {(r.step_id, r.check) for r in R.step_review_violations(rev, steps).collect()} == {("s2", "missing"), ("s3", "unexpected"), ("s1", "borrowed_citation")}
    cite = "array<array<struct<context_id string, start int, `end` int, quote string>>>"
    a, b = ("c", 0, 2, "ab"), ("c", 1, 3, "bc")
    facts = spark.createDataFrame([("r", "f1", "support_proposed", [[a, b], [b, a]]), ("r", "f2", "unresolved", [[a, a]]), ("r", "f3", "support_proposed", [[("c", 0, 9, "x")], []])], f"request_id string, fact_id string, status string, groups {cite}")
    req = spark.createDataFrame([("r", f) for f in ("f1", "f2", "f3", "f4")], "request_id string, fact_id string")
    ctx = spark.createDataFrame([("r", "c", "abc")], "request_id string, context_id string, text string")
    assert {(r.fact_id, r.check) for r in R.registration_violations(facts, req, ctx).collect()} == {("f4", "missing"), ("f1", "repeated_group"), ("f2", "groups_and_status"), ("f2", "repeated_citation"), ("f3", "empty_group"), ("f3", "citation")}
    lists = spark.createDataFrame([("r1", "pass", [("x", True), ("x", False)], [], []), ("r2", "pass", [("x", True), ("y", True)], [], [])], "review_id string, verdict string, checks array<struct<name string, passed boolean>>, issues array<string>, required_changes array<string>")
    assert {(r.review_id, r.check) for r in R.checklist_violations(lists, ["x", "y"]).collect()} == {("r1", "repeated_check"), ("r1", "omitted_check"), ("r1", "pass_with_defects")}


def test_strata_and_findings(spark):
    rows = spark.createDataFrame([(c, 1, a, "completed", d, True) for c in ("c1", "c2") for a, d in (("x", False), ("y", True))], "case_id string, repeat int, arm string, status string, decision boolean, expected boolean")
    strata = spark.createDataFrame([("c1", "proof_hint")], "case_id string, stratum string")
    assert {(r.stratum, r.corrections) for r in R.pairs_by_stratum(rows, strata, ["case_id", "repeat"], [], "x", "y").collect()} == {("proof_hint", 1), ("no_hint", 1)}
    q = spark.createDataFrame([("q1", "o", "a"), ("q2", "o", "a")], "query_id string, owner_id string, start string")
    s = spark.createDataFrame([("q1", 1, "father", "s"), ("q2", 1, "father", "s")], "query_id string, hop int, role string, scope string")
    e = spark.createDataFrame([("o", "f", "a", "b", "father", "s")], "owner_id string, fact_id string, child string, parent string, parent_role string, scope string")
    v = spark.createDataFrame([("q1", "a", "supported"), ("q2", "a", "undetermined")], "query_id string, child string, verdict string")
    assert {r.query_id: (r.status, r.answers) for r in R.reviewed_findings(q, s, e, v, 1).collect()} == {"q1": ("answerable", ["b"]), "q2": ("undetermined", ["b"])}


def test_answers_of_orders_are_dealt_by_order_alone(spark, monkeypatch):
    import re

    from hopmill.plans import review_queries
    from hopmill.sources import shared

    plans, written, key = [], shared.written, "spark.sql.requireAllClusterKeysForCoPartition"
    monkeypatch.setattr(shared, "written", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or written(df, name))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), spark.conf.get(key)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert review_queries.x19_answers(spark, "/root/testdata/sf0.001").count() > 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before[0])
    dealt = re.findall(r"hashpartitioning\((.*?), \d+\), ENSURE_REQUIREMENTS", plans[-1])
    assert dealt and {k.split("#")[0] for k in dealt} <= {"owner_id", "o_orderkey", "_groupingexpression", "item_id", "l_orderkey"} and not any("," in k for k in dealt)
    assert spark.conf.get(key) == before[1]


def test_assessment_reads_written_answers(spark, monkeypatch):
    from hopmill.plans import review_queries

    names, written = [], review_queries.written_as_dealt
    monkeypatch.setattr(review_queries, "written_as_dealt", lambda df, name: names.append((name, df.columns)) or written(df, name))
    assert review_queries.x20_assessment(spark, "/root/testdata/sf0.001").count() > 0
    assert names == [("answers", ["item_id", "answer_correct", "path_correct", "quotes_located", "reference_covered", "strict"])]
