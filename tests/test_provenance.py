"""Deletion families: eight conditions of one family, and families that break each rule."""

from hopmill.operators import provenance as P
from pyspark.sql import functions as F

PACKET = "family_id string, base_unit_ids array<string>, distractor_ids array<string>, irrelevant_ids array<string>, deletions array<struct<condition string, unit_id string, quote string>>, start_names array<string>, not_applicable array<struct<condition string, reason string>>, residual array<string>"
TEXTS = {"u1": "Ann bore Bob. Mud.", "u2": "Bob bore Cy.", "u3": "Again: Ann bore Bob.", "u4": "Dee bore Cy. Ann bore Dee.", "d": "Ann saw Eve.", "i": "Rain."}
EVIDENCE = [("ab", 1, "u1", "Ann bore Bob."), ("ab", 2, "u3", "Ann bore Bob."), ("bc", 1, "u2", "Bob bore Cy."), ("ad", 1, "u4", "Ann bore Dee."), ("dc", 1, "u4", "Dee bore Cy.")]
NAMES = [(c, u, "Ann") for c, u in ((P.ABSENT, "u1"), (P.ABSENT, "u3"), (P.ABSENT, "u4"))]
CUTS = [(P.NECESSARY, "u2", "Bob bore Cy."), (P.NECESSARY, "u4", "Dee bore Cy."), ("irrelevant_deleted", "u1", " Mud."), *NAMES, (P.REDUNDANT, "u3", "Ann bore Bob."), (P.ALTERNATIVE, "u4", "Dee bore Cy.")]
GOOD = {"base": ["u1", "u2", "u3", "u4"], "d": ["d"], "i": ["i"], "cuts": CUTS, "names": ["Ann", "Annie"], "why": [], "residual": []}


def flow(spark, families):
    rows = [(k, f["base"], f["d"], f["i"], f["cuts"], f["names"], f["why"], f["residual"]) for k, f in families.items()]
    packets = spark.createDataFrame(rows, PACKET)
    units = spark.createDataFrame([(k, u, t) for k in families for u, t in TEXTS.items()], "family_id string, unit_id string, text string")
    evidence = spark.createDataFrame([(k, *e) for k in families for e in EVIDENCE], "family_id string, fact_id string, group_no int, unit_id string, quote string")
    proofs = spark.createDataFrame([(k, "cy", p) for k in families for p in (["ab", "bc"], ["ad", "dc"])], "family_id string, answer string, facts array<string>")
    contexts, log, bad = P.family_contexts(packets, units)
    solved = P.solved_families(proofs, *P.support_bits(evidence, contexts))
    found = {(r.family_id, r.condition, r.check) for r in P.family_violations(packets, solved, contexts).collect()}
    return {(r.family_id, r.condition): r for r in solved.collect()}, found, log, bad, proofs


def test_eight_conditions(spark):
    solved, found, log, bad, proofs = flow(spark, {"f": GOOD})
    assert bad.count() == 0 and log.count() == len(CUTS)
    both = ["ab>bc", "ad>dc"]
    want = {"base": both, "main_distractor": both, "irrelevant_addition": both, P.NECESSARY: [], "irrelevant_deleted": both, P.ABSENT: [], P.REDUNDANT: both, P.ALTERNATIVE: ["ab>bc"]}
    assert {c: r.proofs for (_, c), r in solved.items()} == want
    assert {c: r.status for (_, c), r in solved.items()} == {c: "answerable" if p else "insufficient_evidence" for c, p in want.items()}
    assert solved["f", "base"].support == {"ab": 2, "bc": 1, "ad": 1, "dc": 1} and solved["f", P.REDUNDANT].support["ab"] == 1
    assert found == set()
    assert P.necessary_facts(proofs).count() == 0
    assert [r.fact_id for r in P.necessary_facts(proofs.where("array_contains(facts, 'ab')")).orderBy("fact_id").collect()] == ["ab", "bc"]


def test_rules(spark):
    without = lambda *c: [d for d in CUTS if d[0] not in c]
    families = {
        "good": GOOD,
        "left": GOOD | {"cuts": [d for d in CUTS if d != (P.NECESSARY, "u4", "Dee bore Cy.")]},
        "residual": GOOD | {"cuts": [d for d in CUTS if d != (P.NECESSARY, "u4", "Dee bore Cy.")], "residual": [P.NECESSARY]},
        "lost": GOOD | {"cuts": [*without("irrelevant_deleted"), ("irrelevant_deleted", "u2", "Bob bore Cy.")]},
        "one": GOOD | {"cuts": [*without(P.REDUNDANT, P.ALTERNATIVE), (P.REDUNDANT, "u1", " Mud."), (P.ALTERNATIVE, "u1", " Mud.")]},
        "named": GOOD | {"names": ["Zed", "Bob"]},
        "none": GOOD | {"cuts": without(P.ABSENT)},
        "twice": GOOD | {"why": [(P.ABSENT, "so")], "d": ["i", "u1"]},
        "empty": GOOD | {"base": ["u1"], "cuts": [], "why": [(c, "so") for c in P.OPTIONAL]},
    }
    _, found, _, _, _ = flow(spark, families)
    of = lambda k: {(c, v) for f, c, v in found if f == k}
    assert of("good") == of("residual") == set()
    assert of("left") == {(P.NECESSARY, "proof_left")}
    assert of("lost") == {("irrelevant_deleted", "base_proof_lost")}
    assert of("one") == {(P.REDUNDANT, "support_not_reduced"), (P.ALTERNATIVE, "no_proof_removed")}
    assert of("named") == {("base", "start_not_named"), (P.NECESSARY, "name_lost"), (P.ABSENT, "name_left")}
    assert of("none") == {(P.ABSENT, "no_reason")}
    assert of("twice") == {(P.ABSENT, "applicable_and_not"), ("main_distractor", "additions_overlap"), ("main_distractor", "addition_in_base")}
    assert ("base", "base_not_answerable") in of("empty") and ("main_distractor", "answer_changed") in of("empty")


def test_bits(spark):
    r = spark.range(1).select(P.bits(F.array(*map(F.lit, (0, 5, 63, 64, 130))), F.lit(3)).alias("b"), P.bits(F.array(F.lit(63), F.lit(130), F.lit(1)), F.lit(3)).alias("c")).select("b", P.shared_bits(F.col("b"), F.col("c")).alias("n")).first()
    assert [x % 2**64 for x in r.b] == [1 + 2**5 + 2**63, 1, 4] and r.n == 2


def test_tables_dealt_by_family_are_not_shuffled_again(spark):
    packets = spark.createDataFrame([("f", GOOD["base"], GOOD["d"], GOOD["i"], GOOD["cuts"], GOOD["names"], GOOD["why"], GOOD["residual"])], PACKET).repartition("family_id")
    units = spark.createDataFrame([("f", u, t) for u, t in TEXTS.items()], "family_id string, unit_id string, text string").repartition("family_id")
    evidence = spark.createDataFrame([("f", *e) for e in EVIDENCE], "family_id string, fact_id string, group_no int, unit_id string, quote string").repartition("family_id")
    proofs = spark.createDataFrame([("f", "cy", p) for p in (["ab", "bc"], ["ad", "dc"])], "family_id string, answer string, facts array<string>").repartition("family_id")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        contexts, _, _ = P.family_contexts(packets, units)
        solved = P.solved_families(proofs, *P.support_bits(evidence, contexts))
        for df in (solved, P.family_violations(packets, solved, contexts)):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "REPARTITION_BY_COL" in plan and "ENSURE_REQUIREMENTS" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_contexts_are_those_of_deleted_quotes(spark):
    from hopmill.operators.text import delete_quotes

    texts = {"a": "Ann met Bob. Ann left.", "b": "Ann", "c": "", "d": None, "e": "x x"}
    quotes = [("a", "Bob"), ("a", "Ann"), ("a", "Ann met"), ("b", "Ann"), ("c", "y"), ("d", "y"), ("e", "x x"), ("e", None), ("gone", "y")]
    for k in range(1, len(quotes) + 1):
        cut = [(P.NECESSARY, *q) for q in quotes[:k]]
        packets = spark.createDataFrame([("f", list(texts), [], [], cut, [], [], [])], PACKET)
        contexts, _, _ = P.family_contexts(packets, spark.createDataFrame([("f", *t) for t in texts.items()], "family_id string, unit_id string, text string"))
        rows = spark.createDataFrame([("f", P.NECESSARY, *t) for t in texts.items()], "family_id string, condition string, unit_id string, text string")
        want, _, _ = delete_quotes(rows, spark.createDataFrame([("f", *c) for c in cut], "family_id string, condition string, unit_id string, quote string"), ["family_id", "condition", "unit_id"])
        got = contexts.where(F.col("condition") == P.NECESSARY)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.select(got.columns).collect()))
