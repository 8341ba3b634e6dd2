import math
import random
from fractions import Fraction
from itertools import combinations, product

import pytest
from pyspark.sql import functions as F

from hopmill.operators import accounting as X
from hopmill.operators import metrics as M


def test_estimates_match_subsets(spark):
    """Every n up to 8, c and k up to 5 against all subsets of trials."""
    cases = [(n, c, k) for n in range(1, 9) for c in range(n + 1) for k in range(1, 6)]
    df = spark.createDataFrame(cases, "n int, c int, k int")
    for k in range(1, 6):
        rows = df.where(F.col("k") == k).select("n", "c", *(M.lowest_terms(M.estimate(F.col("n"), F.col("c"), k, e)).alias(a) for e, a in ((False, "any"), (True, "all")))).collect()
        for r in rows:
            if r.n < k:
                assert r["any"] is None and r["all"] is None
                continue
            sets = list(combinations([i < r.c for i in range(r.n)], k))
            for name, of in (("any", any), ("all", all)):
                want = Fraction(sum(map(of, sets)), len(sets))
                assert (r[name].numerator, r[name].denominator) == (want.numerator, want.denominator)


def test_tri_state_patterns(spark):
    """Every pattern of three verdicts on five trials: the bounds are the least and greatest of all completions."""
    rows = [(f"{i}", v) for i, p in enumerate(product(("pass", "fail", "needs_review"), repeat=5)) for v in p]
    q = M.question_metrics(M.verdict_counts(spark.createDataFrame(rows, "case_id string, verdict string"), ["case_id"])).collect()
    for r in q:
        k, every = M.METRICS[r.metric]
        values = []
        for extra in range(r.unknown + 1):
            sets = list(combinations([i < r.passed + extra for i in range(5)], k))
            values.append(sum((all if every else any)(s) for s in sets) / len(sets))
        assert r.lower.value == pytest.approx(min(values)) and r.upper.value == pytest.approx(max(values))
        assert (r.point is None) == (r.unknown > 0)
        assert r.status == ("pending_outcomes" if r.unknown else "complete")


def test_point_stays_null_though_bounds_meet(spark):
    t = spark.createDataFrame([("a", v) for v in ("pass", "needs_review", "needs_review", "needs_review", None)], "case_id string, verdict string")
    r = {x.metric: x for x in M.question_metrics(M.verdict_counts(t, ["case_id"])).collect()}["pass@5"]
    assert r.lower.value == r.upper.value == 1 and r.point is None


def test_macro_means_never_drop_a_question(spark):
    t = spark.createDataFrame([("f", "a", "pass"), ("f", "b", "needs_review"), ("g", "c", "fail")], "family_id string, case_id string, verdict string")
    q = M.question_metrics(M.verdict_counts(t, ["family_id", "case_id"]))
    r = {x.metric: x for x in M.question_macro(q, []).collect()}
    assert (r["pass@1"].questions, r["pass@1"].complete, r["pass@1"].point, r["pass@1"].lower, r["pass@1"].complete_only) == (3, 2, None, pytest.approx(1 / 3), 0.5)
    assert r["pass@5"].lower is None and r["pass@5"].underbudget == 3
    f = {x.metric: x for x in M.family_macro(q, []).collect()}["pass@1"]
    assert (f.families, f.point, f.lower, f.upper) == (2, None, 0.25, 0.5)


def test_verdict_rules(spark):
    v = "struct<answer string, logical_proof string, output_contract string>"
    rows = [
        ("t1", "accepted", ["a", "b"], "a", True, "why", ("pass", "pass", "pass")),
        ("t2", "accepted", ["a"], "a", True, "why", ("fail", "pass", "fail")),
        ("t3", "accepted", ["a", "x"], "b", None, " ", ("pass", "fail", "pass")),
        ("t4", "pending", None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, f"trial_id string, status string, reviewers array<string>, approved_by string, independent_review boolean, rationale string, verdicts {v}")
    got = {(r.key, r.check) for r in M.verdict_violations(df, ["a", "b"], "a").collect()}
    assert got == {("t2", "proof_without_answer"), ("t2", "fewer_than_two_reviewers"), ("t3", "contract_without_proof"), ("t3", "unregistered_reviewer"), ("t3", "not_approved"), ("t3", "not_independent"), ("t3", "no_rationale")}


def test_parent_transitions(spark):
    rev = spark.createDataFrame([("r1", "p1", "P"), ("r2", "p9", "F")], "case_id string, parent string, label string")
    cur = spark.createDataFrame([("p1", "F")], "case_id string, label string")
    moved, lost = M.parent_transitions(rev, cur, "parent", "case_id")
    assert [(r.transition, r.pairs) for r in moved.collect()] == [("F->P", 1)] and [r.case_id for r in lost.collect()] == ["r2"]


def test_pairs_and_stability(spark):
    rows = [("c1", 1, a, "completed", d, True) for a, d in (("x", False), ("y", True))] + [("c1", 2, "x", "completed", True, True), ("c2", 1, "x", "completed", True, None), ("c2", 1, "y", "completed", True, None)]
    df = spark.createDataFrame(rows, "case_id string, repeat int, arm string, status string, decision boolean, expected boolean")
    r = X.paired_arms(df, ["case_id", "repeat"], [], "x", "y").first()
    assert (r.scheduled_pairs, r.corrections, r.introduced_errors, r.excluded_not_completed, r.excluded_unadjudicated) == (3, 1, 0, 1, 1)
    runs = spark.createDataFrame([("a", "completed", "pass")] * 3 + [("b", "completed", "pass")] * 2 + [("c", "completed", None)] * 3, "case_id string, status string, verdict string")
    s = {r.case_id: r for r in X.repeat_stability(runs, ["case_id"], ["pass"]).collect()}
    assert s["a"].all_same and s["a"].all_decisive and not s["b"].all_valid and s["c"].all_valid and not s["c"].all_decisive


def test_hint_stratum_and_empty_tables(spark):
    rows = [("a", "noise_fact", "warning", False), ("a", "base_proof", "matches", False), ("b", "base_proof", "warning", False), ("c", "noise_fact", "matches", False), ("d", "unassigned", "omissions", False), ("e", "noise_fact", "matches", False), ("e", "unassigned", "matches", False), ("f", "base_proof", "matches", True)]
    h = spark.createDataFrame(rows, "case_id string, relevance string, kind string, excluded boolean")
    cases = spark.createDataFrame([(c,) for c in "abcdefg"], "case_id string")
    other, none = "nonproof_or_unassigned_only", "empty_fact_hints"
    assert {r.case_id: r.stratum for r in X.hint_stratum(h, cases=cases).collect()} == {"a": "base_proof_related", "b": none, "c": "noise_only", "d": other, "e": other, "f": none, "g": none}
    facts = spark.createDataFrame([("a", 1), ("a", 2)], "case_id string, fact_id int")
    seen = X.hint_relevance(spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("a", None)], "case_id string, fact_id int"), facts.where("fact_id = 1"), facts)
    assert sorted((r.fact_id or 0, r.relevance) for r in seen.collect()) == [(0, "unassigned"), (1, "base_proof"), (2, "noise_fact"), (3, "unassigned")]
    empty = spark.createDataFrame([], "case_id string, verdict string")
    assert M.question_metrics(M.verdict_counts(empty, ["case_id"])).count() == 0


def test_estimates_of_many_trials(spark):
    r = spark.createDataFrame([(7000, 3), (1_000_000, 999_999)], "n long, c long").select(M.estimate(F.col("n"), F.col("c"), 5, False)["value"].alias("v"), M.lowest_terms(M.estimate(F.col("n"), F.col("c"), 5, False)).alias("f")).collect()
    for (n, c), x in zip(((7000, 3), (1_000_000, 999_999)), r, strict=True):
        want = 1 - Fraction(math.comb(n - c, 5), math.comb(n, 5))
        assert abs(x.v - float(want)) < 1e-12 and Fraction(int(x.f.numerator), int(x.f.denominator)) == want


def test_exact_means(spark):
    rng = random.Random(2)
    counts = [(f"f{rng.randrange(6)}", (n := rng.randint(5, 11)), (p := rng.randint(0, n)), rng.randint(0, n - p) if rng.random() < 0.5 else 0) for _ in range(80)] + [("big", 7000, 3, 0), ("big", 9001, 9000, 1)]
    df = spark.createDataFrame([(f, n, p, u) for f, n, p, u in counts], "family_id string, n long, passed long, unknown long")

    def value(n, c, k, every):
        return Fraction(math.comb(c, k), math.comb(n, k)) if every else 1 - Fraction(math.comb(n - c, k), math.comb(n, k))

    questions = {r.metric: r for r in M.exact_means(M.verdict_classes(df, []), []).collect()}
    families = {r.metric: r for r in M.exact_means(M.verdict_classes(df, ["family_id"]), [], "family_id").collect()}
    text = lambda x: (str(x.numerator), str(x.denominator), float(x))
    for name, (k, every) in M.METRICS.items():
        low = [(f, value(n, p, k, every)) for f, n, p, u in counts]
        high = [(f, value(n, p + u, k, every)) for f, n, p, u in counts]
        for side, each in (("lower", low), ("upper", high)):
            assert tuple(questions[name][side]) == text(sum(v for _, v in each) / len(each))
            names = {f for f, _ in each}
            means = [sum(v for g, v in each if g == f) / sum(g == f for g, _ in each) for f in names]
            assert tuple(families[name][side]) == text(sum(means) / len(means))
        assert questions[name].point is None and families[name].families == len({f for f, *_ in counts})
    done = M.exact_means(M.verdict_classes(df.where("unknown = 0"), []), []).where("metric = 'pass@1'").first()
    known = [value(n, p, 1, False) for _, n, p, u in counts if not u]
    assert tuple(done.point) == tuple(done.lower) == text(sum(known) / len(known))
    short = M.exact_means(M.verdict_classes(spark.createDataFrame([(4, 4, 0)], "n long, passed long, unknown long"), []), []).where("metric = 'pass^5'").first()
    assert short.lower is None and short.questions == 1
    assert M.exact_means(M.verdict_classes(df.limit(0), []), []).count() == 0
