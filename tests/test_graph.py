import pytest
import random

from pyspark.sql import functions as F

from hopmill.operators import families as V
from hopmill.operators import graph as G
from hopmill.operators import integrity as I


def test_paths_match_brute_force(spark):
    rng = random.Random(3)
    facts = [("o", f"f{i}", rng.choice("abcdef"), rng.choice("abcdef"), rng.choice(["father", "mother", "parent"]), rng.choice("st")) for i in range(60)]
    facts = [f for f in facts if f[2] != f[3]]
    queries = [(f"q{i}", "o", rng.choice("abcdef"), [(rng.choice(["father", "mother", "parent"]), rng.choice("st")) for _ in range(rng.randint(1, 3))]) for i in range(25)]
    q = spark.createDataFrame([x[:3] for x in queries], "query_id string, owner_id string, start string")
    s = spark.createDataFrame([(x[0], h + 1, r, sc) for x in queries for h, (r, sc) in enumerate(x[3])], "query_id string, hop int, role string, scope string")
    f = spark.createDataFrame([(o, i, c, p, r, sc) for o, i, c, p, r, sc in facts], "owner_id string, fact_id string, child string, parent string, parent_role string, scope string")
    paths = G.parent_paths(q, s, f, 3)
    got = {(r.query_id, tuple(r.entities), tuple(r.facts)) for r in paths.collect()}
    want = set()
    for qid, _, start, steps in queries:
        grown = [((start,), ())]
        for role, scope in steps:
            grown = [(e + (p,), u + (i,)) for e, u in grown for _, i, c, p, r, sc in facts if c == e[-1] and sc == scope and role in ("parent", r) and p not in e and i not in u]
        want |= {(qid, e, u) for e, u in grown}
    assert got == want and want
    a = {r.query_id: (r.status, r.answers) for r in G.answers(q, paths).collect()}
    for qid, *_ in queries:
        ends = sorted({e[-1] for i, e, _ in want if i == qid})
        assert a[qid] == ("insufficient_evidence" if not ends else "answerable" if len(ends) == 1 else "ambiguous", ends)


def test_two_hop_options(spark):
    f = spark.createDataFrame([("o", "1", "a", "b", "father", "s"), ("o", "2", "b", "c", "mother", "s"), ("o", "3", "b", "d", "mother", "s"), ("o", "4", "x", "a", "father", "s"), ("o", "5", "b", "a", "father", "s")], "owner_id string, fact_id string, child string, parent string, parent_role string, scope string")
    got = {(r.start, r.first_role, r.second_role, r.answer) for r in G.two_hop_options(f).collect()}
    assert got == {("x", "father", "father", "b"), ("b", "father", "father", None)} - {("b", "father", "father", None)}


def test_frontiers(spark):
    start = spark.createDataFrame([("q", "a")], "query_id string, entity string")
    r = spark.createDataFrame([("q", 1, "a", ["b", "c"]), ("q", 2, "b", ["d"]), ("q", 2, "b", ["d"]), ("q", 2, "z", [])], "query_id string, hop int, child string, parents array<string>")
    assert {(x.hop, x.entity, x.check) for x in G.frontier_violations(r, start, 2).collect()} == {(2, "b", "repeated"), (2, "c", "missing"), (2, "z", "unexpected")}


def test_alternatives_and_differences(spark):
    w = spark.createDataFrame([("a1", "x"), ("a1", "x"), ("a2", "y")], "query_id string, value string")
    labels = spark.createDataFrame([("q", "L1", "a1"), ("q", "L2", "a2")], "query_id string, label string, alternative_id string")
    assert {(r.label, tuple(r.answers)) for r in G.alternatives(w, labels).collect()} == {("L1", ("x",)), ("L2", ("y",))}
    p = lambda *rows: spark.createDataFrame([("q", list(r)) for r in rows], "query_id string, facts array<string>")
    assert {(r.facts, r.side) for r in G.path_difference(p("12", "13"), p("13", "45")).collect()} == {("1>2", "omitted"), ("4>5", "invented")}


def test_family_conditions(spark):
    packets = spark.createDataFrame([("f", ["u1"], ["d1"], ["i1"], [("necessary_support_deleted_name_retained", "u1", "x")])], "family_id string, base_unit_ids array<string>, distractor_ids array<string>, irrelevant_ids array<string>, deletions array<struct<condition string, unit_id string, quote string>>")
    units = spark.createDataFrame([("f", u, u) for u in ("u1", "d1", "i1")], "family_id string, unit_id string, text string")
    rows, cuts = V.expand_conditions(packets, units)
    assert rows.count() == 7 and cuts.count() == 1
    solved = spark.createDataFrame([("f", "base", "answerable", ["a"], ["p1"]), ("f", "main_distractor", "ambiguous", ["a", "b"], ["p1", "p2"]), ("f", "irrelevant_addition", "answerable", ["a"], ["p2"]), ("f", "necessary_support_deleted_name_retained", "answerable", ["a"], ["p1"])], "family_id string, condition string, status string, answers array<string>, proofs array<string>")
    assert {(r.condition, r.check) for r in V.invariant_violations(solved).collect()} == {("main_distractor", "answer_changed"), ("irrelevant_addition", "base_proof_lost"), ("necessary_support_deleted_name_retained", "still_answerable")}
    flags = solved.where("condition = 'base'").select("family_id", "condition")
    assert V.residual_override(solved, flags).where("condition = 'base'").first().status == "unresolved"


def test_corruptions_change_one_thing(spark):
    fam = spark.createDataFrame([(f"f{i}", "a", "answerable", ["1", "2"], 1) for i in range(20)], "family_id string, answer string, status string, proof array<string>, deletions int")
    rows = {(r.family_id, r["copy"]): r for r in V.corruptions(fam).collect()}
    for i in range(20):
        g, b = rows[f"f{i}", "good"], rows[f"f{i}", "bad"]
        assert sum(g[c] != b[c] for c in ("answer", "status", "proof", "deletions")) == 1


def test_fingerprint_ignores_order_and_sees_changes(spark):
    a = spark.range(50).withColumn("x", F.col("id") % 7)
    f = lambda df: I.fingerprint(df).first()
    assert f(a) == f(a.orderBy(F.desc("id")).repartition(3)) != f(a.withColumn("x", F.when(F.col("id") == 3, 9).otherwise(F.col("x"))))
    assert f(a.unionByName(a.limit(1)))[0] == 51


def test_sources(spark, tmp_path):
    from hopmill.sources import readers as S

    (tmp_path / "a.jsonl").write_text('{"k": 1, "t": "x"}\n\n{"k": 2, "t": "y"}\n')
    assert S.read_lines(spark, str(tmp_path / "a.jsonl"), "k int, t string").count() == 2
    (tmp_path / "b.json").write_text('{"cases": [{"k": 1},\n {"k": 2}]}')
    assert [r.k for r in S.read_list(spark, str(tmp_path / "b.json"), "cases", "k int").collect()] == [1, 2]
    (tmp_path / "c.csv").write_bytes("﻿head,tail,relation,label\na,b,r,father\n\nc,,r,son\nd,e,r\n".encode())
    rows, bad = S.read_relations(spark, str(tmp_path / "c.csv"), header=True)
    assert [(r.source_row, r.head, r.label) for r in rows.collect()] == [(2, "a", "father")] and {r.detail for r in bad.collect()} == {"c,,r,son", "d,e,r"}
    (tmp_path / "d").mkdir()
    for i in range(2):
        (tmp_path / "d" / f"{i}.json").write_text(f'{{"k": {i}}}')
    assert S.read_folder(spark, str(tmp_path / "d"), "k int").count() == 2
    m = S.manifest(spark, str(tmp_path / "d"))
    assert m.count() == 2 and S.manifest_violations(m, m).count() == 0
    assert {r.check for r in S.manifest_violations(m, m.withColumn("bytes", F.lit(0))).collect()} == {"changed"}
    df = spark.range(5)
    assert S.write_once(df, str(tmp_path / "w")) is True and S.write_once(df, str(tmp_path / "w")) is False
    try:
        S.write_once(spark.range(6), str(tmp_path / "w"))
        raise AssertionError("a changed table was accepted")
    except ValueError:
        pass
    S.write_projection(df.withColumn("hidden", F.lit(1)), str(tmp_path / "p"), ["id"])
    assert spark.read.json(str(tmp_path / "p")).columns == ["id"]
    (tmp_path / "r.md").write_text("| S07 | Seven |\nnone\n- S08: Eight\n")
    assert {(r.id, r.title) for r in S.registry(spark, str(tmp_path / "r.md")).collect()} == {("S07", "Seven |"), ("S08", "Eight")}


def test_no_cap_on_steps_or_depth(spark):
    facts = spark.createDataFrame([("o", f"f{i}", f"e{i}", f"e{i + 1}", "father", "s") for i in range(5)], "owner_id string, fact_id string, child string, parent string, parent_role string, scope string")
    steps = spark.createDataFrame([(1, h, "parent", "s") for h in (1, 2, 3)], "query_id int, hop int, role string, scope string")
    asked = spark.createDataFrame([(1, "o", "e0")], "query_id int, owner_id string, start string")
    assert [r.answers for r in G.answers(asked, G.parent_paths(asked, steps, facts)).collect()] == [["e3"]]
    with pytest.raises(ValueError):
        G.parent_paths(asked, steps, facts, hops=2)
    nodes = [("p", str(i), [str(i - 1)] if i else []) for i in range(40)] + [("c", "a", ["b"]), ("c", "b", ["a"]), ("x", "a", ["lost"])]
    got = {r.proof_id: r.depth for r in G.proof_depths(spark.createDataFrame(nodes, "proof_id string, node_id string, dependencies array<string>")).collect()}
    assert got == {"p": 40, "c": None, "x": 1}


def test_distractors_by_hand(spark):
    triples = [
        ("o", "legal", "a", "r", "b", None, True), ("o", "late", "a", "r", "c", (1, 2), True), ("o", "fits", "a", "r", "c", (1, 9), True), ("o", "kin", "a", "q", "d", None, True),
        ("o", "far", "z", "r", "y", None, False), ("o", "one", "d", "q", "e", None, True), ("o", "two", "e", "q", "f", None, True), ("o", "three", "f", "q", "g", None, True), ("o", "value", "y", "q", "h", None, True),
    ]
    t = spark.createDataFrame(triples, "owner_id string, fact_id string, subject string, relation string, object string, period struct<lo int, hi int>, is_entity boolean")
    nodes = spark.createDataFrame([("o", "n", "a", "r", "out", 5), ("o", "back", "b", "q", "in", None)], "owner_id string, node_id string, upstream string, relation string, direction string, at_time int")
    got = {(r.node_id, r.fact_id): r.kind for r in G.distractors(nodes, t, t.where("fact_id = 'legal'")).collect()}
    assert {k[1]: v for k, v in got.items() if k[0] == "n"} == {"late": "out_of_period", "kin": "other_relation", "far": "other_upstream", "one": "continuation", "two": "continuation"}
    assert {k[1] for k, v in got.items() if k[0] == "back" and v == "other_upstream"} == {"kin", "one", "two", "three", "value"}


def test_path_shape_against_its_query(spark):
    steps = [("short", 1, "s", "a", True, False), ("start", 1, "x", "a", True, False), ("start", 2, "a", "t", True, False), ("end", 1, "s", "a", True, False), ("end", 2, "a", "z", True, False), ("any", 1, "s", "a", True, False), ("any", 2, "a", "z", True, False), ("clash", 1, "s", None, True, True), ("clash", 2, "a", "t", True, False), ("open", 1, None, "a", True, False), ("open", 2, "a", None, True, False), ("good", 1, "s", "a", True, False), ("good", 2, "a", "t", True, False)]
    rows = spark.createDataFrame(steps, "item_id string, step_no int, from_id string, to_id string, role_ok boolean, to_conflict boolean")
    ask = [(i, 2, "s", [] if i == "any" else ["t"]) for i in ("short", "start", "end", "any", "clash", "open", "good", "absent")]
    got = {r.item_id: r.shape for r in G.path_shape(rows, spark.createDataFrame(ask, "item_id string, length int, start string, targets array<string>")).collect()}
    assert got == {"short": "incorrect", "start": "incorrect", "end": "incorrect", "any": "correct", "clash": "incorrect", "open": "needs_semantic_review", "good": "correct", "absent": "incorrect"}


def test_question_depths(spark):
    nodes = [("long", f"n{i}", [f"n{i - 1}"] if i else []) for i in range(10_000)] + [("p", "a", []), ("p", "b", ["a"]), ("loop", "a", ["b"]), ("loop", "b", ["a"])]
    proofs = [("q1", "long"), ("q1", "p"), ("q2", "long"), ("q3", "loop"), ("q3", "p"), ("q4", "bare")]
    got = G.question_depths(spark.createDataFrame([(f"q{i}",) for i in range(1, 6)], "question_id string"), spark.createDataFrame(nodes, "proof_id string, node_id string, dependencies array<string>"), spark.createDataFrame(proofs, "question_id string, proof_id string"))
    assert {r.question_id: r.depth for r in got.collect()} == {"q1": 2, "q2": 10_000, "q3": None, "q4": 0, "q5": 0}


def test_chinese_labels(spark):
    rows = spark.createDataFrame([("a", "b", "父亲"), ("a", "b", "女儿"), ("a", "b", "母亲"), ("a", "b", "儿子"), ("a", "b", "uncle")], "head string, tail string, label string")
    assert sorted((r.label, r.parent, r.child, r.parent_role) for r in G.normal_relations(rows).select("*").collect()) == sorted((r, p, c, role) for r, p, c, role in [(x.label, x.parent, x.child, x.parent_role) for x in G.normal_relations(rows).collect()])
    assert [r.parent_role for r in G.normal_relations(rows).orderBy("label").collect()] == ["parent", "parent", "mother", "father"]
