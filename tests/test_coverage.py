import random

from hopmill.operators import accounting as X


def test_nested_groups_are_those_of_all_pairs(spark):
    rnd = random.Random(5)
    rows = [(f, g, [rnd.choice("abcdefg") for _ in range(rnd.randint(0, 5))]) for f in range(6) for g in range(30)] + [(9, 0, None), (9, 1, ["a", None]), (9, 2, ["b", "a", "a"])]
    got = X.nested_groups(spark.createDataFrame(rows, "fact_id long, group_id long, group_unit_ids array<string>"), ["fact_id"])
    sets = {}
    for f, _, units in rows:
        s = tuple(sorted({u for u in units or [] if u}))
        if s:
            sets[f, s] = sets.get((f, s), 0) + 1
    want = {}
    for f, s in sets:
        outer = [o for g, o in sets if g == f and set(s) < set(o)]
        if outer:
            want[f, s] = (sets[f, s], len(outer), min(outer))
    assert {(r.fact_id, tuple(r.units)): (r.groups, r.outers, tuple(r.outer)) for r in got.collect()} == want
    assert want[9, ("a",)] == (1, 1, ("a", "b"))


def test_findings_of_cells(spark):
    facts = spark.createDataFrame([("f", "support_proposed"), ("g", "not_found"), ("h", "not_found")], "fact_id string, status string")
    cells = [("f", 1, "support_anchor"), ("f", 2, "support_anchor"), ("f", 3, "support_context"), ("f", 4, None), ("g", 1, "unresolved"), ("g", 2, "not_supporting"), ("h", 1, "not_supporting")]
    groups = [("f", "a", 1, [1, 2]), ("f", "b", 1, [1, 5]), ("f", "c", 6, [2])]
    got = X.coverage_findings(facts, spark.createDataFrame(cells, "fact_id string, unit_id int, status string"), spark.createDataFrame(groups, "fact_id string, group_id string, anchor_unit_id int, unit_ids array<int>"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted([("f", 2, "label"), ("f", 3, "label"), ("f", 4, "label"), ("g", 1, "unresolved"), ("g", None, "concealed"), ("f", 6, "anchor_outside"), ("f", 1, "repeated_anchor")], key=str)
