import random

from hopmill.operators import graph as G


def _answers(df):
    return {r.query_id: (r.status, tuple(r.answers), r.proofs) for r in df.collect()}


def _frames(spark, queries, steps, facts):
    return (
        spark.createDataFrame(queries, "query_id long, owner_id string, start string"),
        spark.createDataFrame(steps, "query_id long, hop int, role string, scope string"),
        spark.createDataFrame(facts, "owner_id string, fact_id string, child string, parent string, parent_role string, scope string"),
    )


def test_counts_are_those_of_listed_paths(spark):
    rnd = random.Random(8)
    role = lambda: rnd.choice(["father", "mother"])
    facts = [(rnd.choice("ab"), f"f{i}", f"e{rnd.randint(0, 7)}", rnd.choice([None, *(f"e{k}" for k in range(8))]), role(), rnd.choice("st")) for i in range(90)]
    queries = [(i, rnd.choice("ab"), None if i == 0 else f"e{i % 9}") for i in range(30)]
    steps = [(i, h, rnd.choice(["parent", "father"]), rnd.choice("st")) for i in range(29) for h in range(1, rnd.randint(1, 4) + 1)]
    q, s, f = _frames(spark, queries, steps, facts)
    want = _answers(G.answers(q, G.parent_paths(q, s, f)))
    assert _answers(G.path_answers(q, s, f)) == want
    assert {w[0] for w in want.values()} == {"insufficient_evidence", "answerable", "ambiguous"}
    assert _answers(G.path_answers(q, s.where("false"), f)) == _answers(G.answers(q, G.parent_paths(q, s.where("false"), f)))


def test_layers_of_many_paths_are_counted_and_not_listed(spark):
    layers = 9  # 20 entities a layer, all joined to all of the next: 20 ** 8 paths
    facts = [("a", f"{h}-{i}-{j}", f"l{h}x{i}" if h else "start", f"l{h + 1}x{j}", "father", "s") for h in range(layers) for i in range(20 if h else 1) for j in range(20 if h < layers - 1 else 1)]
    q, s, f = _frames(spark, [(1, "a", "start")], [(1, h + 1, "parent", "s") for h in range(layers)], facts)
    assert _answers(G.path_answers(q, s, f)) == {1: ("answerable", (f"l{layers}x0",), 20**8)}
