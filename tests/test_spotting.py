"""Name spotting, interval joins and placement against plain versions."""

import random
import re

import pytest
from pyspark.sql import functions as F

from hopmill.functions import strings
from hopmill.operators import intervals, spotting
from hopmill.operators import text as T

RNG = random.Random(4)
LETTERS = "ab\\E.😀é"


def word(n):
    return "".join(RNG.choice(LETTERS) for _ in range(n))


def hits(t, s):
    return [i for i in range(len(t)) if t.startswith(s, i)] if t and s else []


@pytest.mark.parametrize("part,size", [(1 << 20, 8 << 20), (6, 40)])
def test_spotted(spark, monkeypatch, part, size):
    monkeypatch.setattr(spotting, "PART", part)
    monkeypatch.setattr(spotting, "SLICE", size)
    texts = [(o, c, word(RNG.randint(0, 30))) for o in ("x", "y") for c in range(12)] + [("hot", c, word(25)) for c in range(60)] + [("x", 50, None), ("none", 1, "ab"), (None, 1, "ab"), ("hot", 0, "abab"), ("x", 60, "ab" * 500)]
    names = [(o, word(RNG.randint(0, 3))) for o in ("x", "y", "hot", "lost") for _ in range(14)] + [("x", None), (None, "a"), ("x", "a"), ("x", "a")]
    t, n = spark.createDataFrame(texts, "owner string, c int, text string").withColumn("surface", F.lit("clash")), spark.createDataFrame(names, "owner string, surface string")
    want = sorted((o, c, s, i) for o, c, text in texts for s in {s for p, s in names if p == o and o} for i in hits(text, s))
    assert sorted(map(tuple, spotting.spotted(t, n, "owner", ("c",)).collect())) == want
    first = [(o, c, s, min(hits(text, s))) for o, c, text in texts for s in {s for p, s in names if p == o and o} if hits(text, s)]
    assert sorted(map(tuple, spotting.spotted(t, n, "owner", ("c",), once=True).collect())) == sorted(first)
    assert spotting.spotted(t.limit(0), n, "owner").count() == spotting.spotted(t, n.limit(0), "owner").count() == 0


def test_spotting_many_surfaces(spark):
    """Thousands of surfaces of one owner: no join of surfaces with texts."""
    names = spark.range(5000).select(F.lit(1).alias("owner_id"), F.format_string("n%04d", "id").alias("surface"))
    texts = spark.range(200).select(F.lit(1).alias("owner_id"), "id", F.format_string("see n%04d and n%04d.", "id", F.col("id") + 4000).alias("text"))
    got = spotting.spotted(texts, names, keys=("id",))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "contains" not in plan.lower() and "CartesianProduct" not in plan
    assert got.count() == 400


def test_occurrences_and_replacement(spark):
    rows = [(word(RNG.randint(0, 25)), word(RNG.randint(0, 2))) for _ in range(200)] + [("aaaa", "aa"), (None, "a"), ("a", None), ("", "a"), ("ab" * 3000, "ab")]
    df = spark.createDataFrame(rows, "t string, n string").select("t", "n", strings.occurrences(F.col("t"), F.col("n")).alias("at"))
    for r in df.collect():
        assert r.at == hits(r.t, r.n), r
    mapping = {"a": "<1>", "ab": "", "\\E": "é", "é😀": "a", "": "never"}
    keys = sorted((k for k in mapping if k), key=len, reverse=True)
    made = F.create_map(*(F.lit(x) for kv in mapping.items() for x in kv))
    out = spark.createDataFrame([(t,) for t, _ in rows], "t string").select("t", strings.replace_all(F.col("t"), made).alias("r")).select("t", "r", strings.replay(F.col("t"), F.col("r.changes")).alias("again"))
    for r in out.collect():
        if r.t is None:
            assert r.r is None
            continue
        found = list(re.finditer("|".join(map(re.escape, keys)), r.t))
        assert r.r.text == r.again == re.sub("|".join(map(re.escape, keys)), lambda m: mapping[m[0]], r.t)
        assert [tuple(c) for c in r.r.changes] == [(m.start(), m.end(), m[0], mapping[m[0]]) for m in found]


def test_running(spark):
    for n in (0, 1, 255, 256, 257, 1000):
        x = [RNG.randint(0, 9) for _ in range(n)]
        got = spark.range(1).select(strings.running(F.lit(x).cast("array<int>") if x else F.array().cast("array<int>")).alias("r")).first().r
        assert got == [sum(x[: i + 1]) for i in range(n)]


def test_overlapping(spark):
    some = lambda n: [(RNG.randint(0, 2), a := RNG.randint(0, 300), a + RNG.choice([0, 1, 5, 63, 64, 65, 200])) for _ in range(n)]
    a, b = some(60), some(60)
    got = intervals.overlapping(*(spark.createDataFrame(x, "k int, start int, `end` int") for x in (a, b)), ["k"])
    want = sorted((k, s, e, t, u) for k, s, e in a for m, t, u in b if k == m and max(s, t) < min(e, u))
    assert sorted(map(tuple, got.select("k", "start", "end", "other_start", "other_end").collect())) == want


def test_against_cuts(spark):
    rows = [(RNG.randint(0, 3), a := RNG.randint(0, 50), a + RNG.randint(1, 9), f"r{i}") for i in range(80)] + [(9, 1, 2, "alone"), (9, 1, 2, "alone")]
    cuts = [(RNG.randint(0, 3), a := RNG.randint(0, 50), a + RNG.randint(1, 6)) for _ in range(15)]
    got = intervals.against_cuts(spark.createDataFrame(rows, "k int, start int, `end` int, name string"), spark.createDataFrame(cuts, "k int, start int, `end` int"), ["k"])
    want = sorted((k, s, e, n, any(c == k and t < e and s < u for c, t, u in cuts), sum(u - t for c, t, u in cuts if c == k and u <= s)) for k, s, e, n in rows)
    assert sorted(map(tuple, got.select("k", "start", "end", "name", "hit", "shift").collect())) == want


def test_hit_windows(spark):
    rng = random.Random(6)
    texts = [("".join(rng.choice("xy。！\nz") for _ in range(rng.randint(0, 40)))) for _ in range(25)]
    ctx = [(1, i, t) for i, t in enumerate(texts)]
    names = [("e1", "x"), ("e1", "xy"), ("e2", "z"), ("e3", "")]
    edges = [("edge1", "e1"), ("edge2", "e2"), ("edge3", "e3"), ("edge4", "e1")]
    got = T.hit_windows(spark.createDataFrame([(1, *e) for e in edges], "owner_id int, edge_id string, child string"), spark.createDataFrame([(1, *n) for n in names], "owner_id int, entity_id string, surface string"), spark.createDataFrame(ctx, "owner_id int, context_id int, text string"))
    want = {}
    for _, c, t in ctx:
        spans = [m.span() for m in re.finditer(T.SENTENCE, t)]
        for edge, child in edges:
            for e, s in names:
                for at in hits(t, s) if e == child else ():
                    n = next(i for i, (a, b) in enumerate(spans) if a <= at < b)
                    key = (edge, c, spans[max(n - 1, 0)][0], spans[min(n + 1, len(spans) - 1)][1])
                    want[key] = min(want.get(key, s), s, key=lambda v: (-len(v), v))
    assert sorted((r.edge_id, r.context_id, r.start, r.end, r.matched_surface, r.text) for r in got.collect()) == sorted((*k, s, texts[k[1]][k[2] : k[3]]) for k, s in want.items())
