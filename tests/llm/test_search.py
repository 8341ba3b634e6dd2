"""Ranked lexical search, nearest neighbours and the Merkle manifest against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from hopmill.llm import lexical, merkle, neighbours, queries

SF = "/root/testdata/sf0.001"
LOWER = {i: i + 32 for i in range(65, 91)}


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def plain_ranked(docs, items, top=10):
    counts = [(d, Counter(terms(t))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    n_docs, length = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = set()
    for i, own in asked.items():
        scored = []
        for d, c in counts:
            m = 10 + 90 * sum(c.values()) * n_docs // length
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in own if c[t])
            if s > 0:
                scored.append((-s, d is None, d, s))
        out |= {(i, k + 1, r[2], r[3]) for k, r in enumerate(sorted(scored, key=lambda r: (r[0], r[1], r[2] or 0))[:top])}
    return out


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(30)] + ["Éte", "été", "ß1", "x2"]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    docs = [(i, say(rng.randint(1, 60))) for i in range(150)] + [(200, None), (201, ""), (202, " .,;"), (203, "w1 " * 40_000), (None, say(30)), (3, say(20))]
    docs += [(300 + i, docs[5][1]) for i in range(25)] + [docs[7]]
    items = [(i, say(rng.randint(1, 12))) for i in range(20)] + [(50, docs[5][1]), (51, docs[5][1]), (52, None), (53, "nowhere"), (None, "w1 w2"), (1, "w3 w9"), (54, "w1"), (54, "w1")]
    return docs, items


def test_lexical(spark, texts, monkeypatch):
    docs, items = texts
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"score": F.lit("clash"), "item_id": F.lit("clash")})
    q = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("clash"))
    want = plain_ranked(docs, items)
    run = lambda: [tuple(r) for r in lexical.ranked(d, q).collect()]
    got = run()
    assert set(got) == want and len(got) == len(want)
    monkeypatch.setattr(lexical, "ENTRIES", 40)  # several blocks of items
    monkeypatch.setattr(lexical, "CELLS", 500)  # a few documents at a time
    monkeypatch.setattr(lexical, "PIECE", 17)
    got = run()
    assert set(got) == want and len(got) == len(want)


def test_lexical_empty(spark, texts):
    docs, items = (spark.createDataFrame(x, f"{k} long, text string") for x, k in zip(texts, ("doc_id", "item_id"), strict=True))
    assert lexical.ranked(docs.limit(0), items).count() == 0
    assert lexical.ranked(docs, items.limit(0)).count() == 0


def test_shared_plan():
    """Every item adds each of its terms once, and what several items share is one node."""
    rng = random.Random(8)
    held = {i: {f"t{rng.randrange(60)}" for _ in range(rng.randint(1, 25))} for i in range(40)} | {100: {f"t{i}" for i in range(20)}, 101: {f"t{i}" for i in range(20)}}
    plan = lexical.shared_plan(held)
    sets = max(plan["term_set"]) + 1
    of = [Counter() for _ in range(sets + len(plan["left"]))]
    for t, n in zip(plan["terms"], plan["term_set"], strict=True):
        of[n][t] += 1
    for n, (a, b) in enumerate(zip(plan["left"], plan["right"], strict=True)):
        assert max(a, b) < sets + n
        of[sets + n] = of[a] + of[b]
    ends = [*plan["starts"][1:], len(plan["nodes"])]
    for item, a, b in zip(plan["items"], plan["starts"], ends, strict=True):
        assert sum((of[n] for n in plan["nodes"][a:b]), Counter()) == Counter(held[item])
    assert len(plan["left"]) > 0 and len(plan["nodes"]) < sum(map(len, held.values()))


def dot(x, y):
    s = 0.0
    for a, b in zip(x, y, strict=True):  # sum() would round otherwise
        s += float(a) * float(b)
    return s


def plain_nearest(rows, top=20):
    sound = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, x in sound:
        if q % 20 == 0:
            scored = sorted((-dot(x, y), i) for i, y in sound if len(y) == len(x) and i != q)
            out[q] = [(i, -s) for s, i in scored[:top]]
    return out


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((12, 8)) * 2
    x = np.concatenate([c + rng.standard_normal((60, 8)) for c in centres]).astype(np.float32)
    x *= rng.uniform(0.2, 3, (len(x), 1)).astype(np.float32)  # inner product and cosine differ
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(1000 + i, rows[40][1]) for i in range(70)]  # more copies than places
    rows += [(2000, None), (2020, [0.0] * 8), (2040, [float("nan")] + [1.0] * 7), (2060, [None] + [1.0] * 7), (2080, [float("inf")] * 8), (None, rows[0][1]), (2100, [1.0, 2.0]), (2120, [1.0, 2.0]), (2140, [5.0])]
    return rows


def test_neighbours(spark, vectors, monkeypatch):
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").withColumns({"rank": F.lit("clash"), "query_id": F.lit("clash")})
    want = plain_nearest(vectors)

    def run():
        got = {}
        for r in neighbours.search(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.vec_id, r.score))
            assert r["rank"] == len(got[r.query_id])
        return got

    got = run()
    assert set(got) == {q for q, w in want.items() if w}
    assert all(got[q] == want[q] for q in got)  # one leaf: exact, scores to the last bit
    monkeypatch.setattr(neighbours, "LEAF", 25)
    monkeypatch.setattr(neighbours, "MEMBERS", 10)
    monkeypatch.setattr(neighbours, "ASKED", 2)
    monkeypatch.setattr(neighbours, "TOGETHER", 3)
    monkeypatch.setattr(neighbours, "HOT", 3)
    seen = []
    monkeypatch.setattr(neighbours, "widened", lambda *a, f=neighbours.widened: seen.append((a[0], f(*a))) or seen[-1][1])
    got = run()
    trees, most = seen[0]
    assert len(trees[8][0].leaves) > 15 and most[8] < len(trees[8][0].leaves)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in got)
    assert hits >= 0.9 * sum(len(w) for w in want.values())
    exact = {i: v for i, v in vectors if i is not None and v is not None}
    for q, found in got.items():
        assert found == sorted(found, key=lambda f: (-f[1], f[0])) and q not in dict(found)
        assert all(s == dot(exact[q], exact[i]) for i, s in found)


def test_neighbours_recall(spark):
    """Recall on the larger table, where visits stop short of all leaves: at least 0.9."""
    sf = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    x = np.array([v for _, v in rows], np.float64)
    ids = np.array([i for i, _ in rows])
    got = {}
    for r in queries.op12_neighbours(spark, sf).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        s = x @ x[q]
        s[q] = -np.inf
        near = set(ids[np.argsort(-s)[:20]].tolist())
        hits, total = hits + len(near & got[int(ids[q])]), total + len(near)
    assert hits >= 0.9 * total


def test_neighbours_empty(spark):
    assert neighbours.search(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0).count() == 0
    one = spark.createDataFrame([(20, [1.0, 2.0]), (21, None)], "vec_id long, embedding array<double>")
    assert neighbours.search(one, F.col("vec_id") % 20 == 0).count() == 0


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(nodes):
    """(root, path of left and right siblings for each node)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for n, p in enumerate(paths):
            run, i = at[n] // 3 * 3, at[n]
            p.append(("".join(nodes[run:i]), "".join(nodes[i + 1 : run + 3])))
            at[n] //= 3
        nodes = [h(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)]
    return nodes[0], paths


def plain_manifest(rows):
    f = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    sources = {}
    for r in rows:
        sources.setdefault(r[3], []).append((r[0], h(*(f(r[i]) for i in (0, 3, 2, 4, 1))), r))
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in order:
        own = sorted(sources[s], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees.append((own, *plain_tree([leaf for _, leaf, _ in own])))
    root, tops = plain_tree([t[1] for t in trees])
    out = []
    for (own, sub, paths), top in zip(trees, tops, strict=True):
        for (key, leaf, r), path in zip(own, paths, strict=True):
            path, text = path + top, r[1]
            if key is not None and text is not None and zlib.crc32(str(key).encode()) % 2 == 0:
                text = text.replace("\n", "")
            fold = h(*map(f, (key, r[3], r[2], r[4], text)))
            for a, b in path:
                fold = h(a, fold, b)
            out.append((key, leaf, sub, root, h(*(a + b for a, b in path)), fold, fold == root))
    return Counter(out)


@pytest.mark.parametrize("depth", [6, 1, 2])
def test_merkle(spark, monkeypatch, tmp_path, depth):
    monkeypatch.setattr(merkle, "DEPTH", depth)
    rng = random.Random(depth)
    sources = [None, "", "a", "b", "é", "z", "Z", "￿", "😀", "q1", "q2"]
    rows = [(i, rng.choice([None, "", "one\ntwo", "\n\n", "ü 😀\r\n", "plain"]), rng.choice(["en", None]), "hot", i) for i in range(120)]
    rows += [(500 + i, rng.choice(["a\nb", "c"]), "fr", sources[i % 11], None) for i in range(45)]
    rows += [(9001, "x\n" * 20_000, None, "long", -1), (None, "a\nb", None, None, 3), (501, "other", "fr", "", 1), rows[3], rows[3]]
    path = f"file://{tmp_path}"
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({"leaf": F.lit("clash"), "_h": F.lit(1)}).repartition(5).write.parquet(f"{path}/documents.parquet")
    got = [tuple(r) for r in queries.op13_merkle(spark, path).collect()]
    assert Counter(got) == plain_manifest(rows)
    assert not all(r[6] for r in got)


def test_merkle_small(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for n, rows in enumerate(([], [(1, "x", "en", "a", 1)], [(1, "x", "en", "a", 1), (2, None, None, "a", None)])):
        path = f"file://{tmp_path}/{n}"
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/documents.parquet")
        assert Counter(tuple(r) for r in queries.op13_merkle(spark, path).collect()) == (plain_manifest(rows) if rows else Counter())
