"""Nearest neighbours by inner product: a tree of k-means, searched best bin first, with leaf visits widened to a measured recall."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hopmill.llm.common import small, stash

#: Vectors, the first by a hash, that fit the tree; children of a tree's node; leaves at most.
SAMPLE, BRANCH, MAX_LEAVES = 32_768, 8, 2048
#: Vectors that a leaf should hold on average, and that one task compares: members with queries, these so many at a time.
LEAF, MEMBERS, ASKED, TOGETHER = 2000, 8192, 2048, 512
#: Each round of visits ends at so many times the leaves of the one before.
WIDER = 4
#: Query vectors whose exact neighbours say how many leaves to visit, and the share of those neighbours to be found.
CALIBRATION, TARGET_RECALL = 512, 0.95
#: Query rows with one vector from which on their answer is broadcast.
HOT = 1000


class Tree:
    """A hierarchical k-means tree: centres of all nodes, the children of each (none: a leaf), leaves numbered in order."""

    def __init__(self, sample: np.ndarray, leaf: float, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        centres, self.children = [sample.mean(0)], [[]]
        todo = [(0, np.arange(len(sample)))]
        while todo:
            node, rows = todo.pop()
            if len(rows) <= leaf or len(self.children) >= 2 * MAX_LEAVES:
                continue
            c, near = _kmeans(sample[rows], min(BRANCH, int(np.ceil(len(rows) / leaf))), rng)
            parts = [rows[near == k] for k in range(len(c))]
            if sum(len(p) > 0 for p in parts) < 2:  # copies only
                continue
            for centre, part in zip(c, parts, strict=True):
                if len(part):
                    self.children[node].append(len(centres))
                    todo.append((len(centres), part))
                    centres.append(centre)
                    self.children.append([])
        self.centres = np.stack(centres)
        self.leaves = {n: k for k, n in enumerate(n for n, c in enumerate(self.children) if not c)}

    def distances(self, x: np.ndarray) -> np.ndarray:
        return (x**2).sum(1)[:, None] - 2 * x @ self.centres.T + (self.centres**2).sum(1)

    def place(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector: the nearest child at every node."""
        d, at = self.distances(x), np.zeros(len(x), np.int64)
        while True:
            moved = False
            for node in np.unique(at):
                if own := self.children[node]:
                    rows, moved = np.flatnonzero(at == node), True
                    at[rows] = np.array(own)[d[rows][:, own].argmin(1)]
            if not moved:
                return np.array([self.leaves[n] for n in at.tolist()], np.int64)

    def visit(self, distance: list[float], most: int) -> list[int]:
        """The first `most` leaves, best bin first: always the node whose centre is nearest among those that wait."""
        heap, out = [(distance[0], 0)], []
        while heap and len(out) < most:
            _, node = heapq.heappop(heap)
            if node in self.leaves:
                out.append(self.leaves[node])
            for child in self.children[node]:
                heapq.heappush(heap, (distance[child], child))
        return out


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """Centres and the nearest of each row; empty clusters keep their place."""
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = ((c**2).sum(1) - 2 * x @ c.T).argmin(1)
        total, count = np.zeros_like(c), np.bincount(near, minlength=k)
        np.add.at(total, near, x)
        c = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], c)
    return c, ((c**2).sum(1) - 2 * x @ c.T).argmin(1)


def _lifted(x: np.ndarray, norm: float, query: bool = False) -> np.ndarray:
    """Vectors over the greatest norm, with one more number: of members what lacks to length 1, of queries 0.

    The distance of a query and a member then falls as their inner product grows.
    """
    x = x / norm
    return np.c_[x, np.zeros(len(x)) if query else np.sqrt(np.maximum(1 - (x**2).sum(1), 0))]


def _products(q: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Inner products of rows, added up from the first component to the last, so that equal vectors have equal products wherever they are."""
    s = np.zeros(len(q))
    for k in range(q.shape[1]):
        s += q[:, k] * m[:, k]
    return s


def _stack(vectors: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in vectors])


def nearest(q: np.ndarray, m: np.ndarray, key: np.ndarray, top: int, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, member, product) of the `top` members of each query, none below its least product.

    A matrix product proposes, products added up in one order decide; ties go to smaller keys.
    """
    out = []
    for at in range(0, len(q), TOGETHER):
        own = q[at : at + TOGETHER]
        rough = own @ m.T
        doubt = 2e-12 * np.linalg.norm(own, axis=1) * np.linalg.norm(m, axis=1).max()
        low = np.full(len(own), -np.inf) if least is None else least[at : at + TOGETHER]
        bar = np.maximum(np.partition(rough, len(m) - top, axis=1)[:, -top], low) if len(m) > top else low
        i, j = np.nonzero(rough >= (bar - doubt)[:, None])
        s = np.concatenate([_products(own[i[a : a + 65536]], m[j[a : a + 65536]]) for a in range(0, len(i), 65536)] or [np.zeros(0)])
        order = np.lexsort((key[j], -s, i))
        order = order[s[order] >= low[i[order]]]
        i, j, s = i[order], j[order], s[order]
        keep = np.arange(len(i)) - np.searchsorted(i, i) < top
        out.append((i[keep] + at, j[keep], s[keep]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _placed(trees: dict[int, tuple[Tree, float]]):
    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for n, rows in frame.groupby("_dim", sort=False):
                for at in range(0, len(rows), 4096):
                    part = rows.iloc[at : at + 4096]
                    leaf = trees[n][0].place(_lifted(_stack(part["_vector"]), trees[n][1])) if n in trees else 0  # a length that the sample lacks: one leaf
                    yield pd.DataFrame({"_node": part["_node"].to_numpy(), "_leaf": leaf}).astype("int64")

    return of


def _visits(trees: dict[int, tuple[Tree, float]], most: dict[int, int]):
    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for n, rows in frame.groupby("_dim", sort=False):
                for at in range(0, len(rows), 1024):
                    part = rows.iloc[at : at + 1024]
                    seen = [[0]] * len(part)
                    if n in trees:
                        tree, norm = trees[n]
                        seen = [tree.visit(d, most[n]) for d in tree.distances(_lifted(_stack(part["_vector"]), norm, True)).tolist()]
                    yield pd.DataFrame({"_node": part["_node"].to_numpy(), "_visits": seen})

    return of


def _exact(asked: pd.DataFrame, top: int):
    """The nearest `top` members of each of a few queries among what a task reads."""

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = None
        for frame in frames:
            for n, rows in frame.groupby("_dim", sort=False):
                own = asked[asked["_dim"] == n]
                for at in range(0, len(rows) if len(own) else 0, MEMBERS):
                    part = rows.iloc[at : at + MEMBERS]
                    i, j, s = nearest(_stack(own["_vector"]), _stack(part["_vector"]), part["_node"].to_numpy(), top)
                    got = pd.DataFrame({"_query": own["_node"].to_numpy()[i], "_node": part["_node"].to_numpy()[j], "_leaf": part["_leaf"].to_numpy()[j], "score": s})
                    best = got if best is None else pd.concat([best, got])
                    best = best.sort_values(["_query", "score", "_node"], ascending=[True, False, True]).groupby("_query").head(top)
        if best is not None:
            yield best

    return of


def _compared(top: int):
    def of(rows: pd.DataFrame) -> pd.DataFrame:
        m, q = rows[rows["_member"]], rows[~rows["_member"]]
        if not len(m) or not len(q):
            return pd.DataFrame({"_query": [], "_node": [], "score": []}).astype({"_query": "int64", "_node": "int64", "score": "float64"})
        key = m["_node"].to_numpy()
        i, j, s = nearest(_stack(q["_vector"]), _stack(m["_vector"]), key, top, q["_least"].fillna(-np.inf).to_numpy())
        return pd.DataFrame({"_query": q["_node"].to_numpy()[i], "_node": key[j], "score": s})

    return of


def _searched(placed: DataFrame, visits: DataFrame, best: DataFrame | None, top: int) -> DataFrame:
    """(_query, _node, score): the `top` best nodes of each query among those of `best` and of the leaves that it visits now.

    visits has one row a query and leaf. A leaf is dealt into blocks of members and queries; a task returns only nodes that
    are as good as the last of a query's `top` so far.
    """
    spot = ["_dim", "_leaf"]
    if best is not None:
        bars = best.groupBy(F.col("_query").alias("_node")).agg(F.when(F.count("*") >= top, F.min("score")).alias("_least"))
        visits = visits.join(bars, "_node", "left")
    else:
        visits = visits.withColumn("_least", F.lit(None).cast("double"))
    members = placed.groupBy(*spot).agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("_mb"))
    grid = small(stash(members.join(visits.groupBy(*spot).agg(F.ceil(F.count("*") / ASKED).cast("int").alias("_qb")), spot), "grid"))
    part = lambda n: F.pmod(F.xxhash64("_node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    m = placed.join(grid, spot).select(*spot, "_node", "_vector", F.lit(None).cast("double").alias("_least"), part("_mb").alias("_i"), every("_qb").alias("_j"), F.lit(True).alias("_member"))
    q = visits.join(grid, spot).select(*spot, "_node", "_vector", "_least", every("_mb").alias("_i"), part("_qb").alias("_j"), F.lit(False).alias("_member"))
    found = m.unionByName(q).groupBy(*spot, "_i", "_j").applyInPandas(_compared(top), "_query long, _node long, score double")
    found = found if best is None else found.unionByName(best)
    order = Window.partitionBy("_query").orderBy(F.desc("score"), "_node")
    return stash(found.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= top).drop("_n"), "found")


def fit(nodes: DataFrame) -> dict[int, tuple[Tree, float]]:
    """A tree for each length of vector in the sample, and the greatest norm among all vectors of that length."""
    size = {r["_dim"]: r for r in nodes.groupBy("_dim").agg(F.count("*").alias("n"), F.max(_square(F.col("_vector"))).alias("norm")).collect()}  # a row a length
    sample = nodes.select("_dim", "_vector", F.xxhash64("_node").alias("_h")).orderBy("_h").limit(SAMPLE).toPandas()
    out = {}
    for n, g in sample.groupby("_dim"):
        norm = float(size[n]["norm"]) ** 0.5
        leaves = min(MAX_LEAVES, size[n]["n"] / LEAF)
        out[int(n)] = Tree(_lifted(_stack(g["_vector"]), norm), max(len(g) / max(leaves, 1), 1)), norm
    return out


def _square(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))


def widened(trees: dict[int, tuple[Tree, float]], asked: pd.DataFrame, truth: pd.DataFrame, recall: float) -> dict[int, int]:
    """Leaves to visit for each length: as few as find the share `recall` of the true neighbours of the asked vectors."""
    out = {}
    for n, (tree, norm) in trees.items():
        own = asked[asked["_dim"] == n]
        if not len(own):
            out[n] = len(tree.leaves)
            continue
        order = {}
        for node, d in zip(own["_node"], tree.distances(_lifted(_stack(own["_vector"]), norm, True)).tolist(), strict=True):
            order[node] = {leaf: k + 1 for k, leaf in enumerate(tree.visit(d, len(tree.leaves)))}
        ranks = np.sort([order[q][leaf] for q, leaf in zip(truth["_query"], truth["_leaf"], strict=True) if q in order])
        out[n] = int(ranks[min(int(np.ceil(recall * len(ranks))), len(ranks)) - 1]) if len(ranks) else len(tree.leaves)
    return out


def search(vectors: DataFrame, asks: Column, key: str = "vec_id", vector: str = "embedding", top: int = 20, recall: float = TARGET_RECALL) -> DataFrame:
    """(query_id, rank, key, score): the `top` nearest rows found for each row that asks selects, itself left out.

    Nearness is the largest inner product in double precision, ties to the smaller key. Equal vectors are one node with
    its top + 1 smallest keys; equal queries are searched once. Trees are fitted on SAMPLE rows at most (LEAF vectors a leaf
    on average, MAX_LEAVES leaves at most), every node is placed in one, and queries visit leaves best bin first, as many
    as found the share `recall` of the exact neighbours of CALIBRATION queries (compared with all nodes, a batch at a
    time). Visits widen in rounds, each WIDER times the last, so that tasks return only what is as good as a query's
    best of the rounds before. Leaves are dealt into blocks of MEMBERS nodes and ASKED queries: a large leaf is many
    tasks. If all vectors fit one leaf, the search is exact.

    Vectors that are null, zero or hold null or non-finite components, and rows with a null key, neither ask nor answer.
    Vectors of other lengths never meet. Rows that repeat a key and a vector are each an answer, but no row with the key
    of the query is one. Fewer candidates give fewer ranks; an empty table gives an empty one. Other columns are not read.
    """
    values = F.col(vector) if dict(vectors.dtypes)[vector] == "array<float>" else F.col(vector).cast("array<double>")
    base = vectors.select(F.col(key).cast("long").alias("_id"), values.alias("_vector"), F.coalesce(asks, F.lit(False)).alias("_asks"))
    base = base.where(F.col("_id").isNotNull() & F.forall("_vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("_vector", lambda x: x != 0))
    least = base.withColumn("_n", F.row_number().over(Window.partitionBy("_vector").orderBy("_id"))).where(F.col("_n") <= top + 1)
    nodes = least.groupBy("_vector").agg(F.sort_array(F.collect_list("_id")).alias("_ids")).withColumns({"_node": F.col("_ids")[0], "_dim": F.size("_vector")})
    nodes = stash(nodes, "nodes")
    trees = fit(nodes)
    placed = stash(nodes.select("_node", "_dim", "_vector").join(nodes.select("_node", "_dim", "_vector").mapInPandas(_placed(trees), "_node long, _leaf long"), "_node"), "placed")
    counts = base.where("_asks").groupBy("_vector").agg(F.count("*").alias("_rows"))
    queries = stash(counts.join(nodes.select("_vector", "_node", "_dim"), "_vector"), "queries")
    asked = queries.select("_node", "_dim", "_vector", F.xxhash64("_node").alias("_h")).orderBy("_h").limit(CALIBRATION).drop("_h").toPandas()
    exact = Window.partitionBy("_query").orderBy(F.desc("score"), "_node")
    truth = placed.mapInPandas(_exact(asked, top + 1), "_query long, _node long, _leaf long, score double").withColumn("_n", F.row_number().over(exact)).where(F.col("_n") <= top + 1)
    most = widened(trees, asked, truth.select("_query", "_leaf").toPandas(), recall)  # CALIBRATION queries at most
    visits = stash(queries.select("_node", "_dim", "_vector").mapInPandas(_visits(trees, most), "_node long, _visits array<int>").join(queries.select("_node", "_dim", "_vector"), "_node"), "visits")
    found, low = None, 0
    while low < max(most.values(), default=1):
        high = max(low * WIDER, WIDER)
        turn = F.slice(F.col("_visits").cast("array<long>"), low + 1, high - low)
        found, low = _searched(placed, visits.select("_node", "_dim", "_vector", F.explode(turn).alias("_leaf")), found, top + 1), high
    by_id = Window.partitionBy("_query").orderBy(F.desc("score"), "_id")
    found = found.join(nodes.select("_node", "_ids"), "_node").select("_query", "score", F.explode("_ids").alias("_id")).withColumn("_n", F.row_number().over(by_id)).where(F.col("_n") <= top + 1)
    found = found.groupBy("_query").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("less"), "_id"))), lambda x: F.struct(x["_id"].alias("id"), (-x["less"]).alias("score"))).alias("_found"))
    answers = stash(queries.select("_vector", "_rows", F.col("_node").alias("_query")).join(found, "_query").select("_vector", "_rows", "_found"), "answers")
    rows = base.where("_asks").select("_id", "_vector")
    hot = small(answers.where(F.col("_rows") >= HOT).select("_vector", "_found"))
    rest = rows.join(hot.select("_vector"), "_vector", "left_anti").join(answers.where(F.col("_rows") < HOT).select("_vector", "_found"), "_vector")
    rows = rows.join(hot, "_vector").unionByName(rest)
    own = F.slice(F.filter("_found", lambda x: x["id"] != F.col("_id")), 1, top)
    return rows.select(F.col("_id").alias("query_id"), F.posexplode(own).alias("_at", "_x")).select("query_id", (F.col("_at") + 1).alias("rank"), F.col("_x.id").alias(key), F.col("_x.score").alias("score"))
