"""Near-duplicate vectors by an inverted multi-index: two codebooks, their product grid, multi-sequence traversal."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopmill.llm.common import small, stash
from hopmill.llm.components import components

#: At most so many vectors, the first by a hash of their key, fit the codebooks and the traversal's stop.
SAMPLE = 8192
#: Vectors that a cell should hold on average, and that one task compares with as many others.
CELL, BLOCK = 1000, 512
TARGET_RECALL = 0.995


def _halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return x[:, : (x.shape[1] + 1) // 2], x[:, (x.shape[1] + 1) // 2 :]


def _codebook(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """k-means; empty clusters keep their place."""
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = (((c**2).sum(1)) - 2 * x @ c.T).argmin(1)
        count = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], c)
    return c


def _borders(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Own cluster of each vector, and the square of its distance to the border of every other (0 for its own)."""
    d = ((x[:, None, :] - c[None]) ** 2).sum(2) if len(x) * c.size < 1 << 22 else (x**2).sum(1)[:, None] + (c**2).sum(1) - 2 * x @ c.T
    own = d.argmin(1)
    apart = np.sqrt(np.maximum(((c[:, None] - c[None]) ** 2).sum(2), 1e-30))
    gap = (d - d[np.arange(len(x)), own][:, None]) / (2 * apart[own])
    gap[np.arange(len(x)), own] = 0
    return own, np.maximum(gap, 0) ** 2


def visit(a: np.ndarray, b: np.ndarray, most: float) -> list[int]:
    """Cells (i * len(b) + j) in the order of a[i] + b[j] while that is at most `most`: the multi-sequence traversal."""
    ia, ib = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    sa, sb = a[ia].tolist(), b[ib].tolist()
    heap, out = [(sa[0] + sb[0], 0, 0)], []
    while heap:
        s, i, j = heapq.heappop(heap)
        if s > most:
            break
        out.append(int(ia[i]) * len(b) + int(ib[j]))
        if j + 1 < len(sb):
            heapq.heappush(heap, (sa[i] + sb[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(sa):
            heapq.heappush(heap, (sa[i + 1] + sb[0], i + 1, 0))
    return out


def fit(sample: np.ndarray, k: int, cosine: float, recall: float = TARGET_RECALL, seed: int = 7) -> tuple[np.ndarray, np.ndarray, float]:
    """Two codebooks on the halves of unit vectors, and how far the traversal goes.

    Each sample vector gets a partner at exactly the least cosine in a random direction; the stop is the quantile
    `recall` of the distance at which the traversal meets the partner's cell.
    """
    rng = np.random.default_rng(seed)
    left, right = _halves(sample)
    books = _codebook(left, k, rng), _codebook(right, k, rng) if right.shape[1] else np.zeros((1, 0))
    noise = rng.standard_normal(sample.shape)
    noise -= (noise * sample).sum(1)[:, None] * sample
    noise /= np.maximum(np.linalg.norm(noise, axis=1), 1e-30)[:, None]
    partner = cosine * sample + np.sqrt(1 - cosine**2) * noise
    total = np.zeros(len(sample))
    for x, y, c in zip(_halves(sample), _halves(partner), books, strict=True):
        total += _borders(x, c)[1][np.arange(len(x)), _borders(y, c)[0]]
    return *books, float(np.quantile(total, recall))


def _unit(vectors: pd.Series) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in vectors])
    x /= np.abs(x).max(1)[:, None]
    return x / np.linalg.norm(x, axis=1)[:, None]


def _placed(models: dict[int, tuple[np.ndarray, np.ndarray, float]]):
    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for n, rows in frame.groupby("_dim", sort=False):
                if n not in models:  # a length that the sample lacks: one cell for all of its vectors
                    yield rows.assign(_home=0, _visits=[[0]] * len(rows))[["_node", "_home", "_visits"]]
                    continue
                left, right, most = models[n]
                for at in range(0, len(rows), 4096):
                    part = rows.iloc[at : at + 4096]
                    a, b = _halves(_unit(part["_vector"]))
                    own_a, gap_a = _borders(a, left)
                    own_b, gap_b = _borders(b, right)
                    seen = [visit(x, y, most) for x, y in zip(gap_a, gap_b, strict=True)]
                    yield pd.DataFrame({"_node": part["_node"].to_numpy(), "_home": own_a * len(right) + own_b, "_visits": seen})

    return of


def _compared(cosine: float):
    def of(rows: pd.DataFrame) -> pd.DataFrame:
        """Links between the queries and the members of one block of a cell: sums for each vector, and a spanning forest."""
        m, q = rows[rows["_member"]], rows[~rows["_member"]]
        if not len(m) or not len(q):
            return pd.DataFrame({"a": [], "b": [], "n": []}).astype("int64")
        near = _unit(q["_vector"]) @ _unit(m["_vector"]).T >= cosine
        qi, mi = q["_node"].to_numpy(), m["_node"].to_numpy()
        near &= qi[:, None] != mi[None]
        homes, at = np.unique(q["_home"].to_numpy(), return_inverse=True)
        back = np.stack([np.isin(homes, v) for v in m["_visits"]])  # does the member, too, visit the query's cell
        alone = near & ~back[:, at].T
        got = near @ m["_copies"].to_numpy().astype(np.int64)
        given = q["_copies"].to_numpy().astype(np.int64) @ alone
        edges, label = [], np.arange(len(qi) + len(mi))
        place = {v: i for i, v in enumerate(qi)}
        twin = np.array([place.get(v, -1) for v in mi])
        for k in np.flatnonzero(twin >= 0):
            label[len(qi) + k] = twin[k]
        for i in np.flatnonzero(near.any(1)):
            c = np.flatnonzero(near[i] & (label[len(qi) :] != label[i]))
            while len(c):
                j = c[0]
                label[label == label[len(qi) + j]] = label[i]
                edges.append((qi[i], mi[j]))
                c = c[label[len(qi) + c] != label[i]]
        sums = [(v, -1, n) for v, n in zip([*qi, *mi], [*got, *given], strict=True) if n]
        return pd.DataFrame([*sums, *((a, b, 0) for a, b in edges)], columns=["a", "b", "n"]).astype("int64")

    return of


def near_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = 0.93) -> DataFrame:
    """(key, n_links, component_id, kept) for each row: links between vectors of one label with a cosine of at least `cosine`.

    Equal vectors of a label are one node with a number of copies (they link with each other); nodes are placed in the
    product grid of two codebooks, fitted on at most SAMPLE rows. Each node visits cells in the order of its distance to
    their borders up to a calibrated stop, and is compared there in double precision. Cells with many members are dealt
    into blocks, so a task has a bounded number of vectors; tasks return sums and spanning forests, no pairs. A link found from one
    side only counts for both.

    Null labels, and vectors that are null, zero or hold nulls or non-finite components, link with nothing; so does a
    null key, whose component is null. Vectors of other lengths never link. Repeated rows count as copies. An empty
    table gives an empty one. Other columns are not read.
    """
    values = F.col(vector) if dict(vectors.dtypes)[vector] == "array<float>" else F.col(vector).cast("array<double>")  # half the bytes to shuffle
    base = vectors.select(F.col(key).cast("long").alias("_id"), F.col(label).alias("_label"), values.alias("_vector"))
    sound = F.col("_label").isNotNull() & F.col("_id").isNotNull() & F.forall("_vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("_vector", lambda x: x != 0)
    base = base.withColumn("_vector", F.when(F.coalesce(sound, F.lit(False)), F.col("_vector")))
    nodes = stash(base.where("_vector is not null").groupBy("_label", "_vector").agg(F.min("_id").alias("_node"), F.count("*").alias("_copies")).withColumn("_dim", F.size("_vector")), "vectors")
    count = nodes.count()
    k = int(np.clip(round((count / CELL) ** 0.5), 4, 1024))
    sample = nodes.select("_dim", "_vector", F.xxhash64("_node").alias("_h")).orderBy("_h").limit(SAMPLE).toPandas()
    models = {int(n): fit(_unit(g["_vector"]), k, cosine) for n, g in sample.groupby("_dim")}
    placed = nodes.select("_node", "_dim", "_vector").mapInPandas(_placed(models), "_node long, _home int, _visits array<int>")
    full = stash(nodes.join(placed, "_node"), "placed")
    spot = ["_label", "_dim", "_cell"]
    members = full.groupBy("_label", "_dim", F.col("_home").alias("_cell")).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("_mb"))
    queries = full.select(*spot[:2], F.explode("_visits").alias("_cell")).groupBy(*spot).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("_qb"))
    grid = small(stash(members.join(queries, spot), "grid"))
    payload = ["_node", "_copies", "_vector", "_home", "_visits"]
    part = lambda n: F.pmod(F.xxhash64("_node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    m = full.withColumn("_cell", F.col("_home")).join(grid, spot).select(*spot, *payload, part("_mb").alias("_i"), every("_qb").alias("_j"), F.lit(True).alias("_member"))
    q = full.withColumn("_cell", F.explode("_visits")).join(grid, spot).select(*spot, *payload[:-1], F.lit(None).cast("array<int>").alias("_visits"), every("_mb").alias("_i"), part("_qb").alias("_j"), F.lit(False).alias("_member"))
    found = stash(m.unionByName(q).groupBy(*spot, "_i", "_j").applyInPandas(_compared(cosine), "a long, b long, n long"), "found")
    sums = found.where("n > 0").groupBy(F.col("a").alias("_node")).agg(F.sum("n").alias("_others"))
    groups = components(found.where("n = 0")).select(F.col("node").alias("_node"), "component")
    done = nodes.join(sums, "_node", "left").join(groups, "_node", "left")
    done = done.select("_label", "_vector", (F.coalesce("_others", F.lit(0)) + F.col("_copies") - 1).alias("_links"), F.coalesce("component", "_node").alias("_component"))
    out = base.join(done, ["_label", "_vector"], "left")
    component = F.when(F.col("_id").isNotNull(), F.coalesce("_component", "_id"))
    out = out.select(F.col("_id").alias(key), F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)))
