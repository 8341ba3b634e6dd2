"""Near duplicates by SetSketch registers: banded, estimated jointly by likelihood, then verified on full sets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopmill.llm.arrays import chunks, flat, mixed, shingle_sets
from hopmill.llm.common import small, small_batches, stash
from hopmill.llm.components import components

#: Registers are floor(1 - log_b(least exponential value)) within 0 and Q + 1, so values are spaced by the factor b.
BASE_B, RATE_A, Q = 1.001, 20.0, (1 << 16) - 2
BANDS, ROWS = 36, 6
#: Members of a candidate group compared in one piece; larger groups are compared piece by piece.
BLOCK = 256
#: What places a candidate in a group of pairs to compare.
PLACE = ("_component", "_side", "_group", "_i", "_j")
#: Pairs whose estimate is so many standard deviations below the threshold are not verified.
DEVIATIONS = 5.0
#: Rows of a table that is broadcast here, of which the driver holds several; larger ones are shuffled, candidates with their texts.
BROADCAST = 100_000


def _factors() -> tuple[np.ndarray, np.ndarray]:
    seeds = mixed(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    odd = (seeds >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    return odd[: BANDS * ROWS], odd[BANDS * ROWS :]


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """SetSketch registers (uint16, one row for each set): mergeable by maximum. Sets must not be empty.

    Each register has its own hash of the elements, whose least value u stands for the least of exponential values
    -ln(1 - u) / a; register = floor(1 - log_b of that), truncated to 0 and Q + 1.
    """
    flat_set = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    lo, hi = flat_set.astype(np.uint32), (flat_set >> np.uint64(32)).astype(np.uint32)
    least = np.empty((len(sets), BANDS * ROWS), np.uint32)
    h, t = np.empty_like(lo), np.empty_like(lo)
    for i, (a, b) in enumerate(zip(*_factors(), strict=True)):
        np.multiply(lo, a, out=h)
        np.multiply(hi, b, out=t)
        np.add(h, t, out=h)
        least[:, i] = np.minimum.reduceat(h, starts)
    x = -np.log1p(-(least + 0.5) / 2.0**32) / RATE_A
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE_B)), 0, Q + 1).astype(np.uint16)


def joint_estimate(greater: np.ndarray, less: np.ndarray, equal: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """The similarity of greatest likelihood, from how many registers are greater, less and equal and the sets' sizes.

    With u = n_a / (n_a + n_b) and v = 1 - u, a register is greater with probability u - vJ and less with v - uJ (bases
    near 1); the likelihood's derivative is a quadratic in J.
    """
    u = n_a / (n_a + n_b)
    v = 1 - u
    m = greater + less + equal
    b = equal * (u * u + v * v) + greater * v * v + less * u * u
    root = np.sqrt(np.maximum(b * b - 4 * u * u * v * v * m * equal, 0))
    return np.clip((b - root) / (2 * u * v * m), 0, np.minimum(u / v, v / u))


def _sketched(words: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column(1))
            for i, j, part, at in chunks(data, offsets):
                sets = shingle_sets(part, at, words)
                full = [s for s in sets if len(s)]
                digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                keys: list = [None] * len(sets)
                if full:
                    r = registers(full).astype(np.uint64).reshape(len(full), BANDS, ROWS)
                    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(full), BANDS))
                    for row in range(ROWS):
                        h = mixed(h * np.uint64(0xD6E8FEB86659FD93) + r[:, :, row])
                    rows = iter(h.astype(np.int64))
                    keys = [next(rows) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["_id", "n_shingles", "digest", "bands"])

    return of


def _with_sets(words: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column(1))
            for i, j, part, at in chunks(data, offsets):
                sets = shingle_sets(part, at, words)
                full = [k for k, s in enumerate(sets) if len(s)]
                if full:
                    r = registers([sets[k] for k in full])
                    ids = batch.column(0)[i:j].take(pa.array(full))
                    places = batch.column(2)[i:j].take(pa.array(full))
                    yield pa.RecordBatch.from_arrays([ids, places, pa.array([sets[k].tobytes() for k in full], pa.binary()), pa.array([x.tobytes() for x in r], pa.binary())], ["_node", "places", "shingles", "registers"])

    return of


def _linked(group: list[np.ndarray], r: np.ndarray, side: np.ndarray, across: bool, per: int, cent: int) -> list[tuple[int, int]]:
    """Pairs of a spanning forest of the links in a group: a pair is compared only while its two are not yet connected."""
    n = np.array([len(s) for s in group])
    label = np.arange(len(group))
    least = per / cent - DEVIATIONS * np.sqrt(per / cent * (1 - per / cent) / r.shape[1])
    edges = []
    for p in range(len(group) - 1):
        mask = (label[p + 1 :] != label[p]) & (cent * np.minimum(n[p + 1 :], n[p]) >= per * np.maximum(n[p + 1 :], n[p]))
        if across:
            mask &= side[p + 1 :] != side[p]
        c = np.flatnonzero(mask) + p + 1
        if not len(c):
            continue
        greater, equal = (r[c] < r[p]).sum(1), (r[c] == r[p]).sum(1)
        c = c[joint_estimate(greater, r.shape[1] - greater - equal, equal, n[p], n[c]) >= least]
        if not len(c):
            continue
        theirs = np.concatenate([group[k] for k in c])
        found = np.searchsorted(group[p], theirs)
        found[found == n[p]] = 0
        inter = np.add.reduceat((group[p][found] == theirs).astype(np.int64), np.cumsum([0, *n[c[:-1]]]))
        for k in c[cent * inter >= per * (n[p] + n[c] - inter)]:
            if label[k] != label[p]:
                label[label == label[k]] = label[p]
                edges.append((p, k))
    return edges


def _verified(per: int, cent: int):
    def of(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        a, b = [], []
        for _, g in rows.groupby("_component", sort=False):
            sets = [np.frombuffer(x, np.uint64) for x in g["shingles"]]
            r = np.stack([np.frombuffer(x, np.uint16) for x in g["registers"]])
            nodes = g["_node"].to_numpy()
            for i, j in _linked(sets, r, g["_side"].to_numpy(), key[1] != key[2], per, cent):
                a.append(nodes[i])
                b.append(nodes[j])
        return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    return of


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, per: int = 80, cent: int = 100) -> DataFrame:
    """(key, n_shingles, component_id, kept) for each row: groups of documents connected by a similarity of per / cent or more.

    1. One pass over the texts makes each one's set of shingles and from it its size, a 128-bit digest and the keys of
       its bands; texts of one digest are one node, named by their smallest key, whatever their number.
    2. Nodes that share a band key meet at the key's smallest node: as many pairs as nodes, never all pairs of a bucket.
       The connected components of those pairs are candidate groups; every link whose bands met lies inside one.
    3. Only texts in candidate groups are read again. Inside a group a pair is compared while its two are not connected:
       first by the joint estimate, then on full sets. Small groups share tasks; a large one is dealt into blocks, and
       each pair of blocks is a task of bounded size.
    4. The verified links' connected components are the result.

    A link at the threshold is missed if none of 36 bands of 6 registers agrees (2 in 100,000), or if the joint estimate
    from 216 registers is five standard deviations too low (less than 1 in a million). Texts are taken whole, a long one alone in its chunk.

    Words are lower-cased (A-Z). Texts of fewer words than a shingle are one shingle; null and wordless texts have none,
    link with nothing and are kept. A null key links with nothing, has a null component and is kept. Rows that share a
    key are one document for linking; each gets its row. An empty table gives an empty one. Other columns are not read.
    """
    small_batches(docs.sparkSession)
    slim = docs.select(F.col(key).cast("long").alias("_id"), F.col(text).alias("_text"))
    s = stash(slim.mapInArrow(_sketched(words), "_id long, n_shingles long, digest binary, bands array<long>"), "sketches")
    nodes = stash(s.where("digest is not null and _id is not null").groupBy("digest").agg(F.min("_id").alias("node"), F.first("bands").alias("bands")), "nodes")
    banded = nodes.select("node", F.explode("bands").alias("band"))
    met = stash(banded.groupBy("band").agg(F.min("node").alias("pivot"), F.count("*").alias("n")).where("n > 1").select("band", "pivot"), "buckets")
    pairs = banded.join(small(met, BROADCAST), "band").where("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()
    candidates = stash(components(pairs).select(F.col("node").alias("_node"), F.col("component").alias("_component")), "candidates")
    sizes = candidates.groupBy("_component").agg(F.count("*").alias("_size"))
    total = candidates.count()
    blocks = F.ceil(F.col("_size") / BLOCK).cast("int")
    dealt = candidates.join(sizes, "_component").withColumn("_blocks", blocks).withColumn("_side", F.pmod(F.xxhash64("_node"), F.col("_blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_other")
    dealt = dealt.select("_node", "_component", "_blocks", "_side", other).select(
        "_node",
        "_component",
        "_side",
        F.when(F.col("_blocks") > 1, F.col("_component")).otherwise(-1 - F.pmod(F.xxhash64("_component"), F.lit(1 + total // (2 * BLOCK)))).alias("_group"),
        F.least("_side", "_other").alias("_i"),
        F.greatest("_side", "_other").alias("_j"),
    )
    places = dealt.groupBy(F.col("_node").alias("_id")).agg(F.collect_list(F.struct(*PLACE)).alias("places"))
    places = stash(places, "places")
    near = small(places, BROADCAST)
    near = places.hint("shuffle_hash") if near is places else near  # texts that are shuffled need not be sorted
    sets = slim.join(near, "_id").select("_id", "_text", "places").mapInArrow(_with_sets(words), f"_node long, places {places.schema['places'].dataType.simpleString()}, shingles binary, registers binary")
    links = sets.select("_node", "shingles", "registers", F.inline("places")).groupBy("_group", "_i", "_j").applyInPandas(_verified(per, cent), "a long, b long")
    groups = components(links).withColumnsRenamed({"component": "_found"})
    of = nodes.join(groups, "node", "left").select("digest", F.coalesce("_found", "node").alias("_found"))
    out = s.select("_id", "n_shingles", "digest").join(of, "digest", "left")
    own = F.when(F.col("_id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("_found", "_id"))
    return out.select(F.col("_id").alias(key), "n_shingles", own.alias("component_id")).withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)))


def deduplicated(docs: DataFrame, key: str = "doc_id", **more) -> DataFrame:
    """docs without near duplicates: of each group the document with the smallest key stays; rows without a key stay.

    Of several rows with that key one stays, of equal texts any.
    """
    gone = stash(near_duplicates(docs, key, **more).where("not kept").select(F.col(key).alias("_gone")).distinct(), "gone")
    left = docs.join(small(gone), F.col(key) == F.col("_gone"), "left_anti")
    twice = stash(docs.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").select(F.col(key).alias("_twice")), "twice")
    if not twice.count():
        return left
    once = left.join(small(twice), F.col(key) == F.col("_twice"), "left_anti")
    rest = left.join(small(twice), F.col(key) == F.col("_twice"), "left_semi").dropDuplicates([key])
    return once.unionByName(rest)
