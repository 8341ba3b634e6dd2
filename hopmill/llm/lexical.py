"""Ranked lexical search for many queries at once: shared term sets, accumulators filled once a document, a query-sharing DAG.

Items are dealt into blocks of bounded size. In each block the terms that the same items hold are one shared set, and sets
that stand side by side in several items (in the order of their use) are joined into nodes, round by round: a DAG of sums.
A document's partial sum of each set is computed once, each node adds two earlier ones, and each item adds what is left.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hopmill.llm.common import ascii_lower, small_batches, stash
from hopmill.llm.sharding import prefix_sums

#: Terms are runs of letters and digits in ASCII and of whatever lies above.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SEPARATOR = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
#: Pairs of item and term in a block (a plan of a few MB), accumulators that a task holds at a time (32 MB), and characters of a text that are cut up at a time.
ENTRIES, CELLS, PIECE = 200_000, 1 << 22, 1 << 20
PLAN = "_block long, terms array<string>, term_set array<int>, left array<int>, right array<int>, items array<long>, starts array<int>, nodes array<int>"
COUNTS = "_doc long, _n long, _terms array<int>, _tf array<int>"


def shared_plan(held: dict[int, set[str]]) -> dict:
    """The DAG of a block: held has the terms of each item, none of them empty.

    terms and term_set: each term and its shared set; left and right: the two earlier nodes that each further node adds
    (sets come first in the numbering); items, starts and nodes: the nodes that each item adds.
    """
    where = defaultdict(list)
    for i in sorted(held):
        for t in held[i]:
            where[t].append(i)
    together = defaultdict(list)
    for t in sorted(where):
        together[tuple(where[t])].append(t)
    sets = sorted(together, key=lambda s: (-len(s), s))
    terms = [(t, n) for n, s in enumerate(sets) for t in together[s]]
    rows: dict[int, list[int]] = {i: [] for i in sorted(held)}
    for n, s in enumerate(sets):
        for i in s:
            rows[i].append(n)
    left, right = [], []
    while True:
        seen = Counter(p for r in rows.values() for p in zip(r, r[1:], strict=False))
        new = {p: len(sets) + len(left) + k for k, p in enumerate(sorted(p for p, n in seen.items() if n > 1))}
        if not new:
            break
        left += [p[0] for p in new]
        right += [p[1] for p in new]
        for i, r in rows.items():
            out, at = [], 0
            while at < len(r):
                p, q = tuple(r[at : at + 2]), tuple(r[at + 1 : at + 3])
                if p in new and not (q in new and seen[q] > seen[p]):
                    out.append(new[p])
                    at += 2
                else:
                    out.append(r[at])
                    at += 1
            rows[i] = out
    starts = np.cumsum([0, *(len(r) for r in rows.values())])[:-1]
    return {"terms": [t for t, _ in terms], "term_set": [n for _, n in terms], "left": left, "right": right, "items": list(rows), "starts": starts.tolist(), "nodes": [n for r in rows.values() for n in r]}


def _planned(rows: pd.DataFrame) -> pd.DataFrame:
    held = defaultdict(set)
    for i, t in zip(rows["_query"], rows["_term"], strict=True):
        held[int(i)].add(t)
    return pd.DataFrame([{"_block": rows["_block"].iloc[0]} | shared_plan(held)])


def _pieces(text: str) -> Iterator[str]:
    """The text in parts of about PIECE characters, cut between terms."""
    at = 0
    while at < len(text):
        m = re.compile(SEPARATOR).search(text, at + PIECE)
        end = m.start() if m else len(text)
        yield text[at:end]
        at = end


def _counted(terms: list[str]):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, term = {t: n for n, t in enumerate(terms)}, re.compile(TERM)
        for batch in batches:
            docs, sizes, found, times = [], [], [], []
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                n, counts = 0, Counter()
                for piece in _pieces(text.as_py() or ""):
                    words = term.findall(piece)
                    n += len(words)
                    counts.update(words)
                if n:
                    got = sorted((place[t], k) for t, k in counts.items() if t in place)
                    docs.append(doc.as_py())
                    sizes.append(n)
                    found.append([t for t, _ in got])
                    times.append([k for _, k in got])
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int32()))], ["_doc", "_n", "_terms", "_tf"])

    return of


def _best(rows: np.ndarray, top: int) -> np.ndarray:
    """The `top` best rows (item, -score, null, doc) of each item, in order."""
    rows = rows[np.lexsort(rows.T[::-1])]
    first = np.r_[True, rows[1:, 0] != rows[:-1, 0]] if len(rows) else np.zeros(0, bool)
    start = np.maximum.accumulate(np.where(first, np.arange(len(rows)), 0))
    return rows[np.arange(len(rows)) - start < top]


def _scored(plan: dict, weights: np.ndarray, docs: int, words: int, top: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = max(plan["term_set"]) + 1
        left, right, term_set = (np.array(plan[c], np.int64) for c in ("left", "right", "term_set"))
        starts, nodes, count = np.array(plan["starts"]), np.array(plan["nodes"]), sets + len(left)
        depth = [0] * count  # nodes of one depth are added up together
        for n, (x, y) in enumerate(zip(plan["left"], plan["right"], strict=True)):
            depth[sets + n] = 1 + max(depth[x], depth[y])
        inner = np.array(depth[sets:])
        rounds = [np.flatnonzero(inner == d) for d in range(1, max(depth) + 1)]
        step = max(1, CELLS // max(count, len(nodes)))
        best, least = np.zeros((0, 4), np.int64), np.ones(len(starts), np.int64)
        for batch in batches:
            for at in range(0, len(batch), step):
                part = batch.slice(at, step)
                ids = part.column(0)
                null = np.asarray(ids.is_null())
                doc, n = np.asarray(ids.fill_null(0)), part.column(1).to_pylist()
                m = np.array([100 - 90 + 90 * x * docs // words for x in n], np.int64)
                term = np.asarray(part.column(2).flatten())
                tf = np.asarray(part.column(3).flatten()).astype(np.int64)
                own = np.repeat(np.arange(len(part)), np.asarray(part.column(2).value_lengths()))
                sums = np.zeros((count, len(part)), np.int64)
                np.add.at(sums, (term_set[term], own), weights[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[own])))
                for r in rounds:
                    sums[sets + r] = sums[left[r]] + sums[right[r]]
                score = np.add.reduceat(sums[nodes], starts, axis=0)
                if len(part) > top:  # no row below a block's own best can be among the best
                    score[score < np.partition(score, len(part) - top, axis=1)[:, -top, None]] = 0
                item, j = np.nonzero(score >= least[:, None])
                best = _best(np.concatenate([best, np.stack([item, -score[item, j], null[j].astype(np.int64), doc[j]], 1)]), top)
                full = np.flatnonzero(np.bincount(best[:, 0], minlength=len(starts)) == top)
                ends = np.searchsorted(best[:, 0], full, "right") - 1
                least[full] = -best[ends, 1]
        yield pa.RecordBatch.from_arrays([pa.array(best[:, 0]), pa.array(best[:, 3], mask=best[:, 2] > 0), pa.array(-best[:, 1])], ["_at", "_doc", "score"])

    return of


def ranked(docs: DataFrame, queries: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", top: int = 10) -> DataFrame:
    """(item, rank, key, score): the `top` documents with the highest score above 0 for each item, ties by ascending key.

    Terms are those of TERM in the whole text, A-Z lower-cased. N documents hold a term, L is all their terms with
    repeats; a document has n terms, m = 100 - 90 + 90 * n * N div L; a term in df documents weighs
    w = floor(1000 * ln((2 * N + 2) / (2 * df + 1))); a document's score sums w * (1000000000 * tf div (1000 * tf + 8 * m))
    over the distinct terms of the item, in whole numbers.

    Documents are read once for each block of items (ENTRIES pairs of item and term; one block as a rule): a task counts
    the block's terms in each text, and only those counts are written. A second pass fills the accumulators a batch of
    documents at a time and returns its best `top` rows for each item, which are all that is shuffled. The plan of a
    block is bounded by ENTRIES (or by one item's text).

    Rows that share an item are one item with the terms of all their texts, also where it is null; items without terms
    give no rows. Null and wordless texts are not counted as documents; a null key comes last among equal scores; repeated
    documents count and rank each. Texts are cut up whole, a piece at a time. If either table is empty so is the result.
    Other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    held = queries.select(F.col(item).cast("long").alias("_item"), F.explode(F.regexp_extract_all(ascii_lower(F.coalesce(item_text, F.lit(""))), F.lit(TERM), F.lit(0))).alias("_term")).distinct()
    held = stash(held, "item-terms")
    sizes = prefix_sums(held.groupBy("_item").agg(F.count("*").alias("_size")), ["_item"], "_size")
    sizes = stash(sizes.select(F.col("_item").alias("_own"), F.col("_rank").cast("long").alias("_query"), F.expr(f"_before div {ENTRIES}").alias("_block")), "items")
    entries = held.join(sizes, F.col("_item").eqNullSafe(F.col("_own"))).select("_block", "_query", "_term")
    plans = stash(entries.groupBy("_block").applyInPandas(_planned, PLAN), "plans")
    texts = docs.select(F.col(key).cast("long").alias("_doc"), ascii_lower(F.col(text)).alias("_text"))
    out, total = None, None
    for (block,) in plans.select("_block").orderBy("_block").collect():
        plan = plans.where(F.col("_block") == block).first().asDict()  # bounded by ENTRIES
        counts = stash(texts.mapInArrow(_counted(plan["terms"]), COUNTS), "counts")
        total = total or counts.agg(F.count("*"), F.sum("_n")).first()
        df = {r[0]: r[1] for r in counts.select(F.explode("_terms").alias("_t")).groupBy("_t").count().collect()}
        weights = np.array([math.floor(1000 * math.log((2 * total[0] + 2) / (2 * df.get(t, 0) + 1))) for t in range(len(plan["terms"]))], np.int64)
        found = counts.where(F.size("_terms") > 0).mapInArrow(_scored({k: plan[k] for k in plan if k != "terms"}, weights, total[0], total[1], top), "_at long, _doc long, score long")
        names = F.broadcast(spark.createDataFrame([(n, q) for n, q in enumerate(plan["items"])], "_at long, _query long"))
        found = found.join(names, "_at").select("_query", "_doc", "score")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], "_query long, _doc long, score long")
    order = Window.partitionBy("_query").orderBy(F.desc("score"), F.asc_nulls_last("_doc"))
    out = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return out.join(sizes, "_query").select(F.col("_own").alias(item), "rank", F.col("_doc").alias(key), "score")
