"""Merkle manifest of a dataset: every row's proof up to one root, by rolling nodes up in bounded blocks of nested structs.

Rows are ranked within their group. The base-3 digits of the rank are columns; within a block of BASE ** DEPTH ranks they
are grouped away one after the other, each step nesting the children's structs under their parent. A transform then writes
each child's siblings beside it and an explode hands them down, level by level, so a block's proofs need no join. Blocks
are the leaves of the next tier; what lies above a block comes back to it as one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopmill.llm.common import small, stash
from hopmill.llm.sharding import prefix_sums

#: Nodes of a run, and levels that one tier rolls up: a block is one row of at most BASE ** DEPTH leaves (some 100 KB).
BASE, DEPTH = 3, 6


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of the parts, concatenated."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """A field as a leaf hashes it: - if null, else its UTF-8 byte count, a colon and the value, integers in decimal."""
    v = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-"))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path (array of left and right siblings, from the leaf up) give."""
    return F.aggregate(path, leaf, lambda acc, step: digest(step["left"], acc, step["right"]))


def siblings(path: Column) -> Column:
    """All sibling digests of a path, level by level and from left to right, in one string."""
    return F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), "")


def _levels(count: Column) -> Column:
    """Rounds until one node remains: the powers of BASE below the count."""
    return F.size(F.filter(F.array(*(F.lit(BASE**i).cast("long") for i in range(39))), lambda p: p < count))


def _rolled(nodes: DataFrame) -> DataFrame:
    """One row (_tree, _block, _levels, _node) for each block of nodes (_tree, _rank, _levels, _h, _row): digits grouped away, structs nested.

    A round beyond a tree's levels has one child, whose digest goes up as it is.
    """
    digits = [f"_d{j}" for j in range(DEPTH)]
    keys = ["_tree", "_block", "_levels"]
    rows = nodes.select("_tree", "_levels", F.expr(f"_rank div {BASE**DEPTH}").alias("_block"), *(F.expr(f"cast(_rank div {BASE**j} % {BASE} as int)").alias(d) for j, d in enumerate(digits)), F.struct(F.col("_h").alias("h"), F.col("_row").alias("kids")).alias("_node"))
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(parts, "_tree", "_block")  # the groupings below need no other exchange
    for j, d in enumerate(digits):
        kids = F.transform(F.array_sort(F.collect_list(F.struct(F.col(d).alias("d"), F.col("_node").alias("n")))), lambda k: k["n"])
        rows = rows.groupBy(*keys, *digits[j + 1 :]).agg(kids.alias("_kids"))
        up = F.array_join(F.transform("_kids", lambda k: k["h"]), "")
        rows = rows.select(*keys, *digits[j + 1 :], F.struct(F.when(F.col("_levels") > j, F.sha2(up, 256)).otherwise(up).alias("h"), F.col("_kids").alias("kids")).alias("_node"))
    return rows


def _unrolled(blocks: DataFrame) -> DataFrame:
    """The leaves of blocks again, each with _row, _h and its _path prolonged downwards: transform, then explode, for each level."""
    rest = [c for c in blocks.columns if c not in ("_node", "_path")]
    rows = blocks
    for j in reversed(range(DEPTH)):
        kids = F.col("_node.kids")
        hashes = F.transform(kids, lambda k: k["h"])
        step = lambda i, h: F.when(F.col("_levels") > j, F.struct(F.array_join(F.slice(h, F.lit(1), i), "").alias("left"), F.array_join(F.slice(h, i + 2, F.lit(BASE)), "").alias("right")))  # noqa: B023, E731
        each = F.transform(kids, lambda k, i: F.struct(k.alias("node"), step(i, hashes).alias("step")))  # noqa: B023
        rows = rows.select(*rest, "_path", F.explode(each).alias("_k"))
        rows = rows.select(*rest, F.array_compact(F.concat(F.array("_k.step"), "_path")).alias("_path"), F.col("_k.node").alias("_node"))
    return rows.select(*rest, "_path", F.col("_node.h").alias("_h"), F.col("_node.kids").alias("_row"))


def _proved(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(blocks with the _path above them and the _top of their tree, tops): tiers of blocks until every tree is one block."""
    blocks = stash(_rolled(nodes), "blocks")
    if (blocks.agg(F.max("_levels")).first()[0] or 0) <= DEPTH:
        return blocks.withColumns({"_path": F.array().cast("array<struct<left string, right string>>"), "_top": F.col("_node.h")}), blocks.select("_tree", F.col("_node.h").alias("_top"))
    above, tops = _proved(blocks.select("_tree", F.col("_block").alias("_rank"), F.greatest(F.col("_levels") - DEPTH, F.lit(0)).alias("_levels"), F.col("_node.h").alias("_h"), F.struct(F.col("_block").alias("at")).alias("_row")))
    paths = _unrolled(above).select("_tree", F.col("_row.at").alias("_block"), "_path", "_top")
    return blocks.join(small(stash(paths, "paths")), ["_tree", "_block"]), tops


def manifest(rows: DataFrame, group: str | None, order: list[str], fields: list[str], tampered: Column | None = None) -> DataFrame:
    """(order columns, group, leaf, subroot, root, path, tampered_leaf): the proof of each row.

    A row's leaf is the digest of its fields. Leaves of a group ascend by the order columns (nulls first, ties by the
    leaf); while several nodes remain, every BASE consecutive ones (the last run may be shorter, even one) become their
    digest. What remains is the subroot; the subroots in the order of their groups (null first, then UTF-8 bytewise) give
    root in the same way. path goes from the leaf to the root: left and right siblings of each level, concatenated.
    tampered, if given, stands for the last field in tampered_leaf, which a check folds along the original path.

    Hashing is map-side; digests alone are shuffled: once into ranges of the order (ranks are sums of the ranges' sizes, so
    a large group is many ranges), once into blocks. Tasks hold a few blocks of bounded size, whatever the groups. The
    join that takes the paths of higher tiers back has one row a block.

    Null fields are -, empty texts 0:, and texts of any length are hashed whole. Rows equal in order columns and fields
    have equal leaves and places of their own. A group of one row has its leaf as subroot, and a single group its subroot
    as root. An empty table gives an empty one. Other columns are not read; the result's names are its own.
    """
    leaf = digest(*(field(F.col(c)) for c in fields))
    other = leaf if tampered is None else digest(*(field(F.col(c)) for c in fields[:-1]), field(tampered))
    changed = F.lit(False) if tampered is None else ~tampered.eqNullSafe(F.col(fields[-1]))
    own = F.col(group) if group else F.lit(None).cast("string")
    slim = rows.select(own.alias("_group"), *(F.col(c).alias(f"_o{i}") for i, c in enumerate(order)), leaf.alias("_h"), F.when(changed, other).alias("_other"))
    keys = [f"_o{i}" for i in range(len(order))]
    placed = stash(prefix_sums(stash(slim.withColumn("_one", F.lit(1)), "leaves"), ["_group", *keys, "_h"], "_one").drop("_before", "_one"), "ranked")
    groups = placed.groupBy("_group").agg(F.min("_rank").alias("_first"), F.count("*").alias("_size"), F.lit(1).alias("_one"))
    groups = stash(prefix_sums(stash(groups, "groups"), ["_group"], "_one").select("_group", "_first", F.col("_rank").alias("_tree"), _levels(F.col("_size")).alias("_levels")), "trees")
    known = small(groups.withColumnRenamed("_group", "_own"))
    nodes = placed.join(known, F.col("_group").eqNullSafe(F.col("_own"))).select("_tree", (F.col("_rank") - F.col("_first")).alias("_rank"), "_levels", "_h", F.struct("_group", *keys, "_other").alias("_row"))
    blocks, tops = _proved(nodes)
    tops = stash(tops, "subroots")
    above, _ = _proved(tops.select(F.lit(0).cast("long").alias("_tree"), F.col("_tree").alias("_rank"), _levels(F.lit(tops.count()).cast("long")).alias("_levels"), F.col("_top").alias("_h"), F.struct(F.col("_tree").alias("at")).alias("_row")))
    roots = _unrolled(above).select(F.col("_row.at").alias("_tree"), F.col("_path").alias("_upper"), F.col("_top").alias("_root"))
    leaves = _unrolled(blocks.join(small(stash(roots, "roots")), "_tree"))
    return leaves.select(*(F.col(f"_row._o{i}").alias(c) for i, c in enumerate(order)), F.col("_row._group").alias(group or "group"), F.col("_h").alias("leaf"), F.col("_top").alias("subroot"), F.col("_root").alias("root"), F.concat("_path", "_upper").alias("path"), F.coalesce("_row._other", "_h").alias("tampered_leaf"))
