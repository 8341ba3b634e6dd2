"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hopmill.llm.common import small, stash

#: Leading hex digits of a row's seeded key: each source falls into so many slices, of which at most one is cut.
SLICE = 3
INNER = ("_key", "_slice", "_size", "_source", "_whole", "_rest", "_edge", "_edge_before", "_run", "_more", "_n")


def water_fill(sizes: DataFrame, budget: Column, max_epochs: float) -> DataFrame:
    """sizes has one row for each source: source, source_size (long, >= 0), weight (> 0). Adds target (double).

    Targets share the budget by weight; a source stops at max_epochs times its size and what it leaves goes to the others
    by weight, again and again until none is above. Sorted by cap / weight, the stopped sources are a prefix, so the
    last round's level is found with running sums: the first source whose own cap is not below the level that holds when
    all before it are stopped, sets it. One row for each source meets in one task, nothing else.
    An empty table gives an empty one. If all caps together are below the budget, all sources stop at their caps.
    """
    cap = F.col("source_size") * F.lit(float(max_epochs))
    by = Window.orderBy(cap / F.col("weight"), F.col("source").asc_nulls_last())
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0))
    s = sizes.withColumns({
        "_cap": cap,
        "_left": budget.cast("double") - F.coalesce(F.sum(cap).over(before), F.lit(0.0)),
        "_weight": F.sum(F.col("weight").cast("double")).over(every) - F.coalesce(F.sum(F.col("weight").cast("double")).over(before), F.lit(0.0)),
    }).withColumn("_stops", F.col("_left") / F.col("_weight") >= F.col("_cap") / F.col("weight"))
    first = F.min(F.when(~F.col("_stops"), F.struct(F.col("_weight") * -1, "_left", "_weight"))).over(every)
    s = s.withColumn("_first", first)
    target = F.when(F.col("_stops"), F.col("_cap")).otherwise(F.col("weight") * F.col("_first._left") / F.col("_first._weight"))
    return s.withColumn("target", target).drop("_cap", "_left", "_weight", "_stops", "_first")


def cyclic_weights(sizes: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0)) -> DataFrame:
    """Weights given in turn to the sources by code point, the null source last."""
    n = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    return sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (n % len(weights) + 1).cast("int")))


def mix(rows: DataFrame, weigh=cyclic_weights, key: str = "doc_id", source: str = "source", size: str = "size", max_epochs: float = 3.0, seed: str = "mix-1") -> DataFrame:
    """rows with source_size, target and repeats (int): how often the mix takes the row whole.

    The budget is the sum of all sizes. A source with target T and size S takes each row floor(T / S) times, and once
    more the rows that come first in the order of md5(seed, key) until the rest of the target is used; the row on the
    edge counts if its middle is inside, so a source misses its target by half a row at most, and no row is taken more
    than max_epochs times. The order is cut without sorting a source: sums of 16**SLICE slices of the key show the
    one slice with the edge, and only that slice is sorted.

    Nulls: a null source is a source of its own; a null key is hashed as an empty one; a null size is 0. Rows with the
    same key tie in the order and are then ordered by size. An empty table gives an empty one. Other columns are kept;
    columns named like the new ones are replaced.
    """
    rows = rows.drop("source_size", "target", "repeats", *INNER)
    keyed = rows.withColumns({"_size": F.coalesce(F.col(size).cast("long"), F.lit(0)), "_key": F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))))}).withColumn("_slice", F.substring("_key", 1, SLICE))
    slices = stash(keyed.groupBy(F.col(source).alias("source"), "_slice").agg(F.sum("_size").alias("_size")), "slices")
    sizes = slices.groupBy("source").agg(F.sum("_size").alias("source_size"))
    targets = water_fill(weigh(sizes), F.sum("source_size").over(Window.partitionBy(F.lit(0))), max_epochs)
    rate = F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))
    targets = targets.select(F.col("source").alias("_source"), "source_size", "target", F.floor(rate).cast("int").alias("_whole")).withColumn("_rest", F.col("target") - F.col("_whole") * F.col("source_size"))
    upto = Window.partitionBy("source").orderBy("_slice")
    run = slices.withColumn("_after", F.sum("_size").over(upto)).withColumn("_before", F.col("_after") - F.col("_size"))
    cut = run.join(targets, F.col("source").eqNullSafe(F.col("_source"))).groupBy("_source", "source_size", "target", "_whole", "_rest").agg(F.max(F.when(F.col("_before") <= F.col("_rest"), F.struct("_slice", "_before"))).alias("_cut"))
    cut = small(stash(cut.select("_source", "source_size", "target", "_whole", "_rest", F.col("_cut._slice").alias("_edge"), F.col("_cut._before").alias("_edge_before")), "cuts"))
    joined = keyed.join(cut, F.col(source).eqNullSafe(F.col("_source")))
    plain = joined.where("_slice <> _edge").withColumn("_more", (F.col("_slice") < F.col("_edge")).cast("int"))
    order = Window.partitionBy("_source").orderBy("_key", key, "_size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = joined.where("_slice = _edge").withColumn("_run", F.sum("_size").over(order))
    edge = edge.withColumn("_more", (2 * (F.col("_edge_before") + F.col("_run")) - F.col("_size") <= 2 * F.col("_rest")).cast("int"))
    both = plain.unionByName(edge.drop("_run"))
    both = both.withColumn("repeats", F.when(F.col("_rest") > 0, F.col("_whole") + F.col("_more")).otherwise(F.col("_whole")))
    return both.select(*rows.columns, "source_size", "target", "repeats")


def repeat(mixed: DataFrame) -> DataFrame:
    """Each row as often as the mix takes it."""
    return mixed.where("repeats > 0").withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("repeats")))).drop("_n")
