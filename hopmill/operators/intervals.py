"""Joins of half-open intervals inside a context: overlaps by bins, and what a running window knows at a place."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Characters in a bin.
BIN = 64


def overlapping(a: DataFrame, b: DataFrame, keys: list[str], width: int = BIN) -> DataFrame:
    """Pairs of intervals of one context with a common character: a's columns, and b's as other_start and other_end.

    Intervals are dealt into the bins that they touch; a pair meets by bin and is given in the first bin that both touch, so
    rows grow with the intervals and the pairs that there are. Empty intervals have no character and no pair; a null key
    meets nothing.
    """
    binned = lambda df, s, e: df.where(F.col(s) < F.col(e)).withColumn("_bin", F.explode(F.sequence(F.floor(F.col(s) / width), F.floor((F.col(e) - 1) / width))))
    other = binned(b.select(*keys, F.col("start").alias("other_start"), F.col("end").alias("other_end")), "other_start", "other_end")
    both = binned(a, "start", "end").join(other, [*keys, "_bin"])
    first = F.col("_bin") == F.floor(F.greatest("start", "other_start") / width)
    return both.where(first & (F.col("start") < F.col("other_end")) & (F.col("other_start") < F.col("end"))).drop("_bin")


def against_cuts(rows: DataFrame, cuts: DataFrame, keys: list[str]) -> DataFrame:
    """rows (with start, end) with hit (a cut has a common character) and shift (length of the cuts that end at or before start).

    Ends and starts of cuts, and the two ends of each row, pass by in the order of place under running sums: no list of cuts
    is held beside a row. Of a row that overlaps nothing, as many cuts start before its end as end by its start.
    """
    own = F.struct(*(F.col(c) for c in rows.columns)).alias("_own")
    asks = rows.withColumn("_id", F.monotonically_increasing_id()).select("*", F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("turn")), F.struct(F.col("end").alias("at"), F.lit(2).alias("turn")))).alias("_e"))
    asks = asks.select(*keys, "_id", own, "_e.at", "_e.turn", F.lit(0).alias("_count"), F.lit(0).alias("_length"))
    ends = cuts.where(F.col("start") < F.col("end")).select(*keys, F.explode(F.array(F.struct(F.col("end").alias("at"), F.lit(0).alias("turn"), (F.col("end") - F.col("start")).alias("length")), F.struct(F.col("start").alias("at"), F.lit(3).alias("turn"), F.lit(0).alias("length")))).alias("_e"))
    ends = ends.dropna(subset=keys).select(*keys, "_e.at", "_e.turn", F.lit(1).alias("_count"), F.col("_e.length").alias("_length"))
    w = Window.partitionBy(*keys).orderBy("at", "turn").rowsBetween(Window.unboundedPreceding, 0)
    upto = lambda turn, c: F.coalesce(F.sum(F.when(F.col("turn") == turn, F.col(c))).over(w), F.lit(0))
    seen = asks.unionByName(ends, allowMissingColumns=True).withColumns({"_closed": upto(0, "_count"), "_shift": upto(0, "_length"), "_opened": upto(3, "_count")}).where("_id is not null")
    at = lambda turn, c: F.max(F.when(F.col("turn") == turn, F.col(c)))
    out = seen.groupBy("_id").agg(F.first("_own").alias("_own"), at(1, "_closed").alias("_closed"), at(1, "_shift").alias("shift"), at(2, "_opened").alias("_opened"))
    return out.select("_own.*", (F.col("_opened") > F.col("_closed")).alias("hit"), F.col("shift").cast("int").alias("shift"))
