"""Places of rows in an order, and pages of it, where no task sorts more than a range of the rows.

Ranges are cut at quantiles of the whole sort key, so a hot first column is split by the columns after it.
"""

from __future__ import annotations

from bisect import bisect_right
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hopmill.functions.strings import let
from hopmill.sources.shared import written

#: Rows of a range that one task sorts.
RANGE_ROWS = 1_000_000
#: Ranges that a page is sought among at each step, and rows sampled for each cut.
CUTS, SAMPLED = 32, 64


def positions(rows: DataFrame, order: list[Column], name: str = "position", range_rows: int = RANGE_ROWS) -> DataFrame:
    """rows with their place (from 0, gapless) in the order; rows that tie in all of it come in any order.

    One range shuffle; ranges are written with each row's place in its own, since cuts are sampled and would move if rows
    were computed again. Then the totals of the ranges before are added, a row a range. An empty table gives an empty one.
    """
    spark = rows.sparkSession
    parts = max(-(-rows.count() // range_rows), int(spark.conf.get("spark.sql.shuffle.partitions")))
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("_range"), inside.alias("_inside"))
    ranged = written(ranged, "ranges")
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_range", before.alias("_before"))
    return ranged.join(offsets, "_range").select(*rows.columns, (F.col("_before") + F.col("_inside")).alias(name))


def _cuts(rows: DataFrame, key: Column) -> list[Column]:
    """At most CUTS values of the key, at quantiles of a sample."""
    sample = rows.select(key.alias("_key")).orderBy(F.rand(7)).limit(CUTS * SAMPLED).orderBy("_key")
    kind = sample.schema["_key"].dataType
    cuts = dict.fromkeys(r["_key"] for r in sample.collect()[SAMPLED // 2 :: SAMPLED])
    return [F.struct(*(F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(c, kind.fields, strict=True))) for c in cuts]


def _narrowed(rows: DataFrame, order: list[Column], left: int, start: int, end: int, range_rows: int) -> tuple[DataFrame, int, int]:
    """(part, rows skipped before it, rows in it): those of `left` rows among which the places start to end lie, by counts of ranges."""
    key = F.struct(*(c.alias(f"_{i}") for i, c in enumerate(order)))
    part, skipped = rows, 0
    while left > range_rows:
        cuts = _cuts(part, key)
        if not cuts:
            break
        range_ = let(key, lambda k: F.size(F.filter(F.array(*cuts), lambda c: c <= k)))
        counted = dict(part.groupBy(range_.alias("_range")).count().collect())
        ranges = sorted(counted)
        ends = list(accumulate(counted[r] for r in ranges))
        low, high = (min(bisect_right(ends, x - skipped), len(ranges) - 1) for x in (start, end))
        inside = ends[high] - (ends[low - 1] if low else 0)
        if inside == left:
            break
        above = [key >= cuts[ranges[low] - 1]] if ranges[low] else []
        below = [key < cuts[ranges[high]]] if ranges[high] < len(cuts) else []
        part, left = reduce(DataFrame.where, above + below, part), inside
        skipped += ends[low - 1] if low else 0
    return part, skipped, left


def _start(left: int, number: int, size: int) -> int:
    """The first place of a page of `left` rows, clamped to the pages there are."""
    return (max(1, min(number, -(-left // size))) - 1) * size


def page(rows: DataFrame, order: list[Column], number: int, size: int = 12, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Page `number` (from 1) of the rows in ascending order (nulls first), clamped to the pages there are; position counts from 1.

    While more than range_rows rows are in question they are counted by range, and only the ranges that the page touches
    are read again, so a deep page costs as much as the first one. Rows that tie in the whole order come in any order;
    where more than range_rows of them do, the page's last task holds those before it. An empty table has an empty page.
    """
    left = rows.count()
    start = _start(left, number, size)
    part, skipped, _ = _narrowed(rows, order, left, start, start + size - 1, range_rows)
    top = part.orderBy(*order).limit(start - skipped + size)
    return top.withColumn("position", F.row_number().over(Window.orderBy(*order)) + skipped).where(F.col("position") > start)


def pages_from(rows: DataFrame, order: list[Column], number: int, size: int = 12, range_rows: int = RANGE_ROWS) -> DataFrame:
    """page() and all pages after it, which are the rest of the rows: those before are only counted, by range."""
    total = rows.count()
    start = _start(total, number, size)
    part, skipped, left = _narrowed(rows, order, total, start, total - 1, range_rows)
    if left <= range_rows:
        placed = part.withColumn("position", F.row_number().over(Window.orderBy(*order)) + skipped)
    else:
        placed = positions(part, order, "_place", max(range_rows, RANGE_ROWS)).select(*rows.columns, (F.col("_place") + skipped + 1).alias("position"))
    return placed.where(F.col("position") > start)
