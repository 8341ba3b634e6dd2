"""Contiguous shards of nearly equal bytes, from global prefix sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hopmill.llm.common import small, stash


def byte_size(text: Column) -> Column:
    """UTF-8 bytes of the text (0 for null) and 1 for its separator."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def prefix_sums(rows: DataFrame, order: list[str], value: str) -> DataFrame:
    """rows with _before (sum of value over all rows before this one) and _rank (number of rows before), in the global order.

    Rows are dealt into ranges of the order and written once; each range's total is summed, the totals of the ranges
    (as many rows as there are ranges) give each range its offset, and a window inside the range adds the rest. Equal
    rows that would fill a range are dealt out further by their place in the input, which no result shows.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = rows.withColumn("_salt", F.monotonically_increasing_id())
    ranged = stash(salted.repartitionByRange(n, *order, "_salt").withColumn("_range", F.spark_partition_id()), "ranged")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("_range").agg(F.sum(value).alias("_sum"), F.count("*").alias("_rows"))
    starts = totals.select("_range", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(d) for c, d in (("_sum", "_start"), ("_rows", "_start_rows"))))
    upto = Window.partitionBy("_range").orderBy(*order, "_salt")
    run = ranged.withColumns({"_in": F.sum(value).over(upto.rowsBetween(Window.unboundedPreceding, 0)) - F.col(value), "_n": F.row_number().over(upto) - 1})
    return run.join(F.broadcast(starts), "_range").withColumns({"_before": F.col("_start") + F.col("_in"), "_rank": F.col("_start_rows") + F.col("_n")}).drop("_range", "_salt", "_start", "_start_rows", "_in", "_n")


def shards(docs: DataFrame, count: int = 16, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, size, text_crc32, shard, slot): documents in the order of key, cut into count contiguous shards of equal bytes.

    A document goes to the shard that its middle byte falls in, so a shard misses its share by one document at most on
    either side. slot counts a shard's documents from 0 in the order of key.

    Nulls: a null text has size 1 and the checksum of an empty one; null keys come first. Documents with equal keys are
    ordered by checksum and size; rows equal in all three are interchangeable. An empty table gives an empty one.
    """
    crc = F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    slim = docs.select(F.col(key).alias("_key"), byte_size(F.col(text)).alias("size"), crc.alias("text_crc32"))
    placed = prefix_sums(slim, ["_key", "text_crc32", "size"], "size")
    total = placed.agg(F.sum("size").alias("_total"))
    placed = placed.crossJoin(F.broadcast(total)).withColumn("shard", F.expr(f"cast(least((2 * _before + size) * {int(count)} div (2 * _total), {int(count) - 1}) as int)"))
    placed = stash(placed.select("_key", "size", "text_crc32", "shard", "_rank"), "placed")
    first = small(stash(placed.groupBy("shard").agg(F.min("_rank").alias("_first")), "firsts"))
    return placed.join(first, "shard").select(F.col("_key").alias(key), "size", "text_crc32", "shard", (F.col("_rank") - F.col("_first")).alias("slot"))
