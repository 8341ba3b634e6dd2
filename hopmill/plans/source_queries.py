"""Queries of reading and writing record files: tables written to the shared folder as files and read again, and their SQL.

Files hold the customers of a thousand keys each, so their number grows with the table and none holds an unbounded group.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from hopmill.operators import catalog as C
from hopmill.sources import readers as R
from hopmill.sources.shared import new_path
from hopmill.plans.bindings import table

ROWS_A_FILE = 1000
CUSTOMER = "c_custkey long, c_name string, c_nationkey int"


def _customers(spark, sf_dir):
    return table(spark, sf_dir, "customer").withColumn("chunk", F.floor(F.col("c_custkey") / ROWS_A_FILE))


def _write_files(df, name: str, kind: str = "json") -> str:
    """One file for each chunk, in a folder of its own."""
    path = new_path(df.sparkSession, name)
    df.repartition("chunk").write.partitionBy("chunk").format(kind).save(path)
    return path


def s01_lines(spark, sf_dir):
    path = new_path(spark, "lines")
    table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice").write.json(path)
    return R.read_lines(spark, path, "o_orderkey long, o_orderstatus string, o_totalprice double")


def s02_lists(spark, sf_dir):
    docs = _customers(spark, sf_dir).groupBy("chunk").agg(F.collect_list(F.struct("c_custkey", "c_name", "c_nationkey")).alias("cases"))
    return R.read_list(spark, _write_files(docs, "lists"), "cases", CUSTOMER)


def s03_folder(spark, sf_dir):
    results = _customers(spark, sf_dir).groupBy("chunk").agg(F.count("*").alias("rows"), F.sum("c_nationkey").alias("total")).withColumn("job_id", F.concat(F.lit("job-"), "chunk"))
    rows = R.read_folder(spark, f"{_write_files(results, 'folder')}/chunk=*", "job_id string, rows long, total long")
    return rows.groupBy("job_id", "rows", "total").agg(F.count_distinct("file_path").alias("files"))


def s04_relations(spark, sf_dir):
    cells = F.when(F.col("c_custkey") % 50 == 0, F.concat_ws(",", "c_name", F.lit(""), F.lit("of"), "c_mktsegment")).when(F.col("c_custkey") % 50 == 1, F.concat_ws(",", "c_name", "c_nationkey")).when(F.col("c_custkey") % 50 == 2, "").otherwise(F.concat_ws(",", F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit('"'), "c_name", F.lit(', ""x"""'))).otherwise(F.col("c_name")), F.concat(F.lit(" n"), "c_nationkey"), F.lit("of"), "c_mktsegment"))
    lines = _customers(spark, sf_dir).groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("c_custkey", cells.alias("v")))).alias("_l"))
    text = F.concat(F.lit("﻿head,tail,relation,label\n"), F.array_join(F.transform("_l", lambda s: s["v"]), "\n"))
    rows, bad = R.read_relations(spark, f"{_write_files(lines.select('chunk', text.alias('value')), 'relations', 'text')}/chunk=*", True)
    return rows.select("source_row", "head", "tail", "relation", "label", F.lit(None).cast("string").alias("bad")).unionByName(bad.select(F.substring_index("key", ":", -1).cast("int").alias("source_row"), *(F.lit(None).cast("string").alias(c) for c in ("head", "tail", "relation", "label")), F.col("detail").alias("bad")))


def s05_projection(spark, sf_dir):
    path = new_path(spark, "projection")
    R.write_projection(table(spark, sf_dir, "orders"), path, ["o_orderkey", "o_orderpriority"])
    return spark.read.json(path)


def s07_manifest(spark, sf_dir):
    lines = _customers(spark, sf_dir).groupBy("chunk").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", "c_name"))), lambda s: F.concat_ws(" ", s["c_custkey"].cast("string"), s["c_name"])), "\n").alias("value"))
    actual = R.manifest(spark, _write_files(lines, "manifest", "text")).withColumn("path", F.regexp_extract("path", r"chunk=(\d+)", 1))
    n = F.col("path").cast("long")
    stored = actual.where(n % 3 > 0).withColumn("sha256", F.when(n % 3 == 1, F.lit("other")).otherwise(F.col("sha256"))).unionByName(actual.withColumn("path", F.concat(F.lit("gone-"), "path")))
    return actual.join(R.manifest_violations(actual, stored).withColumnRenamed("key", "path"), "path", "full").select("path", "sha256", "bytes", "check")


def s08_once(spark, sf_dir):
    path, rows = new_path(spark, "once"), table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    first, again = R.write_once(rows, path), R.write_once(rows, path)
    try:
        R.write_once(rows.where("c_custkey > 1"), path)
        refused = False
    except ValueError:
        refused = True
    return spark.read.parquet(path).select("c_custkey", "c_name", F.lit(first).alias("written"), F.lit(again).alias("again"), F.lit(refused).alias("refused"))


def s09_lines(spark, sf_dir):
    """Parts as lines of text files, every seventh without an id, read by the registry."""
    path = new_path(spark, "registry")
    id_ = F.when(F.col("p_partkey") % 7 == 0, F.lit("see ")).otherwise(F.concat(F.lit("S"), F.lpad((F.col("p_partkey") % 100).cast("string"), 2, "0")))
    table(spark, sf_dir, "part").select(F.concat(F.lit("| "), id_, F.lit(" | "), "p_name", F.lit("  ")).alias("value")).write.text(path)
    return R.registry(spark, path)


def c15_import(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("value"))
    export = o.withColumn("value", F.when(F.col("k") % 5 == 0, "changed").when(F.col("k") % 5 > 1, F.col("value")))
    new, skipped = C.import_entries(o.where("k % 3 > 0"), export, ["k"])
    return new.withColumn("outcome", F.lit("new")).unionByName(skipped.withColumns({"value": F.lit(None).cast("string"), "outcome": F.lit("skipped")}))


QUERIES = {f.__name__: f for f in (s01_lines, s02_lists, s03_folder, s04_relations, s05_projection, s07_manifest, s08_once, s09_lines, c15_import)}

_CHUNKS = f"c AS (SELECT *, c_custkey // {ROWS_A_FILE} AS chunk FROM customer)"
SQL = {
    "s01_lines": "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders",
    "s02_lists": "SELECT c_custkey, c_name, c_nationkey FROM customer",
    "s03_folder": f"WITH {_CHUNKS} SELECT 'job-' || chunk AS job_id, count(*) AS rows, sum(c_nationkey)::BIGINT AS total, 1::BIGINT AS files FROM c GROUP BY chunk",
    "s04_relations": f"""WITH {_CHUNKS}, r AS (SELECT (row_number() OVER (PARTITION BY chunk ORDER BY c_custkey) + 1)::INT AS source_row, c_custkey % 50 AS m, c_custkey AS k, c_name, c_nationkey, c_mktsegment FROM c)
SELECT source_row, CASE WHEN m > 2 THEN c_name || CASE WHEN k % 3 = 0 THEN ', "x"' ELSE '' END END AS head, CASE WHEN m > 2 THEN ' n' || c_nationkey END AS tail, CASE WHEN m > 2 THEN 'of' END AS relation, CASE WHEN m > 2 THEN c_mktsegment END AS label,
  CASE m WHEN 0 THEN c_name || ',,of,' || c_mktsegment WHEN 1 THEN c_name || ',' || c_nationkey END AS bad FROM r WHERE m <> 2""",
    "s05_projection": "SELECT o_orderkey, o_orderpriority FROM orders",
    "s07_manifest": f"""WITH {_CHUNKS}, f AS (SELECT chunk, string_agg(c_custkey || ' ' || c_name, chr(10) ORDER BY c_custkey) || chr(10) AS t FROM c GROUP BY 1)
SELECT chunk::VARCHAR AS path, sha256(t) AS sha256, strlen(t)::BIGINT AS bytes, CASE chunk % 3 WHEN 0 THEN 'unexpected' WHEN 1 THEN 'changed' END AS "check" FROM f UNION ALL SELECT 'gone-' || chunk, NULL, NULL, 'missing' FROM f""",
    "s08_once": "SELECT c_custkey, c_name, true AS written, false AS again, true AS refused FROM customer",
    "s09_lines": "SELECT 'S' || lpad((p_partkey % 100)::VARCHAR, 2, '0') AS id, p_name AS title FROM part WHERE p_partkey % 7 > 0",
    "c15_import": """SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 > 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN 'changed' WHEN o_orderkey % 5 > 1 THEN o_orderstatus END AS value, CASE WHEN o_orderkey % 3 = 0 THEN 'new' ELSE 'skipped' END AS outcome
FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 5 < 2""",
}
