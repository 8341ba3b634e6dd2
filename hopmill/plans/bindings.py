
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def verdict(flag: str = "l_returnflag") -> Column:
    return F.when(F.col(flag) == "A", "pass").when(F.col(flag) == "R", "fail").otherwise("needs_review")


VERDICT_SQL = "CASE l_returnflag WHEN 'A' THEN 'pass' WHEN 'R' THEN 'fail' ELSE 'needs_review' END"


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(case_id, verdict): line items as trials of their part."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("case_id"), verdict().alias("verdict"))


def order_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(case_id, partition, family_id, verdict): line items as trials of their order, by priority and customer."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case_id"), F.col("o_orderpriority").alias("partition"), F.col("o_custkey").alias("family_id"))
    t = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("case_id"), verdict().alias("verdict"))
    return t.join(o, "case_id")


ORDER_TRIALS_SQL = f"SELECT o_orderkey AS case_id, o_orderpriority AS \"partition\", o_custkey AS family_id, {VERDICT_SQL} AS verdict FROM lineitem JOIN orders ON l_orderkey = o_orderkey"
STATUS_SQL = "CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'technical_failure' ELSE 'protocol_failure' END"


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(case_id, arm, repeat, status, decision, expected, verdict): orders as reviewed jobs.

    case: customer; arm: priority; repeat: month; status: order status; decision: price above 100000, null above 300000;
    expected: the customer's balance above 0, null above 9000; verdict: pass or revise by the decision.
    """
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("case_id"), "c_acctbal", "c_mktsegment", "c_nationkey")
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "technical_failure").otherwise("protocol_failure")
    price = F.col("o_totalprice")
    decision = F.when(price <= 300000, price > 100000)
    rows = o.select(F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("job_id"), F.substring("o_orderpriority", 1, 1).alias("arm"), F.month("o_orderdate").alias("repeat"), status.alias("status"), decision.alias("decision"))
    rows = rows.withColumn("verdict", F.when(F.col("decision"), "pass").when(~F.col("decision"), "revise"))
    expected = F.when(F.col("c_acctbal") <= 9000, F.col("c_acctbal") > 0)
    return rows.join(c, "case_id").select(*rows.columns, expected.alias("expected"), F.col("c_mktsegment").alias("track"), F.col("c_nationkey").alias("family_id"))


JOBS_SQL = f"""SELECT o_custkey AS case_id, o_orderkey AS job_id, substr(o_orderpriority, 1, 1) AS arm, month(o_orderdate) AS repeat, {STATUS_SQL} AS status,
  CASE WHEN o_totalprice <= 300000 THEN o_totalprice > 100000 END AS decision,
  CASE WHEN o_totalprice <= 100000 THEN 'revise' WHEN o_totalprice <= 300000 THEN 'pass' END AS verdict,
  CASE WHEN c_acctbal <= 9000 THEN c_acctbal > 0 END AS expected, c_mktsegment AS track, c_nationkey AS family_id
  FROM orders JOIN customer ON o_custkey = c_custkey"""


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Means to six places, so that the order of additions does not show."""
    return df.withColumns({c: F.round(c, 6) for c in columns})
