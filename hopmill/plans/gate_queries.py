"""Queries over gates of delivered reviews and over what two rounds share, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from hopmill.operators import accounting as X
from hopmill.operators import gates as G
from hopmill.plans.accounting_queries import COUNTERS
from hopmill.plans.bindings import JOBS_SQL, STATUS_SQL, jobs, table


def x05_unfinished(spark, sf_dir):
    rows = jobs(spark, sf_dir).withColumns({"ref_status": F.when(F.col("expected").isNull(), "disputed").otherwise("adjudicated"), "expected_valid": F.col("expected"), "major_defect": F.when(F.col("repeat") <= 6, ~F.col("expected"))})
    return G.unfinished_trials(rows.withColumn("status", F.when(F.col("repeat") != 3, F.col("status"))), ["track", "arm"])


def _rounds(spark, sf_dir):
    """Jobs of two rounds, and their cases compared: customers, of which every fifth has another reference and every seventh another payload."""
    rows = jobs(spark, sf_dir).withColumn("kind", F.when(F.col("case_id") % 4 == 0, "review").otherwise("scoring"))
    old = rows.where("case_id % 3 <> 0 and repeat <= 8")
    new = rows.where("case_id % 11 <> 0 and repeat > 4").withColumn("expected", F.when(F.col("case_id") % 5 == 0, ~F.col("expected")).otherwise(F.col("expected")))
    cases = lambda df, payload: df.select("kind", "case_id", "expected", payload.alias("payload_sha256")).distinct()
    then = F.sha2(F.col("case_id").cast("string"), 256)
    compared = X.round_comparison(cases(old, then), cases(new, F.when((F.col("case_id") % 7 == 0) & (F.col("kind") == "review"), "other").otherwise(then)), ["kind", "case_id"])
    return old, new, compared


def x15_subsets(spark, sf_dir):
    old, new, compared = _rounds(spark, sf_dir)
    return G.round_subsets(compared, old, new, ["kind", "case_id"], ["kind", "arm"])


def x15_flags(spark, sf_dir):
    _, _, compared = _rounds(spark, sf_dir)
    kinds = table(spark, sf_dir, "customer").select(F.when(F.col("c_custkey") % 4 == 0, "review").otherwise("scoring").alias("kind")).distinct()
    contracts = lambda prompt: kinds.select("kind", F.sha2("kind", 256).alias("schema_sha256"), prompt.alias("prompt_sha256"))
    return G.contract_flags(compared, contracts(F.lit("p")), contracts(F.when(F.col("kind") == "scoring", "p")))


def x28_gate(spark, sf_dir):
    # dealt by their order as they are: digests are larger than what they are made of, and flags smaller than their numbers
    o, li = table(spark, sf_dir, "orders").repartition("o_orderkey"), table(spark, sf_dir, "lineitem")
    flags = {"_tax": F.col("l_tax") > 0.075, "_many": F.col("l_quantity") > 45, "_few": F.col("l_quantity") < 5, "_discount": F.col("l_discount") > 0.085}
    dealt = li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", *(c.alias(n) for n, c in flags.items())).repartition("l_orderkey")
    sha = lambda *c: F.sha2(F.concat_ws("-", *(F.col(x).cast("string") for x in c)), 256)
    kind = F.substring("o_orderpriority", 1, 1)
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "technical_failure").otherwise("protocol_failure")
    both = F.array(F.lit("coverage"), F.lit("scope"))
    requests = o.select(F.col("o_orderkey").alias("job_id"), F.when(kind == "1", "scoring").when(kind == "2", "inventory").otherwise("review").alias("kind"), status.alias("status"), (F.col("o_custkey") % 2 == 0).alias("closed_world"), (F.col("o_totalprice") < 150000).alias("source_empty"), F.concat(F.lit("r"), F.col("o_custkey") % 10).alias("author"), sha("o_orderkey").alias("request_sha256"), sha("o_custkey").alias("source_sha256"), sha("o_orderpriority").alias("draft_sha256"), F.array("o_orderpriority").alias("coverage"), both.alias("facets"), F.col("o_orderstatus").alias("core"))
    reviewer = F.concat(F.lit("r"), F.col("l_suppkey") % 10)
    off = lambda n, right: F.when(F.col("l_partkey") % n != 0, right)
    receipts = dealt.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_orderkey").alias("job_id"), sha("l_orderkey", "l_linenumber").alias("receipt_sha256"), F.when(F.col("l_suppkey") % 9 == 0, "short").otherwise(sha("l_partkey")).alias("artifact_sha256"), F.when(F.col("_tax"), "v0").otherwise("v1").alias("version"), F.lit("core").alias("scope"), off(11, sha("o_orderkey")).alias("request_sha256"), off(13, sha("o_custkey")).alias("source_sha256"), off(7, sha("o_orderpriority")).alias("draft_sha256"), F.when(F.col("l_returnflag") == "R", "rejected").otherwise("confirmed").alias("decision"), F.when(F.col("_many"), F.array(F.lit("scope"))).otherwise(F.array().cast("array<string>")).alias("unresolved"), F.when(F.col("l_suppkey") % 5 == 0, "model").otherwise("human").alias("reviewer_kind"), reviewer.alias("reviewer"), F.when(F.col("_few"), F.array().cast("array<string>")).otherwise(F.array("o_orderpriority")).alias("coverage"), F.when(F.col("_discount"), F.array(F.lit("scope"))).otherwise(both).alias("facets"), F.when(F.col("l_linenumber") == 4, "other").otherwise(F.col("o_orderstatus")).alias("core"))
    registry = li.where("l_linenumber <> 3").select(sha("l_orderkey", "l_linenumber").alias("receipt_sha256"), sha("l_partkey").alias("artifact_sha256"), F.when(F.col("l_linenumber") == 5, "someone").otherwise(reviewer).alias("reviewer"), (F.col("l_linenumber") != 6).alias("verified"))
    routed = G.gated_reviews(requests, receipts, registry, "v1", "core")
    return routed.groupBy("kind", "before", "after", "reason", "usable").agg(F.count("*").alias("jobs"))


QUERIES = {f.__name__: f for f in (x05_unfinished, x15_subsets, x15_flags, x28_gate)}

_ROUNDS = f"""WITH j AS ({JOBS_SQL}), k AS (SELECT *, CASE WHEN case_id % 4 = 0 THEN 'review' ELSE 'scoring' END AS kind FROM j),
o AS (SELECT * FROM k WHERE case_id % 3 <> 0 AND repeat <= 8), n AS (SELECT * REPLACE (CASE WHEN case_id % 5 = 0 THEN NOT expected ELSE expected END AS expected) FROM k WHERE case_id % 11 <> 0 AND repeat > 4),
oc AS (SELECT DISTINCT kind, case_id, expected FROM o), nc AS (SELECT DISTINCT kind, case_id, expected FROM n),
e AS (SELECT kind, case_id, NOT (case_id % 7 = 0 AND kind = 'review') AS same_payload FROM oc JOIN nc USING (kind, case_id) WHERE oc.expected = nc.expected)"""
SQL = {
    "x05_unfinished": f"""WITH j AS ({JOBS_SQL}), r AS (SELECT *, CASE WHEN repeat <> 3 THEN status ELSE 'not_run' END AS s FROM j WHERE expected IS NOT NULL)
SELECT track, arm, s AS status, count(*) AS trials, count(*) FILTER (WHERE expected) AS valid_trials, count(*) FILTER (WHERE NOT expected) AS major_defect_trials FROM r WHERE s <> 'completed' GROUP BY ALL""",
    "x15_subsets": f"""{_ROUNDS}, b AS (SELECT 'previous' AS round, * FROM o UNION ALL BY NAME SELECT 'current' AS round, * FROM n)
SELECT round, kind, arm, {COUNTERS}, count(DISTINCT case_id) AS shared_cases FROM b SEMI JOIN e USING (kind, case_id) GROUP BY ALL""",
    "x15_flags": f"{_ROUNDS} SELECT kind, count(*) AS cases, bool_and(same_payload) AS same_payloads, true AS same_schema, kind = 'scoring' AS same_prompt FROM e GROUP BY kind",
    "x28_gate": f"""WITH r AS (SELECT l_orderkey AS k, max(CASE WHEN l_linenumber = 3 THEN 0 WHEN l_suppkey % 9 = 0 THEN 1 WHEN l_linenumber = 5 THEN 2 WHEN l_tax > 0.075 THEN 3 WHEN l_partkey % 11 = 0 THEN 4 WHEN l_partkey % 13 = 0 THEN 5
  WHEN l_partkey % 7 = 0 THEN 6 WHEN l_returnflag = 'R' THEN 7 WHEN l_quantity > 45 THEN 8 WHEN l_suppkey % 5 = 0 OR l_suppkey % 10 = o_custkey % 10 OR l_linenumber = 6 THEN 9 WHEN l_quantity < 5 THEN 10 WHEN l_discount > 0.085 THEN 11 WHEN l_linenumber = 4 THEN 12 ELSE 13 END) AS l
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey),
q AS (SELECT CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'scoring' WHEN '2' THEN 'inventory' ELSE 'review' END AS kind, {STATUS_SQL} AS before, o_custkey % 2 = 0 AND o_totalprice < 150000 AS closed, l FROM orders LEFT JOIN r ON o_orderkey = k),
a AS (SELECT kind, before, l, CASE WHEN kind = 'scoring' AND closed AND before = 'completed' THEN '{G.DETERMINED}' WHEN l = 13 THEN '{G.CONFIRMED}' ELSE '{G.OPEN}' END AS after FROM q)
SELECT kind, before, after, CASE WHEN after = '{G.OPEN}' THEN CASE WHEN l IS NOT NULL THEN 'receipt_' || ['registered', 'artifact', 'authority', 'scope', 'request', 'source', 'draft', 'decision', 'unresolved', 'independence', 'coverage', 'facets', 'core'][l + 1]
  WHEN before <> 'completed' THEN '{G.NOT_COMPLETED}' WHEN kind = 'inventory' THEN '{G.INVENTORY}' ELSE '{G.SEMANTICS}' END END AS reason, after <> '{G.OPEN}' AS usable, count(*) AS jobs FROM a GROUP BY ALL""",
}
