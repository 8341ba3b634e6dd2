"""Run-metric queries on the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from hopmill.operators import metrics as M
from hopmill.plans.bindings import ORDER_TRIALS_SQL, VERDICT_SQL, order_trials, rounded, table, trials, verdict


def _falling(n: str, k: int) -> str:
    return f"(CASE WHEN {n} >= {k} THEN {' * '.join(f'(({n}) - {i})::BIGINT' for i in range(k))} ELSE 0 END)"


def _estimate(c: str) -> str:
    """SQL of the numerator of each metric for c successes."""
    return f"CASE metric WHEN 'pass@1' THEN n - {_falling(f'n - ({c})', 1)} WHEN 'pass@5' THEN {_falling('n', 5)} - {_falling(f'n - ({c})', 5)} ELSE {_falling(c, 5)} END"


QUESTIONS = f"""
q AS (SELECT *, CASE WHEN metric = 'pass@1' THEN 1 ELSE 5 END AS k, CASE WHEN metric = 'pass@1' THEN n ELSE {_falling('n', 5)} END AS den FROM counts, (VALUES ('pass@1'), ('pass@5'), ('pass^5')) AS m(metric)),
questions AS (SELECT *, CASE WHEN n >= k THEN ({_estimate('passed')})::BIGINT END AS lower_num, CASE WHEN n >= k THEN ({_estimate('passed + unknown')})::BIGINT END AS upper_num,
  CASE WHEN n < k THEN 'insufficient_planned_trials' WHEN unknown > 0 THEN 'pending_outcomes' ELSE 'complete' END AS status FROM q)"""
COUNTS = "count(*) AS n, count(*) FILTER (WHERE verdict = 'pass') AS passed, count(*) FILTER (WHERE verdict = 'fail') AS failed, count(*) FILTER (WHERE verdict NOT IN ('pass', 'fail')) AS unknown"
MACRO = """count(*) AS questions, count(*) FILTER (WHERE status = 'complete') AS complete, count(*) FILTER (WHERE status = 'insufficient_planned_trials') AS underbudget,
  CASE WHEN count(*) FILTER (WHERE status = 'complete') = count(*) THEN avg(lower_num / den) END AS point,
  CASE WHEN count(lower_num) = count(*) THEN avg(lower_num / den) END AS lower, CASE WHEN count(lower_num) = count(*) THEN avg(upper_num / den) END AS upper,
  avg(CASE WHEN status = 'complete' THEN lower_num / den END) AS complete_only"""
MEANS = "round(point, 6) AS point, round(lower, 6) AS lower, round(upper, 6) AS upper"


#: Sums l and u over d in lowest terms, as text.
_LOWEST = ", ".join(
    f"CASE WHEN {ok} THEN ({v} // gcd({x}::HUGEINT, d::HUGEINT))::VARCHAR END AS {name}_{part}"
    for name, ok, x in (("point", "whole", "l"), ("lower", "bounded", "l"), ("upper", "bounded", "u"))
    for part, v in (("num", x), ("den", "d"))
)


_LCM = "list_reduce(list_prepend(1::HUGEINT, list(DISTINCT {0}::HUGEINT)), lambda a, b: lcm(a, b))"
#: Of each group the least common multiple of its fractions' denominators.
_COMMON = f"""common AS (SELECT "partition", metric, {_LCM.format("greatest(den, 1)")} AS dk FROM questions GROUP BY ALL)"""


def m01_estimates(spark, sf_dir):
    q = M.question_metrics(M.verdict_counts(trials(spark, sf_dir), ["case_id"]))
    return q.select("case_id", "metric", "n", "passed", "failed", "unknown", F.col("lower.numerator").cast("long").alias("lower_num"), F.col("upper.numerator").cast("long").alias("upper_num"), F.round("lower.value", 9).alias("lower"), F.round("point.value", 9).alias("point"), "status")


def m01_lowest_terms(spark, sf_dir):
    c = M.verdict_counts(trials(spark, sf_dir), ["case_id"])
    f = M.lowest_terms(M.estimate(F.col("n"), F.col("passed"), 5, False))
    return c.select("case_id", f["numerator"].cast("long").alias("numerator"), f["denominator"].cast("long").alias("denominator"))


def m03_slots(spark, sf_dir):
    slots = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("trial_id"), F.col("o_custkey").alias("case_id"))
    records = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("trial_id")).agg(F.max(F.struct("l_linenumber", verdict().alias("v")))["v"].alias("answer"), F.lit("completed").alias("status"))
    out = M.fill_slots(slots, records.withColumns({"logical_proof": F.col("answer"), "output_contract": F.lit("pass")}))
    return M.long_verdicts(out, ["status"]).groupBy("status", "dimension").agg(F.count("*").alias("slots"))


def m04_qualified(spark, sf_dir):
    t = order_trials(spark, sf_dir)
    gold = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case_id"), F.when(F.col("o_orderstatus") == "F", "accepted").when(F.col("o_orderstatus") == "O", "requires_review").otherwise("rejected").alias("gold_status"))
    return M.apply_qualification(t, gold).groupBy("gold_status", "eligible", "submitted", "verdict").agg(F.count("*").alias("trials"))


def m05_first_attempt(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("case_id"), (F.col("l_linenumber") - 1).alias("ordinal"), verdict().alias("verdict"))
    return M.first_attempt(t, ["case_id"])


def m06_question_macro(spark, sf_dir):
    q = M.question_metrics(M.verdict_classes(M.verdict_counts(order_trials(spark, sf_dir), ["partition", "case_id"]), ["partition"]))
    return rounded(M.question_macro(q, ["partition"], "questions"), "point", "lower", "upper", "complete_only")


def _exact(df, *more):
    sides = [F.col(c)[part].alias(f"{c}_{name}") for c in ("point", "lower", "upper") for part, name in (("numerator", "num"), ("denominator", "den"))]
    return df.select("partition", "metric", *more, "questions", *sides)


def m06_exact(spark, sf_dir):
    t = order_trials(spark, sf_dir)
    return _exact(M.exact_means(M.verdict_classes(M.verdict_counts(t, ["partition", "case_id"]), ["partition"]), ["partition"]))


def m07_exact(spark, sf_dir):
    """Odd families have their known verdicts alone, so that points, too, come out."""
    t = order_trials(spark, sf_dir).where("family_id % 2 = 0 or verdict <> 'needs_review'").withColumn("partition", (F.col("family_id") % 2).cast("string"))
    return _exact(M.exact_means(M.verdict_classes(M.verdict_counts(t, ["partition", "family_id", "case_id"]), ["partition", "family_id"]), ["partition"], "family_id"), "families")


def m07_family_macro(spark, sf_dir):
    q = M.question_metrics(M.verdict_classes(M.verdict_counts(order_trials(spark, sf_dir), ["partition", "family_id", "case_id"]), ["partition", "family_id"]))
    return rounded(M.family_macro(q, ["partition"], weight="questions"), "point", "lower", "upper")


def m08_partitions(spark, sf_dir):
    t = order_trials(spark, sf_dir).withColumn("partition", F.when(F.col("partition").startswith("1"), "primary").when(F.col("partition").startswith("2"), "node"))
    q = M.question_metrics(M.verdict_counts(t.where("partition is not null").withColumn("dimension", F.lit("answer")), ["partition", "dimension", "case_id"]))
    return rounded(M.partition_table(q), "point", "lower", "upper", "complete_only")


def m09_gate(spark, sf_dir):
    q = M.question_metrics(M.verdict_counts(order_trials(spark, sf_dir), ["partition", "case_id"]))
    table_ = rounded(M.question_macro(q, ["partition"]), "lower", "upper").select("partition", "metric", "questions", "lower", "upper")
    official, descriptive = M.gate(table_, F.col("partition").startswith("1"), ["lower", "upper"])
    return official.withColumn("copy", F.lit("official")).unionByName(descriptive.withColumn("copy", F.lit("descriptive")))


def m12_cohorts(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    rows = table(spark, sf_dir, "lineitem").join(p, F.col("l_partkey") == F.col("p_partkey")).select("p_brand", F.when(F.col("p_size") > 10, F.col("p_size")).alias("p_size"), F.when(F.col("l_returnflag") == "A", "P").when(F.col("l_returnflag") == "R", "F").otherwise("U").alias("label"))
    return rounded(M.cohort_bounds(rows, ["p_brand", "p_size"]), "lower", "upper").withColumn("grouping", F.col("grouping").cast("long"))


def _labels(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", F.when(F.col("l_returnflag") == "A", "P").when(F.col("l_returnflag") == "R", "F").otherwise("U").alias("label"))


LABELS = "SELECT l_orderkey, l_linenumber, l_suppkey, CASE l_returnflag WHEN 'A' THEN 'P' WHEN 'R' THEN 'F' ELSE 'U' END AS label FROM lineitem"


def m13_model_pairs(spark, sf_dir):
    moved, missing = M.pair_transitions(_labels(spark, sf_dir).withColumn("side", F.col("l_linenumber").cast("string")), ["l_orderkey"], "side", "1", "2")
    return moved.unionByName(missing.groupBy(F.col("reason").alias("transition")).agg(F.count("*").alias("pairs")))


def m13_bases(spark, sf_dir):
    moved, missing = M.base_transitions(_labels(spark, sf_dir), ["l_orderkey"], F.col("l_linenumber") == 1)
    return moved.unionByName(missing.groupBy(F.lit("unavailable").alias("transition")).agg(F.count("*").alias("pairs")))


def m13_parents(spark, sf_dir):
    """Lines are revisions of the line before; every third line was not observed."""
    rows = _labels(spark, sf_dir).withColumn("id", F.concat_ws("-", "l_orderkey", "l_linenumber"))
    revisions = rows.where("l_linenumber > 1").withColumn("parent", F.concat_ws("-", "l_orderkey", F.col("l_linenumber") - 1)).select("parent", "label")
    moved, lost = M.parent_transitions(revisions, rows.where("l_linenumber % 3 > 0"), "parent", "id")
    return moved.unionByName(lost.groupBy(F.lit("unobserved").alias("transition")).agg(F.count("*").alias("pairs")))


def m14_errors(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *(F.when(F.col(c) == a, "P").otherwise("F").alias(d) for d, c, a in (("answer", "l_returnflag", "A"), ("logical_proof", "l_linestatus", "F"), ("output_contract", "l_returnflag", "A"))))
    return M.error_index(rows).groupBy("answer", "logical_proof", "output_contract").agg(F.count("*").alias("rows"))


QUERIES = {f.__name__: f for f in (m01_estimates, m01_lowest_terms, m03_slots, m04_qualified, m05_first_attempt, m06_question_macro, m06_exact, m07_family_macro, m07_exact, m08_partitions, m09_gate, m12_cohorts, m13_model_pairs, m13_bases, m13_parents, m14_errors)}

_BY_PARTITION = f"""WITH t AS ({ORDER_TRIALS_SQL}), counts AS (SELECT "partition", family_id, case_id, {COUNTS} FROM t GROUP BY ALL), {QUESTIONS}"""
SQL = {
    "m01_estimates": f"WITH counts AS (SELECT l_partkey AS case_id, {COUNTS.replace('verdict', VERDICT_SQL)} FROM lineitem GROUP BY 1), {QUESTIONS} SELECT case_id, metric, n, passed, failed, unknown, lower_num, upper_num, round(lower_num / den, 9) AS lower, CASE WHEN unknown = 0 THEN round(lower_num / den, 9) END AS point, status FROM questions",
    "m01_lowest_terms": f"WITH counts AS (SELECT l_partkey AS case_id, {COUNTS.replace('verdict', VERDICT_SQL)} FROM lineitem GROUP BY 1), {QUESTIONS} SELECT case_id, lower_num // gcd(lower_num, den) AS numerator, CASE WHEN lower_num IS NOT NULL THEN den // gcd(lower_num, den) END AS denominator FROM questions WHERE metric = 'pass@5'",
    "m03_slots": f"""WITH r AS (SELECT l_orderkey, max(struct_pack(l := l_linenumber, v := {VERDICT_SQL})).v AS answer FROM lineitem GROUP BY 1),
s AS (SELECT CASE WHEN l_orderkey IS NULL THEN 'missing' ELSE 'completed' END AS status FROM orders LEFT JOIN r ON o_orderkey = l_orderkey)
SELECT status, dimension, count(*) AS slots FROM s, (VALUES ('answer'), ('logical_proof'), ('output_contract')) AS d(dimension) GROUP BY ALL""",
    "m04_qualified": f"""WITH t AS ({ORDER_TRIALS_SQL}), g AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'accepted' WHEN 'O' THEN 'requires_review' ELSE 'rejected' END AS gold_status FROM orders)
SELECT gold_status, gold_status = 'accepted' AS eligible, verdict AS submitted, CASE WHEN gold_status = 'accepted' THEN verdict ELSE 'needs_review' END AS verdict, count(*) AS trials FROM t JOIN g ON case_id = o_orderkey GROUP BY ALL""",
    "m05_first_attempt": "SELECT l_orderkey AS case_id, max(CASE WHEN l_linenumber = 1 THEN CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN 0 END END) AS first_attempt FROM lineitem GROUP BY 1",
    "m06_exact": f"""{_BY_PARTITION}, {_COMMON},
g AS (SELECT "partition", metric, count(*) AS questions, count(*) FILTER (WHERE status = 'complete') = count(*) AS whole, count(lower_num) = count(*) AS bounded, dk * count(*) AS d, sum(lower_num * (dk // nullif(den, 0))) AS l, sum(upper_num * (dk // nullif(den, 0))) AS u FROM questions JOIN common USING ("partition", metric) GROUP BY "partition", metric, dk)
SELECT "partition", metric, questions, {_LOWEST} FROM g""",
    "m07_exact": f"""WITH t AS (SELECT * REPLACE ((family_id % 2)::VARCHAR AS "partition") FROM ({ORDER_TRIALS_SQL}) WHERE family_id % 2 = 0 OR verdict <> 'needs_review'), counts AS (SELECT "partition", family_id, case_id, {COUNTS} FROM t GROUP BY ALL), {QUESTIONS}, {_COMMON},
f AS (SELECT "partition", family_id, metric, dk, count(*) AS q, count(*) FILTER (WHERE status = 'complete') = count(*) AS whole, count(lower_num) = count(*) AS bounded, sum(lower_num * (dk // nullif(den, 0))) AS l, sum(upper_num * (dk // nullif(den, 0))) AS u FROM questions JOIN common USING ("partition", metric) GROUP BY ALL),
c AS (SELECT "partition", metric, {_LCM.format("q")} AS k FROM f GROUP BY ALL),
g AS (SELECT "partition", metric, count(*) AS families, sum(q)::BIGINT AS questions, bool_and(whole) AS whole, bool_and(bounded) AS bounded, dk * k * count(*) AS d, sum(l * (k // q)) AS l, sum(u * (k // q)) AS u FROM f JOIN c USING ("partition", metric) GROUP BY "partition", metric, k, dk)
SELECT "partition", metric, families, questions, {_LOWEST} FROM g""",
    "m06_question_macro": f'{_BY_PARTITION}, g AS (SELECT "partition", metric, {MACRO} FROM questions GROUP BY ALL) SELECT "partition", metric, questions, complete, underbudget, {MEANS}, round(complete_only, 6) AS complete_only FROM g',
    "m07_family_macro": f'{_BY_PARTITION}, f AS (SELECT "partition", family_id, metric, {MACRO} FROM questions GROUP BY ALL), g AS (SELECT "partition", metric, count(*) AS families, sum(questions)::BIGINT AS questions, CASE WHEN count(point) = count(*) THEN avg(point) END AS point, CASE WHEN count(lower) = count(*) THEN avg(lower) END AS lower, CASE WHEN count(lower) = count(*) THEN avg(upper) END AS upper FROM f GROUP BY ALL) SELECT "partition", metric, families, questions, {MEANS} FROM g',
    "m08_partitions": f"""WITH t AS (SELECT * REPLACE (CASE substr("partition", 1, 1) WHEN '1' THEN 'primary' WHEN '2' THEN 'node' END AS "partition") FROM ({ORDER_TRIALS_SQL}) WHERE substr("partition", 1, 1) IN ('1', '2')), counts AS (SELECT "partition", case_id, {COUNTS} FROM t GROUP BY ALL), {QUESTIONS},
g AS (SELECT "partition", 'answer' AS dimension, metric, {MACRO} FROM questions GROUP BY ALL), frame AS (SELECT * FROM (VALUES ('primary'), ('node'), ('control')) AS p("partition"), (VALUES ('answer'), ('logical_proof'), ('output_contract')) AS d(dimension), (VALUES ('pass@1'), ('pass@5'), ('pass^5')) AS m(metric))
SELECT "partition", dimension, metric, coalesce(questions, 0) AS questions, coalesce(complete, 0) AS complete, coalesce(underbudget, 0) AS underbudget, {MEANS}, round(complete_only, 6) AS complete_only FROM frame LEFT JOIN g USING ("partition", dimension, metric)""",
    "m09_gate": f"""{_BY_PARTITION}, g AS (SELECT "partition", metric, {MACRO} FROM questions GROUP BY ALL), d AS (SELECT "partition", metric, questions, round(lower, 6) AS lower, round(upper, 6) AS upper FROM g)
SELECT *, 'descriptive' AS copy FROM d UNION ALL SELECT "partition", metric, questions, CASE WHEN "partition" LIKE '1%' THEN lower END, CASE WHEN "partition" LIKE '1%' THEN upper END, 'official' FROM d""",
    "m12_cohorts": """WITH r AS (SELECT p_brand, CASE WHEN p_size > 10 THEN p_size END AS p_size, CASE l_returnflag WHEN 'A' THEN 'P' WHEN 'R' THEN 'F' ELSE 'U' END AS label FROM lineitem JOIN part ON l_partkey = p_partkey),
g AS (SELECT p_brand, p_size, grouping(p_brand, p_size) AS "grouping", count(*) AS n, count(*) FILTER (WHERE label = 'P') AS p, count(*) FILTER (WHERE label = 'F') AS f FROM r GROUP BY GROUPING SETS ((), (p_brand), (p_size), (p_brand, p_size)))
SELECT *, n - p - f AS u, round(p / n, 6) AS lower, round((n - f) / n, 6) AS upper FROM g""",
    "m13_model_pairs": f"WITH p AS (SELECT l_orderkey, max(CASE WHEN l_linenumber = 1 THEN label END) AS l, max(CASE WHEN l_linenumber = 2 THEN label END) AS r FROM ({LABELS}) GROUP BY 1) SELECT coalesce(l || '->' || r, CASE WHEN l IS NULL AND r IS NULL THEN 'no_side' WHEN l IS NULL THEN 'no_left' ELSE 'no_right' END) AS transition, count(*) AS pairs FROM p GROUP BY 1",
    "m13_parents": f"WITH r AS ({LABELS}) SELECT CASE WHEN c.l_orderkey IS NULL THEN 'unobserved' ELSE c.label || '->' || r.label END AS transition, count(*) AS pairs FROM r LEFT JOIN r c ON c.l_orderkey = r.l_orderkey AND c.l_linenumber = r.l_linenumber - 1 AND c.l_linenumber % 3 > 0 WHERE r.l_linenumber > 1 GROUP BY 1",
    "m13_bases": f"""WITH m AS (SELECT *, l_linenumber = 1 AS base, count(*) FILTER (WHERE l_linenumber = 1) OVER (PARTITION BY l_orderkey) AS bases, max(CASE WHEN l_linenumber = 1 THEN label END) OVER (PARTITION BY l_orderkey) AS b FROM ({LABELS}))
SELECT b || '->' || label AS transition, count(*) AS pairs FROM m WHERE bases = 1 AND NOT base GROUP BY 1 UNION ALL SELECT 'unavailable', count(DISTINCT l_orderkey) FROM m WHERE bases <> 1 HAVING count(*) > 0""",
    "m14_errors": "WITH r AS (SELECT CASE WHEN l_returnflag = 'A' THEN 'P' ELSE 'F' END AS answer, CASE WHEN l_linestatus = 'F' THEN 'P' ELSE 'F' END AS logical_proof, CASE WHEN l_returnflag = 'A' THEN 'P' ELSE 'F' END AS output_contract FROM lineitem) SELECT *, count(*) AS rows FROM r WHERE answer <> 'P' OR logical_proof <> 'P' OR output_contract <> 'P' GROUP BY ALL",
}
