"""Experiment-accounting queries on the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from hopmill.operators import accounting as X
from hopmill.plans.bindings import JOBS_SQL, jobs, rounded, table

CLOSED = ["unsafe_accept_per_invalid", "false_block_per_valid", "unsafe_accept_among_decided", "false_block_among_decided", "decision_coverage"]


def x01_grid(spark, sf_dir):
    cases = table(spark, sf_dir, "customer").select("c_mktsegment", F.col("c_custkey").alias("case_id"), F.col("c_nationkey").cast("int").alias("n"))
    grid = X.job_grid(cases, ["generic", "skills"], F.col("n") % 4)
    return grid.groupBy("c_mktsegment", "arm", "repeat").agg(F.count("*").alias("jobs"))


def x02_seeded_order(spark, sf_dir):
    return X.seeded_order(table(spark, sf_dir, "orders").select("o_orderkey"), "seed-7", ["o_orderkey"])


def x03_pending(spark, sf_dir):
    done = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return X.pending_jobs(table(spark, sf_dir, "orders").select("o_orderkey"), done, ["o_orderkey"])


def x04_counters(spark, sf_dir):
    return rounded(X.rates(X.outcome_counters(jobs(spark, sf_dir), ["track", "arm"])), *CLOSED)


def x05_review(spark, sf_dir):
    rows = jobs(spark, sf_dir).withColumns({"ref_status": F.when(F.col("expected").isNull(), "disputed").otherwise("adjudicated"), "expected_valid": F.col("expected"), "major_defect": F.when(F.col("repeat") <= 6, ~F.col("expected")).when(F.col("expected").isNotNull(), F.lit(False)), "defect_category": F.concat(F.lit("c"), F.col("repeat") % 3), "issue_codes": F.array(F.concat(F.lit("c"), F.col("arm").cast("int") % 3), F.lit("other"))})
    return X.review_counters(rows, ["track", "arm"])


def x07_conflicts(spark, sf_dir):
    rows = jobs(spark, sf_dir).withColumns({"kind": F.when(F.col("repeat") % 2 == 0, "review").otherwise("scoring"), "raw": F.col("decision"), "disposition": F.when(F.col("repeat") > 6, "needs_revision_structural").otherwise(F.col("verdict")), "structural": F.when(F.col("repeat") > 9, "incorrect").otherwise("needs_semantic_review")})
    decided = rows.withColumn("program", X.program_decision(F.col("kind"), F.col("raw"), F.col("disposition"), F.col("structural")))
    return X.program_conflicts(decided).groupBy("kind", "conflict", "program").agg(F.count("*").alias("rows"))


def x08_agreement(spark, sf_dir):
    rows = jobs(spark, sf_dir).withColumns({"e2": ~F.col("expected"), "d2": F.when(F.col("repeat") != 5, F.col("repeat") > 5)})
    return rounded(X.dimension_agreement(rows, ["track"], {"answer": ("expected", "decision"), "proof": ("e2", "d2")}), "agreement_among_decided")


def x09_pairs(spark, sf_dir):
    one = jobs(spark, sf_dir).groupBy("track", "case_id", "repeat", "arm").agg(F.max_by(F.struct("status", "decision", "expected"), "job_id").alias("s")).select("track", "case_id", "repeat", "arm", "s.*")
    return X.paired_arms(one, ["case_id", "repeat"], ["track"], "1", "2")


def x10_stability(spark, sf_dir):
    return X.repeat_stability(jobs(spark, sf_dir), ["case_id", "arm"], ["pass", "revise"])


def x11_family_means(spark, sf_dir):
    c = X.outcome_counters(jobs(spark, sf_dir), ["track", "arm", "family_id"])
    return rounded(X.family_means(c, ["track", "arm"], "unsafe_accept", "invalid_trials"), "family_mean")


def x12_blind(spark, sf_dir):
    rows = jobs(spark, sf_dir).withColumns({"answer_ok": F.col("decision"), "proof_ok": F.coalesce(F.col("decision") & F.col("expected"), F.lit(False))})
    return rounded(X.blind_table(rows, ["arm"], ["answer_ok", "proof_ok"]), "answer_ok_rate", "proof_ok_rate", "coverage")


def x13_hints(spark, sf_dir):
    hints = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.when(F.col("l_quantity") <= 45, F.col("l_partkey")).alias("fact_id"), F.col("l_returnflag").alias("library"), F.when(F.col("l_linestatus") == "O", "warning").otherwise("match").alias("kind"))
    proofs = table(spark, sf_dir, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("case_id"), F.col("l_partkey").alias("fact_id"))
    return X.hint_coverage(hints, proofs)


def _hints(spark, sf_dir):
    """Lines as hints of their order: some facts are unknown to the order's family, some rows warnings or excluded."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    kind = F.when(F.col("l_quantity") > 40, "warning").when(F.col("l_linestatus") == "O", "conflict_hints").otherwise("matches")
    rows = rows.select(F.col("l_orderkey").alias("case_id"), F.col("o_custkey").alias("family_id"), F.when(F.col("l_quantity") % 5 > 0, F.col("l_partkey")).alias("fact_id"), F.col("l_returnflag").alias("library"), kind.alias("kind"), (F.col("l_suppkey") % 7 == 0).alias("excluded"))
    facts = rows.where("fact_id % 4 > 0")
    return X.hint_relevance(rows, facts.where("fact_id % 10 = 1"), facts)


def x13_strata(spark, sf_dir):
    cases = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case_id"))
    return X.hint_stratum(_hints(spark, sf_dir), cases=cases)


def x13_libraries(spark, sf_dir):
    return X.hint_stratum(_hints(spark, sf_dir), by=("library",)).groupBy("library", "stratum").agg(F.count("*").alias("cases"))


def x13_totals(spark, sf_dir):
    return X.hint_totals(_hints(spark, sf_dir))


def x15_rounds(spark, sf_dir):
    old = table(spark, sf_dir, "orders").where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("case_id"), (F.col("o_totalprice") > 50000).alias("expected"), F.sha2("o_orderpriority", 256).alias("payload_sha256"))
    new = table(spark, sf_dir, "orders").where("o_orderkey % 4 <> 0").select(F.col("o_orderkey").alias("case_id"), F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice") > 80000).alias("expected"), F.sha2(F.when(F.col("o_orderkey") % 5 == 0, "x").otherwise(F.col("o_orderpriority")), 256).alias("payload_sha256"))
    return X.round_comparison(old, new, ["case_id"]).groupBy("comparison", "same_payload").agg(F.count("*").alias("cases"))


def x16_labels(spark, sf_dir):
    rows = jobs(spark, sf_dir).withColumn("labels", F.array_compact(F.array(F.lit("all"), F.when(F.col("repeat") <= 6, "first_half"), F.when(F.col("track") == "BUILDING", "building"), F.lit("all"))))
    return X.labelled_counts(rows, ["arm"])


def x17_accept(spark, sf_dir):
    return X.accept_reject(jobs(spark, sf_dir).withColumn("disputed", F.col("repeat") == 12), ["track", "arm"])


def x21_merge(spark, sf_dir):
    state = lambda c: F.when(F.col(c) == 1, "unsupported").when(F.col(c) < 5, "supported")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_quantity") == 50).alias("hard_defect"), F.when(F.col("l_returnflag") == "R", "unsupported").when(F.col("l_discount") < 0.09, "supported").alias("first"), state("l_linenumber").alias("second"))
    a = X.merge_support(rows, ["l_orderkey"]).withColumnRenamed("verdict", "isolation")
    b = X.merge_support(rows, ["l_orderkey"], failure_first=True).select("l_orderkey", F.col("verdict").alias("failure_first"))
    return a.join(b, "l_orderkey").groupBy("isolation", "failure_first").agg(F.count("*").alias("answers"), F.sum("steps").alias("steps"))


def x24_windows(spark, sf_dir):
    units = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("owner_id"), F.col("l_linenumber").alias("pos"), F.col("l_suppkey").alias("unit_id")).distinct()
    facts = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("owner_id"), F.col("o_custkey").alias("fact_id"))
    return X.anchor_windows(facts, units, most=3).groupBy("fact_id", "window").agg(F.count("*").alias("units"), F.max("slot").alias("last_slot"))


def x25_anchors(spark, sf_dir):
    o = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", F.when(F.col("l_returnflag") == "A", "supported").when(F.col("l_returnflag") == "N", "unknown").otherwise("unsupported").alias("verdict"))
    return X.anchor_status(o, ["l_partkey", "l_suppkey"])


def x25_footprints(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_orderkey").agg(F.collect_list(F.concat(F.lit("u"), F.col("l_partkey") % 5)).alias("group_unit_ids"))
    return X.shared_footprints(g, ["l_suppkey"]).select("l_suppkey", "l_orderkey", "footprint", F.col("group_index").cast("long").alias("group_index"), "duplicate")


def x26_outcome(spark, sf_dir):
    of = lambda c, a, b: F.when(F.col(c) == a, "accepted").when(F.col(c) == b, "rejected").otherwise("needs_review")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", of("l_returnflag", "A", "X").alias("support"), of("l_linestatus", "F", "Y").alias("scope"), F.when(F.col("l_quantity") > 48, "rejected").otherwise("accepted").alias("role"))
    return X.group_outcome(rows, ["l_orderkey"], ["support", "scope", "role"]).groupBy("outcome").agg(F.count("*").alias("groups"))


def x27_cells(spark, sf_dir):
    expected = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("fact_id"), F.explode(F.sequence(F.lit(1), F.lit(7))).alias("unit_id"))
    cells = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("fact_id"), F.col("l_linenumber").alias("unit_id"))
    return X.cell_coverage(expected, cells, ["fact_id", "unit_id"]).groupBy("unit_id", "check").agg(F.count("*").alias("cells"))


def x27_findings(spark, sf_dir):
    """Facts are orders, units their lines, groups the lines of a return flag other than R; small groups claim line 1 as their anchor."""
    li = table(spark, sf_dir, "lineitem")
    facts = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("fact_id"), F.when(F.col("o_orderstatus") == "P", "not_found").otherwise("support_proposed").alias("status"))
    status = F.when(F.col("l_quantity") > 45, "unresolved").when(F.col("l_returnflag") == "R", "not_supporting").when(F.col("l_linenumber") == 1, "support_anchor").otherwise("support_context")
    cells = li.select(F.col("l_orderkey").alias("fact_id"), F.col("l_linenumber").alias("unit_id"), status.alias("status"))
    anchor = F.when(F.count("*") > 2, F.min("l_linenumber")).otherwise(1)
    groups = li.where("l_returnflag <> 'R'").groupBy(F.col("l_orderkey").alias("fact_id"), F.col("l_returnflag").alias("group_id")).agg(anchor.alias("anchor_unit_id"), F.collect_set("l_linenumber").alias("unit_ids"))
    return X.coverage_findings(facts, cells, groups).groupBy("check", "unit_id").agg(F.count("*").alias("cells"), F.count_distinct("fact_id").alias("facts"))


def x27_nested(spark, sf_dir):
    """Groups of a supplier: the residues of part numbers in each of its orders."""
    g = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_orderkey").agg(F.collect_list(F.concat(F.lit("u"), F.col("l_partkey") % 7)).alias("group_unit_ids"))
    n = X.nested_groups(g, ["l_suppkey"])
    return n.select("l_suppkey", F.array_join("units", ",").alias("units"), "groups", "outers", F.array_join("outer", ",").alias("outer"))


def x28_routing(spark, sf_dir):
    drafts = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_orderpriority").alias("source_sha256"), F.col("o_orderstatus").alias("draft_sha256"), (F.col("o_totalprice") < 20000).alias("source_empty"), (F.col("o_custkey") % 2 == 0).alias("closed_world"))
    facets = F.when(F.col("l_quantity") > 10, F.array(F.lit("coverage"), F.lit("scope"))).otherwise(F.array(F.lit("scope")))
    receipts = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus"), F.col("l_orderkey") == F.col("o_orderkey"))
    receipts = receipts.select(F.col("l_orderkey").alias("job_id"), F.when(F.col("l_returnflag") == "R", "stale").otherwise(F.col("o_orderpriority")).alias("source_sha256"), F.col("o_orderstatus").alias("draft_sha256"), facets.alias("facets"), (F.col("l_linestatus") == "F").alias("trusted"))
    return X.review_routing(drafts, receipts, ["coverage", "scope"]).groupBy("route", "reason").agg(F.count("*").alias("jobs"))


QUERIES = {f.__name__: f for f in (x01_grid, x02_seeded_order, x03_pending, x04_counters, x05_review, x07_conflicts, x08_agreement, x09_pairs, x10_stability, x11_family_means, x12_blind, x13_hints, x13_strata, x13_libraries, x13_totals, x15_rounds, x16_labels, x17_accept, x21_merge, x24_windows, x25_anchors, x25_footprints, x26_outcome, x27_cells, x27_findings, x27_nested, x28_routing)}

_N = "count(*) FILTER (WHERE {})".format
_DONE = "status = 'completed' AND expected IS NOT NULL AND decision IS NOT NULL"
COUNTERS = f"""count(*) AS scheduled, {_N("status = 'completed'")} AS completed, {_N("status = 'technical_failure'")} AS technical_failure, {_N("status = 'protocol_failure'")} AS protocol_failure, {_N("status = 'not_run'")} AS not_run,
  {_N("expected")} AS valid_trials, {_N("NOT expected")} AS invalid_trials, {_N("expected IS NULL")} AS unadjudicated_trials, {_N(_DONE)} AS decided, {_N(_DONE + " AND expected")} AS valid_decided, {_N(_DONE + " AND NOT expected")} AS invalid_decided,
  {_N(_DONE + " AND expected = decision")} AS correct_disposition, {_N(_DONE + " AND expected AND NOT decision")} AS false_block, {_N(_DONE + " AND NOT expected AND decision")} AS unsafe_accept,
  {_N("status = 'completed' AND expected IS NOT NULL AND decision IS NULL")} AS needs_adjudication, {_N("status = 'completed' AND expected IS NULL")} AS unadjudicated"""
_RATE = "round({} / nullif({}, 0), 6) AS {}".format
_J = f"WITH j AS ({JOBS_SQL})"
_HINTS = """WITH r AS (SELECT l_orderkey AS case_id, o_custkey AS family_id, CASE WHEN l_quantity % 5 > 0 THEN l_partkey END AS f, l_returnflag AS library, CASE WHEN l_quantity > 40 THEN 'warning' WHEN l_linestatus = 'O' THEN 'conflict_hints' ELSE 'matches' END AS kind, l_suppkey % 7 = 0 AS excluded FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
h AS (SELECT *, kind <> 'warning' AND NOT excluded AS use, CASE WHEN f % 4 > 0 AND f % 10 = 1 THEN 'base_proof' WHEN f % 4 > 0 THEN 'noise_fact' ELSE 'unassigned' END AS relevance FROM r)"""
_STRATUM = "CASE WHEN p > 0 THEN 'base_proof_related' WHEN coalesce(hints, 0) = 0 THEN 'empty_fact_hints' WHEN z = hints THEN 'noise_only' ELSE 'nonproof_or_unassigned_only' END"
SQL = {
    "x01_grid": "SELECT c_mktsegment, arm, repeat::INT AS repeat, count(*) AS jobs FROM (SELECT c_mktsegment, arm, unnest(range(1, c_nationkey % 4 + 1)) AS repeat FROM customer, (VALUES ('generic'), ('skills')) AS a(arm)) GROUP BY ALL",
    "x02_seeded_order": "SELECT o_orderkey, row_number() OVER (ORDER BY sha256('seed-7|' || o_orderkey), o_orderkey) - 1 AS position FROM orders",
    "x03_pending": "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')",
    "x04_counters": f"{_J}, c AS (SELECT track, arm, {COUNTERS} FROM j GROUP BY ALL) SELECT *, {_RATE('unsafe_accept', 'invalid_trials', CLOSED[0])}, {_RATE('false_block', 'valid_trials', CLOSED[1])}, {_RATE('unsafe_accept', 'invalid_decided', CLOSED[2])}, {_RATE('false_block', 'valid_decided', CLOSED[3])}, {_RATE('decided', '(scheduled - unadjudicated_trials)', CLOSED[4])} FROM c",
    "x05_review": f"""{_J}, r AS (SELECT *, expected IS NULL AS open, coalesce(expected, false) AS valid, coalesce(CASE WHEN repeat <= 6 THEN NOT expected WHEN expected IS NOT NULL THEN false END, NOT coalesce(expected, false)) AS major, coalesce(verdict = 'pass', false) AS passed, NOT (expected IS NULL) AND status = 'completed' AS decided, repeat % 3 = arm::INT % 3 AS same FROM j),
o AS (SELECT *, CASE WHEN valid AND NOT passed THEN 'fb' WHEN major AND passed THEN 'ua' WHEN NOT valid AND passed THEN 'im' ELSE 'ok' END AS outcome FROM r)
SELECT track, arm, count(*) AS scheduled, {_N('open')} AS unadjudicated, {_N('NOT open AND valid')} AS valid_trials, {_N('NOT open AND NOT valid')} AS defective_trials, {_N('NOT open AND major')} AS major_defect_trials, {_N('decided')} AS decided,
  {_N("decided AND outcome = 'fb'")} AS false_block, {_N("decided AND outcome = 'ua'")} AS unsafe_accept, {_N("decided AND outcome = 'im'")} AS incorrect_minor_disposition, {_N("decided AND outcome = 'ok'")} AS correct_disposition,
  {_N('decided AND NOT valid')} AS defect_localization_trials, {_N('decided AND NOT valid AND same')} AS defect_code_match FROM o GROUP BY ALL""",
    "x07_conflicts": f"""{_J}, r AS (SELECT *, CASE WHEN repeat % 2 = 0 THEN 'review' ELSE 'scoring' END AS kind, CASE WHEN repeat > 6 THEN 'needs_revision_structural' ELSE verdict END AS disposition, repeat > 9 AS wrong FROM j),
c AS (SELECT kind, CASE WHEN kind = 'review' AND decision AND disposition = 'needs_revision_structural' THEN 'overridden_pass' WHEN kind = 'scoring' AND decision AND wrong THEN 'supported_but_incorrect' END AS conflict, false AS program FROM r)
SELECT kind, conflict, program, count(*) AS rows FROM c WHERE conflict IS NOT NULL GROUP BY ALL""",
    "x08_agreement": f"""{_J}, d AS (SELECT track, 'answer' AS dimension, expected AS r, decision AS m FROM j UNION ALL SELECT track, 'proof', NOT expected, CASE WHEN repeat <> 5 THEN repeat > 5 END FROM j),
c AS (SELECT track, dimension, {_N('r IS NULL')} AS reference_unadjudicated, {_N('r IS NOT NULL')} AS completed_reference_trials, {_N('r IS NOT NULL AND m IS NULL')} AS model_undetermined, {_N('r IS NOT NULL AND m IS NOT NULL')} AS model_decided, {_N('r = m')} AS agreement FROM d GROUP BY ALL)
SELECT *, model_decided - agreement AS error, round(agreement / nullif(model_decided, 0), 6) AS agreement_among_decided FROM c""",
    "x09_pairs": f"""{_J}, one AS (SELECT track, case_id, repeat, arm, max_by(struct_pack(s := status, d := decision, e := expected), job_id) AS v FROM j WHERE arm IN ('1', '2') GROUP BY ALL),
p AS (SELECT track, case_id, repeat, bool_or(v.e) AS e, coalesce(bool_or(CASE WHEN arm = '1' THEN v.s = 'completed' END), false) AS ok1, coalesce(bool_or(CASE WHEN arm = '2' THEN v.s = 'completed' END), false) AS ok2, bool_or(CASE WHEN arm = '1' THEN v.d END) AS b, bool_or(CASE WHEN arm = '2' THEN v.d END) AS a FROM one GROUP BY ALL),
r AS (SELECT *, CASE WHEN e IS NULL THEN 'unadjudicated' WHEN NOT (ok1 AND ok2) THEN 'not_completed' WHEN a IS NULL OR b IS NULL THEN 'undecided' END AS reason FROM p)
SELECT track, count(*) AS scheduled_pairs, {_N("reason = 'unadjudicated'")} AS excluded_unadjudicated, {_N("reason = 'not_completed'")} AS excluded_not_completed, {_N("reason = 'undecided'")} AS excluded_undecided, {_N('reason IS NULL')} AS paired_decisive, {_N('reason IS NULL AND b <> e AND a = e')} AS corrections, {_N('reason IS NULL AND b = e AND a <> e')} AS introduced_errors FROM r GROUP BY 1""",
    "x10_stability": f"""{_J}, s AS (SELECT case_id, arm, count(*) AS runs, {_N("status = 'completed'")} AS done, {_N("status = 'completed' AND verdict IS NOT NULL")} AS dec, string_agg(CASE WHEN status = 'completed' THEN coalesce(verdict, 'none') ELSE status END, ',' ORDER BY CASE WHEN status = 'completed' THEN coalesce(verdict, 'none') ELSE status END) AS verdicts, count(DISTINCT CASE WHEN status = 'completed' THEN coalesce(verdict, 'none') END) AS kinds FROM j GROUP BY ALL)
SELECT case_id, arm, runs, verdicts, runs = 3 AND done = 3 AS all_valid, runs = 3 AND done = 3 AND dec = 3 AS all_decisive, runs = 3 AND done = 3 AND kinds = 1 AS all_same FROM s""",
    "x11_family_means": f"{_J}, c AS (SELECT track, arm, family_id, {COUNTERS} FROM j GROUP BY ALL) SELECT track, arm, count(*) AS families, count(unsafe_accept / nullif(invalid_trials, 0)) AS families_with_rate, round(avg(unsafe_accept / nullif(invalid_trials, 0)), 6) AS family_mean FROM c GROUP BY ALL",
    "x12_blind": f"{_J}, b AS (SELECT arm, count(*) AS scheduled, {_N(chr(39).join(['status = ', 'completed', '']))} AS completed, {_N(chr(39).join(['status = ', 'completed', ' AND decision']))} AS answer_ok, {_N(chr(39).join(['status = ', 'completed', ' AND decision AND expected']))} AS proof_ok FROM j GROUP BY ALL) SELECT *, round(answer_ok / nullif(completed, 0), 6) AS answer_ok_rate, round(proof_ok / nullif(completed, 0), 6) AS proof_ok_rate, round(completed / scheduled, 6) AS coverage FROM b",
    "x13_hints": """WITH p AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_linenumber = 1), h AS (SELECT l_orderkey, CASE WHEN l_quantity <= 45 THEN l_partkey END AS f, l_returnflag AS library, CASE l_linestatus WHEN 'O' THEN 'warning' ELSE 'match' END AS kind FROM lineitem)
SELECT library, kind, CASE WHEN f IS NULL THEN 'unassigned' WHEN l_partkey IS NOT NULL THEN 'base_proof' ELSE 'noise_fact' END AS relevance, count(*) AS hints, count(DISTINCT h.l_orderkey) AS cases FROM h LEFT JOIN p ON h.l_orderkey = p.l_orderkey AND f = l_partkey GROUP BY ALL""",
    "x13_strata": f"""{_HINTS}, g AS (SELECT case_id, count(*) FILTER (WHERE use) AS hints, count(*) FILTER (WHERE use AND relevance = 'base_proof') AS p, count(*) FILTER (WHERE use AND relevance = 'noise_fact') AS z FROM h GROUP BY 1)
SELECT o_orderkey AS case_id, coalesce(hints, 0) AS hints, {_STRATUM} AS stratum FROM orders LEFT JOIN g ON o_orderkey = case_id""",
    "x13_libraries": f"""{_HINTS}, g AS (SELECT case_id, library, count(*) FILTER (WHERE use) AS hints, count(*) FILTER (WHERE use AND relevance = 'base_proof') AS p, count(*) FILTER (WHERE use AND relevance = 'noise_fact') AS z FROM h GROUP BY ALL)
SELECT library, {_STRATUM} AS stratum, count(*) AS cases FROM g GROUP BY ALL""",
    "x13_totals": f"""{_HINTS}, g AS (SELECT *, use AND relevance = 'base_proof' AS p, use AND kind = 'conflict_hints' AS c FROM h)
SELECT library, count(*) FILTER (WHERE use) AS usable, count(*) FILTER (WHERE p) AS base_proof, count(*) FILTER (WHERE use AND NOT p) AS nonproof, count(*) FILTER (WHERE excluded AND kind <> 'warning') AS excluded, count(*) FILTER (WHERE kind = 'warning') AS warnings, count(*) FILTER (WHERE c) AS conflicts,
  count(DISTINCT case_id) FILTER (WHERE use) AS cases_with_any, count(DISTINCT case_id) FILTER (WHERE p) AS cases_with_proof, count(DISTINCT case_id) FILTER (WHERE c) AS cases_with_conflict,
  count(DISTINCT family_id) FILTER (WHERE use) AS families_with_any, count(DISTINCT family_id) FILTER (WHERE p) AS families_with_proof, count(DISTINCT family_id) FILTER (WHERE c) AS families_with_conflict FROM g GROUP BY 1""",
    "x15_rounds": """WITH o AS (SELECT o_orderkey AS k, o_totalprice > 50000 AS e, o_orderpriority AS p FROM orders WHERE o_orderkey % 3 <> 0), n AS (SELECT o_orderkey AS k, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice > 80000 END AS e, CASE WHEN o_orderkey % 5 = 0 THEN 'x' ELSE o_orderpriority END AS p FROM orders WHERE o_orderkey % 4 <> 0)
SELECT CASE WHEN n.k IS NULL THEN 'old_only' WHEN o.k IS NULL THEN 'new_only' WHEN o.e IS NULL OR n.e IS NULL THEN 'unadjudicated' WHEN o.e <> n.e THEN 'reference_changed' ELSE 'eligible' END AS comparison, o.p IS NOT DISTINCT FROM n.p AS same_payload, count(*) AS cases FROM o FULL JOIN n ON o.k = n.k GROUP BY ALL""",
    "x16_labels": f"{_J}, l AS (SELECT arm, expected, decision, unnest(list_filter(['all', CASE WHEN repeat <= 6 THEN 'first_half' END, CASE WHEN track = 'BUILDING' THEN 'building' END], lambda x: x IS NOT NULL)) AS label FROM j) SELECT label, arm, count(*) AS rows, {_N('expected = decision')} AS agreement FROM l GROUP BY ALL",
    "x17_accept": f"{_J} SELECT track, arm, {_N('expected')} AS planned_valid, {_N('NOT expected')} AS planned_invalid, {_N('expected AND decision')} AS correct_accept, {_N('NOT expected AND NOT decision')} AS correct_reject, {_N('expected AND NOT decision')} AS false_block, {_N('NOT expected AND decision')} AS false_accept, {_N('decision IS NULL')} AS undetermined FROM j WHERE repeat <> 12 AND expected IS NOT NULL GROUP BY ALL",
    "x21_merge": """WITH r AS (SELECT l_orderkey, l_quantity = 50 AS hard, CASE WHEN l_returnflag = 'R' THEN 'unsupported' WHEN l_discount < 0.09 THEN 'supported' END AS a, CASE WHEN l_linenumber = 1 THEN 'unsupported' WHEN l_linenumber < 5 THEN 'supported' END AS b FROM lineitem),
s AS (SELECT l_orderkey, count(*) AS steps, bool_or(hard) AS h, bool_or(a IS NULL OR b IS NULL) AS u, coalesce(bool_or(a = 'unsupported' OR b = 'unsupported'), false) AS f FROM r GROUP BY 1)
SELECT CASE WHEN h THEN 'incorrect' WHEN u THEN 'needs_review' WHEN f THEN 'incorrect' ELSE 'supported' END AS isolation, CASE WHEN h OR f THEN 'incorrect' WHEN u THEN 'needs_review' ELSE 'supported' END AS failure_first, count(*) AS answers, sum(steps)::BIGINT AS steps FROM s GROUP BY ALL""",
    "x24_windows": """WITH u AS (SELECT DISTINCT l_orderkey, l_linenumber, l_suppkey FROM lineitem), p AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey) - 1 AS n FROM u)
SELECT o_custkey AS fact_id, (n // 3)::INT AS "window", count(*) AS units, max(n % 3)::INT AS last_slot FROM orders JOIN p ON o_orderkey = l_orderkey GROUP BY ALL""",
    "x25_anchors": "SELECT l_partkey, l_suppkey, CASE WHEN bool_or(l_returnflag = 'A') THEN 'support_proposed' WHEN bool_or(l_returnflag = 'N') THEN 'unresolved' ELSE 'not_found' END AS status, count(*) AS anchors FROM lineitem GROUP BY ALL",
    "x25_footprints": """WITH f AS (SELECT l_suppkey, l_orderkey, string_agg(DISTINCT 'u' || l_partkey % 5, ',' ORDER BY 'u' || l_partkey % 5) AS footprint FROM lineitem GROUP BY ALL)
SELECT *, dense_rank() OVER (PARTITION BY l_suppkey ORDER BY footprint) - 1 AS group_index, count(*) OVER (PARTITION BY l_suppkey, footprint) > 1 AS duplicate FROM f""",
    "x26_outcome": "WITH g AS (SELECT l_orderkey, bool_or(l_quantity > 48) AS bad, bool_or(l_returnflag <> 'A' OR l_linestatus <> 'F') AS open FROM lineitem GROUP BY 1) SELECT CASE WHEN bad THEN 'rejected' WHEN open THEN 'needs_adjudication' ELSE 'passed' END AS outcome, count(*) AS groups FROM g GROUP BY 1",
    "x27_cells": """WITH e AS (SELECT o_orderkey AS f, unnest(range(1, 8)) AS u FROM orders), s AS (SELECT l_orderkey AS f, l_linenumber AS u, count(*) AS n FROM lineitem GROUP BY ALL),
b AS (SELECT coalesce(e.u, s.u)::INT AS unit_id, CASE WHEN s.f IS NULL THEN 'missing' WHEN e.f IS NULL THEN 'unexpected' WHEN n > 1 THEN 'repeated' END AS "check" FROM e FULL JOIN s ON e.f = s.f AND e.u = s.u) SELECT unit_id, "check", count(*) AS cells FROM b WHERE "check" IS NOT NULL GROUP BY ALL""",
    "x27_findings": """WITH c AS (SELECT l_orderkey AS f, l_linenumber AS u, CASE WHEN l_quantity > 45 THEN 'unresolved' WHEN l_returnflag = 'R' THEN 'not_supporting' WHEN l_linenumber = 1 THEN 'support_anchor' ELSE 'support_context' END AS s FROM lineitem),
g AS (SELECT l_orderkey AS f, l_returnflag, CASE WHEN count(*) > 2 THEN min(l_linenumber) ELSE 1 END AS a, list(DISTINCT l_linenumber) AS m FROM lineitem WHERE l_returnflag <> 'R' GROUP BY ALL),
w AS (SELECT f, u, min(w) AS w FROM (SELECT f, a AS u, 'support_anchor' AS w FROM g UNION ALL SELECT f, unnest(m), 'support_context' FROM g) GROUP BY ALL),
k AS (SELECT 'label' AS "check", c.u, c.f FROM c LEFT JOIN w ON c.f = w.f AND c.u = w.u WHERE CASE WHEN w.w IS NULL THEN s NOT IN ('not_supporting', 'unresolved') ELSE s <> w.w END
  UNION ALL SELECT 'unresolved', u, f FROM c WHERE s = 'unresolved'
  UNION ALL SELECT 'concealed', NULL, o_orderkey FROM orders WHERE o_orderstatus = 'P' AND o_orderkey IN (SELECT f FROM c WHERE s = 'unresolved')
  UNION ALL SELECT 'anchor_outside', a, f FROM g WHERE NOT list_contains(m, a)
  UNION ALL SELECT 'repeated_anchor', a, f FROM g GROUP BY a, f HAVING count(*) > 1)
SELECT "check", u::INT AS unit_id, count(*) AS cells, count(DISTINCT f) AS facts FROM k GROUP BY ALL""",
    "x27_nested": """WITH g AS (SELECT l_suppkey, l_orderkey, list_sort(list(DISTINCT 'u' || l_partkey % 7)) AS u FROM lineitem GROUP BY ALL), s AS (SELECT l_suppkey, u, count(*) AS groups FROM g GROUP BY ALL)
SELECT a.l_suppkey, array_to_string(a.u, ',') AS units, a.groups, count(*) AS outers, array_to_string(min(b.u), ',') AS "outer" FROM s a JOIN s b ON a.l_suppkey = b.l_suppkey AND len(b.u) > len(a.u) AND list_has_all(b.u, a.u) GROUP BY a.l_suppkey, a.u, a.groups""",
    "x28_routing": """WITH r AS (SELECT l_orderkey, max(CASE WHEN l_returnflag = 'R' THEN 1 WHEN l_linestatus <> 'F' THEN 2 WHEN l_quantity <= 10 THEN 3 ELSE 4 END) AS l FROM lineitem GROUP BY 1),
d AS (SELECT CASE WHEN o_totalprice < 20000 AND o_custkey % 2 = 0 THEN 'closed_world_empty' ELSE ['no_receipt', 'stale_receipt', 'untrusted_receipt', 'facets_missing', 'trusted_receipt'][coalesce(l, 0) + 1] END AS reason FROM orders LEFT JOIN r ON o_orderkey = l_orderkey)
SELECT CASE WHEN reason IN ('closed_world_empty', 'trusted_receipt') THEN 'determinate' ELSE 'requires_review' END AS route, reason, count(*) AS jobs FROM d GROUP BY ALL""",
}
