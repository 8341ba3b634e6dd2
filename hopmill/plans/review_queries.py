"""Queries of the answer and review gates and of the scorer's pieces on the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from hopmill.operators import graph as G
from hopmill.operators import metrics as M
from hopmill.operators import reviews as R
from hopmill.plans.accounting_queries import _J, _N
from hopmill.plans.bindings import ORDER_TRIALS_SQL, jobs, order_trials, rounded, table
from hopmill.sources.shared import written_as_dealt
from hopmill.plans.metric_queries import COUNTS, MACRO, MEANS, QUESTIONS


def lines(spark, sf_dir):
    """One row for each line of an order, with n, its place from 0. Lines are dealt by their order once, which is what all later steps go by."""
    rows = table(spark, sf_dir, "lineitem").repartition("l_orderkey").groupBy("l_orderkey", "l_linenumber").agg(*(F.max(c).alias(c[2:]) for c in ("l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus")))
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber")  # an order has few lines by its nature
    return rows.withColumn("n", F.row_number().over(w) - 1)


LINES = """lines AS (SELECT l_orderkey, l_linenumber, max(l_partkey) AS partkey, max(l_suppkey) AS suppkey, max(l_quantity) AS quantity, max(l_discount) AS discount, max(l_tax) AS tax, max(l_returnflag) AS returnflag, max(l_linestatus) AS linestatus FROM lineitem GROUP BY ALL)"""


def m02_tristate(spark, sf_dir):
    q = M.question_metrics(M.verdict_counts(order_trials(spark, sf_dir), ["partition", "family_id", "case_id"]))
    return q.select("partition", "case_id", "metric", F.round("lower.value", 9).alias("lower"), F.round("upper.value", 9).alias("upper"), F.round("point.value", 9).alias("point"), "status")


def m08_hops(spark, sf_dir):
    claim = F.when(F.col("o_orderstatus") == "F", "certified_under_explicit_contract").when(F.col("o_orderstatus") == "O", "local_dependency_only").otherwise("none")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case_id"), claim.alias("hop_claim_status"), (F.col("o_custkey") % 4 + 1).cast("int").alias("declared_hops"))
    q = M.question_metrics(M.verdict_counts(order_trials(spark, sf_dir).withColumn("dimension", F.lit("answer")), ["dimension", "case_id"])).join(o, "case_id")
    return rounded(M.hop_subgroups(q), "point", "lower", "upper", "complete_only")


def m10_rules(spark, sf_dir):
    key, total = F.col("o_orderkey"), F.col("o_totalprice")
    word = lambda c: F.when(c % 3 == 0, "pass").when(c % 3 == 1, "fail")
    rows = table(spark, sf_dir, "orders").select(
        key.alias("trial_id"), F.when(F.col("o_orderstatus") == "P", "pending").otherwise("accepted").alias("status"),
        F.struct(word(key).alias("answer"), word(F.col("o_custkey")).alias("logical_proof"), word(key + F.col("o_custkey")).alias("output_contract")).alias("verdicts"),
        F.when(key % 5 == 0, F.array(F.lit("ann"), F.lit("ann"))).when(key % 5 == 1, F.array(F.lit("ann"), F.lit("eve"))).when(key % 5 < 4, F.array(F.lit("ann"), F.lit("bob"))).alias("reviewers"),
        F.when(key % 7 > 0, "bob").alias("approved_by"), (total > 20000).alias("independent_review"), F.when(total < 250000, F.concat(F.lit(" "), F.substring("o_orderpriority", 1, 1))).alias("rationale"),
    )
    return M.verdict_violations(rows, ["ann", "bob"], "bob").groupBy("check").agg(F.count("*").alias("trials"), F.sum("key").alias("keys"))


def m11_grades(spark, sf_dir):
    slots = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("trial_id"), F.col("o_custkey").alias("case_id"))
    g = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("trial_id")).agg(F.when(F.max("l_quantity") > 20, "P").otherwise("F").alias("answer"), F.max(F.when(F.col("l_returnflag") == "A", "P")).alias("logical_proof"), F.min(F.when(F.col("l_linestatus") == "F", "F").otherwise("P")).alias("output_contract"))
    return M.attach_grades(slots, g)


def m11_violations(spark, sf_dir):
    slots = table(spark, sf_dir, "orders").where("o_orderkey % 6 > 0").select(F.col("o_orderkey").alias("trial_id"), F.col("o_custkey").alias("case_id"))
    grades = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("trial_id"), "l_linenumber").join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("trial_id"), "o_custkey"), "trial_id")
    grades = grades.select("trial_id", F.when(F.col("l_linenumber") == 2, F.col("o_custkey") + F.col("trial_id") % 2).otherwise(F.col("o_custkey")).alias("case_id"))
    return M.grade_violations(slots, grades, ["case_id"])


def x14_strata(spark, sf_dir):
    one = jobs(spark, sf_dir).groupBy("track", "case_id", "repeat", "arm").agg(F.max_by(F.struct("status", "decision", "expected"), "job_id").alias("s")).select("track", "case_id", "repeat", "arm", "s.*")
    c = table(spark, sf_dir, "customer").where("c_nationkey % 3 < 2").select(F.col("c_custkey").alias("case_id"), F.when(F.col("c_nationkey") % 3 == 0, "proof_hint").otherwise("noise_only").alias("stratum"))
    return R.pairs_by_stratum(one, c, ["case_id", "repeat"], ["track"], "1", "2")


def x18_reviews(spark, sf_dir):
    k, text = F.col("doc_id"), F.col("text")
    none = F.array().cast(f"array<{R.CITATION}>")
    cite = lambda q: F.struct(k.cast("string").alias("context_id"), q.alias("quote"))
    d = table(spark, sf_dir, "documents").withColumn("owner_id", F.col("source"))
    step = lambda i: F.struct(i.cast("int").alias("step"), ((k + i) % 23 > 0).alias("supported"), F.when((k + i) % 29 > 0, F.array(cite(F.substring(text, i * 10 + 1, F.lit(12))))).otherwise(none).alias("evidence"))
    rows = d.select(
        k.alias("review_id"), "owner_id", F.when(k % 3 > 0, "pass").otherwise("revise").alias("verdict"),
        F.array(k % 5 > 0, F.when(k % 11 > 0, F.lit(True))).alias("flags"), F.array(F.when(k % 13 == 0, "major").otherwise("minor")).alias("findings"),
        F.element_at(F.array(*map(F.lit, ("shortcut", "necessary", "necessary", "not_applicable"))), (k % 4 + 1).cast("int")).alias("two_hop_verdict"),
        F.when(k % 6 == 0, F.array(cite(F.col("lang")))).when(k % 6 > 1, none).alias("two_hop_evidence"),
        F.transform(F.filter(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda i: i < k % 4), step).alias("step_reviews"),
        F.when(k % 10 == 0, "insufficient_evidence").when(k % 10 == 1, "ambiguous").otherwise("answerable").alias("candidate_status"),
        F.when(k % 8 > 0, 2).alias("n_steps"), (k % 17 > 0).alias("structural_valid"), (k % 19 == 0).alias("review_required"),
    )
    out = R.review_gate(rows, d.select("owner_id", k.cast("string").alias("context_id"), "text"))
    return out.select("review_id", F.array_join("errors", ",").alias("errors"), "disposition")


def x18_checklists(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.collect_list(F.struct(F.col("l_returnflag").alias("name"), (F.col("l_quantity") < 48).alias("passed"))).alias("checks"),
        F.collect_list(F.when(F.col("l_discount") > 0.095, "major")).alias("issues"), F.collect_list(F.when(F.col("l_tax") > 0.075, "rewrite")).alias("required_changes"))
    rows = g.join(table(spark, sf_dir, "orders"), "o_orderkey").withColumns({"review_id": F.col("o_orderkey"), "verdict": F.when(F.col("o_orderstatus") == "F", "pass").otherwise("revise")})
    return R.checklist_violations(rows, ["A", "N"])


def _answer_inputs(spark, sf_dir):
    """Orders as items: the proof goes from the order through the parts of its lines; what was submitted departs from it by the line's values."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    x = lines(spark, sf_dir).join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    line = F.struct("n", F.col("l_linenumber").alias("l_linenumber"), F.concat(F.lit("p"), "partkey").alias("to"), F.col("returnflag").alias("returnflag"), (F.col("discount") >= 0.095).alias("lost"), (F.col("quantity") > 45).alias("many"), (F.col("tax") < 0.075).alias("joined"), "o_orderstatus", "l_orderkey")
    # what all tables below read, dealt by the name of the order, so that one shuffle serves them
    rows = x.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("_x")).groupBy(F.col("l_orderkey").cast("string").alias("owner_id")).agg(F.first("_x").alias("_x"))
    rows = rows.withColumn("_x", F.transform("_x", lambda r: r.withField("fact", F.concat_ws("-", r["l_orderkey"], r["l_linenumber"])).withField("said", F.when(r["returnflag"] == "R", "other").otherwise(r["returnflag"])).withField("quote", F.when(r["lost"], "missing").otherwise(F.concat(F.lit("line "), r["l_linenumber"])))))
    x, at = rows.select("owner_id", F.inline("_x")), (lambda c: F.transform("_x", lambda r: r[c]))
    first = F.element_at("_x", 1)
    g = rows.select("owner_id", F.col("owner_id").alias("item_id"), first["o_orderstatus"].alias("o_orderstatus"), first["l_orderkey"].alias("l_orderkey"), *(at(c).alias(c) for c in ("to", "fact", "returnflag", "said", "quote", "l_linenumber")))
    g = g.withColumn("entities", F.concat(F.array(F.concat(F.lit("o"), "l_orderkey")), F.col("to")))
    blank, name = F.col("o_orderstatus") == "P", lambda e: F.concat(F.lit("the "), e)
    cite = lambda q: F.array(F.struct(F.lit("c").alias("context_id"), q.alias("quote")))
    step = lambda i: F.struct(name(F.get("entities", i)).alias("from_name"), F.get("said", i).alias("relation"), name(F.get("entities", i + 1)).alias("to_name"), cite(F.get("quote", i)).alias("evidence"))
    steps = F.transform(F.sequence(F.lit(0), F.size("to") - 1), step)
    answer = F.when(F.col("o_orderstatus") == "F", name(F.element_at("to", -1))).otherwise("the order")
    submitted = g.select("item_id", "owner_id", F.when(blank, "insufficient_evidence").otherwise("answerable").alias("status"), F.filter(F.array(answer), lambda a: ~blank).alias("answers"), F.filter(steps, lambda s: ~blank).alias("steps"), F.array().cast(f"array<{R.CITATION}>").alias("evidence"))
    none = blank & (F.col("l_orderkey") % 2 == 0)
    gold = g.select("item_id", F.when(none, "insufficient_evidence").otherwise("answerable").alias("status"), F.filter(F.array(F.element_at("to", -1)), lambda a: ~none).alias("answer_ids"))
    proofs = g.select("item_id", F.lit(1).alias("proof_no"), "entities", F.col("returnflag").alias("relations"), F.col("fact").alias("facts"))
    surfaces = g.select("owner_id", F.explode("entities").alias("entity_id")).withColumn("surface", name(F.col("entity_id")))
    each = F.zip_with("l_linenumber", "to", lambda n, p: F.concat(F.lit("line "), n, F.lit(" holds "), p))
    contexts = g.select("owner_id", F.lit("c").alias("context_id"), F.concat(F.lit("top; "), F.array_join(each, "; "), F.lit(";")).alias("text"))
    cited = lambda no, quote: F.struct(F.col("fact").alias("fact_id"), F.lit(1).alias("group_no"), F.lit(no).alias("cite_no"), F.lit("c").alias("context_id"), quote.alias("quote"))
    top = F.when(F.col("many"), cited(2, F.lit("top")))
    references = x.select("owner_id", F.inline(F.array_compact(F.array(cited(1, F.concat(F.lit("line "), "l_linenumber", F.lit(" holds "), "to", F.lit(";"))), top))))
    return x, (submitted, gold, proofs, surfaces, contexts, references)


def x19_answers(spark, sf_dir):
    return written_as_dealt(R.answer_checks(*_answer_inputs(spark, sf_dir)[1]), "answers")


def x20_assessment(spark, sf_dir):
    x, inputs = _answer_inputs(spark, sf_dir)
    shapes = G.path_shape(x.select(F.col("owner_id").alias("item_id"), F.col("n").alias("step_no"), F.col("n").alias("from_id"), F.when(F.col("joined"), F.col("n") + 1).alias("to_id"), (F.col("returnflag") != "R").alias("role_ok")))
    checks = written_as_dealt(R.answer_checks(*inputs), "answers")
    return R.assessment(checks, shapes).groupBy("shape", "strict", "provisional").agg(F.count("*").alias("items"))


def x22_steps(spark, sf_dir):
    x = lines(spark, sf_dir)
    own, foreign = F.concat(F.lit("p"), "partkey"), F.lit("elsewhere")
    steps = x.select(F.col("l_orderkey").alias("item_id"), F.col("l_linenumber").alias("step_id"), F.array(F.concat(F.lit("s"), "suppkey"), own).alias("submitted"))
    used = F.when(F.col("l_linenumber") % 3 == 1, F.array(own)).when(F.col("l_linenumber") % 3 == 2, F.array(own, foreign))
    rev = x.withColumn("_copies", F.when(F.col("quantity") >= 50, 0).when(F.col("quantity") >= 49, 2).otherwise(1)).withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.col("_copies"))))
    rev = rev.select(F.col("l_orderkey").alias("item_id"), F.when(F.col("quantity") == 48, F.col("l_linenumber") + 100).otherwise(F.col("l_linenumber")).alias("step_id"), F.when(F.col("returnflag") == "A", "supported").otherwise("unsupported").alias("support"), used.alias("used"))
    return R.step_review_violations(rev, steps)


def x23_registrations(spark, sf_dir):
    x = lines(spark, sf_dir)
    text = F.concat_ws(" ", F.lit("order"), "l_orderkey", F.lit("entered"))
    c = lambda a, b, q: F.struct(F.lit("c").alias("context_id"), F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(q).alias("quote"))
    a, b, bad = c(0, 5, "order"), c(1, 5, "rder"), c(0, 4, "orde?")
    flag, empty = F.col("returnflag"), F.array().cast("array<array<struct<context_id string, start int, `end` int, quote string>>>")
    groups = F.when(F.col("quantity") >= 50, F.array(F.array(bad), F.slice(F.array(a), 1, 0))).when(F.col("tax") < 0.005, F.array(F.array(a, a))).when(flag == "A", F.array(F.array(a, b), F.array(b, a))).when(flag == "N", F.array(F.array(a))).otherwise(empty)
    facts = x.select(F.col("l_orderkey").alias("request_id"), F.col("l_linenumber").alias("fact_id"), F.when(F.col("linestatus") == "F", "support_proposed").otherwise("unresolved").alias("status"), groups.alias("groups"), "quantity")
    facts = facts.unionByName(facts.where("quantity = 2"))
    asked = x.where("quantity <> 3").select(F.col("l_orderkey").alias("request_id"), F.col("l_linenumber").alias("fact_id")).unionByName(x.where("n = 0 and partkey % 5 = 0").select(F.col("l_orderkey").alias("request_id"), F.lit(0).alias("fact_id")))
    return R.registration_violations(facts.drop("quantity"), asked, x.where("n = 0").select(F.col("l_orderkey").alias("request_id"), F.lit("c").alias("context_id"), text.alias("text")))


QUERIES = {f.__name__: f for f in (m02_tristate, m08_hops, m10_rules, m11_grades, m11_violations, x14_strata, x18_reviews, x18_checklists, x19_answers, x20_assessment, x22_steps, x23_registrations)}

_RULES = """r AS (SELECT *, (['pass', 'fail', NULL])[o_orderkey % 3 + 1] AS a, (['pass', 'fail', NULL])[o_custkey % 3 + 1] AS p, (['pass', 'fail', NULL])[(o_orderkey + o_custkey) % 3 + 1] AS c, o_orderkey % 5 AS m FROM orders WHERE o_orderstatus <> 'P'),
v AS (SELECT o_orderkey AS k, unnest(list_filter([
  CASE WHEN p = 'pass' AND a IS DISTINCT FROM 'pass' THEN 'proof_without_answer' END, CASE WHEN c = 'pass' AND NOT (p IS NOT DISTINCT FROM 'pass' AND a IS NOT DISTINCT FROM 'pass') THEN 'contract_without_proof' END,
  CASE WHEN m IN (0, 4) THEN 'fewer_than_two_reviewers' END, CASE WHEN m = 1 THEN 'unregistered_reviewer' END, CASE WHEN o_orderkey % 7 = 0 OR m NOT IN (2, 3) THEN 'not_approved' END,
  CASE WHEN o_totalprice <= 20000 THEN 'not_independent' END, CASE WHEN o_totalprice >= 250000 THEN 'no_rationale' END], lambda x: x IS NOT NULL)) AS "check" FROM r)"""
_ANSWERS = f"""{LINES}, l AS (SELECT l_orderkey, bool_or(returnflag = 'R') AS wrong, bool_or(discount >= 0.095) AS lost, bool_or(quantity > 45) AS half, bool_or(tax >= 0.075) AS open FROM lines GROUP BY 1),
s AS (SELECT *, o_orderstatus = 'P' AS blank, o_orderstatus = 'P' AND o_orderkey % 2 = 0 AS none FROM l JOIN orders ON l_orderkey = o_orderkey),
c AS (SELECT o_orderkey::VARCHAR AS item_id, CASE WHEN blank THEN none ELSE o_orderstatus = 'F' END AS answer_correct, CASE WHEN blank THEN none ELSE NOT wrong END AS path_correct, blank OR NOT lost AS quotes_located, CASE WHEN blank THEN none ELSE NOT (wrong OR lost OR half) END AS reference_covered, wrong, open FROM s),
a AS (SELECT *, answer_correct AND path_correct AND quotes_located AND reference_covered AS strict FROM c)"""
SQL = {
    "m02_tristate": f"""WITH t AS ({ORDER_TRIALS_SQL}), counts AS (SELECT "partition", case_id, {COUNTS} FROM t GROUP BY ALL), {QUESTIONS} SELECT "partition", case_id, metric, round(lower_num / den, 9) AS lower, round(upper_num / den, 9) AS upper, CASE WHEN unknown = 0 THEN round(lower_num / den, 9) END AS point, status FROM questions""",
    "m08_hops": f"""WITH t AS ({ORDER_TRIALS_SQL}), counts AS (SELECT case_id, {COUNTS} FROM t GROUP BY ALL), {QUESTIONS},
claims AS (SELECT 'local' AS claim, ['F', 'O'] AS s UNION ALL SELECT 'certified', ['F']),
h AS (SELECT claim, (o_custkey % 4 + 1)::INT AS declared_hops, 'answer' AS dimension, questions.* FROM questions JOIN orders ON case_id = o_orderkey JOIN claims ON list_contains(s, o_orderstatus) WHERE o_custkey % 4 + 1 IN (3, 4)),
m AS (SELECT claim, declared_hops, dimension, metric, {MACRO} FROM h GROUP BY ALL) SELECT claim, declared_hops, dimension, metric, questions, complete, underbudget, {MEANS}, round(complete_only, 6) AS complete_only FROM m""",
    "m10_rules": f"""WITH {_RULES} SELECT "check", count(*) AS trials, sum(k)::BIGINT AS keys FROM v GROUP BY 1""",
    "m11_grades": """WITH g AS (SELECT l_orderkey, CASE WHEN max(l_quantity) > 20 THEN 'P' ELSE 'F' END AS a, max(CASE WHEN l_returnflag = 'A' THEN 'P' END) AS p, min(CASE WHEN l_linestatus = 'F' THEN 'F' ELSE 'P' END) AS c FROM lineitem GROUP BY 1)
SELECT o_orderkey AS trial_id, o_custkey AS case_id, coalesce(a, 'U') AS answer, coalesce(p, 'U') AS logical_proof, coalesce(c, 'U') AS output_contract FROM orders LEFT JOIN g ON l_orderkey = o_orderkey""",
    "m11_violations": """WITH g AS (SELECT l_orderkey AS k, count(*) AS n, bool_or(l_linenumber = 2 AND l_orderkey % 2 = 1) AS d FROM lineitem GROUP BY 1)
SELECT unnest(list_filter([CASE WHEN k % 6 = 0 THEN 'extra' END, CASE WHEN n > 1 THEN 'repeated' END, CASE WHEN k % 6 > 0 AND d THEN 'identity' END], lambda x: x IS NOT NULL)) AS "check", k AS "key" FROM g""",
    "x14_strata": f"""{_J}, one AS (SELECT track, case_id, repeat, arm, max_by(struct_pack(s := status, d := decision, e := expected), job_id) AS v FROM j WHERE arm IN ('1', '2') GROUP BY ALL),
p AS (SELECT track, CASE c_nationkey % 3 WHEN 0 THEN 'proof_hint' WHEN 1 THEN 'noise_only' ELSE 'no_hint' END AS stratum, case_id, repeat, bool_or(v.e) AS e, coalesce(bool_or(CASE WHEN arm = '1' THEN v.s = 'completed' END), false) AS ok1, coalesce(bool_or(CASE WHEN arm = '2' THEN v.s = 'completed' END), false) AS ok2, bool_or(CASE WHEN arm = '1' THEN v.d END) AS b, bool_or(CASE WHEN arm = '2' THEN v.d END) AS a FROM one JOIN customer ON case_id = c_custkey GROUP BY ALL),
r AS (SELECT *, CASE WHEN e IS NULL THEN 'unadjudicated' WHEN NOT (ok1 AND ok2) THEN 'not_completed' WHEN a IS NULL OR b IS NULL THEN 'undecided' END AS reason FROM p)
SELECT track, stratum, count(*) AS scheduled_pairs, {_N("reason = 'unadjudicated'")} AS excluded_unadjudicated, {_N("reason = 'not_completed'")} AS excluded_not_completed, {_N("reason = 'undecided'")} AS excluded_undecided, {_N('reason IS NULL')} AS paired_decisive, {_N('reason IS NULL AND b <> e AND a = e')} AS corrections, {_N('reason IS NULL AND b = e AND a <> e')} AS introduced_errors FROM r GROUP BY ALL""",
    "x18_reviews": """WITH d AS (SELECT doc_id AS k, text, source, lang, doc_id % 3 > 0 AS passed, doc_id % 10 > 0 AS posed, doc_id % 4 AS n, CASE WHEN doc_id % 4 = 0 THEN 'shortcut' WHEN doc_id % 4 = 3 THEN 'not_applicable' ELSE 'necessary' END AS v FROM documents),
q AS (SELECT *, [0, 1, 2][:n] AS st FROM d),
e AS (SELECT *, coalesce(list_bool_or(list_transform(st, lambda i: (k + i) % 29 > 0 AND NOT coalesce(substr(text, i * 10 + 1, 12) <> '' AND contains(text, substr(text, i * 10 + 1, 12)), false))), false) OR (k % 6 = 0 AND NOT coalesce(lang <> '' AND contains(text, lang), false)) AS lost,
  coalesce(list_bool_or(list_transform(st, lambda i: (k + i) % 23 = 0 OR (k + i) % 29 = 0)), false) AS bare FROM q),
r AS (SELECT k, passed, list_filter([
  CASE WHEN lost THEN 'review_evidence_not_in_current_member' END, CASE WHEN passed AND (k % 5 = 0 OR k % 11 = 0) THEN 'pass_contradicts_support_flags' END, CASE WHEN passed AND k % 13 = 0 THEN 'pass_contradicts_findings' END,
  CASE WHEN passed AND posed AND v <> 'necessary' THEN 'pass_without_two_hop_necessity' END, CASE WHEN passed AND posed AND n <> 2 THEN 'step_review_coverage' END, CASE WHEN passed AND posed AND n = 2 AND bare THEN 'step_review_missing_support' END,
  CASE WHEN passed AND NOT posed AND v <> 'not_applicable' THEN 'insufficient_claim_necessity_not_applicable' END, CASE WHEN v = 'shortcut' AND k % 6 > 0 THEN 'shortcut_claim_without_location' END], lambda x: x IS NOT NULL) AS errors FROM e)
SELECT k AS review_id, array_to_string(errors, ',') AS errors, CASE WHEN k % 17 = 0 THEN 'needs_revision_structural' WHEN len(errors) > 0 OR k % 19 = 0 THEN 'needs_adjudication' WHEN passed THEN 'pass' ELSE 'revise' END AS disposition FROM r""",
    "x18_checklists": """WITH g AS (SELECT l_orderkey, count(*) > count(DISTINCT l_returnflag) AS twice, NOT (bool_or(l_returnflag = 'A') AND bool_or(l_returnflag = 'N')) AS lack, bool_or(l_quantity >= 48 OR l_discount > 0.095 OR l_tax > 0.075) AS bad FROM lineitem GROUP BY 1)
SELECT o_orderkey AS review_id, unnest(list_filter([CASE WHEN twice THEN 'repeated_check' END, CASE WHEN lack THEN 'omitted_check' END, CASE WHEN o_orderstatus = 'F' AND bad THEN 'pass_with_defects' END], lambda x: x IS NOT NULL)) AS "check" FROM orders JOIN g ON l_orderkey = o_orderkey""",
    "x19_answers": f"WITH {_ANSWERS} SELECT item_id, answer_correct, path_correct, quotes_located, reference_covered, strict FROM a",
    "x20_assessment": f"""WITH {_ANSWERS}, h AS (SELECT *, CASE WHEN wrong THEN 'incorrect' WHEN open THEN 'needs_semantic_review' ELSE 'correct' END AS shape FROM a)
SELECT shape, strict, CASE WHEN NOT answer_correct OR shape = 'incorrect' THEN 'incorrect' WHEN strict AND shape = 'correct' THEN 'structurally_correct' ELSE 'needs_semantic_review' END AS provisional, count(*) AS items FROM h GROUP BY ALL""",
    "x22_steps": f"""WITH {LINES}, r AS (SELECT l_orderkey AS item_id, l_linenumber, CASE WHEN quantity = 48 THEN l_linenumber + 100 ELSE l_linenumber END AS step_id, CASE WHEN quantity >= 50 THEN 0 WHEN quantity >= 49 THEN 2 ELSE 1 END AS n, quantity, returnflag FROM lines)
SELECT item_id, l_linenumber AS step_id, 'missing' AS "check" FROM r WHERE quantity >= 50 OR quantity = 48 UNION ALL SELECT item_id, step_id, 'unexpected' FROM r WHERE quantity = 48 UNION ALL SELECT item_id, step_id, 'repeated' FROM r WHERE n = 2
UNION ALL SELECT item_id, step_id, 'borrowed_citation' FROM r, range(n) WHERE quantity <> 48 AND l_linenumber % 3 = 2 UNION ALL SELECT item_id, step_id, 'support_without_citation' FROM r, range(n) WHERE quantity <> 48 AND l_linenumber % 3 = 0 AND returnflag = 'A'""",
    "x23_registrations": f"""WITH {LINES}, p AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) = 1 AS head FROM lines),
f AS (SELECT *, CASE WHEN quantity >= 50 THEN 'bad' WHEN tax < 0.005 THEN 'twice' ELSE returnflag END AS kind, linestatus = 'F' AS proposed FROM lines), g AS (SELECT * FROM f UNION ALL SELECT * FROM f WHERE quantity = 2)
SELECT l_orderkey AS request_id, 0 AS fact_id, 'missing' AS "check" FROM p WHERE head AND partkey % 5 = 0 UNION ALL SELECT l_orderkey, l_linenumber, 'unexpected' FROM f WHERE quantity = 3 UNION ALL SELECT l_orderkey, l_linenumber, 'repeated' FROM f WHERE quantity = 2
UNION ALL SELECT l_orderkey, l_linenumber, 'groups_and_status' FROM g WHERE (kind <> 'R') <> proposed UNION ALL SELECT l_orderkey, l_linenumber, 'empty_group' FROM g WHERE kind = 'bad' UNION ALL SELECT l_orderkey, l_linenumber, 'citation' FROM f WHERE kind = 'bad'
UNION ALL SELECT l_orderkey, l_linenumber, 'repeated_citation' FROM g WHERE kind = 'twice' UNION ALL SELECT l_orderkey, l_linenumber, 'repeated_group' FROM g WHERE kind = 'A'""",
}
