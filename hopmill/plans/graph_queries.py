"""Relation-graph and variant-family queries on the driver's tables, and their SQL.

Facts: a customer's parent is its nation (role father where the nation is odd, else mother), a nation's its region.
Walks: line item to supplier to nation, by shipping year.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from hopmill.operators import families as V
from hopmill.operators import graph as G
from hopmill.operators import reviews as R
from hopmill.plans.bindings import table


def _facts(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("fc"), "c_custkey").alias("fact_id"), F.concat(F.lit("c"), "c_custkey").alias("child"), F.concat(F.lit("n"), "c_nationkey").alias("parent"), F.when(F.col("c_nationkey") % 2 == 1, "father").otherwise("mother").alias("parent_role"))
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("fn"), "n_nationkey").alias("fact_id"), F.concat(F.lit("n"), "n_nationkey").alias("child"), F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.lit("mother").alias("parent_role"))
    return c.unionByName(n).select(F.lit("all").alias("owner_id"), "*", F.lit("s").alias("scope"))


def _asked(spark, sf_dir):
    q = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("query_id"), F.lit("all").alias("owner_id"), F.concat(F.lit("c"), "c_custkey").alias("start"))
    roles = F.array(F.struct(F.lit(1).alias("hop"), F.lit("father").alias("role")), F.struct(F.lit(2).alias("hop"), F.lit("parent").alias("role")))
    s = q.select("query_id", F.explode(roles).alias("_s")).select("query_id", "_s.*", F.lit("s").alias("scope"))
    return q, s


def g01_paths(spark, sf_dir):
    q, s = _asked(spark, sf_dir)
    a = G.answers(q, G.parent_paths(q, s, _facts(spark, sf_dir)))
    return a.select("query_id", "status", F.array_join("answers", ",").alias("answers"), "proofs")


def g01_counts(spark, sf_dir):
    """As g01_paths, by counting instead of listing."""
    q, s = _asked(spark, sf_dir)
    a = G.path_answers(q, s, _facts(spark, sf_dir))
    return a.select("query_id", "status", F.array_join("answers", ",").alias("answers"), "proofs")


def g02_walks(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.concat("l_orderkey", F.lit("-"), "l_linenumber").alias("fact_id"), F.lit("sold_by").alias("relation"), F.col("l_partkey").cast("string").alias("subject"), F.concat(F.lit("s"), "l_suppkey").alias("object"), G.interval(F.year("l_shipdate"), F.year("l_shipdate") + 1).alias("period")).distinct()
    su = table(spark, sf_dir, "supplier").select(F.concat(F.lit("x"), "s_suppkey").alias("fact_id"), F.lit("in").alias("relation"), F.concat(F.lit("s"), "s_suppkey").alias("subject"), F.concat(F.lit("n"), "s_nationkey").alias("object"), F.lit(None).cast("struct<lo:int,hi:int>").alias("period"))
    triples = li.unionByName(su).withColumn("owner_id", F.lit("all"))
    q = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("query_id"), F.lit("all").alias("owner_id"), F.col("p_partkey").cast("string").alias("start"), F.lit(1995).alias("at_time"))
    s = q.select("query_id", F.explode(F.array(F.struct(F.lit(1).alias("hop"), F.lit("sold_by").alias("relation"), F.lit("out").alias("direction")), F.struct(F.lit(2).alias("hop"), F.lit("in").alias("relation"), F.lit("out").alias("direction")))).alias("_s")).select("query_id", "_s.*")
    return G.walks(q, s, triples).groupBy("query_id", "value").agg(F.count("*").alias("walks"))


def g03_options(spark, sf_dir):
    return G.two_hop_options(_facts(spark, sf_dir)).select("start", "first_role", "second_role", "answer", "first", "second")


def _prices(spark, sf_dir, flag):
    return table(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == flag).select(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("value"))


def g04_alternatives(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    walked = o.select(F.col("o_orderkey").alias("query_id"), F.col("o_orderstatus").alias("value"))
    labels = o.select(F.col("o_orderkey").alias("alternative_id"), F.col("o_custkey").alias("query_id"), F.col("o_orderpriority").alias("label"))
    return G.alternatives(walked, labels).select("query_id", "label", F.array_join("answers", ",").alias("answers"))


def g13_difference(spark, sf_dir):
    """Paths of orders: submitted ones leave out line 3 and turn line 2 round."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("query_id"), "l_linenumber", F.array(F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")).alias("facts"))
    given = li.where("l_linenumber <> 3").withColumn("facts", F.when(F.col("l_linenumber") == 2, F.reverse("facts")).otherwise(F.col("facts")))
    return G.path_difference(li, given)


def g15_findings(spark, sf_dir):
    """The queries of g01; every seventh has an undetermined review."""
    q, s = _asked(spark, sf_dir)
    verdicts = q.select("query_id", F.col("start").alias("child"), F.when(F.col("query_id") % 7 == 0, "undetermined").otherwise("supported").alias("verdict"))
    return R.reviewed_findings(q, s, _facts(spark, sf_dir), verdicts).select("query_id", "status", F.array_join("answers", ",").alias("answers"))


def g05_compare(spark, sf_dir):
    return G.compare_branches(_prices(spark, sf_dir, "A"), _prices(spark, sf_dir, "R"))


def g06_roster(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_suppkey").alias("author"), F.col("l_linenumber").cast("long").alias("pages"))
    return G.roster_sum(items, items.where("pages = 1"), "query_id", "author", "pages")


def g07_entailment(spark, sf_dir):
    asked = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("query_id"))
    support = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("query_id"))
    return G.open_world(asked, support, ["query_id"]).groupBy("verdict").agg(F.count("*").alias("queries"))


def g07_abduction(spark, sf_dir):
    c = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("candidate_id"), F.col("l_linenumber").alias("k"))
    rules = table(spark, sf_dir, "region").select((F.col("r_regionkey") * 2).alias("k"))
    return G.abduction(c, rules, "query_id", ["k"])


def _nodes(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("proof_id"), F.col("l_linenumber").alias("pos"), "l_partkey").dropDuplicates(["proof_id", "pos"])
    deps = F.when(F.col("pos") % 3 == 1, F.array().cast("array<string>")).otherwise(F.array((F.col("pos") - 1).cast("string")))
    return li.select("proof_id", "pos", F.col("pos").cast("string").alias("node_id"), deps.alias("dependencies"), F.array(F.col("pos") * 10).alias("support_fact_ids"))


def g08_depth(spark, sf_dir):
    return G.proof_depths(_nodes(spark, sf_dir))


def g09_dag(spark, sf_dir):
    supports = table(spark, sf_dir, "lineitem").select((F.col("l_linenumber") * 10).alias("fact_id")).where("fact_id < 60").distinct()
    return G.dag_violations(_nodes(spark, sf_dir), supports).groupBy("check").agg(F.count("*").alias("nodes"))


def g10_degrees(spark, sf_dir):
    t = _facts(spark, sf_dir).select("owner_id", F.col("child").alias("subject"), F.col("parent_role").alias("relation"), F.col("parent").alias("object"))
    return G.degree_signature(t).select("entity", "relation", "direction", "degree")


def g10_difference(spark, sf_dir):
    t = _facts(spark, sf_dir).select("owner_id", F.col("child").alias("subject"), F.col("parent_role").alias("relation"), F.col("parent").alias("object"))
    keys = ["owner_id", "entity", "relation", "direction"]
    return G.signature_difference(G.degree_signature(t), G.degree_signature(t.where("subject <> 'c7'")), keys).select("entity", "relation", "direction", "degree", "other")


def g11_defects(spark, sf_dir):
    q, s = _asked(spark, sf_dir)
    n = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("query_id"), "c_nationkey").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("query_id") % 4
    proofs = q.join(n, "query_id").select("query_id", "owner_id", "start", F.when(k == 1, "r9").otherwise(F.concat(F.lit("r"), "n_regionkey")).alias("answer"), F.array("start", F.concat(F.lit("n"), "c_nationkey"), F.concat(F.lit("r"), "n_regionkey")).alias("entities"), F.when(k == 2, F.array(F.concat(F.lit("fc"), "query_id"))).when(k == 3, F.array(F.concat(F.lit("fc"), "query_id"), F.lit("none"))).otherwise(F.array(F.concat(F.lit("fc"), "query_id"), F.concat(F.lit("fn"), "c_nationkey"))).alias("facts"))
    return G.proof_defects(proofs, s, _facts(spark, sf_dir)).groupBy("check").agg(F.count("*").alias("queries"))


def g12_shape(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").dropDuplicates(["l_orderkey", "l_linenumber"]).select(F.col("l_orderkey").alias("item_id"), F.col("l_linenumber").alias("step_no"), F.col("l_linenumber").alias("from_id"), F.when(F.col("l_linenumber") != 6, F.col("l_linenumber") + 1).alias("to_id"), F.when(F.col("l_linenumber") != 5, True).alias("role_ok"))
    return G.path_shape(rows)


def g12_checked(spark, sf_dir):
    """Lines as steps against what their order asks for: length, start and targets, and conflicting ends."""
    n = F.col("l_linenumber")
    rows = table(spark, sf_dir, "lineitem").dropDuplicates(["l_orderkey", "l_linenumber"]).select(F.col("l_orderkey").alias("item_id"), n.alias("step_no"), F.when((F.col("l_orderkey") % 7 > 0) | (n > 1), n).alias("from_id"), F.when(n != 6, n + 1).alias("to_id"), F.lit(True).alias("role_ok"), ((F.col("l_orderkey") % 11 == 0) & (n == 2)).alias("from_conflict"))
    k = F.col("o_orderkey")
    queries = table(spark, sf_dir, "orders").select(k.alias("item_id"), (k % 4 + 1).cast("int").alias("length"), F.when(k % 5 > 0, 1).otherwise(2).alias("start"), F.when(k % 3 == 0, F.array().cast("array<int>")).otherwise(F.array(F.lit(2), F.lit(4), F.lit(5))).alias("targets"))
    return G.path_shape(rows, queries)


def g08_questions(spark, sf_dir):
    """Orders are proofs of their customer's questions."""
    o = table(spark, sf_dir, "orders")
    proofs = o.select(F.col("o_custkey").alias("question_id"), F.col("o_orderkey").alias("proof_id"))
    return G.question_depths(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("question_id")), _nodes(spark, sf_dir), proofs)


def g16_distractors(spark, sf_dir):
    k, month = F.col("o_orderkey"), F.month("o_orderdate")
    t = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("owner_id"), k.alias("fact_id"), (k % 5).alias("subject"), F.col("o_orderstatus").alias("relation"), (F.floor(k / 5) % 5).alias("object"),
        F.when(k % 3 > 0, F.struct(month.alias("lo"), (month + 3).alias("hi"))).alias("period"), (k % 7 > 0).alias("is_entity"))
    c = F.col("c_custkey")
    nodes = table(spark, sf_dir, "customer").select(c.alias("owner_id"), c.alias("node_id"), (c % 5).alias("upstream"), F.lit("F").alias("relation"), F.when(c % 2 == 1, "out").otherwise("in").alias("direction"), F.when(c % 4 > 0, 6).alias("at_time"))
    return G.distractors(nodes, t, t.where("fact_id % 11 = 0"))


def g17_roles(spark, sf_dir):
    docs = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("document_id"))
    uses = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("document_id"), F.when(F.col("l_linenumber") == 1, "proof").when(F.col("l_linenumber") == 2, "alternative").otherwise("noise").alias("use"))
    return G.document_roles(docs, uses)


def g14_frontier(spark, sf_dir):
    """Hop 1 reviews customers, hop 2 the nations they reach; some nations are reviewed though nobody reached them."""
    c = table(spark, sf_dir, "customer")
    start = c.where("c_custkey % 3 <> 0").select((F.col("c_custkey") % 10).alias("query_id"), F.col("c_custkey").cast("string").alias("entity"))
    one = c.where("c_custkey % 4 <> 0").select((F.col("c_custkey") % 10).alias("query_id"), F.lit(1).alias("hop"), F.col("c_custkey").cast("string").alias("child"), F.array(F.concat(F.lit("n"), "c_nationkey")).alias("parents"))
    two = table(spark, sf_dir, "nation").select((F.col("n_nationkey") % 10).cast("long").alias("query_id"), F.lit(2).alias("hop"), F.concat(F.lit("n"), "n_nationkey").alias("child"), F.array().cast("array<string>").alias("parents"))
    return G.frontier_violations(one.unionByName(two), start, 2).groupBy("hop", "check").agg(F.count("*").alias("entities"))


def g18_probes(spark, sf_dir):
    node = F.struct(F.col("l_partkey").alias("upstream"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("relation"), F.col("l_suppkey").alias("value"), F.array("l_linenumber").alias("supports"))
    proofs = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("question_id")).agg(F.array_sort(F.collect_list(node)).alias("nodes"))
    return G.one_hop_probes(proofs).select("question_id", "upstream", "relation", "answer")


def g19_normal(spark, sf_dir):
    label = F.element_at(F.array(*map(F.lit, ("father", "daughter", "mother", "uncle", "父亲", "女儿", "母亲", "儿子"))), (F.col("o_orderkey") % 8 + 1).cast("int"))
    r = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("head"), F.col("o_orderkey").alias("tail"), label.alias("label"))
    return G.normal_relations(r).select("o_orderkey", "parent", "child", "parent_role")


def _library(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select(F.when(F.col("o_orderstatus") == "F", "C02").otherwise("C01").alias("library"), (F.col("o_custkey") % 25).alias("parent"), F.col("o_custkey").alias("child"), F.when(F.col("o_orderkey") % 3 == 0, "parent").when(F.col("o_orderkey") % 3 == 1, "father").otherwise("mother").alias("parent_role"), (F.col("o_orderkey") % 17 == 0).alias("known_issue"), F.col("o_orderkey").alias("source_row"))


def g20_libraries(spark, sf_dir):
    facts = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("fact_id"), F.col("c_nationkey").alias("parent"), F.col("c_custkey").alias("child"), F.when(F.col("c_custkey") % 2 == 0, "father").otherwise("parent").alias("parent_role"), (F.col("c_custkey") % 9 != 0).alias("safe"))
    known = G.known_issues(facts, _library(spark, sf_dir)).select("library", F.lit("known_issue").alias("status"))
    return G.compare_libraries(facts, _library(spark, sf_dir), ["C01"], ["C02"]).select("library", "status").unionByName(known).groupBy("library", "status").agg(F.count("*").alias("facts"))


def g21_omissions(spark, sf_dir):
    facts = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("parent"), F.col("c_custkey").alias("child"))
    safe = table(spark, sf_dir, "customer").where("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("name"))
    return G.omissions(_library(spark, sf_dir), facts, safe, "C01")


def g22_clusters(spark, sf_dir):
    return G.source_clusters(table(spark, sf_dir, "lineitem"), "l_partkey", "l_suppkey")


def v04_changes(spark, sf_dir):
    f = table(spark, sf_dir, "lineitem").dropDuplicates(["l_orderkey", "l_linenumber"]).select(F.col("l_orderkey").alias("family_id"), F.col("l_linenumber").cast("string").alias("fact_id"), F.col("l_linenumber").alias("value"))
    child = f.where("value <> 2").withColumn("value", F.when(F.col("value") == 3, 33).otherwise(F.col("value"))).unionByName(f.where("value = 1").withColumns({"fact_id": F.lit("9"), "value": F.lit(9)}))
    c = V.change_set(f, child, ["family_id"], "fact_id", "value")
    return c.select("family_id", *(F.array_join(x, ",").alias(x) for x in ("added", "removed", "rewritten")))


def v05_missing(spark, sf_dir):
    f = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    return V.missing_facts(f, f.where("l_linenumber % 3 <> 0"), ["l_orderkey", "l_linenumber"])


def v06_primary(spark, sf_dir):
    v = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("family_id"), F.col("l_linenumber").alias("surface"))
    _, counts = V.select_primary(v, v.groupBy("family_id").agg(F.max("surface").alias("surface")))
    return counts


def v07_complete(spark, sf_dir):
    r = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus")
    return V.completeness(r, "l_orderkey", "l_returnflag", ["A", "R"], "l_linestatus", ["F", "O"])


#: Rules of v07_rules: orders are families, lines their variants.
_RULES = (("", "1", "line", "is", "", "F"), ("C1", "2", "flag", "equal", "1", "flag"), ("C2 C3", "2", "flag", "differs", "1", "flag"), ("C3", "3", "line", "equal", "2", "status"))


def v07_rules(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    values = F.create_map(F.lit("flag"), "l_returnflag", F.lit("line"), "l_linestatus", F.lit("status"), "o_orderstatus")
    r = li.select(F.col("l_orderkey").alias("family_id"), F.concat(F.lit("C"), F.col("o_custkey") % 4).alias("combination_id"), F.col("l_linenumber").cast("string").alias("variant"), values.alias("values"))
    return V.rule_violations(r, _RULES)


def v07_scenes(spark, sf_dir):
    """Customers plan the priorities of their whole nation, by initial; their own orders cover some."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    r = o.select("c_custkey", F.array(F.substring("o_orderpriority", 1, 1)).alias("scenes"), "c_nationkey")
    plans = r.groupBy("c_nationkey").agg(F.collect_set(F.col("scenes")[0]).alias("planned")).join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_nationkey")
    return V.uncovered(r, plans, "c_custkey", "planned", "scenes")


def v09_codes(spark, sf_dir):
    return V.name_codes(table(spark, sf_dir, "customer"), "c_nationkey", "c_custkey", "seed-3")


def v08_equivariance(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select(F.concat("c_nationkey", F.lit("|"), "c_mktsegment").alias("g"), "c_custkey")
    codes = V.name_codes(customers, "g", "c_custkey", "seed-3").withColumn("c_custkey", F.col("c_custkey").cast("string"))
    facts = table(spark, sf_dir, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey")).select("g", F.col("o_orderkey").alias("q"), F.col("o_custkey").cast("string").alias("c_custkey"))
    renamed = V.renamed_facts(facts, codes, "g", "c_custkey", ["c_custkey"])
    bad = V.equivariance_violations(facts, renamed.where("q % 100 <> 0"), codes, "q", "g", "c_custkey")
    return bad.groupBy("side").agg(F.count("*").alias("answers"))


def v12_order(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.col("l_linenumber").cast("string")).alias("d"))
    return d.select("l_orderkey", F.array_join(V.document_order(F.col("l_orderkey").cast("string"), F.col("d"), "v1"), ",").alias("documents"))


def v11_rebuild(spark, sf_dir):
    s = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_custkey")
    r = s.where("o_orderkey % 10 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 7 == 0, "X").otherwise(F.col("o_orderstatus")))
    return V.rebuild_differences(s, r, ["o_orderkey"]).groupBy("check").agg(F.count("*").alias("rows"))


QUERIES = {f.__name__: f for f in (g01_paths, g01_counts, g02_walks, g03_options, g04_alternatives, g05_compare, g06_roster, g07_entailment, g07_abduction, g08_depth, g08_questions, g09_dag, g10_degrees, g10_difference, g11_defects, g12_shape, g12_checked, g13_difference, g14_frontier, g15_findings, g16_distractors, g17_roles, g18_probes, g19_normal, g20_libraries, g21_omissions, g22_clusters, v04_changes, v05_missing, v06_primary, v07_complete, v07_rules, v07_scenes, v08_equivariance, v09_codes, v11_rebuild, v12_order)}

_FACTS = "f AS (SELECT 'fc' || c_custkey AS fact_id, 'c' || c_custkey AS child, 'n' || c_nationkey AS parent, CASE WHEN c_nationkey % 2 = 1 THEN 'father' ELSE 'mother' END AS parent_role FROM customer UNION ALL SELECT 'fn' || n_nationkey, 'n' || n_nationkey, 'r' || n_regionkey, 'mother' FROM nation)"
_DEGREES = f"{_FACTS}, s AS (SELECT child AS entity, parent_role AS relation, 'out' AS direction, child FROM f UNION ALL SELECT parent, parent_role, 'in', child FROM f)"
_LIB = "l AS (SELECT CASE WHEN o_orderstatus = 'F' THEN 'C02' ELSE 'C01' END AS library, o_custkey % 25 AS p, o_custkey AS c, ['parent', 'father', 'mother'][o_orderkey % 3 + 1] AS r, o_orderkey AS n FROM orders WHERE o_orderkey % 17 <> 0)"
_N = "n AS (SELECT DISTINCT l_orderkey AS proof_id, l_linenumber AS pos FROM lineitem)"
SQL = {
    "g01_paths": f"WITH {_FACTS} SELECT c_custkey AS query_id, CASE WHEN b.fact_id IS NULL THEN 'insufficient_evidence' ELSE 'answerable' END AS status, coalesce(b.parent, '') AS answers, count(b.fact_id) AS proofs FROM customer LEFT JOIN f a ON a.child = 'c' || c_custkey AND a.parent_role = 'father' LEFT JOIN f b ON b.child = a.parent GROUP BY ALL",
    "g01_counts": f"WITH {_FACTS} SELECT c_custkey AS query_id, CASE WHEN b.fact_id IS NULL THEN 'insufficient_evidence' ELSE 'answerable' END AS status, coalesce(b.parent, '') AS answers, count(b.fact_id) AS proofs FROM customer LEFT JOIN f a ON a.child = 'c' || c_custkey AND a.parent_role = 'father' LEFT JOIN f b ON b.child = a.parent GROUP BY ALL",
    "g02_walks": "WITH t AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, year(l_shipdate) AS y FROM lineitem) SELECT l_partkey AS query_id, 'n' || s_nationkey AS value, count(*) AS walks FROM t JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey WHERE 1995 BETWEEN y AND y + 1 GROUP BY ALL",
    "g03_options": f"WITH {_FACTS} SELECT a.child AS start, a.parent_role AS first_role, b.parent_role AS second_role, b.parent AS answer, a.fact_id AS \"first\", b.fact_id AS \"second\" FROM f a JOIN f b ON b.child = a.parent",
    "g04_alternatives": "SELECT o_custkey AS query_id, o_orderpriority AS label, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS answers FROM orders GROUP BY ALL",
    "g13_difference": """WITH e AS (SELECT DISTINCT l_orderkey AS query_id, l_partkey || '>' || l_suppkey AS facts FROM lineitem), s AS (SELECT DISTINCT l_orderkey AS query_id, CASE WHEN l_linenumber = 2 THEN l_suppkey || '>' || l_partkey ELSE l_partkey || '>' || l_suppkey END AS facts FROM lineitem WHERE l_linenumber <> 3)
(SELECT *, 'omitted' AS side FROM (SELECT * FROM e EXCEPT SELECT * FROM s)) UNION ALL (SELECT *, 'invented' FROM (SELECT * FROM s EXCEPT SELECT * FROM e))""",
    "g15_findings": f"WITH {_FACTS} SELECT DISTINCT c_custkey AS query_id, CASE WHEN c_custkey % 7 = 0 THEN 'undetermined' WHEN b.fact_id IS NULL THEN 'insufficient_evidence' ELSE 'answerable' END AS status, coalesce(b.parent, '') AS answers FROM customer LEFT JOIN f a ON a.child = 'c' || c_custkey AND a.parent_role = 'father' LEFT JOIN f b ON b.child = a.parent",
    "g05_compare": """WITH s AS (SELECT l_orderkey AS query_id, count(DISTINCT l_partkey) FILTER (WHERE l_returnflag = 'A') AS a, count(DISTINCT l_partkey) FILTER (WHERE l_returnflag = 'R') AS r, min(l_partkey) FILTER (WHERE l_returnflag = 'A') AS left_value, min(l_partkey) FILTER (WHERE l_returnflag = 'R') AS right_value FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1),
c AS (SELECT *, CASE WHEN NOT (a = 1 AND r = 1) THEN 'not_single' WHEN left_value = right_value THEN 'tie' ELSE 'answerable' END AS status FROM s) SELECT query_id, status, CASE WHEN status = 'answerable' THEN CASE WHEN left_value < right_value THEN 'left' ELSE 'right' END END AS smaller, left_value, right_value FROM c""",
    "g06_roster": "SELECT l_orderkey AS query_id, sum(l_linenumber)::BIGINT AS total, count(*) AS items FROM lineitem WHERE (l_orderkey, l_suppkey) IN (SELECT (l_orderkey, l_suppkey) FROM lineitem WHERE l_linenumber = 1) GROUP BY 1",
    "g07_entailment": "SELECT CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45) THEN 'yes' ELSE 'undetermined' END AS verdict, count(*) AS queries FROM orders GROUP BY 1",
    "g07_abduction": "WITH g AS (SELECT l_orderkey AS query_id, count(*) FILTER (WHERE l_linenumber IN (0, 2, 4, 6, 8)) AS n, min(l_partkey) FILTER (WHERE l_linenumber IN (0, 2, 4, 6, 8)) AS c FROM lineitem GROUP BY 1) SELECT query_id, CASE WHEN n = 1 THEN c END AS hypothesis, CASE n WHEN 0 THEN 'none' WHEN 1 THEN 'single' ELSE 'ambiguous' END AS status FROM g",
    "g08_depth": f"WITH {_N}, d AS (SELECT proof_id, CASE WHEN pos % 3 = 1 OR NOT EXISTS (SELECT 1 FROM n m WHERE m.proof_id = n.proof_id AND m.pos = n.pos - 1) THEN 1 WHEN pos % 3 = 2 OR NOT EXISTS (SELECT 1 FROM n m WHERE m.proof_id = n.proof_id AND m.pos = n.pos - 2) THEN 2 ELSE 3 END AS d FROM n) SELECT proof_id, max(d)::INT AS depth FROM d GROUP BY 1",
    "g09_dag": f"WITH {_N}, v AS (SELECT 'dependency' AS \"check\" FROM n WHERE pos % 3 <> 1 AND NOT EXISTS (SELECT 1 FROM n m WHERE m.proof_id = n.proof_id AND m.pos = n.pos - 1) UNION ALL SELECT 'support' FROM n WHERE pos >= 6) SELECT \"check\", count(*) AS nodes FROM v GROUP BY 1",
    "g10_degrees": f"WITH {_DEGREES} SELECT entity, relation, direction, count(*) AS degree FROM s GROUP BY ALL",
    "g10_difference": f"WITH {_DEGREES}, g AS (SELECT entity, relation, direction, count(*) AS degree, nullif(count(*) FILTER (WHERE child <> 'c7'), 0) AS other FROM s GROUP BY ALL) SELECT * FROM g WHERE degree IS DISTINCT FROM other",
    "g11_defects": """WITH c AS (SELECT c_custkey % 4 AS k, c_nationkey % 2 = 1 AS father FROM customer), v AS (SELECT 'answer' AS "check" FROM c WHERE k = 1 UNION ALL SELECT 'length' FROM c WHERE k = 2 UNION ALL SELECT 'unknown_fact' FROM c WHERE k = 3 UNION ALL SELECT 'role' FROM c WHERE NOT father) SELECT "check", count(*) AS queries FROM v GROUP BY 1""",
    "g12_shape": "WITH s AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem), j AS (SELECT *, lead(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS nx FROM s) SELECT l_orderkey AS item_id, CASE WHEN bool_or(l_linenumber <> 6 AND nx IS NOT NULL AND nx <> l_linenumber + 1) THEN 'incorrect' WHEN bool_or(l_linenumber IN (5, 6)) THEN 'needs_semantic_review' ELSE 'correct' END AS shape FROM j GROUP BY 1",
    "g12_checked": """WITH s AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS n FROM lineitem), j AS (SELECT *, lead(n) OVER (PARTITION BY k ORDER BY n) AS nx FROM s),
g AS (SELECT k, count(*) AS c, min(n) AS a, max(n) AS z, bool_or(n <> 6 AND nx IS NOT NULL AND nx <> n + 1 AND NOT (k % 7 = 0 AND nx = 1)) AS torn, bool_or(n = 6) AS six, bool_or(k % 11 = 0 AND n = 2) AS clash FROM j GROUP BY 1)
SELECT o_orderkey AS item_id, CASE WHEN c IS NULL OR c <> o_orderkey % 4 + 1 OR clash OR torn OR (NOT (o_orderkey % 7 = 0 AND a = 1) AND a <> CASE WHEN o_orderkey % 5 > 0 THEN 1 ELSE 2 END) OR (o_orderkey % 3 > 0 AND z <> 6 AND z + 1 NOT IN (2, 4, 5)) THEN 'incorrect'
  WHEN six OR (o_orderkey % 7 = 0 AND a = 1) THEN 'needs_semantic_review' ELSE 'correct' END AS shape FROM orders LEFT JOIN g ON k = o_orderkey""",
    "g08_questions": f"""WITH {_N}, d AS (SELECT proof_id, CASE WHEN pos % 3 = 1 OR NOT EXISTS (SELECT 1 FROM n m WHERE m.proof_id = n.proof_id AND m.pos = n.pos - 1) THEN 1 WHEN pos % 3 = 2 OR NOT EXISTS (SELECT 1 FROM n m WHERE m.proof_id = n.proof_id AND m.pos = n.pos - 2) THEN 2 ELSE 3 END AS d FROM n), p AS (SELECT proof_id, max(d)::INT AS depth FROM d GROUP BY 1)
SELECT c_custkey AS question_id, coalesce(min(CASE WHEN o_orderkey IS NULL THEN 0 ELSE coalesce(depth, 0) END), 0)::INT AS depth FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN p ON proof_id = o_orderkey GROUP BY 1""",
    "g14_frontier": """WITH s AS (SELECT DISTINCT c_custkey % 10 AS q, c_custkey::VARCHAR AS e FROM customer WHERE c_custkey % 3 <> 0), r1 AS (SELECT c_custkey % 10 AS q, c_custkey::VARCHAR AS e, 'n' || c_nationkey AS p FROM customer WHERE c_custkey % 4 <> 0),
r2 AS (SELECT n_nationkey % 10 AS q, 'n' || n_nationkey AS e FROM nation), f2 AS (SELECT DISTINCT q, p AS e FROM r1),
v AS (SELECT 1 AS hop, CASE WHEN r1.e IS NULL THEN 'missing' ELSE 'unexpected' END AS "check" FROM s FULL JOIN r1 ON s.q = r1.q AND s.e = r1.e WHERE r1.e IS NULL OR s.e IS NULL
UNION ALL SELECT 2, CASE WHEN r2.e IS NULL THEN 'missing' ELSE 'unexpected' END FROM f2 FULL JOIN r2 ON f2.q = r2.q AND f2.e = r2.e WHERE r2.e IS NULL OR f2.e IS NULL) SELECT hop, "check", count(*) AS entities FROM v GROUP BY ALL""",
    "g18_probes": "SELECT l_orderkey AS question_id, l_partkey AS upstream, l_returnflag AS relation, l_suppkey AS answer FROM lineitem WHERE l_returnflag <> 'N'",
    "g16_distractors": """WITH t AS (SELECT o_custkey AS w, o_orderkey AS f, o_orderkey % 5 AS s, o_orderstatus AS r, (o_orderkey // 5) % 5 AS o, o_orderkey % 3 > 0 AS bound, month(o_orderdate) AS lo, o_orderkey % 7 > 0 AS ent FROM orders WHERE o_orderkey % 11 > 0),
e AS (SELECT c_custkey AS n, f, r, c_custkey % 5 AS u, CASE WHEN c_custkey % 2 = 1 THEN s ELSE o END AS a, CASE WHEN c_custkey % 2 = 1 THEN o ELSE s END AS b, c_custkey % 4 > 0 AND bound AND NOT 6 BETWEEN lo AND lo + 3 AS late, ent FROM customer JOIN t ON w = c_custkey),
d AS (SELECT * FROM (SELECT *, CASE WHEN a = u AND r <> 'F' THEN 'other_relation' WHEN a <> u AND r = 'F' THEN 'other_upstream' WHEN a = u AND late THEN 'out_of_period' END AS kind FROM e) WHERE kind IS NOT NULL),
c1 AS (SELECT * FROM e WHERE EXISTS (FROM d WHERE d.n = e.n AND d.ent AND d.b = e.a) AND NOT EXISTS (FROM d WHERE d.n = e.n AND d.f = e.f)),
c2 AS (SELECT * FROM e WHERE EXISTS (FROM c1 WHERE c1.n = e.n AND c1.ent AND c1.b = e.a) AND NOT EXISTS (FROM d WHERE d.n = e.n AND d.f = e.f) AND NOT EXISTS (FROM c1 WHERE c1.n = e.n AND c1.f = e.f))
SELECT n AS node_id, f AS fact_id, kind FROM d UNION ALL SELECT n, f, 'continuation' FROM c1 UNION ALL SELECT n, f, 'continuation' FROM c2""",
    "g17_roles": "WITH u AS (SELECT l_partkey, min(CASE l_linenumber WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 3 END) AS r FROM lineitem GROUP BY 1) SELECT p_partkey AS document_id, ['current_proof', 'alternative', 'background', 'unreferenced'][coalesce(r, 4)] AS role FROM part LEFT JOIN u ON l_partkey = p_partkey",
    "g19_normal": "SELECT o_orderkey, CASE WHEN o_orderkey % 8 IN (1, 5, 7) THEN o_custkey ELSE o_orderkey END AS parent, CASE WHEN o_orderkey % 8 IN (1, 5, 7) THEN o_orderkey ELSE o_custkey END AS child, ['father', 'parent', 'mother', '', 'father', 'parent', 'mother', 'parent'][o_orderkey % 8 + 1] AS parent_role FROM orders WHERE o_orderkey % 8 <> 3",
    "g20_libraries": f"""WITH {_LIB}, fa AS (SELECT c_custkey AS id, c_nationkey AS p, CASE WHEN c_custkey % 2 = 0 THEN 'father' ELSE 'parent' END AS r, c_custkey % 9 <> 0 AS safe FROM customer),
j AS (SELECT fa.id, b.library, fa.safe, coalesce(l.p = fa.p AND (l.r = fa.r OR l.r = 'parent' OR fa.r = 'parent'), false) AS m, fa.p AS fp, fa.r AS fr, l.p AS lp, l.r AS lr FROM fa CROSS JOIN (VALUES ('C01'), ('C02')) AS b(library) LEFT JOIN l ON l.library = b.library AND l.c = fa.id),
g AS (SELECT id, library, bool_or(m) AS m, bool_or(NOT m AND coalesce((lr = fr AND fr <> 'parent') OR (lp = fp AND lr <> 'parent' AND fr <> 'parent'), false)) AS c, bool_and(safe) AS s FROM j GROUP BY ALL),
st AS (SELECT library, CASE WHEN NOT s THEN 'not_comparable_temporal_or_ambiguous_identity' WHEN c THEN 'conflict_hint' WHEN library = 'C02' THEN 'conflict_hints_only_none_found' WHEN m THEN 'static_compatible_hint' ELSE 'not_covered' END AS status FROM g
  UNION ALL SELECT CASE WHEN o_orderstatus = 'F' THEN 'C02' ELSE 'C01' END, 'known_issue' FROM orders WHERE o_orderkey % 17 = 0 AND o_custkey IN (SELECT id FROM fa WHERE safe))
SELECT library, status, count(*) AS facts FROM st GROUP BY ALL""",
    "g21_omissions": "SELECT 'C01' AS library, o_custkey % 25 AS parent, o_custkey AS child, min(o_orderkey) AS source_row FROM orders WHERE o_orderstatus <> 'F' AND o_custkey % 25 IN (SELECT c_custkey FROM customer WHERE c_custkey % 5 <> 0) AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 5 <> 0) AND NOT EXISTS (SELECT 1 FROM customer WHERE c_nationkey = o_custkey % 25 AND c_custkey = o_custkey) GROUP BY ALL",
    "g22_clusters": "WITH u AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) SELECT * FROM (SELECT l_partkey, l_suppkey, count(*) OVER (PARTITION BY l_partkey) AS n FROM u) WHERE n > 1",
    "v04_changes": "WITH f AS (SELECT l_orderkey AS family_id, bool_or(l_linenumber = 1) AS a, bool_or(l_linenumber = 2) AS b, bool_or(l_linenumber = 3) AS c FROM lineitem GROUP BY 1) SELECT family_id, CASE WHEN a THEN '9' ELSE '' END AS added, CASE WHEN b THEN '2' ELSE '' END AS removed, CASE WHEN c THEN '3' ELSE '' END AS rewritten FROM f",
    "v05_missing": "SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber % 3 = 0",
    "v06_primary": "SELECT l_orderkey AS family_id, count(*) AS generated, count(*) - count(*) FILTER (WHERE l_linenumber = m) AS removed FROM (SELECT *, max(l_linenumber) OVER (PARTITION BY l_orderkey) AS m FROM lineitem) GROUP BY 1",
    "v07_rules": """WITH r AS (SELECT l_orderkey AS f, 'C' || o_custkey % 4 AS c, l_linenumber::VARCHAR AS v, l_returnflag AS flag, l_linestatus AS line, o_orderstatus AS status FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
q AS (SELECT DISTINCT f, c FROM r), x AS (
SELECT q.f, 1 AS rule, a.v AS a, '-' AS b, a.line = 'F' AS ok FROM q LEFT JOIN r a ON a.f = q.f AND a.v = '1'
UNION ALL SELECT q.f, CASE c WHEN 'C1' THEN 2 ELSE 3 END, a.v, b.v, (a.flag = b.flag) = (c = 'C1') FROM q LEFT JOIN (SELECT f, v, flag FROM r) a ON a.f = q.f AND a.v = '2' LEFT JOIN (SELECT f, v, flag FROM r) b ON b.f = q.f AND b.v = '1' WHERE c IN ('C1', 'C2', 'C3')
UNION ALL SELECT q.f, 4, a.v, b.v, a.line = b.status FROM q LEFT JOIN (SELECT f, v, line FROM r) a ON a.f = q.f AND a.v = '3' LEFT JOIN (SELECT f, v, status FROM r) b ON b.f = q.f AND b.v = '2' WHERE c = 'C3')
SELECT DISTINCT f AS family_id, rule, CASE WHEN a IS NULL THEN 'missing' WHEN b IS NULL THEN 'missing_other' ELSE 'relation' END AS "check" FROM x WHERE a IS NULL OR b IS NULL OR NOT coalesce(ok, false)""",
    "v07_scenes": "WITH o AS (SELECT DISTINCT c_custkey, c_nationkey, substr(o_orderpriority, 1, 1) AS p FROM orders JOIN customer ON c_custkey = o_custkey) SELECT c.c_custkey, n.p AS missing FROM customer c JOIN (SELECT DISTINCT c_nationkey, p FROM o) n USING (c_nationkey) WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.c_custkey = c.c_custkey AND o.p = n.p)",
    "v07_complete": "WITH g AS (SELECT l_orderkey, list(DISTINCT l_returnflag) AS v, list(DISTINCT l_linestatus) AS d FROM lineitem GROUP BY 1), m AS (SELECT l_orderkey, unnest(list_concat(list_filter(['A', 'R'], lambda x: NOT list_contains(v, x)), list_filter(['F', 'O'], lambda x: NOT list_contains(d, x)))) AS missing FROM g) SELECT * FROM m",
    "v08_equivariance": "SELECT 'lost' AS side, count(*) AS answers FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey % 100 = 0 HAVING count(*) > 0",
    "v09_codes": "SELECT c_nationkey, c_custkey, 'E' || lpad((row_number() OVER (PARTITION BY c_nationkey ORDER BY sha256('seed-3|' || c_custkey), c_custkey))::VARCHAR, 4, '0') AS code FROM customer",
    "v11_rebuild": "SELECT CASE WHEN o_orderkey % 10 = 0 THEN 'not_rebuilt' ELSE 'changed' END AS \"check\", count(*) AS rows FROM orders WHERE o_orderkey % 10 = 0 OR o_orderkey % 7 = 0 GROUP BY 1",
    "v12_order": "SELECT l_orderkey, string_agg(d, ',' ORDER BY sha256(l_orderkey || '|v1|' || d)) AS documents FROM (SELECT DISTINCT l_orderkey, l_linenumber::VARCHAR AS d FROM lineitem) GROUP BY 1",
}
