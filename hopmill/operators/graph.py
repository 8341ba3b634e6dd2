"""Relation graphs: typed paths, walks, proofs, degrees, library comparison. Paths grow one join for each hop."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from hopmill.sources.shared import written

#: Chinese labels of library records.
CHINESE = {"父亲": "father", "母亲": "mother", "儿子": "son", "女儿": "daughter"}


def _longest(steps: DataFrame, hops: int | None) -> int:
    """The largest hop of the steps; one beyond a stated limit raises rather than being left out."""
    most = steps.agg(F.max("hop")).first()[0] or 0
    if hops is not None and most > hops:
        raise ValueError(f"steps have {most} hops, more than the limit of {hops}")
    return most


def parent_paths(queries: DataFrame, steps: DataFrame, facts: DataFrame, hops: int | None = None, bar_facts: bool = True) -> DataFrame:
    """(query_id, entities, facts, length) of all complete child-to-parent paths, of as many hops as each query has steps; more than `hops`, if given, raise.

    queries: query_id, owner_id, start; steps: query_id, hop (from 1), role, scope; facts: owner_id, fact_id, child,
    parent, parent_role, scope. A requested role `parent` takes any role, no other does. Entities never repeat in a
    path, nor do facts unless bar_facts is false. Each hop is one equi-join on owner, entity and scope.
    """
    lengths = steps.groupBy("query_id").agg(F.max("hop").alias("_hops"))
    paths = queries.join(lengths, "query_id").select("query_id", "owner_id", "_hops", F.array("start").alias("entities"), F.array().cast("array<string>").alias("facts"))
    edge = facts.select("owner_id", F.col("child").alias("_at"), F.col("scope").alias("_scope"), F.col("fact_id").cast("string").alias("_fact"), "parent", "parent_role")
    done = [paths.where("false")]
    for hop in range(1, _longest(steps, hops) + 1):
        step = steps.where(F.col("hop") == hop).select("query_id", "role", F.col("scope").alias("_scope"))
        grown = paths.where(F.col("_hops") >= hop).withColumn("_at", F.element_at("entities", -1)).join(step, "query_id").join(edge, ["owner_id", "_at", "_scope"])
        grown = grown.where(((F.col("role") == "parent") | (F.col("role") == F.col("parent_role"))) & ~F.array_contains("entities", F.col("parent")))
        if bar_facts:
            grown = grown.where(~F.array_contains("facts", F.col("_fact")))
        paths = grown.select("query_id", "owner_id", "_hops", F.array_append("entities", F.col("parent")).alias("entities"), F.array_append("facts", F.col("_fact")).alias("facts"))
        done.append(paths.where(F.col("_hops") == hop))
    return reduce(DataFrame.unionByName, done).select("query_id", "entities", "facts", F.col("_hops").alias("length"))


def answers(queries: DataFrame, paths: DataFrame) -> DataFrame:
    """(query_id, status, answers, proofs): distinct last entities in order; insufficient_evidence, answerable or ambiguous."""
    return _answered(queries, paths.groupBy("query_id", F.element_at("entities", -1).alias("answer")).agg(F.count("*").alias("proofs")))


def _answered(queries: DataFrame, found: DataFrame) -> DataFrame:
    """Answers of queries from (query_id, answer, proofs), one row for each answer."""
    found = found.groupBy("query_id").agg(F.array_sort(F.collect_list("answer")).alias("answers"), F.sum("proofs").alias("proofs"))
    out = queries.select("query_id").join(found, "query_id", "left").withColumns({"answers": F.coalesce("answers", F.array().cast("array<string>")), "proofs": F.coalesce("proofs", F.lit(0))})
    n = F.size("answers")
    return out.withColumn("status", F.when(n == 0, "insufficient_evidence").when(n == 1, "answerable").otherwise("ambiguous"))


def path_answers(queries: DataFrame, steps: DataFrame, facts: DataFrame, hops: int | None = None) -> DataFrame:
    """answers() of parent_paths(), without listing paths; a fact_id names one fact of its owner.

    Facts are reduced to those that lie on a way from the start to a last hop: by semi-joins forward from the starts, then
    backward from the ends. On these, proofs are counted by (query, entity), hop by hop, so rows stay in proportion to
    facts however many paths run through a hub. An entity can only repeat in a path if it occurs at two hops of the reduced
    facts; for the queries where one does, paths are listed. Counts beyond a long raise.
    """
    lengths = steps.groupBy("query_id").agg(F.max("hop").alias("_hops"))
    edge = facts.where("parent is not null").select("owner_id", F.col("child").alias("_at"), F.col("scope").alias("_scope"), "parent", "parent_role")
    starts = queries.join(lengths, "query_id").select("query_id", "owner_id", "_hops", F.col("start").alias("_at"))
    reached, layers = starts, []
    for hop in range(1, _longest(steps, hops) + 1):
        step = steps.where(F.col("hop") == hop).select("query_id", "role", F.col("scope").alias("_scope"))
        taken = reached.where(F.col("_hops") >= hop).join(step, "query_id").join(edge, ["owner_id", "_at", "_scope"]).where((F.col("role") == "parent") | (F.col("role") == F.col("parent_role")))
        layers.append(written(taken.groupBy("query_id", "owner_id", "_hops", "_at", "parent").agg(F.count("*").alias("_facts")), "reached"))
        reached = layers[-1].select("query_id", "owner_id", "_hops", F.col("parent").alias("_at")).distinct()
    for i in reversed(range(len(layers) - 1)):
        on = layers[i + 1].select("query_id", F.col("_at").alias("parent")).distinct()
        ends = layers[i].where(F.col("_hops") == i + 1)
        layers[i] = written(layers[i].where(F.col("_hops") > i + 1).join(on, ["query_id", "parent"], "left_semi").unionByName(ends), "reduced")
    if not layers:
        return answers(queries, parent_paths(queries, steps, facts, hops))
    seen = [layers[0].select("query_id", F.col("_at").alias("entity"), F.lit(0).alias("_hop")), *(x.select("query_id", F.col("parent").alias("entity"), F.lit(i + 1).alias("_hop")) for i, x in enumerate(layers))]
    mixed = reduce(DataFrame.unionByName, seen).groupBy("query_id", "entity").agg((F.min("_hop") < F.max("_hop")).alias("_twice")).where("_twice").select("query_id").distinct()
    mixed = written(mixed, "mixed")
    proofs, found = starts.select("query_id", "_at", F.lit(1).cast("long").alias("proofs")).join(mixed, "query_id", "left_anti"), []
    for i, layer in enumerate(layers):
        grown = layer.join(proofs, ["query_id", "_at"]).groupBy("query_id", "_hops", "parent").agg(F.sum(F.col("_facts") * F.col("proofs")).alias("proofs"))
        found.append(grown.where(F.col("_hops") == i + 1).select("query_id", F.col("parent").alias("answer"), "proofs"))
        proofs = grown.where(F.col("_hops") > i + 1).select("query_id", F.col("parent").alias("_at"), "proofs")
    listed = parent_paths(queries.join(mixed, "query_id", "left_semi"), steps.join(mixed, "query_id", "left_semi"), facts, hops, bar_facts=False)
    listed = listed.groupBy("query_id", F.element_at("entities", -1).alias("answer")).agg(F.count("*").alias("proofs"))
    return _answered(queries, reduce(DataFrame.unionByName, found).unionByName(listed))


def walks(queries: DataFrame, steps: DataFrame, triples: DataFrame, hops: int | None = None) -> DataFrame:
    """(query_id, value, facts) of walks with a direction (out: subject to object; in: back) for each step.

    A fact counts if its period (inclusive lo and hi) holds the query's at_time, or either is null. Repeats are allowed.
    There are as many hops as the steps have; more than `hops`, if given, raise.
    """
    out = triples.select("owner_id", "fact_id", "relation", "period", F.lit("out").alias("direction"), F.col("subject").alias("_at"), F.col("object").alias("_to"))
    back = triples.select("owner_id", "fact_id", "relation", "period", F.lit("in").alias("direction"), F.col("object").alias("_at"), F.col("subject").alias("_to"))
    edge = out.unionByName(back)
    lengths = steps.groupBy("query_id").agg(F.max("hop").alias("_hops"))
    paths = queries.join(lengths, "query_id").select("query_id", "owner_id", "at_time", "_hops", F.col("start").alias("_at"), F.array().cast("array<string>").alias("facts"))
    done = [paths.where("false")]
    for hop in range(1, _longest(steps, hops) + 1):
        step = steps.where(F.col("hop") == hop).select("query_id", "relation", "direction")
        valid = F.col("period").isNull() | F.col("at_time").isNull() | F.col("at_time").between(F.col("period.lo"), F.col("period.hi"))
        grown = paths.where(F.col("_hops") >= hop).join(step, "query_id").join(edge, ["owner_id", "relation", "direction", "_at"]).where(valid)
        paths = grown.select("query_id", "owner_id", "at_time", "_hops", F.col("_to").alias("_at"), F.array_append("facts", F.col("fact_id").cast("string")).alias("facts"))
        done.append(paths.where(F.col("_hops") == hop))
    return reduce(DataFrame.unionByName, done).select("query_id", F.col("_at").alias("value"), "facts")


def two_hop_options(facts: DataFrame) -> DataFrame:
    """(owner_id, start, first_role, second_role, scope, answer, first, second): pairs of facts, the first's parent being the
    second's child in one scope, whose query has one answer. Queries are grouped before they are solved."""
    a = facts.select("owner_id", "scope", F.col("child").alias("start"), F.col("parent").alias("_mid"), F.col("parent_role").alias("first_role"), F.col("fact_id").alias("first"))
    b = facts.select("owner_id", "scope", F.col("child").alias("_mid"), F.col("parent").alias("answer"), F.col("parent_role").alias("second_role"), F.col("fact_id").alias("second"))
    pairs = a.join(b, ["owner_id", "scope", "_mid"]).where((F.col("start") != F.col("_mid")) & (F.col("answer") != F.col("start")) & (F.col("answer") != F.col("_mid")) & (F.col("first") != F.col("second")))
    query = ["owner_id", "start", "first_role", "second_role", "scope"]
    asked = pairs.select(*query).distinct().withColumn("query_id", F.xxhash64(*query))
    steps = asked.select("query_id", F.explode(F.array(F.struct(F.lit(1).alias("hop"), F.col("first_role").alias("role")), F.struct(F.lit(2).alias("hop"), F.col("second_role").alias("role")))).alias("_s"), "scope").select("query_id", "_s.*", "scope")
    paths = parent_paths(asked.select("query_id", "owner_id", "start"), steps, facts, 2)
    single = paths.groupBy("query_id").agg(F.count_distinct(F.element_at("entities", -1)).alias("_n")).where("_n = 1")
    return pairs.join(asked.join(single, "query_id", "left_semi"), query, "left_semi").select(*query, "answer", "first", "second")


def alternatives(walked: DataFrame, labels: DataFrame) -> DataFrame:
    """(query_id, label, answers): interpretations of ambiguous queries; labels maps each alternative's query to its parent and label."""
    return walked.withColumnRenamed("query_id", "alternative_id").join(labels, "alternative_id").groupBy("query_id", "label").agg(F.array_sort(F.collect_set("value")).alias("answers"))


def compare_branches(left: DataFrame, right: DataFrame) -> DataFrame:
    """(query_id, status, smaller, left_value, right_value): both sides must have one value and not tie."""
    one = lambda df, n: df.groupBy("query_id").agg(F.count_distinct("value").alias(f"_{n}"), F.min("value").alias(f"{n}_value"))
    j = one(left, "left").join(one(right, "right"), "query_id", "full")
    status = F.when(~F.coalesce((F.col("_left") == 1) & (F.col("_right") == 1), F.lit(False)), "not_single").when(F.col("left_value") == F.col("right_value"), "tie").otherwise("answerable")
    return j.select("query_id", status.alias("status"), F.when(status == "answerable", F.when(F.col("left_value") < F.col("right_value"), "left").otherwise("right")).alias("smaller"), "left_value", "right_value")


def roster_sum(items: DataFrame, members: DataFrame, query: str, author: str, value: str) -> DataFrame:
    """(query, total, items): sum over the items whose author is in the roster."""
    return items.join(members.select(query, author).distinct(), [query, author], "left_semi").groupBy(query).agg(F.sum(value).alias("total"), F.count("*").alias("items"))


def open_world(asked: DataFrame, support: DataFrame, keys: list[str]) -> DataFrame:
    """asked with verdict: yes only where a supporting fact exists, else undetermined (never no)."""
    s = support.select(*keys).distinct().withColumn("_s", F.lit(True))
    return asked.join(s, keys, "left").withColumn("verdict", F.when(F.col("_s"), "yes").otherwise("undetermined")).drop("_s")


def abduction(candidates: DataFrame, rules: DataFrame, query: str, keys: list[str]) -> DataFrame:
    """(query, hypothesis, status): the candidate that fires a rule; ambiguous or none if it is not exactly one."""
    fit = candidates.join(rules.select(*keys).distinct(), keys, "left_semi").groupBy(query).agg(F.count("*").alias("_n"), F.min("candidate_id").alias("_c"))
    out = candidates.select(query).distinct().join(fit, query, "left")
    return out.select(query, F.when(F.col("_n") == 1, F.col("_c")).alias("hypothesis"), F.when(F.col("_n").isNull(), "none").when(F.col("_n") == 1, "single").otherwise("ambiguous").alias("status"))


@F.arrow_udf(IntegerType())
def _depth(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Nodes on the longest chain of each proof; null if there is a cycle."""
    for batch in batches:
        out = []
        for proof in batch.to_pylist():
            after = {n["node_id"]: [] for n in proof}
            waits = dict.fromkeys(after, 0)
            for n in proof:
                for d in set(n["dependencies"] or []) & after.keys():
                    after[d].append(n["node_id"])
                    waits[n["node_id"]] += 1
            level, depth, seen = [n for n, w in waits.items() if not w], 0, 0
            while level:
                depth, seen, free = depth + 1, seen + len(level), []
                for n in level:
                    for m in after[n]:
                        waits[m] -= 1
                        if not waits[m]:
                            free.append(m)
                level = free
            out.append(depth if seen == len(after) else None)
        yield pa.array(out, pa.int32())


def proof_depths(nodes: DataFrame) -> DataFrame:
    """(proof_id, depth): the longest chain of dependencies, however long; null for a proof with a cycle. nodes: proof_id, node_id, dependencies.

    A proof, which has a bounded number of nodes by its nature, meets in one row; dependencies on unknown nodes count for nothing.
    """
    proofs = nodes.groupBy("proof_id").agg(F.collect_list(F.struct("node_id", "dependencies")).alias("_nodes"))
    return proofs.select("proof_id", _depth("_nodes").alias("depth"))


def question_depths(questions: DataFrame, nodes: DataFrame, proofs: DataFrame) -> DataFrame:
    """(question_id, depth): the least depth among a question's proofs (proofs: question_id, proof_id; nodes as in proof_depths), 0 without any.

    A proof without nodes has depth 0. A question one of whose proofs has a cycle has no depth.
    """
    depth = proofs.join(proof_depths(nodes).withColumn("_has", F.lit(True)), "proof_id", "left").withColumn("_d", F.when(F.col("_has").isNull(), 0).otherwise(F.col("depth")))
    least = depth.groupBy("question_id").agg(F.when(F.count("*") == F.count("_d"), F.min("_d")).alias("_least"), F.lit(True).alias("_any"))
    return questions.select("question_id").join(least, "question_id", "left").select("question_id", F.when(F.col("_any"), F.col("_least")).otherwise(0).alias("depth"))


def dag_violations(nodes: DataFrame, supports: DataFrame) -> DataFrame:
    """(proof_id, check, node_id): repeated ids, dependencies that do not come before, supports that do not exist."""
    twice = nodes.groupBy("proof_id", "node_id").count().where("count > 1").select("proof_id", F.lit("repeated").alias("check"), "node_id")
    dep = nodes.select("proof_id", "node_id", "pos", F.explode("dependencies").alias("_d"))
    at = nodes.groupBy("proof_id", F.col("node_id").alias("_d")).agg(F.min("pos").alias("_p"))
    late = dep.join(at, ["proof_id", "_d"], "left").where(F.col("_p").isNull() | (F.col("_p") >= F.col("pos"))).select("proof_id", F.lit("dependency").alias("check"), "node_id").distinct()
    lost = nodes.select("proof_id", "node_id", F.explode("support_fact_ids").alias("fact_id")).join(supports.select("fact_id").distinct(), "fact_id", "left_anti").select("proof_id", F.lit("support").alias("check"), "node_id").distinct()
    return twice.unionByName(late).unionByName(lost)


def degree_signature(triples: DataFrame, owner: str = "owner_id") -> DataFrame:
    """(owner, entity, relation, direction, degree)."""
    ends = F.explode(F.array(F.struct(F.col("subject").alias("entity"), F.lit("out").alias("direction")), F.struct(F.col("object").alias("entity"), F.lit("in").alias("direction")))).alias("_e")
    return triples.select(owner, "relation", ends).groupBy(owner, "_e.entity", "relation", "_e.direction").agg(F.count("*").alias("degree"))


def signature_difference(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Entries of two signatures whose degrees differ."""
    return a.join(b.withColumnRenamed("degree", "other"), keys, "full").where(~F.col("degree").eqNullSafe(F.col("other")))


def proof_defects(proofs: DataFrame, steps: DataFrame, facts: DataFrame) -> DataFrame:
    """(query_id, check) of submitted proofs: query_id, owner_id, start, answer, entities, facts.

    Checks: length, start, answer, repeat, and for each fact unknown, disconnected (from the entity before), endpoint (not the
    entity after), role, scope.
    """
    wanted = steps.groupBy("query_id").agg(F.max("hop").alias("_hops"))
    p = proofs.join(wanted, "query_id", "left")
    entities, used = F.col("entities"), F.col("facts")
    whole = F.array_compact(F.array(
        F.when((F.size(used) != F.coalesce("_hops", F.lit(0))) | (F.size(entities) != F.size(used) + 1), F.lit("length")),
        F.when(~F.get(entities, F.lit(0)).eqNullSafe(F.col("start")), F.lit("start")),
        F.when(~F.get(entities, F.size(entities) - 1).eqNullSafe(F.col("answer")), F.lit("answer")),
        F.when((F.size(F.array_distinct(entities)) < F.size(entities)) | (F.size(F.array_distinct(used)) < F.size(used)), F.lit("repeat")),
    ))
    each = p.select("query_id", "owner_id", "entities", F.posexplode("facts").alias("_i", "fact_id")).withColumn("hop", F.col("_i") + 1)
    f = facts.select("owner_id", F.col("fact_id").cast("string").alias("fact_id"), "child", "parent", "parent_role", F.col("scope").alias("_scope"), F.lit(True).alias("_known"))
    j = each.join(f, ["owner_id", "fact_id"], "left").join(steps, ["query_id", "hop"], "left")
    known = F.coalesce("_known", F.lit(False))
    single = F.array_compact(F.array(
        F.when(~known, F.lit("unknown_fact")),
        F.when(known & ~F.col("child").eqNullSafe(F.get("entities", F.col("_i"))), F.lit("disconnected")),
        F.when(known & ~F.col("parent").eqNullSafe(F.get("entities", F.col("_i") + 1)), F.lit("endpoint")),
        F.when(known & (F.col("role") != "parent") & (F.col("role") != F.col("parent_role")), F.lit("role")),
        F.when(known & (F.col("scope") != F.col("_scope")), F.lit("scope")),
    ))
    return p.select("query_id", F.explode(whole).alias("check")).unionByName(j.select("query_id", F.explode(single).alias("check"))).distinct()


def path_shape(steps: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """(item_id, shape) from resolved endpoints by step: what is known to be wrong is incorrect, then open ones need a review.

    steps: item_id, step_no, from_id, to_id (null unresolved), role_ok (null unknown), and if there are, from_conflict and
    to_conflict (a mention whose parts name different entities). Incorrect are a wrong role, a conflicting endpoint, and
    steps that do not join. queries (item_id, length, start, targets): incorrect are also another number of steps, none
    among them, a resolved start that is not the query's, and a resolved end outside targets (if there are any).
    """
    conflict = F.lit(False)
    for c in ("from_conflict", "to_conflict"):
        conflict = conflict | (F.coalesce(F.col(c), F.lit(False)) if c in steps.columns else F.lit(False))
    ordered = F.array_sort(F.collect_list(F.struct("step_no", "from_id", "to_id", "role_ok", conflict.alias("conflict"))))
    g = steps.groupBy("item_id").agg(ordered.alias("_s"))
    open_ = F.exists("_s", lambda s: s["from_id"].isNull() | s["to_id"].isNull() | s["role_ok"].isNull())
    joints = F.zip_with(F.slice("_s", 1, F.greatest(F.size("_s") - 1, F.lit(0))), F.slice("_s", 2, F.size("_s")), lambda a, b: F.coalesce(a["to_id"] == b["from_id"], F.lit(True)))
    wrong = F.exists("_s", lambda s: ~F.coalesce(s["role_ok"], F.lit(True)) | s["conflict"]) | F.exists(joints, lambda ok: ~ok)
    if queries is not None:
        g = queries.select("item_id", "length", F.col("start").alias("_start"), F.col("targets").alias("_targets")).join(g, "item_id", "left")
        first, last = F.get("_s", F.lit(0))["from_id"], F.get("_s", F.size("_s") - 1)["to_id"]
        other = F.col("_s").isNull() | (F.size("_s") != F.col("length")) | (first != F.col("_start")) | ((F.size("_targets") > 0) & ~F.array_contains("_targets", last))
        wrong = F.coalesce(other, F.lit(False)) | F.coalesce(wrong, F.lit(False))
    return g.select("item_id", F.when(wrong, "incorrect").when(open_, "needs_semantic_review").otherwise("correct").alias("shape"))


def path_difference(expected: DataFrame, submitted: DataFrame, key: str = "query_id") -> DataFrame:
    """(key, facts, side): complete paths that were left out (omitted) or are not in the graph (invented)."""
    e, s = (df.select(key, F.array_join("facts", ">").alias("facts")).distinct() for df in (expected, submitted))
    return e.join(s, [key, "facts"], "left_anti").withColumn("side", F.lit("omitted")).unionByName(s.join(e, [key, "facts"], "left_anti").withColumn("side", F.lit("invented")))


def frontier_violations(reviews: DataFrame, start: DataFrame, hops: int | None = None) -> DataFrame:
    """(query_id, hop, entity, check): children reviewed twice in a hop, not reached (unexpected) or reached and not reviewed (missing).

    reviews: query_id, hop, child, parents (array, the reviewed result); start: query_id, entity. There are as many hops
    as the reviews have, one at least; more than `hops`, if given, raise.
    """
    frontier, out = start, []
    for hop in range(1, max(1, hops or 0, _longest(reviews, hops)) + 1):
        seen = reviews.where(F.col("hop") == hop).groupBy("query_id", F.col("child").alias("entity")).agg(F.count("*").alias("_n"))
        both = frontier.distinct().withColumn("_f", F.lit(True)).join(seen, ["query_id", "entity"], "full")
        check = F.when(F.col("_n").isNull(), "missing").when(F.col("_f").isNull(), "unexpected").when(F.col("_n") > 1, "repeated")
        out.append(both.select("query_id", F.lit(hop).alias("hop"), "entity", check.alias("check")).where("check is not null"))
        frontier = reviews.where(F.col("hop") == hop).select("query_id", F.explode("parents").alias("entity")).distinct()
    return reduce(DataFrame.unionByName, out)


def distractors(nodes: DataFrame, triples: DataFrame, legal: DataFrame, levels: int = 2) -> DataFrame:
    """(node_id, fact_id, kind): facts off the proof that a reader may take for the node's own.

    nodes: owner_id, node_id, upstream, relation, direction (out: upstream is the subject; in: the object), at_time; triples:
    owner_id, fact_id, subject, relation, object, period (lo, hi), is_entity (of the object's value); legal: fact_id.
    Adjacent kinds: other_relation (same upstream), other_upstream (same relation), out_of_period (both the same, but at_time lies
    outside; no period or no time gives none). continuation: facts that go on from the far end of those, in two levels.
    """
    off = triples.join(legal.select("fact_id").distinct(), "fact_id", "left_anti")
    ends = F.explode(F.array(F.struct(F.lit("out").alias("direction"), F.col("subject").alias("_at"), F.col("object").alias("_to")), F.struct(F.lit("in").alias("direction"), F.col("object").alias("_at"), F.col("subject").alias("_to")))).alias("_e")
    edge = off.select("owner_id", "fact_id", F.col("relation").alias("_r"), "period", F.col("is_entity").alias("_ent"), ends).select("owner_id", "fact_id", "_r", "period", "_ent", "_e.*")
    n = nodes.select("owner_id", "node_id", "upstream", "relation", "direction", "at_time")
    late = F.col("period").isNotNull() & F.col("at_time").isNotNull() & ~F.col("at_time").between(F.col("period.lo"), F.col("period.hi"))
    beside = n.join(edge.withColumn("upstream", F.col("_at")), ["owner_id", "direction", "upstream"]).withColumn("kind", F.when(F.col("relation") != F.col("_r"), "other_relation").when((F.col("relation") == F.col("_r")) & late, "out_of_period")).where("kind is not null")
    alike = n.join(edge.withColumn("relation", F.col("_r")), ["owner_id", "direction", "relation"]).where("upstream <> _at").withColumn("kind", F.lit("other_upstream"))
    columns = ["owner_id", "node_id", "direction", "fact_id", "_to", "_ent", "kind"]
    found = new = beside.select(*columns).unionByName(alike.select(*columns)).distinct()
    for _ in range(levels):
        ahead = new.where("_ent").select("owner_id", "node_id", "direction", F.col("_to").alias("_at")).distinct()
        new = ahead.join(edge, ["owner_id", "direction", "_at"]).join(found.select("node_id", "fact_id").distinct(), ["node_id", "fact_id"], "left_anti").withColumn("kind", F.lit("continuation")).select(*columns).distinct()
        found = found.unionByName(new)
    return found.select("node_id", "fact_id", "kind").distinct()


def document_roles(documents: DataFrame, supports: DataFrame, key: str = "document_id") -> DataFrame:
    """documents with role: current_proof, alternative, background or unreferenced, the first that applies. supports: key, use."""
    rank = F.min(F.when(F.col("use") == "proof", 0).when(F.col("use") == "alternative", 1).otherwise(2))
    s = supports.groupBy(key).agg(rank.alias("_r"))
    return documents.join(s, key, "left").withColumn("role", F.element_at(F.array(*map(F.lit, ("current_proof", "alternative", "background", "unreferenced"))), F.coalesce("_r", F.lit(3)) + 1)).drop("_r")


def one_hop_probes(proofs: DataFrame) -> DataFrame:
    """One probe for each relation node of a question's proof: proofs has question_id and nodes (upstream, relation, value, supports)."""
    n = proofs.select("question_id", F.posexplode("nodes").alias("pos", "_n")).where("_n.relation is not null")
    return n.select(F.concat_ws("-", F.lit("P"), "question_id", "pos").alias("probe_id"), "question_id", F.col("_n.upstream").alias("upstream"), F.col("_n.relation").alias("relation"), F.col("_n.value").alias("answer"), F.col("_n.supports").alias("supports"))


def normal_relations(records: DataFrame) -> DataFrame:
    """Library records as (parent, child, parent_role): father and mother as they are, son and daughter turned round with the role parent, in English or Chinese; other labels go."""
    label = F.coalesce(*(F.when(F.col("label") == zh, en) for zh, en in CHINESE.items()), F.col("label"))
    up, down = label.isin("father", "mother"), label.isin("son", "daughter")
    rows = records.where(up | down)
    return rows.select("*", F.when(up, F.col("tail")).otherwise(F.col("head")).alias("parent"), F.when(up, F.col("head")).otherwise(F.col("tail")).alias("child"), F.when(up, label).otherwise("parent").alias("parent_role"))


def compare_libraries(facts: DataFrame, records: DataFrame, matching: list[str], hints_only: list[str]) -> DataFrame:
    """(fact_id, library, status) for each library named.

    facts: fact_id, parent, child, parent_role, safe (names of one owner, no time); records: library, parent, child, parent_role,
    known_issue. Rows with a known issue take no part (known_issues lists them). Libraries in `matching` give matches, those in
    `hints_only` conflict hints alone. `parent` agrees with any role, both ways.
    """
    good = records.where("not known_issue").select("library", "child", F.col("parent").alias("_p"), F.col("parent_role").alias("_r"))
    j = facts.withColumn("library", F.explode(F.array(*map(F.lit, [*matching, *hints_only])))).join(good, ["library", "child"], "left")
    same_parent, same_role = F.col("_p") == F.col("parent"), F.col("_r") == F.col("parent_role")
    wild, own_wild = F.col("_r") == "parent", F.col("parent_role") == "parent"
    match = same_parent & (same_role | wild | own_wild)
    conflict = ~match & ((same_role & ~own_wild) | (same_parent & ~wild & ~own_wild))
    g = j.groupBy("fact_id", "library").agg(F.bool_or(match).alias("_m"), F.bool_or(conflict).alias("_c"), F.bool_and("safe").alias("_s"))
    hinting = F.col("library").isin(*hints_only) if hints_only else F.lit(False)
    status = F.when(~F.col("_s"), "not_comparable_temporal_or_ambiguous_identity").when(F.col("_c"), "conflict_hint").when(hinting, "conflict_hints_only_none_found").when(F.col("_m"), "static_compatible_hint").otherwise("not_covered")
    return g.select("fact_id", "library", status.alias("status"))


def known_issues(facts: DataFrame, records: DataFrame) -> DataFrame:
    """Library rows with a known issue on the child of a safe fact, each once: they were left out of compare_libraries."""
    return records.where("known_issue").join(facts.where("safe").select("child").distinct(), "child", "left_semi").select(*records.columns)


def omissions(records: DataFrame, facts: DataFrame, safe_names: DataFrame, library: str, temporal: bool = False) -> DataFrame:
    """(library, parent, child, source_row): pairs of safe names that the library has and no fact, each once, by its first row, whether
    that has a known issue or not. None if any fact is temporal."""
    rows = records.where(F.col("library") == library)
    for side in ("parent", "child"):
        rows = rows.join(safe_names.select(F.col("name").alias(side)).distinct(), side, "left_semi")
    rows = rows.join(facts.select("parent", "child").distinct(), ["parent", "child"], "left_anti")
    return rows.where(F.lit(not temporal)).groupBy("library", "parent", "child").agg(F.min("source_row").alias("source_row"))


def source_clusters(uses: DataFrame, item: str, family: str) -> DataFrame:
    """(item, family, n): the families of items that two or more families use, a row for each, with their number."""
    each = uses.select(item, family).where(F.col(family).isNotNull()).distinct()
    shared = each.groupBy(item).agg(F.count("*").alias("n")).where("n > 1")
    return each.join(shared, item)


def interval(lo: Column, hi: Column) -> Column:
    return F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))
