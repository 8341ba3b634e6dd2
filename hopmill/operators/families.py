"""Variant families: conditions of a base packet, invariants, change sets, renaming, corruptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CONDITIONS = ("base", "main_distractor", "irrelevant_addition", "necessary_support_deleted_name_retained", "irrelevant_deleted")
#: The rules of a library's families (combinations, variant, field, relation, other variant, its field or the value).
FAMILY_RULES = (
    ("", "no_context", "status", "is", "", "insufficient"),
    ("", "anonymous_challenge", "status", "equal", "challenge", "status"),
    ("", "unfamiliar_challenge", "status", "equal", "challenge", "status"),
    ("C01 C02 C04 C06 C07 C10", "control", "answers", "equal", "challenge", "answers"),
    ("C04", "challenge", "proofs", "is", "", "2"),
    ("C04", "delete_one_support", "proofs", "is", "", "1"),
    ("C04", "delete_all_bridge_supports", "status", "is", "", "insufficient"),
    ("C04", "delete_irrelevant", "answers", "equal", "challenge", "answers"),
    ("C07", "reorder_same_noise", "documents", "equal", "challenge", "reversed_documents"),
    ("C07", "noise_1000", "answers", "equal", "challenge", "answers"),
    ("C07", "noise_12000", "answers", "equal", "challenge", "answers"),
    ("C07", "reorder_same_noise", "answers", "equal", "challenge", "answers"),
    ("C08", "control", "degrees", "equal", "challenge", "degrees"),
    ("C08", "control", "answers", "differs", "challenge", "answers"),
    ("C08", "switch_question_start", "documents", "equal", "challenge", "documents"),
    ("C08", "switch_question_start", "answers", "differs", "challenge", "answers"),
    ("C08", "same_answer_other_proof", "answers", "equal", "control", "answers"),
    ("C08", "same_answer_other_proof", "support", "differs", "control", "support"),
    ("C08", "same_answer_other_proof", "documents", "equal", "same_answer_original_start", "documents"),
    ("C08", "same_answer_other_proof", "answers", "equal", "same_answer_original_start", "answers"),
    ("C09", "challenge", "logical_truth", "is", "", "unknown"),
    ("C10", "time_2", "answers", "differs", "challenge", "answers"),
)
PRESERVING = ("main_distractor", "irrelevant_addition", "irrelevant_deleted")


def expand_conditions(packets: DataFrame, units: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(units of each family and condition, cuts of each): base units, plus distractors or irrelevant ones where the condition adds them.

    packets: family_id, base_unit_ids, distractor_ids, irrelevant_ids, deletions (condition, unit_id, quote).
    """
    added = F.when(F.col("condition") == "main_distractor", F.col("distractor_ids")).when(F.col("condition") == "irrelevant_addition", F.col("irrelevant_ids")).otherwise(F.array().cast("array<string>"))
    rest = [c for c in units.columns if c not in ("family_id", "unit_id")]
    held = units.groupBy("family_id").agg(F.collect_list(F.struct("unit_id", *rest)).alias("_units"))  # bounded by the nature of a family
    rows = packets.join(held, "family_id").withColumn("condition", F.explode(F.array(*map(F.lit, CONDITIONS)))).withColumn("_ids", F.array_union("base_unit_ids", added))
    rows = rows.select("family_id", "condition", F.inline(F.filter("_units", lambda u: F.array_contains("_ids", u["unit_id"])))).select("family_id", "unit_id", "condition", *rest)
    cuts = packets.select("family_id", F.explode("deletions").alias("_d")).select("family_id", "_d.condition", "_d.unit_id", "_d.quote")
    return rows, cuts


def invariant_violations(solved: DataFrame, name_visible: DataFrame | None = None) -> DataFrame:
    """(family_id, condition, check). solved: family_id, condition, status, answers, proofs (sorted arrays of text).

    The base is answerable; preserving conditions keep status, answers and the base's proofs; a necessary deletion leaves no answer,
    and its name visible where name_visible (family_id, condition, visible) is given.
    """
    base = solved.where("condition = 'base'").select("family_id", F.col("status").alias("_s"), F.col("answers").alias("_a"), F.col("proofs").alias("_p"))
    j = solved.join(base, "family_id", "left")
    keeps = F.col("condition").isin(*PRESERVING)
    gone = F.col("condition") == "necessary_support_deleted_name_retained"
    checks = F.array_compact(F.array(
        F.when((F.col("condition") == "base") & (F.col("status") != "answerable"), F.lit("base_not_answerable")),
        F.when(F.col("_s").isNull(), F.lit("no_base")),
        F.when(keeps & ((F.col("status") != F.col("_s")) | (F.col("answers") != F.col("_a"))), F.lit("answer_changed")),
        F.when(keeps & (F.size(F.array_except("_p", "proofs")) > 0), F.lit("base_proof_lost")),
        F.when(gone & (F.col("status") == "answerable"), F.lit("still_answerable")),
    ))
    out = j.select("family_id", "condition", F.explode(checks).alias("check"))
    if name_visible is not None:
        out = out.unionByName(name_visible.where((F.col("condition") == "necessary_support_deleted_name_retained") & ~F.col("visible")).select("family_id", "condition", F.lit("name_lost").alias("check")))
    return out


def residual_override(variants: DataFrame, flags: DataFrame) -> DataFrame:
    """Flagged conditions become unresolved; what the graph gave stays in graph_status."""
    f = flags.select("family_id", "condition").distinct().withColumn("_f", F.lit(True))
    return variants.join(f, ["family_id", "condition"], "left").withColumn("graph_status", F.col("status")).withColumn("status", F.when(F.col("_f"), "unresolved").otherwise(F.col("status"))).drop("_f")


def change_set(parent: DataFrame, child: DataFrame, keys: list[str], fact: str, value: str) -> DataFrame:
    """(keys, added, removed, rewritten): sorted fact ids of a variant against its parent."""
    p = parent.select(*keys, fact, F.col(value).alias("_p"), F.lit(True).alias("_in"))
    c = child.select(*keys, fact, F.col(value).alias("_c"), F.lit(True).alias("_out"))
    j = p.join(c, [*keys, fact], "full")
    of = lambda cond: F.array_sort(F.collect_list(F.when(cond, F.col(fact))))
    return j.groupBy(*keys).agg(of(F.col("_in").isNull()).alias("added"), of(F.col("_out").isNull()).alias("removed"), of(F.col("_in") & F.col("_out") & ~F.col("_p").eqNullSafe(F.col("_c"))).alias("rewritten"))


def missing_facts(parent: DataFrame, child: DataFrame, keys: list[str]) -> DataFrame:
    """Facts of the parent that the variant lacks."""
    return parent.join(child.select(*keys), keys, "left_anti")


def select_primary(variants: DataFrame, choice: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the chosen surface of each family, counts generated and removed by family)."""
    kept = variants.join(choice, ["family_id", "surface"], "left_semi")
    counts = variants.groupBy("family_id").agg(F.count("*").alias("generated")).join(kept.groupBy("family_id").agg(F.count("*").alias("kept")), "family_id", "left")
    return kept, counts.select("family_id", "generated", (F.col("generated") - F.coalesce("kept", F.lit(0))).alias("removed"))


def completeness(records: DataFrame, family: str, variant: str, needed: list[str], domain: str = "", domains: list[str] | None = None) -> DataFrame:
    """(family, missing): needed variants (and domains) that a family lacks."""
    lack = F.array_except(F.array(*map(F.lit, needed)), F.collect_set(variant))
    if domains:
        lack = F.concat(lack, F.array_except(F.array(*map(F.lit, domains)), F.collect_set(domain)))
    return records.groupBy(family).agg(lack.alias("_m")).select(family, F.explode("_m").alias("missing"))


def rule_violations(records: DataFrame, rules: tuple[tuple[str, ...], ...] = FAMILY_RULES) -> DataFrame:
    """(family_id, rule, check): rules of a family's combination that its variants break, by division of families by rules.

    records: family_id, combination_id, variant, values (map of text: answers, status, documents and the like, whole or as
    digests). A rule has combinations (blank-separated, all if empty), variant, field, relation (is, equal, differs),
    other, and the other's field, or the value of `is`. rule is the rule's place in the table, from 1. Checks: missing (no
    such variant), missing_other, relation (an unset field, too). Rows that repeat a variant are held to it each; a family
    of several combinations has the rules of each.
    """
    named = ("combinations", "variant", "field", "relation", "other", "value")
    listed = F.array(*(F.struct(F.lit(i).alias("rule"), *(F.lit(v).alias(n) for n, v in zip(named, r, strict=True))) for i, r in enumerate(rules, 1)))
    asked = records.select("family_id", "combination_id").distinct().select("family_id", "combination_id", F.explode(listed).alias("_r")).select("family_id", "combination_id", "_r.*")
    asked = asked.where((F.col("combinations") == "") | F.array_contains(F.split("combinations", " "), F.col("combination_id")))
    of = lambda c, v: records.select("family_id", F.col("variant").alias(c), F.col("values").alias(v), F.lit(True).alias(f"{v}_there"))
    met = asked.join(of("variant", "_a"), ["family_id", "variant"], "left").join(of("other", "_b"), ["family_id", "other"], "left")
    mine, theirs = F.col("_a")[F.col("field")], F.when(F.col("relation") == "is", F.col("value")).otherwise(F.col("_b")[F.col("value")])
    holds = F.when(F.col("relation") == "differs", mine != theirs).otherwise(mine == theirs)
    check = F.when(F.col("_a_there").isNull(), "missing").when((F.col("relation") != "is") & F.col("_b_there").isNull(), "missing_other").when(~F.coalesce(holds, F.lit(False)), "relation")
    return met.select("family_id", "rule", check.alias("check")).where("check is not null").distinct()


def uncovered(records: DataFrame, plans: DataFrame, key: str, planned: str, covered: str) -> DataFrame:
    """(key, missing): planned values of each plan (an array) that no record of the same key has in its array."""
    want = plans.select(key, F.explode(planned).alias("missing")).distinct()
    return want.join(records.select(key, F.explode(covered).alias("missing")).distinct(), [key, "missing"], "left_anti")


def name_codes(entities: DataFrame, group: str, entity: str, seed: str, prefix: str = "E") -> DataFrame:
    """(group, entity, code): one code for each entity of a group, in the order of a seeded digest."""
    d = F.sha2(F.concat_ws("|", F.lit(seed), F.col(entity).cast("string")), 256)
    n = F.row_number().over(Window.partitionBy(group).orderBy(d, entity))
    return entities.select(group, entity).distinct().withColumn("code", F.concat(F.lit(prefix), F.lpad(n.cast("string"), 4, "0")))


def renamed_facts(facts: DataFrame, codes: DataFrame, group: str, entity: str, columns: list[str]) -> DataFrame:
    """facts with the entities of some columns replaced by their codes."""
    out = facts
    for c in columns:
        out = out.join(codes.select(group, F.col(entity).alias(c), F.col("code").alias(f"_{c}")), [group, c], "left").withColumn(c, F.coalesce(f"_{c}", c)).drop(f"_{c}")
    return out.select(*facts.columns)


def equivariance_violations(answers: DataFrame, renamed: DataFrame, codes: DataFrame, query: str, group: str, entity: str) -> DataFrame:
    """(query, side): answers whose renaming is not an answer of the renamed facts, and the other way round."""
    want = answers.join(codes, [group, entity]).select(query, "code").distinct()
    got = renamed.select(query, F.col(entity).alias("code")).distinct()
    return want.join(got, [query, "code"], "left_anti").select(query, F.lit("lost").alias("side")).unionByName(got.join(want, [query, "code"], "left_anti").select(query, F.lit("extra").alias("side")))


def corruptions(families: DataFrame, kinds: tuple[str, ...] = ("wrong_answer", "wrong_status", "reversed_proof", "fake_deletion"), other_answer: Column | None = None, index: Column | None = None) -> DataFrame:
    """A good and a bad row for each family (family_id, answer, status, proof, deletions): the kind goes in turn by the family's index, or by a digest of the family."""
    n = F.pmod(F.xxhash64("family_id") if index is None else index, F.lit(len(kinds))).cast("int")
    rows = families.withColumn("category", F.element_at(F.array(*map(F.lit, kinds)), n + 1))
    is_ = lambda k: F.col("category") == k
    wrong = other_answer if other_answer is not None else F.concat("answer", F.lit("?"))
    bad = rows.withColumns({
        "answer": F.when(is_("wrong_answer"), wrong).otherwise(F.col("answer")),
        "status": F.when(is_("wrong_status"), F.when(F.col("status") == "answerable", "ambiguous").otherwise("answerable")).otherwise(F.col("status")),
        "proof": F.when(is_("reversed_proof"), F.reverse("proof")).otherwise(F.col("proof")),
        "deletions": F.when(is_("fake_deletion"), F.col("deletions") + 1).otherwise(F.col("deletions")),
    })
    return rows.withColumn("copy", F.lit("good")).unionByName(bad.withColumn("copy", F.lit("bad")))


def flatten_proofs(paths: DataFrame, facts: DataFrame) -> DataFrame:
    """Proof nodes of paths (query_id, path_no, entities, facts): node_id, dependency on the node before, relation, value, document."""
    n = paths.select("query_id", "path_no", "entities", F.posexplode("facts").alias("_i", "fact_id"))
    n = n.select("query_id", "path_no", "fact_id", F.concat(F.lit("n"), F.col("_i") + 1).alias("node_id"), F.when(F.col("_i") > 0, F.concat(F.lit("n"), F.col("_i"))).alias("dependency"), F.get("entities", F.col("_i") + 1).alias("value"))
    return n.join(facts.select(F.col("fact_id").cast("string").alias("fact_id"), F.col("parent_role").alias("relation"), "document_id"), "fact_id", "left")


def variant_records(variants: DataFrame) -> DataFrame:
    """Catalog records of variants: their ids, those of the family's control and challenge, and what changed against the control.

    variants: family_id, variant_index (0 is the control, 1 the challenge), fact_ids, answers, status, and others that are
    kept. Changes are null for the control and where there is none; null arrays count as empty. A family has one control.
    """
    some = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    name = lambda n: F.concat(F.col("family_id").cast("string"), F.lit("-"), F.format_string("%02d", n))
    control = variants.where("variant_index = 0").select("family_id", some("fact_ids").alias("_f"), some("answers").alias("_a"), F.struct("status").alias("_s"))
    facts, later = some("fact_ids"), (F.col("variant_index") > 0) & F.col("_s").isNotNull()
    return variants.join(control, "family_id", "left").withColumns({
        "record_id": name(F.col("variant_index")), "control_id": name(F.lit(0)), "challenge_id": name(F.lit(1)),
        "added": F.when(later, F.array_sort(F.array_except(facts, "_f"))), "removed": F.when(later, F.array_sort(F.array_except("_f", facts))),
        "answers_changed": F.when(later, some("answers") != F.col("_a")), "status_changed": F.when(later, ~F.col("status").eqNullSafe(F.col("_s.status"))),
    }).drop("_f", "_a", "_s")


def fact_documents(variants: DataFrame, supports: DataFrame) -> DataFrame:
    """(family_id, variant_index, fact_id, document, documents): for each active fact the units of the variant that support it, sorted, and the first.

    variants: family_id, variant_index, fact_ids, unit_ids; supports: family_id, fact_id, unit_id, of all registered
    support sets. A fact that no unit of the variant supports has no document and an empty list.
    """
    known = supports.groupBy("family_id").agg(F.collect_list(F.struct("fact_id", "unit_id")).alias("_known"))  # bounded by the nature of a family
    each = variants.select("family_id", "variant_index", "fact_ids", "unit_ids").join(known, "family_id", "left")
    each = each.select("family_id", "variant_index", "unit_ids", "_known", F.explode(F.array_distinct("fact_ids")).alias("fact_id"))
    holds = F.filter("_known", lambda s: (s["fact_id"] == F.col("fact_id")) & F.array_contains("unit_ids", s["unit_id"]))
    documents = F.array_sort(F.array_distinct(F.transform(holds, lambda s: s["unit_id"])))
    out = each.withColumn("documents", F.coalesce(documents, F.array().cast("array<string>")))
    return out.select("family_id", "variant_index", "fact_id", F.get("documents", 0).alias("document"), "documents")


def document_order(family: Column, documents: Column, salt: str, backwards: bool = False) -> Column:
    """The documents of a family in the order of a digest of family, salt and id, or the reverse."""
    keyed = F.array_sort(F.transform(documents, lambda d: F.struct(F.sha2(F.concat_ws("|", family, F.lit(salt), d), 256).alias("k"), d.alias("d"))))
    out = F.transform(keyed, lambda x: x["d"])
    return F.reverse(out) if backwards else out


def rebuild_differences(stored: DataFrame, rebuilt: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, check): stored rows that a rebuild lacks, adds or changes, by the digest of all other columns."""
    digest = lambda df, n: df.select(*keys, F.sha2(F.to_json(F.struct(*sorted(c for c in df.columns if c not in keys)), {"ignoreNullFields": "false"}), 256).alias(n))
    j = digest(stored, "_s").join(digest(rebuilt, "_r"), keys, "full")
    check = F.when(F.col("_r").isNull(), "not_rebuilt").when(F.col("_s").isNull(), "not_stored").when(F.col("_s") != F.col("_r"), "changed")
    return j.withColumn("check", check).where("check is not null").select(*keys, "check")
