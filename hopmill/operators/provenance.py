"""Deletion families as one flow: contexts of eight conditions, proofs with their support as bits, and the rules of a family.

Proofs are searched once, over all facts. Each support group of a family has a bit; a condition is a mask of the groups that
its texts still hold. A proof lives if every fact of it has a bit under the mask, support is counted by bits, and no
condition is solved anew.

What a family has (units, evidence, proofs, conditions) is bounded by its nature, so it meets by family_id alone: tables that
are dealt by it already, as those of one source are, are not shuffled again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hopmill.operators.text import delete_quotes, without_quotes

#: The conditions of a family.
NECESSARY, ABSENT, REDUNDANT, ALTERNATIVE = "necessary_support_deleted_name_retained", "name_absent_deleted", "redundant_support_deleted", "alternative_proof_preserved"
PRESERVING = ("main_distractor", "irrelevant_addition", "irrelevant_deleted")
MANDATORY = ("base", "main_distractor", "irrelevant_addition", NECESSARY, "irrelevant_deleted")
OPTIONAL = (ABSENT, REDUNDANT, ALTERNATIVE)
SPOT = ["family_id", "condition"]
CUTS = "array<struct<condition string, unit_id string, quote string>>"


def bits(places: Column, words: Column) -> Column:
    """An array of `words` longs with the bits of the places set."""
    word = lambda w: F.aggregate(F.filter(places, lambda p: F.floor(p / 64) == w), F.lit(0).cast("long"), lambda acc, p: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), (p % 64).cast("int"))))
    return F.transform(F.sequence(F.lit(0), words - 1), word)


def shared_bits(a: Column, b: Column) -> Column:
    """How many bits two arrays of longs have in common."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseAND(y))), F.lit(0), lambda acc, n: acc + F.coalesce(n, F.lit(0)))


def family_contexts(packets: DataFrame, units: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(contexts, log of cuts, violations): the units of each family (family_id, condition, unit_id, text) under each condition that applies.

    packets: family_id, base_unit_ids, distractor_ids, irrelevant_ids, deletions (condition, unit_id, quote); units: family_id,
    unit_id, text. An optional condition applies if it has deletions, which fall on base units only.
    """
    of = lambda c: F.exists("deletions", lambda d: d["condition"] == c)
    applies = F.array_compact(F.array(*map(F.lit, MANDATORY), *(F.when(of(c), F.lit(c)) for c in OPTIONAL)))
    none = F.array().cast("array<string>")
    added = F.when(F.col("condition") == "main_distractor", F.col("distractor_ids")).when(F.col("condition") == "irrelevant_addition", F.col("irrelevant_ids")).otherwise(none)
    held = units.groupBy("family_id").agg(F.collect_list(F.struct("unit_id", "text")).alias("_units"))
    each = packets.withColumn("condition", F.explode(applies)).select(*SPOT, F.filter(F.coalesce("deletions", F.array().cast(CUTS)), lambda d: d["condition"] == F.col("condition")).alias("_cuts"), F.array_union("base_unit_ids", added).alias("_ids"))
    each = each.join(held, "family_id").select(*SPOT, "_cuts", F.inline(F.filter("_units", lambda u: F.array_contains("_ids", u["unit_id"]))))
    quotes = F.transform(F.filter("_cuts", lambda d: d["unit_id"] == F.col("unit_id")), lambda d: d["quote"])
    after = each.withColumn("_quotes", quotes).withColumn("_after", without_quotes(F.col("text"), F.col("_quotes")))
    contexts = after.where((F.col("_after") != "") | (F.size("_quotes") == 0) | (F.coalesce("text", F.lit("")) == "")).select(*SPOT, "unit_id", F.col("_after").alias("text"))
    cuts = packets.select("family_id", F.explode("deletions").alias("_d")).select("family_id", "_d.condition", "_d.unit_id", "_d.quote")
    _, log, bad = delete_quotes(each.select(*SPOT, "unit_id", "text"), cuts, [*SPOT, "unit_id"])
    return contexts, log, bad


def support_bits(evidence: DataFrame, contexts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(facts with the bits of their groups, conditions with the bits of the groups that hold).

    evidence: family_id, fact_id, group_no, unit_id, quote. A group holds if every quote of it stands in its own unit.
    """
    groups = evidence.groupBy("family_id", "fact_id", "group_no").agg(F.collect_list(F.struct("unit_id", "quote")).alias("_quotes"))
    w = Window.partitionBy("family_id")  # a family's evidence is bounded by its nature
    groups = groups.withColumns({"_place": F.row_number().over(w.orderBy("fact_id", "group_no")) - 1, "_words": F.ceil(F.count("*").over(w) / 64).cast("int")})
    facts = groups.groupBy("family_id", "fact_id").agg(bits(F.collect_list("_place"), F.max("_words")).alias("bits"))
    own = groups.groupBy("family_id").agg(F.collect_list(F.struct("_place", "_quotes")).alias("_groups"), F.max("_words").alias("_words"))
    texts = contexts.groupBy(*SPOT).agg(F.collect_list(F.struct("unit_id", "text")).alias("_texts"))
    stands = lambda q: F.exists("_texts", lambda t: F.coalesce((t["unit_id"] == q["unit_id"]) & (q["quote"] != "") & t["text"].contains(q["quote"]), F.lit(False)))
    whole = F.transform(F.filter("_groups", lambda g: F.forall(g["_quotes"], stands)), lambda g: g["_place"])
    return facts, texts.join(own, "family_id", "left").select(*SPOT, F.when(F.col("_words").isNotNull(), bits(whole, F.col("_words"))).alias("mask"))


def solved_families(proofs: DataFrame, facts: DataFrame, conditions: DataFrame) -> DataFrame:
    """(family_id, condition, status, answers, proofs, support): what the living proofs answer; support maps facts to groups that hold.

    proofs: family_id, answer, facts (ids in order), found once over all facts; facts and conditions from support_bits.
    """
    each = proofs.where(F.size("facts") > 0).groupBy("family_id").agg(F.collect_list(F.struct("answer", F.array_join("facts", ">").alias("proof"), "facts")).alias("_proofs"))
    known = facts.where("fact_id is not null").groupBy("family_id").agg(F.array_sort(F.collect_list(F.struct("fact_id", "bits"))).alias("_facts"))
    mask = F.coalesce("mask", F.array().cast("array<long>"))
    groups = F.map_from_entries(F.transform("_facts", lambda f: F.struct(f["fact_id"], shared_bits(f["bits"], mask).alias("groups"))))
    out = conditions.join(known, "family_id", "left").select(*SPOT, groups.alias("support")).join(each, "family_id", "left")
    holds = lambda f: F.coalesce(F.element_at("support", f) > 0, F.lit(False))
    out = out.withColumn("_living", F.filter("_proofs", lambda p: F.forall(p["facts"], holds)))
    of = lambda c: F.coalesce(F.array_sort(F.array_distinct(F.array_compact(F.transform("_living", lambda p: p[c])))), F.array().cast("array<string>"))
    out = out.select(*SPOT, of("answer").alias("answers"), of("proof").alias("proofs"), "support")
    n = F.size("answers")
    return out.withColumn("status", F.when(n == 0, "insufficient_evidence").when(n == 1, "answerable").otherwise("ambiguous"))


def necessary_facts(proofs: DataFrame) -> DataFrame:
    """(family_id, fact_id): facts that every proof of the family has."""
    total = proofs.groupBy("family_id").agg(F.count("*").alias("_all"))
    each = proofs.select("family_id", F.explode(F.array_distinct("facts")).alias("fact_id")).groupBy("family_id", "fact_id").agg(F.count("*").alias("_n"))
    return each.join(total, "family_id").where("_n = _all").select("family_id", "fact_id")


def family_violations(packets: DataFrame, solved: DataFrame, contexts: DataFrame, steps: int = 2) -> DataFrame:
    """(family_id, condition, check) where a family breaks a rule.

    packets has besides its units and deletions start_names (the canonical name first), not_applicable (condition, reason) and
    residual (conditions whose meaning survives the cut: there a proof may, too). Rules: the base is answered once, by
    proofs of `steps` facts, and names its start; distractors and additions are no base units and differ; preserving conditions
    keep the answer and every proof; a necessary deletion keeps the name and no proof; a name-absent one keeps neither; a
    redundant one keeps the answer and leaves a fact of a proof fewer supports, but one at least; an alternative one keeps the
    answer and loses a proof; an optional condition has either deletions or a reason.
    """
    w = Window.partitionBy("family_id")
    texts = contexts.groupBy(*SPOT).agg(F.collect_list("text").alias("_texts")).join(packets.select("family_id", F.array_distinct("start_names").alias("_names")), "family_id")
    seen = texts.select(*SPOT, F.filter("_names", lambda s: (s != "") & F.exists("_texts", lambda t: t.contains(s))).alias("_s"))
    seen = seen.groupBy("family_id").agg(F.map_from_entries(F.collect_list(F.struct("condition", "_s"))).alias("_by"))
    p = packets.select("family_id", F.get("start_names", F.lit(0)).alias("_name"), F.coalesce("residual", F.array().cast("array<string>")).alias("_residual"))
    base = F.first(F.when(F.col("condition") == "base", F.struct(F.col("status").alias("_s"), F.col("answers").alias("_a"), F.col("proofs").alias("_p"), F.col("support").alias("_before"))), True)
    j = solved.withColumn("_base", base.over(w)).select(*solved.columns, "_base.*").join(p, "family_id").join(seen, "family_id", "left").withColumn("_seen", F.element_at("_by", F.col("condition")))
    seen_names = F.coalesce("_seen", F.array().cast("array<string>"))
    is_ = lambda c: F.col("condition") == c
    same = F.coalesce((F.col("_s") == "answerable") & (F.col("status") == "answerable") & (F.col("answers") == F.col("_a")), F.lit(False))
    named, residual = F.array_contains(seen_names, F.col("_name")), F.array_contains("_residual", F.col("condition"))
    of_proofs = F.array_distinct(F.flatten(F.transform("_p", lambda x: F.split(x, ">"))))
    fewer = F.exists(of_proofs, lambda f: (F.element_at("_before", f) > F.element_at("support", f)) & (F.element_at("support", f) > 0))
    proved = (F.col("status") != "insufficient_evidence") & ~residual
    rules = {
        "base_not_answerable": is_("base") & (F.col("status") != "answerable"),
        "base_steps": is_("base") & F.exists("proofs", lambda x: F.size(F.split(x, ">")) != steps),
        "start_not_named": is_("base") & ~named,
        "answer_changed": F.col("condition").isin(*PRESERVING, REDUNDANT, ALTERNATIVE) & ~same,
        "base_proof_lost": F.col("condition").isin(*PRESERVING) & (F.size(F.array_except("_p", "proofs")) > 0),
        "name_lost": is_(NECESSARY) & ~named,
        "name_left": is_(ABSENT) & (F.size(seen_names) > 0),
        "proof_left": F.col("condition").isin(NECESSARY, ABSENT) & proved,
        "support_not_reduced": is_(REDUNDANT) & ~F.coalesce(fewer, F.lit(False)),
        "no_proof_removed": is_(ALTERNATIVE) & (F.size(F.array_except("_p", "proofs")) == 0),
    }
    out = j.select(*SPOT, F.explode(F.array_compact(F.array(*(F.when(F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items())))).alias("check"))
    reasons = F.filter(F.coalesce("not_applicable", F.array().cast("array<struct<condition string, reason string>>")), lambda r: F.coalesce(r["reason"], F.lit("")) != "")
    has, says = (lambda c: F.exists("deletions", lambda d: d["condition"] == c)), (lambda c: F.exists(reasons, lambda r: r["condition"] == c))
    at = lambda c, check, when: F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(c).alias("condition"), F.lit(check).alias("check")))
    both = [at(c, "applicable_and_not", has(c) & says(c)) for c in OPTIONAL] + [at(c, "no_reason", ~has(c) & ~says(c)) for c in OPTIONAL]
    both += [at("main_distractor", "additions_overlap", F.arrays_overlap("distractor_ids", "irrelevant_ids"))]
    both += [at(c, "addition_in_base", F.arrays_overlap(ids, "base_unit_ids")) for c, ids in (("main_distractor", "distractor_ids"), ("irrelevant_addition", "irrelevant_ids"))]
    packet = packets.select("family_id", F.explode(F.array_compact(F.array(*both))).alias("_v")).select("family_id", "_v.condition", "_v.check")
    return out.unionByName(packet)
