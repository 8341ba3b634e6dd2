"""Accounting of reviewed experiments: job grids, outcome counters, rates, paired arms, repeat stability, round comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hopmill.operators.ranks import positions
from hopmill.sources.shared import written

PENDING = ("disputed", "unresolved", "pending")


def job_grid(cases: DataFrame, arms: list[str], repeats: Column) -> DataFrame:
    """cases x arms x repeats 1..n, n by row; cases with n below 1 have no jobs."""
    n = F.when(repeats >= 1, F.sequence(F.lit(1), repeats)).otherwise(F.array().cast("array<int>"))
    return cases.withColumn("arm", F.explode(F.array(*map(F.lit, arms)))).withColumn("repeat", F.explode(n))


def seeded_order(jobs: DataFrame, seed: str, keys: list[str]) -> DataFrame:
    """jobs with position (from 0) in the order of a seeded digest of their keys; no task sorts more than a range of them."""
    d = F.sha2(F.concat_ws("|", F.lit(seed), *(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys)), 256)
    return positions(jobs.withColumn("_d", d), [F.col("_d"), *map(F.col, keys)]).drop("_d")


def pending_jobs(jobs: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """Scheduled jobs without a result."""
    return jobs.join(results.select(*keys), keys, "left_anti")


def with_results(jobs: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """Every job with its result; a job without one is not_run."""
    return jobs.join(results, keys, "left").withColumn("status", F.coalesce("status", F.lit("not_run")))


def outcome_counters(rows: DataFrame, keys: list[str], expected: str = "expected", decision: str = "decision", status: str = "status") -> DataFrame:
    """Counters by group of rows with an expected truth, a decision (booleans, null unknown) and a status.

    Not completed jobs stay in scheduled and in the trial counts. Rates follow with rates().
    """
    e, d, done = F.col(expected), F.col(decision), F.col(status) == "completed"
    decided = done & e.isNotNull() & d.isNotNull()
    return rows.groupBy(*keys).agg(
        F.count("*").alias("scheduled"),
        F.count_if(done).alias("completed"),
        F.count_if(F.col(status) == "technical_failure").alias("technical_failure"),
        F.count_if(F.col(status) == "protocol_failure").alias("protocol_failure"),
        F.count_if(F.col(status) == "not_run").alias("not_run"),
        F.count_if(e).alias("valid_trials"),
        F.count_if(~e).alias("invalid_trials"),
        F.count_if(e.isNull()).alias("unadjudicated_trials"),
        F.count_if(decided).alias("decided"),
        F.count_if(decided & e).alias("valid_decided"),
        F.count_if(decided & ~e).alias("invalid_decided"),
        F.count_if(decided & (e == d)).alias("correct_disposition"),
        F.count_if(decided & e & ~d).alias("false_block"),
        F.count_if(decided & ~e & d).alias("unsafe_accept"),
        F.count_if(done & e.isNotNull() & d.isNull()).alias("needs_adjudication"),
        F.count_if(done & e.isNull()).alias("unadjudicated"),
    )


def rates(counters: DataFrame) -> DataFrame:
    """counters with rates, null where the denominator is zero; failures stay in the coverage's denominator."""
    of = lambda a, b: F.try_divide(F.col(a), F.col(b) if isinstance(b, str) else b)
    return counters.withColumns({
        "unsafe_accept_per_invalid": of("unsafe_accept", "invalid_trials"),
        "false_block_per_valid": of("false_block", "valid_trials"),
        "unsafe_accept_among_decided": of("unsafe_accept", "invalid_decided"),
        "false_block_among_decided": of("false_block", "valid_decided"),
        "decision_coverage": of("decided", F.col("scheduled") - F.col("unadjudicated_trials")),
    })


def review_counters(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The review variant: columns ref_status, expected_valid, major_defect (null: not valid), defect_category, status, verdict, issue_codes.

    The outcomes of decided trials exclude each other, in the order false_block, unsafe_accept,
    incorrect_minor_disposition, correct_disposition.
    """
    open_ = F.coalesce(F.col("ref_status").isin(*PENDING), F.lit(False))
    valid = F.coalesce(F.col("expected_valid"), F.lit(False))
    major = F.coalesce(F.col("major_defect"), ~valid)
    decided = ~open_ & (F.col("status") == "completed")
    passed = F.coalesce(F.col("verdict") == "pass", F.lit(False))
    outcome = F.when(valid & ~passed, "false_block").when(major & passed, "unsafe_accept").when(~valid & passed, "incorrect_minor_disposition").otherwise("correct_disposition")
    is_ = lambda name: F.count_if(decided & (outcome == name)).alias(name)
    local = decided & ~valid & F.col("defect_category").isNotNull()
    return rows.groupBy(*keys).agg(
        F.count("*").alias("scheduled"),
        F.count_if(open_).alias("unadjudicated"),
        F.count_if(~open_ & valid).alias("valid_trials"),
        F.count_if(~open_ & ~valid).alias("defective_trials"),
        F.count_if(~open_ & major).alias("major_defect_trials"),
        F.count_if(decided).alias("decided"),
        *map(is_, ("false_block", "unsafe_accept", "incorrect_minor_disposition", "correct_disposition")),
        F.count_if(local).alias("defect_localization_trials"),
        F.count_if(local & F.exists(F.coalesce("issue_codes", F.array().cast("array<string>")), lambda c: c == F.col("defect_category"))).alias("defect_code_match"),
    )


def program_decision(kind: Column, raw: Column, disposition: Column, structural: Column) -> Column:
    """A structural defect overrides the model: false for reviews sent to revision and structurally incorrect answers."""
    review = F.when(disposition == "pass", True).when(disposition.isin("revise", "needs_revision_structural"), False)
    scoring = F.when(structural.eqNullSafe("incorrect"), False).otherwise(raw)
    return F.when(kind == "review", review).when(kind == "scoring", scoring)


def program_conflicts(rows: DataFrame) -> DataFrame:
    """Rows where the model accepts and the structure does not, with the kind of conflict."""
    kind = F.when((F.col("kind") == "review") & F.col("raw") & (F.col("disposition") == "needs_revision_structural"), "overridden_pass").when((F.col("kind") == "scoring") & F.col("raw") & (F.col("structural") == "incorrect"), "supported_but_incorrect")
    return rows.withColumn("conflict", kind).where("conflict is not null")


def dimension_agreement(rows: DataFrame, keys: list[str], dimensions: dict[str, tuple[str, str]]) -> DataFrame:
    """Agreement by dimension: dimensions maps a name to its (reference, model) boolean columns; nulls are counted apart."""
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("dimension"), F.col(r).alias("ref"), F.col(m).alias("model")) for n, (r, m) in dimensions.items()))).alias("_d")
    long = rows.select(*keys, each).select(*keys, "_d.*")
    known = F.col("ref").isNotNull()
    out = long.groupBy(*keys, "dimension").agg(F.count_if(~known).alias("reference_unadjudicated"), F.count_if(known).alias("completed_reference_trials"), F.count_if(known & F.col("model").isNull()).alias("model_undetermined"), F.count_if(known & F.col("model").isNotNull()).alias("model_decided"), F.count_if(F.col("ref") == F.col("model")).alias("agreement"))
    return out.withColumns({"error": F.col("model_decided") - F.col("agreement"), "agreement_among_decided": F.try_divide("agreement", "model_decided")})


def paired_arms(rows: DataFrame, keys: list[str], groups: list[str], before: str, after: str) -> DataFrame:
    """Corrections and introduced errors between two arms, by group: pairs are made by aggregation on keys, not by a self join.

    rows has arm, status, decision, expected. Exclusions take the first reason that applies: no reference, an arm that
    did not complete, an undecided arm.
    """
    of = lambda arm, c: F.max(F.when(F.col("arm") == arm, F.col(c)))
    ok = lambda arm: F.coalesce(F.max(F.when(F.col("arm") == arm, F.col("status") == "completed")), F.lit(False))
    pairs = rows.where(F.col("arm").isin(before, after)).groupBy(*groups, *keys).agg(F.max("expected").alias("e"), ok(before).alias("ok_b"), ok(after).alias("ok_a"), of(before, "decision").alias("b"), of(after, "decision").alias("a"))
    reason = F.when(F.col("e").isNull(), "unadjudicated").when(~(F.col("ok_b") & F.col("ok_a")), "not_completed").when(F.col("b").isNull() | F.col("a").isNull(), "undecided")
    pairs = pairs.withColumn("reason", reason)
    used, was, now = F.col("reason").isNull(), F.col("b") == F.col("e"), F.col("a") == F.col("e")
    return pairs.groupBy(*groups).agg(
        F.count("*").alias("scheduled_pairs"),
        *(F.count_if(F.col("reason") == r).alias(f"excluded_{r}") for r in ("unadjudicated", "not_completed", "undecided")),
        F.count_if(used).alias("paired_decisive"),
        F.count_if(used & ~was & now).alias("corrections"),
        F.count_if(used & was & ~now).alias("introduced_errors"),
    )


def repeat_stability(rows: DataFrame, keys: list[str], decisive: list[str], repeats: int = 3) -> DataFrame:
    """By case and arm: the sorted verdicts, and whether all repeats (exactly `repeats`) completed, decided and agree."""
    done = F.col("status") == "completed"
    out = rows.groupBy(*keys).agg(F.count("*").alias("runs"), F.count_if(done).alias("completed"), F.count_if(done & F.col("verdict").isin(*decisive)).alias("_decisive"), F.array_join(F.array_sort(F.collect_list(F.when(done, F.coalesce("verdict", F.lit("none"))).otherwise(F.col("status")))), ",").alias("verdicts"), F.count_distinct(F.when(done, F.coalesce("verdict", F.lit("none")))).alias("_kinds"))
    valid = (F.col("runs") == repeats) & (F.col("completed") == repeats)
    return out.select(*keys, "runs", "verdicts", valid.alias("all_valid"), (valid & (F.col("_decisive") == repeats)).alias("all_decisive"), (valid & (F.col("_kinds") == 1)).alias("all_same"))


def family_means(counters: DataFrame, keys: list[str], numerator: str, denominator: str) -> DataFrame:
    """Mean over families of a rate, each family with the same weight; families with a zero denominator are left out and counted."""
    rate = F.try_divide(numerator, denominator)
    return counters.groupBy(*keys).agg(F.count("*").alias("families"), F.count(rate).alias("families_with_rate"), F.avg(rate).alias("family_mean"))


def blind_table(rows: DataFrame, keys: list[str], checks: list[str]) -> DataFrame:
    """By condition: scheduled, completed, passes of each check, their rates among completed, and coverage."""
    done = F.col("status") == "completed"
    out = rows.groupBy(*keys).agg(F.count("*").alias("scheduled"), F.count_if(done).alias("completed"), *(F.count_if(done & F.col(c)).alias(c) for c in checks))
    return out.withColumns({**{f"{c}_rate": F.try_divide(c, "completed") for c in checks}, "coverage": F.try_divide("completed", "scheduled")})


def hint_relevance(hints: DataFrame, proofs: DataFrame, facts: DataFrame | None = None, case: str = "case_id", fact: str = "fact_id") -> DataFrame:
    """hints with relevance: base_proof if the fact is in the case's proof, noise_fact if it is another of the case's facts, else unassigned.

    facts (case, fact): the facts that the case's family knows; without them every fact counts as known.
    """
    p = proofs.select(case, fact).distinct().withColumn("_in", F.lit(True))
    rows = hints.join(p, [case, fact], "left")
    if facts is not None:
        rows = rows.join(facts.select(case, fact).distinct().withColumn("_known", F.lit(True)), [case, fact], "left")
    known = F.col("_known") if facts is not None else F.col(fact).isNotNull()
    return rows.select(*hints.columns, F.when(F.col("_in"), "base_proof").when(known, "noise_fact").otherwise("unassigned").alias("relevance"))


def hint_coverage(hints: DataFrame, proofs: DataFrame, facts: DataFrame | None = None, case: str = "case_id", fact: str = "fact_id") -> DataFrame:
    """Hint rows by library, kind and relevance, and the cases that have them."""
    return hint_relevance(hints, proofs, facts, case, fact).groupBy("library", "kind", "relevance").agg(F.count("*").alias("hints"), F.count_distinct(case).alias("cases"))


def _usable(hints: DataFrame) -> Column:
    """Warnings never count as hints, nor do rows with excluded set."""
    return F.coalesce((F.col("kind") != "warning") & (~F.coalesce(F.col("excluded"), F.lit(False)) if "excluded" in hints.columns else F.lit(True)), F.lit(False))


def hint_stratum(hints: DataFrame, case: str = "case_id", by: tuple[str, ...] = (), cases: DataFrame | None = None) -> DataFrame:
    """(case, by, hints, stratum) from hints with kind and relevance, and excluded if there is.

    base_proof_related if any usable hint is; noise_only if all usable ones are known facts off the proof;
    nonproof_or_unassigned_only if there are others; empty_fact_hints if there is none. cases (case, by) without any row are empty, too.
    """
    use, of = _usable(hints), lambda r: F.count_if(_usable(hints) & (F.col("relevance") == r))
    g = hints.groupBy(case, *by).agg(F.count_if(use).alias("hints"), of("base_proof").alias("_proof"), of("noise_fact").alias("_noise"))
    if cases is not None:
        g = cases.select(case, *by).distinct().join(g, [case, *by], "left").fillna(0, ["hints", "_proof", "_noise"])
    stratum = F.when(F.col("_proof") > 0, "base_proof_related").when(F.col("hints") == 0, "empty_fact_hints").when(F.col("_noise") == F.col("hints"), "noise_only").otherwise("nonproof_or_unassigned_only")
    return g.select(case, *by, "hints", stratum.alias("stratum"))


def hint_totals(hints: DataFrame, case: str = "case_id", family: str = "family_id") -> DataFrame:
    """By library: usable, proof and other hints, excluded rows, warnings, and cases and families that have any, proof or conflict hints."""
    use, kind = _usable(hints), F.col("kind")
    proof, conflict = use & (F.col("relevance") == "base_proof"), use & (kind == "conflict_hints")
    excluded = F.coalesce(F.col("excluded"), F.lit(False)) & (kind != "warning") if "excluded" in hints.columns else F.lit(False)
    some = lambda key, when: F.count_distinct(F.when(when, F.col(key)))
    counts = {"usable": F.count_if(use), "base_proof": F.count_if(proof), "nonproof": F.count_if(use & ~(F.col("relevance") == "base_proof")), "excluded": F.count_if(excluded), "warnings": F.count_if(kind == "warning"), "conflicts": F.count_if(conflict)}
    sets = {f"{name}_with_{what}": some(key, when) for name, key in (("cases", case), ("families", family)) for what, when in (("any", use), ("proof", proof), ("conflict", conflict))}
    return hints.groupBy("library").agg(*(c.alias(n) for n, c in (counts | sets).items()))


def round_comparison(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Cases of either round with why they are compared or not: eligible, reference_changed, unadjudicated, old_only, new_only; and whether payloads are equal."""
    o = old.select(*keys, F.col("expected").alias("_oe"), F.col("payload_sha256").alias("_op"), F.lit(True).alias("_o"))
    n = new.select(*keys, F.col("expected").alias("_ne"), F.col("payload_sha256").alias("_np"), F.lit(True).alias("_n"))
    reason = F.when(F.col("_n").isNull(), "old_only").when(F.col("_o").isNull(), "new_only").when(F.col("_oe").isNull() | F.col("_ne").isNull(), "unadjudicated").when(F.col("_oe") != F.col("_ne"), "reference_changed").otherwise("eligible")
    return o.join(n, keys, "full").select(*keys, reason.alias("comparison"), F.col("_op").eqNullSafe(F.col("_np")).alias("same_payload"))


def labelled_counts(rows: DataFrame, keys: list[str], labels: str = "labels") -> DataFrame:
    """Counts by label and keys; a row with several labels counts under each."""
    return rows.select(*keys, F.explode(F.array_distinct(labels)).alias("label"), "expected", "decision").groupBy("label", *keys).agg(F.count("*").alias("rows"), F.count_if(F.col("expected") == F.col("decision")).alias("agreement"))


def accept_reject(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Accepts and rejects against undisputed references; undetermined where nothing was decided."""
    r = rows.where(~F.coalesce(F.col("disputed"), F.lit(False)) & F.col("expected").isNotNull())
    e, d = F.col("expected"), F.col("decision")
    return r.groupBy(*keys).agg(F.count_if(e).alias("planned_valid"), F.count_if(~e).alias("planned_invalid"), F.count_if(e & d).alias("correct_accept"), F.count_if(~e & ~d).alias("correct_reject"), F.count_if(e & ~d).alias("false_block"), F.count_if(~e & d).alias("false_accept"), F.count_if(d.isNull()).alias("undetermined"))


def merge_support(rows: DataFrame, keys: list[str], failure_first: bool = False) -> DataFrame:
    """Three-valued verdict of each answer from its steps' hard_defect, first and second (supported, unsupported or else unknown).

    Order of precedence: hard defect, then unknown, then a definite failure; with failure_first any failure comes before unknown.
    """
    unknown = ~F.coalesce(F.col("first").isin("supported", "unsupported"), F.lit(False)) | ~F.coalesce(F.col("second").isin("supported", "unsupported"), F.lit(False))
    fail = (F.col("first") == "unsupported") | (F.col("second") == "unsupported")
    order = [("fail", F.coalesce(fail, F.lit(False))), ("unknown", unknown)] if failure_first else [("unknown", unknown), ("fail", F.coalesce(fail, F.lit(False)))]
    rank = F.when(F.coalesce(F.col("hard_defect"), F.lit(False)), 0).when(order[0][1], 1).when(order[1][1], 2).otherwise(3)
    names = F.array(F.lit("incorrect"), *(F.lit("needs_review" if n == "unknown" else "incorrect") for n, _ in order), F.lit("supported"))
    return rows.groupBy(*keys).agg(F.min(rank).alias("_r"), F.count("*").alias("steps")).select(*keys, "steps", F.element_at(names, F.col("_r") + 1).alias("verdict"))


def anchor_windows(facts: DataFrame, units: DataFrame, owner: str = "owner_id", most: int = 8) -> DataFrame:
    """Units of each fact's owner, in order, in windows of at most `most`."""
    place = F.row_number().over(Window.partitionBy(owner).orderBy("pos", "unit_id")) - 1
    chunked = units.select(owner, "unit_id", F.floor(place / most).cast("int").alias("window"), (place % most).cast("int").alias("slot"))
    return facts.join(chunked, owner)


def anchor_status(occurrences: DataFrame, keys: list[str]) -> DataFrame:
    """support_proposed if any verdict is supported, else unresolved if any is unknown, else not_found."""
    any_ = lambda v: F.coalesce(F.bool_or(F.col("verdict") == v), F.lit(False))
    return occurrences.groupBy(*keys).agg(F.when(any_("supported"), "support_proposed").when(any_("unknown"), "unresolved").otherwise("not_found").alias("status"), F.count("*").alias("anchors"))


def shared_footprints(groups: DataFrame, keys: list[str], units: str = "group_unit_ids") -> DataFrame:
    """Each anchor's group as a sorted set of units, its index among the distinct ones of its fact, and whether it is shared."""
    foot = F.array_join(F.array_sort(F.array_distinct(units)), ",")
    w = Window.partitionBy(*keys)
    return groups.withColumn("footprint", foot).withColumns({"group_index": F.dense_rank().over(w.orderBy("footprint")) - 1, "duplicate": F.count("*").over(Window.partitionBy(*keys, "footprint")) > 1})


def group_outcome(reviews: DataFrame, keys: list[str], parts: list[str]) -> DataFrame:
    """rejected if any part is rejected, else needs_adjudication if any is not accepted, else passed; none where nothing was reviewed."""
    bad = [F.coalesce(F.bool_or(F.col(p) == "rejected"), F.lit(False)) for p in parts]
    open_ = [F.coalesce(F.bool_or(~F.coalesce(F.col(p) == "accepted", F.lit(False))), F.lit(False)) for p in parts]
    seen = F.max(F.greatest(*(F.col(p).isNotNull().cast("int") for p in parts), F.lit(0)))
    return reviews.groupBy(*keys).agg(F.when(seen == 0, "none").when(F.greatest(*bad) if len(bad) > 1 else bad[0], "rejected").when(F.greatest(*open_) if len(open_) > 1 else open_[0], "needs_adjudication").otherwise("passed").alias("outcome"))


def cell_coverage(expected: DataFrame, cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, check): expected cells that are missing, seen more than once, or not expected at all."""
    seen = cells.groupBy(*keys).agg(F.count("*").alias("_n"))
    both = expected.select(*keys, F.lit(True).alias("_e")).join(seen, keys, "full")
    check = F.when(F.col("_n").isNull(), "missing").when(F.col("_e").isNull(), "unexpected").when(F.col("_n") > 1, "repeated")
    return both.withColumn("check", check).where("check is not null").select(*keys, "check")


def coverage_findings(facts: DataFrame, cells: DataFrame, groups: DataFrame, key: str = "fact_id") -> DataFrame:
    """(fact, unit_id, check) of the cells of facts by units against the support groups that were submitted.

    facts: key, status; cells: key, unit_id, status; groups: key, group_id, anchor_unit_id, unit_ids. Checks: label (an
    anchor is support_anchor, another member of a group support_context, any other unit not_supporting or unresolved);
    unresolved (every such cell, as the list of open ones); concealed (a fact that is not_found with unresolved cells; no
    unit); anchor_outside (an anchor that its own group lacks); repeated_anchor (an anchor of two groups of a fact).
    Repeated cells are judged each; a null status of a cell is a wrong label. Keys and units are not null.
    """
    anchors = groups.select(key, F.col("anchor_unit_id").alias("unit_id"), F.lit("support_anchor").alias("_want"))
    members = groups.select(key, F.explode("unit_ids").alias("unit_id"), F.lit("support_context").alias("_want"))
    wanted = anchors.unionByName(members).groupBy(key, "unit_id").agg(F.min("_want").alias("_want"))
    status = F.col("status")
    fits = F.when(F.col("_want").isNull(), status.isin("not_supporting", "unresolved")).otherwise(status == F.col("_want"))
    named = F.array_compact(F.array(F.when(~F.coalesce(fits, F.lit(False)), "label"), F.when(status == "unresolved", "unresolved")))
    judged = cells.join(wanted, [key, "unit_id"], "left").select(key, "unit_id", F.explode(named).alias("check"))
    open_ = cells.where(status == "unresolved").select(key)
    none = F.lit(None).cast(cells.schema["unit_id"].dataType).alias("unit_id")
    hidden = facts.where(status == "not_found").join(open_, key, "left_semi").select(key, none, F.lit("concealed").alias("check"))
    outside = groups.where(~F.array_contains("unit_ids", F.col("anchor_unit_id"))).select(key, F.col("anchor_unit_id").alias("unit_id"), F.lit("anchor_outside").alias("check"))
    twice = anchors.groupBy(key, "unit_id").count().where("count > 1").select(key, "unit_id", F.lit("repeated_anchor").alias("check"))
    return judged.unionByName(hidden).unionByName(outside).unionByName(twice)


def nested_groups(groups: DataFrame, keys: list[str], units: str = "group_unit_ids") -> DataFrame:
    """(keys, units, groups, outers, outer): sets of units that lie strictly inside other sets of the same keys.

    groups counts the groups with just that set, outers the distinct larger sets that hold it, outer is the least of
    these. A set meets only the sets that hold its rarest unit, and is held against them by size and difference; groups
    with equal sets are one. Empty and null sets are left out (support checks name them); null units count for nothing.
    """
    distinct = F.array_sort(F.array_distinct(F.array_compact(units)))
    sets = written(groups.select(*keys, distinct.alias("units")).where(F.size("units") > 0).groupBy(*keys, "units").agg(F.count("*").alias("groups")), "sets")
    held = sets.select(*keys, "units", "groups", F.explode("units").alias("_unit"))
    often = held.groupBy(*keys, "_unit").agg(F.count("*").alias("_often"))
    rarest = held.join(often, [*keys, "_unit"]).groupBy(*keys, "units", "groups").agg(F.min_by("_unit", F.struct("_often", "_unit")).alias("_unit"))
    met = rarest.join(held.select(*keys, F.col("units").alias("_outer"), "_unit"), [*keys, "_unit"])
    met = met.where((F.size("_outer") > F.size("units")) & (F.size(F.array_except("units", "_outer")) == 0))
    return met.groupBy(*keys, "units", "groups").agg(F.count("*").alias("outers"), F.min("_outer").alias("outer"))


def review_routing(drafts: DataFrame, receipts: DataFrame, facets: list[str]) -> DataFrame:
    """drafts with route: determinate under a declared closed world with an empty source, or by a trusted receipt that
    matches source and draft and covers all facets; else requires_review with the first reason that applies."""
    r = receipts.select("job_id", F.col("source_sha256").alias("_s"), F.col("draft_sha256").alias("_d"), F.col("facets").alias("_f"), F.col("trusted").alias("_t"))
    want = F.array(*map(F.lit, facets))
    same = F.coalesce((F.col("_s") == F.col("source_sha256")) & (F.col("_d") == F.col("draft_sha256")), F.lit(False))
    full = F.coalesce(F.size(F.array_except(want, F.col("_f"))) == 0, F.lit(False))
    level = F.when(F.col("_s").isNull() & F.col("_d").isNull() & F.col("_t").isNull(), 0).when(~same, 1).when(~F.coalesce(F.col("_t"), F.lit(False)), 2).when(~full, 3).otherwise(4)
    best = drafts.join(r, "job_id", "left").withColumn("_l", level).groupBy(*drafts.columns).agg(F.max("_l").alias("_l"))
    closed = F.col("source_empty") & F.col("closed_world")
    reason = F.when(F.coalesce(closed, F.lit(False)), "closed_world_empty").otherwise(F.element_at(F.array(*map(F.lit, ("no_receipt", "stale_receipt", "untrusted_receipt", "facets_missing", "trusted_receipt"))), F.col("_l") + 1))
    return best.withColumn("reason", reason).withColumn("route", F.when(F.col("reason").isin("closed_world_empty", "trusted_receipt"), "determinate").otherwise("requires_review")).drop("_l")
