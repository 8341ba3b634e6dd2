"""Gates over delivered reviews: receipts held against requests and a registry, trials that did not complete, what two rounds share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopmill.operators.accounting import PENDING, outcome_counters

# Kinds of reviewers that may confirm a review, and the outcomes of its routing.
REVIEWERS = ("independent_strong_agent", "human")
DETERMINED, CONFIRMED, OPEN = "automatically_determined_core", "independently_reviewed_core", "requires_review"
DIGEST = "[0-9a-f]{64}"
NOT_COMPLETED = "original_delivery_not_completed"
INVENTORY = "full_source_coverage_and_group_semantics_require_independent_review"
SEMANTICS = "natural_language_semantics_require_independent_review"


def unfinished_trials(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, status, trials, valid_trials, major_defect_trials): adjudicated trials that did not complete, by their status.

    rows as in review_counters; a null status is not_run. With its `decided` these trials make up all adjudicated ones.
    """
    status = F.coalesce("status", F.lit("not_run"))
    valid = F.coalesce("expected_valid", F.lit(False))
    rows = rows.where(~F.coalesce(F.col("ref_status").isin(*PENDING), F.lit(False)) & (status != "completed"))
    return rows.groupBy(*keys, status.alias("status")).agg(F.count("*").alias("trials"), F.count_if(valid).alias("valid_trials"), F.count_if(F.coalesce("major_defect", ~valid)).alias("major_defect_trials"))


def round_subsets(compared: DataFrame, old: DataFrame, new: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """outcome_counters of both rounds (round: previous, current) over the cases that round_comparison finds eligible, with the distinct cases.

    compared: keys, comparison; old and new: keys, by, status, decision, expected, a row for each job. Cases that only one
    round has, or whose reference changed, count in neither. Keys are not null; null values of `by` are a group.
    """
    kept = compared.where("comparison = 'eligible'").select(*keys)
    columns = list(dict.fromkeys([*keys, *by, "status", "decision", "expected"]))
    both = old.select(*columns, F.lit("previous").alias("round")).unionByName(new.select(*columns, F.lit("current").alias("round"))).join(kept, keys, "left_semi")
    groups = ["round", *by]
    cases = both.groupBy(*(F.col(g).alias(f"_{g}") for g in groups)).agg(F.count_distinct(*keys).alias("shared_cases"))
    counts = outcome_counters(both, groups)
    same = [counts[g].eqNullSafe(cases[f"_{g}"]) for g in groups]
    return counts.join(cases, same).drop(*(f"_{g}" for g in groups))


def contract_flags(compared: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """(kind, cases, same_payloads, same_schema, same_prompt) of the eligible cases of each kind.

    compared: kind, comparison, same_payload; old and new: kind, schema_sha256, prompt_sha256, one row a kind. Values that
    neither round has are the same.
    """
    of = lambda df, n: df.select("kind", F.col("schema_sha256").alias(f"_s{n}"), F.col("prompt_sha256").alias(f"_p{n}"))
    cases = compared.where("comparison = 'eligible'").groupBy("kind").agg(F.count("*").alias("cases"), F.bool_and("same_payload").alias("same_payloads"))
    both = cases.join(of(old, 0), "kind", "left").join(of(new, 1), "kind", "left")
    return both.select("kind", "cases", "same_payloads", F.col("_s0").eqNullSafe(F.col("_s1")).alias("same_schema"), F.col("_p0").eqNullSafe(F.col("_p1")).alias("same_prompt"))


def _packed(digest: Column) -> Column:
    """A text as bytes, half as many where it is a digest in lower-case hex; different texts stay different (others have more than 32 bytes)."""
    return F.when(digest.rlike(f"\\A{DIGEST}\\z"), F.unhex(digest)).otherwise(F.concat(digest, F.lit("-" * 33)).cast("binary"))


def _checks(version: str, scope: str) -> dict[str, Column]:
    """What a receipt (r) and the request (q) must hold, in the order in which they are judged; _registered is the registry's share."""
    equal = lambda a, b: F.col(a) == F.col(b)
    return {
        "registered": F.lit(True),
        "artifact": F.col("r.artifact_sha256").rlike(f"^{DIGEST}$"),
        "authority": F.lit(True),
        "scope": (F.col("r.version") == version) & (F.col("r.scope") == scope),
        "request": equal("r.request_sha256", "q.request_sha256"),
        "source": equal("r.source_sha256", "q.source_sha256"),
        "draft": equal("r.draft_sha256", "q.draft_sha256"),
        "decision": F.col("r.decision") == "confirmed",
        "unresolved": F.size("r.unresolved") == 0,
        "independence": F.col("r.reviewer_kind").isin(*REVIEWERS) & (F.trim("r.reviewer") != "") & ~F.col("r.reviewer").eqNullSafe(F.col("q.author")),
        "coverage": equal("r.coverage", "q.coverage"),
        "facets": equal("r.facets", "q.facets"),
        "core": equal("r.core", "q.core"),
    }


def _registered() -> dict[str, Column]:
    """What a receipt (j) and its entry in the registry (g) must hold."""
    return {
        "registered": F.col("g._there"),
        "authority": (F.col("g._artifact") == F.col("j._artifact")) & F.col("g.reviewer").eqNullSafe(F.col("j._reviewer")),
        "independence": F.col("g.verified"),
    }


def _first_unmet(checks: dict[str, Column], names: list[str]) -> Column:
    """The place among names of the first check that is not met; their number if all are."""
    level = F
    for n, met in checks.items():
        level = level.when(~F.coalesce(met, F.lit(False)), names.index(n))
    return level.otherwise(len(names))


def gated_reviews(requests: DataFrame, receipts: DataFrame, registry: DataFrame, version: str, scope: str) -> DataFrame:
    """(job_id, kind, before, after, reason, usable): each request's status before and after independent review.

    requests: job_id, kind, status, closed_world, source_empty, author, request_sha256, source_sha256, draft_sha256,
    coverage and facets (arrays, compared in order), core. receipts: job_id, receipt_sha256, artifact_sha256, version,
    scope, the three digests, decision, unresolved (array), reviewer_kind, reviewer, coverage, facets, core. registry:
    receipt_sha256, artifact_sha256, reviewer, verified; it is the caller's, and no receipt counts that it lacks.

    A completed scoring of an empty source under a closed world is determined without a receipt. Else a receipt that meets
    all of _checks confirms the core; of several the one that gets furthest counts. reason is null then; for the others
    it is receipt_<first check not met>, or, without a receipt, what keeps the request open. One row for each row of
    requests, whose job_id is not null. Nulls meet no check, except that a null author is nobody.
    """
    facts = F.struct("kind", "status", "closed_world", "source_empty").alias("_f")
    q = requests.withColumn("_f", facts).alias("q")
    checks = _checks(version, scope)
    names = list(checks)
    # judged against the request first, so that of a receipt only its digests and a number go on to the registry
    mine = [_packed(F.col(f"r.{c}_sha256")).alias(f"_{c}") for c in ("receipt", "artifact")]
    judged = q.join(receipts.alias("r"), F.col("q.job_id") == F.col("r.job_id"), "left").select(F.col("q.job_id").alias("job_id"), F.col("q._f").alias("_f"), F.when(F.col("r.job_id").isNotNull(), _first_unmet(checks, names)).alias("_own"), *mine, F.col("r.reviewer").alias("_reviewer"))
    entries = registry.select(_packed(F.col("receipt_sha256")).alias("_receipt"), _packed(F.col("artifact_sha256")).alias("_artifact"), "reviewer", "verified", F.lit(True).alias("_there"))
    joined = judged.alias("j").join(entries.alias("g"), F.col("j._receipt") == F.col("g._receipt"), "left")
    level = F.when(F.col("_own").isNotNull(), F.least("_own", _first_unmet(_registered(), names)))
    best = joined.select("job_id", "_f", level.alias("_l")).groupBy("job_id", "_f").agg(F.max("_l").alias("_l"))
    done = F.col("_f.status") == "completed"
    empty = F.coalesce((F.col("_f.kind") == "scoring") & F.col("_f.closed_world") & F.col("_f.source_empty") & done, F.lit(False))
    confirmed = F.coalesce(F.col("_l") == len(checks), F.lit(False))
    failed = F.element_at(F.array(*(F.lit(f"receipt_{n}") for n in checks)), F.col("_l") + 1)
    reason = F.when(empty | confirmed, None).when(F.col("_l").isNotNull(), failed).when(~F.coalesce(done, F.lit(False)), NOT_COMPLETED).when(F.col("_f.kind") == "inventory", INVENTORY).otherwise(SEMANTICS)
    after = F.when(empty, DETERMINED).when(confirmed, CONFIRMED).otherwise(OPEN)
    return best.select("job_id", F.col("_f.kind").alias("kind"), F.col("_f.status").alias("before"), after.alias("after"), reason.alias("reason"), (empty | confirmed).alias("usable"))
