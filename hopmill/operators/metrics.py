"""Run metrics: pass@k and pass^k of tri-state verdicts, question and family means, verdict rules, cohorts, transitions.

Every function takes and returns DataFrames (or Columns); verdicts are pass, fail or needs_review, null counts as
needs_review. Denominators never shrink: what is unknown stays in them.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

DIMENSIONS = ("answer", "logical_proof", "output_contract")
#: name: (k, whether all k must pass)
METRICS = {"pass@1": (1, False), "pass@5": (5, False), "pass^5": (5, True)}
PARTITIONS = ("primary", "node", "control")


def falling(n: Column, k: int) -> Column:
    """n (n - 1) ... (n - k + 1) as a decimal; 0 where n < k (n >= 0). For k = 5 it fits up to n of 39 million."""
    each = [(n - i).cast("decimal(12,0)") for i in range(k)]
    return F.when(n >= k, reduce(lambda a, b: a * b, each).cast("decimal(38,0)")).otherwise(F.lit(0).cast("decimal(38,0)"))


def gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor of whole decimals, not negative: Euclid's steps, of which 38 digits need 183 at most."""
    start = F.struct(F.greatest(a, b).cast("decimal(38,0)").alias("x"), F.least(a, b).cast("decimal(38,0)").alias("y"))
    step = lambda s, _: F.when(s["y"] == 0, s).otherwise(F.struct(s["y"].alias("x"), F.try_mod(s["x"], s["y"]).cast("decimal(38,0)").alias("y")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(183)), start, step, lambda s: s["x"])


def estimate(n: Column, c: Column, k: int, every: bool) -> Column:
    """struct(numerator, denominator, value): pass@k, or pass^k if every; null where n < k. The fraction is not reduced."""
    whole = falling(n, k)
    hit = falling(c, k) if every else whole - falling(n - c, k)
    return F.when(n >= k, F.struct(hit.alias("numerator"), whole.alias("denominator"), F.try_divide(hit.cast("double"), whole.cast("double")).alias("value")))


def lowest_terms(fraction: Column) -> Column:
    """struct(numerator, denominator) without common factors."""
    by = gcd(fraction["numerator"], fraction["denominator"])
    return F.when(fraction.isNotNull(), F.struct((fraction["numerator"] / by).cast("decimal(38,0)").alias("numerator"), (fraction["denominator"] / by).cast("decimal(38,0)").alias("denominator")))


def verdict_counts(trials: DataFrame, keys: list[str], verdict: str = "verdict") -> DataFrame:
    """n, passed, failed, unknown for each key."""
    passed, failed = F.count_if(F.col(verdict) == "pass"), F.count_if(F.col(verdict) == "fail")
    return trials.groupBy(*keys).agg(F.count("*").alias("n"), passed.alias("passed"), failed.alias("failed")).withColumn("unknown", F.col("n") - F.col("passed") - F.col("failed"))


def question_metrics(counts: DataFrame) -> DataFrame:
    """counts (n, passed, failed, unknown) with a row for each metric: lower, upper, point (structs) and status.

    The point is null while any verdict is unknown, even if the bounds coincide.
    """
    name = F.explode(F.array(*map(F.lit, METRICS))).alias("metric")
    rows = counts.select("*", name)

    def pick(c: Column) -> Column:
        out = F.lit(None)
        for m, (k, every) in METRICS.items():
            out = F.when(F.col("metric") == m, estimate(F.col("n"), c, k, every)).otherwise(out)
        return out

    need = reduce(lambda out, m: F.when(F.col("metric") == m[0], m[1][0]).otherwise(out), METRICS.items(), F.lit(None).cast("int"))
    rows = rows.withColumns({"lower": pick(F.col("passed")), "upper": pick(F.col("passed") + F.col("unknown"))})
    status = F.when(F.col("n") < need, "insufficient_planned_trials").when(F.col("unknown") > 0, "pending_outcomes").otherwise("complete")
    return rows.withColumns({"point": F.when(F.col("unknown") == 0, F.col("lower")), "status": status})


def _gated_means(count: Column, complete: Column, bounded: Column, lower: Column, upper: Column, point: Column) -> list[Column]:
    return [F.when((count > 0) & (complete == count), point).alias("point"), F.when((count > 0) & (bounded == count), lower).alias("lower"), F.when((count > 0) & (bounded == count), upper).alias("upper")]


def question_macro(questions: DataFrame, keys: list[str], weight: str | None = None) -> DataFrame:
    """Means over all questions of a group, by metric: null unless all are complete (point) or bounded (lower, upper).

    complete_only is the mean over complete questions with its own denominator. weight: a column of how many questions a row stands for.
    """
    done = F.col("status") == "complete"
    w = F.col(weight) if weight else F.lit(1)
    count = lambda when: F.sum(F.when(when, w).otherwise(0)).cast("long")
    mean = lambda c: F.try_divide(F.sum(F.col(c) * w), F.sum(F.when(F.col(c).isNotNull(), w)))
    rows = questions.withColumn("_done", F.when(done, F.col("point.value")))
    grouped = rows.groupBy(*keys, "metric").agg(
        count(F.lit(True)).alias("questions"),
        count(done).alias("complete"),
        count(F.col("status") == "insufficient_planned_trials").alias("underbudget"),
        count(F.col("lower").isNotNull()).alias("_bounded"),
        mean("lower.value").alias("_lower"),
        mean("upper.value").alias("_upper"),
        mean("_done").alias("complete_only"),
    )
    return grouped.select(*keys, "metric", "questions", "complete", "underbudget", *_gated_means(*map(F.col, ("questions", "complete", "_bounded", "_lower", "_upper", "complete_only"))), "complete_only")


def family_macro(questions: DataFrame, keys: list[str], family: str = "family_id", weight: str | None = None) -> DataFrame:
    """Means of family means, each family with the same weight; null if any family's is null. weight as in question_macro."""
    families = question_macro(questions, [*keys, family], weight)
    grouped = families.groupBy(*keys, "metric").agg(F.count("*").alias("families"), F.count("point").alias("_complete"), F.count("lower").alias("_bounded"), F.avg("lower").alias("_lower"), F.avg("upper").alias("_upper"), F.avg("point").alias("_point"), F.sum("questions").alias("questions"))
    return grouped.select(*keys, "metric", "families", "questions", *_gated_means(*map(F.col, ("families", "_complete", "_bounded", "_lower", "_upper", "_point"))))


def verdict_classes(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Questions with equal counts as one row: keys, n, passed, unknown, questions. Some dozens of rows a group stand for all of its questions."""
    return counts.groupBy(*keys, "n", "passed", "unknown").agg(F.count("*").alias("questions"))


FRACTION = StructType().add("numerator", StringType()).add("denominator", StringType()).add("value", DoubleType())


@F.arrow_udf(FRACTION)
def _mean(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Sums of weighted fractions over a count, in lowest terms; whole numbers of any length."""
    kind = pa.struct([("numerator", pa.string()), ("denominator", pa.string()), ("value", pa.float64())])
    for terms, counts in batches:
        out = []
        for some, count in zip(terms.to_pylist(), counts.to_pylist(), strict=True):
            mean = sum((Fraction(int(t["numerator"]) * t["weight"], int(t["denominator"]) * t["share"]) for t in some), Fraction(0)) / count if some and count else None
            out.append(None if mean is None else {"numerator": str(mean.numerator), "denominator": str(mean.denominator), "value": float(mean)})
        yield pa.array(out, kind)


def exact_means(classes: DataFrame, keys: list[str], family: str | None = None) -> DataFrame:
    """Means of question_macro (or of family_macro, if the classes have a family) as fractions in lowest terms beside their doubles.

    classes: verdict_classes of keys (and family). point, lower and upper are struct(numerator, denominator, value), the
    parts as decimal text, null under the rules of question_macro. Equal fractions are added up as counts, which merge like
    any sum; the few different ones of a group are brought to one denominator at the end.
    """
    own = [*keys, family] if family else keys
    rows = classes
    if family:  # a family of q questions gives each of them a q-th of its own share
        rows = rows.join(classes.groupBy(*own).agg(F.sum("questions").alias("share")), own) if own else rows
    else:
        rows = rows.withColumn("share", F.lit(1).cast("long"))
    families = rows.groupBy(*keys).agg(F.count_distinct(family).alias("families")) if family else None
    rows = question_metrics(rows.groupBy(*keys, "n", "passed", "unknown", "share").agg(F.sum("questions").alias("questions")))
    term = lambda side: F.struct(F.col(side)["numerator"].cast("string").alias("numerator"), F.col(side)["denominator"].cast("string").alias("denominator"), F.col("questions").alias("weight"), "share")
    done = F.col("status") == "complete"
    sides = [F.collect_list(F.when(F.col(c).isNotNull(), term(c))).alias(f"_{c}") for c in ("point", "lower", "upper")]
    count = lambda when: F.sum(F.when(when, F.col("questions")).otherwise(0))
    # equal fractions first
    each = rows.groupBy(*keys, "metric", "share", "status", "lower", "upper", "point").agg(F.sum("questions").alias("questions"))
    out = each.groupBy(*keys, "metric").agg(F.sum("questions").alias("questions"), count(done).alias("complete"), count(F.col("lower").isNotNull()).alias("_bounded"), *sides)
    if family:
        out = out.join(families, keys) if keys else out.crossJoin(families)  # one row
    total = F.col("families" if family else "questions")
    gate = lambda ok, c: F.when(F.col(ok) == F.col("questions"), _mean(F.col(f"_{c}"), total)).alias(c)
    return out.select(*keys, "metric", *(["families"] if family else []), "questions", "complete", gate("complete", "point"), gate("_bounded", "lower"), gate("_bounded", "upper"))


def fill_slots(slots: DataFrame, records: DataFrame, key: str = "trial_id") -> DataFrame:
    """Every planned slot with its record's status and verdicts: a slot without a record is missing, and all that did not complete are unknown in every dimension."""
    extra = [c for c in records.columns if c == key or c not in slots.columns]
    joined = slots.join(records.select(*extra), key, "left").withColumn("status", F.coalesce("status", F.lit("missing")))
    return joined.withColumns({d: F.when(F.col("status") == "completed", F.coalesce(F.col(d), F.lit("needs_review"))).otherwise("needs_review") for d in DIMENSIONS if d in joined.columns})


def long_verdicts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each dimension: keys, dimension, verdict."""
    pairs = F.explode(F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(d).alias("verdict")) for d in DIMENSIONS))).alias("_p")
    return rows.select(*keys, pairs).select(*keys, "_p.dimension", "_p.verdict")


def apply_qualification(verdicts: DataFrame, qualification: DataFrame, case: str = "case_id") -> DataFrame:
    """Verdicts of cases whose gold is not accepted become needs_review; the submitted ones stay beside. eligible says which."""
    q = qualification.select(case, "gold_status")
    eligible = F.coalesce(F.col("gold_status") == "accepted", F.lit(False))
    return verdicts.join(q, case, "left").withColumns({"submitted": F.col("verdict"), "eligible": eligible}).withColumn("verdict", F.when(F.col("eligible"), F.col("verdict")).otherwise("needs_review"))


def first_attempt(trials: DataFrame, keys: list[str], ordinal: str = "ordinal", verdict: str = "verdict") -> DataFrame:
    """1 or 0 for the verdict of the slot with ordinal 0; null if it is unknown or absent."""
    value = F.when(F.col(verdict) == "pass", 1).when(F.col(verdict) == "fail", 0)
    return trials.groupBy(*keys).agg(F.max(F.when(F.col(ordinal) == 0, value)).alias("first_attempt"))


def partition_table(questions: DataFrame, partition: str = "partition") -> DataFrame:
    """question_macro by partition and dimension; a partition without questions keeps its rows, with zero counts."""
    spark = questions.sparkSession
    frame = spark.range(1).select(F.explode(F.array(*map(F.lit, PARTITIONS))).alias(partition))
    frame = frame.select(partition, F.explode(F.array(*map(F.lit, DIMENSIONS))).alias("dimension")).select(partition, "dimension", F.explode(F.array(*map(F.lit, METRICS))).alias("metric"))
    table = question_macro(questions, [partition, "dimension"])
    return frame.join(table, [partition, "dimension", "metric"], "left").fillna(0, ["questions", "complete", "underbudget"])


def hop_subgroups(questions: DataFrame, hops: tuple[int, ...] = (3, 4)) -> DataFrame:
    """question_macro by claim (local, certified), hops and dimension. A certified claim is also a local one."""
    local = questions.where(F.col("hop_claim_status").isin("local_dependency_only", "certified_under_explicit_contract")).withColumn("claim", F.lit("local"))
    certified = questions.where(F.col("hop_claim_status") == "certified_under_explicit_contract").withColumn("claim", F.lit("certified"))
    return question_macro(local.unionByName(certified).where(F.col("declared_hops").isin(*hops)), ["claim", "declared_hops", "dimension"])


def gate(table: DataFrame, enabled: Column, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(official, descriptive): the official copy has nulls in columns unless sampling was qualified."""
    return table.withColumns({c: F.when(enabled, F.col(c)) for c in columns}), table


def verdict_violations(reviews: DataFrame, registered: list[str], approver: str) -> DataFrame:
    """(check, key): accepted adjudications that break a rule of verdicts or of review. registered is a short list."""
    v, done = F.col("verdicts"), F.col("status") == "accepted"
    names = F.array_distinct(F.coalesce("reviewers", F.array().cast("array<string>")))
    rules = {
        "proof_without_answer": (v["logical_proof"] == "pass") & ~v["answer"].eqNullSafe("pass"),
        "contract_without_proof": (v["output_contract"] == "pass") & ~(v["logical_proof"].eqNullSafe("pass") & v["answer"].eqNullSafe("pass")),
        "fewer_than_two_reviewers": F.size(names) < 2,
        "unregistered_reviewer": F.size(F.array_except(names, F.array(*map(F.lit, registered)))) > 0,
        "not_approved": ~(F.col("approved_by").eqNullSafe(approver) & F.coalesce(F.array_contains(names, approver), F.lit(False))),
        "not_independent": ~F.coalesce("independent_review", F.lit(False)),
        "no_rationale": F.coalesce(F.trim("rationale"), F.lit("")) == "",
    }
    failed = F.array_compact(F.array(*(F.when(rule, F.lit(name)) for name, rule in rules.items())))
    return reviews.where(done).select(F.explode(failed).alias("check"), F.col("trial_id").alias("key"))


def attach_grades(slots: DataFrame, grades: DataFrame, key: str = "trial_id") -> DataFrame:
    """slots with their grades; an ungraded slot is U in every dimension."""
    out = slots.join(grades.select(key, *DIMENSIONS), key, "left")
    return out.withColumns({d: F.coalesce(d, F.lit("U")) for d in DIMENSIONS})


def grade_violations(slots: DataFrame, grades: DataFrame, identity: list[str], key: str = "trial_id") -> DataFrame:
    """(check, key): grades of no planned slot (extra), of a slot graded before (repeated), or whose identity columns differ from the slot's."""
    mine = slots.select(key, *(F.col(c).alias(f"_{c}") for c in identity), F.lit(True).alias("_planned"))
    differs = reduce(lambda a, b: a | b, (~F.col(c).eqNullSafe(F.col(f"_{c}")) for c in identity))
    g = grades.join(mine, key, "left").groupBy(key).agg(F.bool_or(F.col("_planned")).alias("_in"), F.count("*").alias("_n"), F.bool_or(differs).alias("_d"))
    planned = F.col("_in").isNotNull()
    checks = F.array_compact(F.array(F.when(~planned, F.lit("extra")), F.when(F.col("_n") > 1, F.lit("repeated")), F.when(planned & F.col("_d"), F.lit("identity"))))
    return g.select(F.explode(checks).alias("check"), F.col(key).alias("key"))


def cohort_bounds(labels: DataFrame, axes: list[str], label: str = "label") -> DataFrame:
    """P, F, U counts and label bounds P / N and (P + U) / N: overall, by each axis alone and by all together.

    grouping tells which axes a row is grouped by (bit set: not grouped), so that a null value of an axis is a group of its own.
    """
    sets = [[], *([a] for a in axes), axes] if len(axes) > 1 else [[], axes]
    p, f = F.count_if(F.col(label) == "P"), F.count_if(F.col(label) == "F")
    out = labels.groupingSets([[F.col(c) for c in s] for s in sets], *axes).agg(F.grouping_id().alias("grouping"), F.count("*").alias("n"), p.alias("p"), f.alias("f"))
    return out.withColumn("u", F.col("n") - F.col("p") - F.col("f")).withColumns({"lower": F.col("p") / F.col("n"), "upper": (F.col("p") + F.col("u")) / F.col("n")})


def pair_transitions(rows: DataFrame, keys: list[str], side: str, left: str, right: str, label: str = "label") -> tuple[DataFrame, DataFrame]:
    """(counts of left -> right labels, (keys, reason) of rows without one of the sides), by one aggregation, without a self join."""
    of = lambda s: F.max(F.when(F.col(side) == s, F.col(label)))
    pairs = rows.groupBy(*keys).agg(of(left).alias("_l"), of(right).alias("_r"))
    moved = pairs.where("_l is not null and _r is not null").groupBy(F.concat("_l", F.lit("->"), "_r").alias("transition")).agg(F.count("*").alias("pairs"))
    reason = F.when(F.col("_l").isNull() & F.col("_r").isNull(), "no_side").when(F.col("_l").isNull(), "no_left").when(F.col("_r").isNull(), "no_right")
    return moved, pairs.withColumn("reason", reason).where("reason is not null").select(*keys, "reason")


def base_transitions(rows: DataFrame, keys: list[str], is_base: Column, label: str = "label") -> tuple[DataFrame, DataFrame]:
    """(transitions from the group's base to its other rows, groups without exactly one base).

    The base comes from a window over the group's key, which is a family in one phase, not from a self join.
    """
    w = Window.partitionBy(*keys)
    marked = rows.withColumns({"_base": is_base}).withColumns({"_bases": F.count_if("_base").over(w), "_from": F.max(F.when(F.col("_base"), F.col(label))).over(w)})
    moved = marked.where("_bases = 1 and not _base").groupBy(F.concat("_from", F.lit("->"), F.col(label)).alias("transition")).agg(F.count("*").alias("pairs"))
    return moved, marked.where("_bases <> 1").groupBy(*keys).agg(F.count("*").alias("rows"), F.max("_bases").alias("bases"))


def parent_transitions(revisions: DataFrame, current: DataFrame, parent: str, key: str, label: str = "label") -> tuple[DataFrame, DataFrame]:
    """(transitions from a parent row to its revision, revisions whose parent was not observed)."""
    c = current.select(F.col(key).alias("_parent"), F.col(label).alias("_from"))
    joined = revisions.join(c, revisions[parent] == F.col("_parent"), "left")
    moved = joined.where("_parent is not null").groupBy(F.concat("_from", F.lit("->"), F.col(label)).alias("transition")).agg(F.count("*").alias("pairs"))
    return moved, joined.where("_parent is null").drop("_parent", "_from")


def error_index(rows: DataFrame) -> DataFrame:
    """Rows with a label other than P in any dimension."""
    return rows.where(reduce(lambda a, b: a | b, (~F.col(d).eqNullSafe("P") for d in DIMENSIONS)))
