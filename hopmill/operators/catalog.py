"""The catalog of cases: cohorts, overlays, facets, filtered pages, completeness and reviews."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hopmill.functions.json_text import is_json
from hopmill.operators.ranks import positions


def union_cohorts(cohorts: dict[str, DataFrame], key: str, payload: str) -> DataFrame:
    """One catalog of cohorts with different columns: key is cohort:id, with a digest of the payload."""
    parts = [df.withColumns({"cohort": F.lit(n), "key": F.concat_ws(":", F.lit(n), F.col(key).cast("string")), "input_sha256": F.sha2(F.col(payload), 256)}) for n, df in cohorts.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def first_match(rules: list[tuple[Column, str]], default: str) -> Column:
    """The name of the first rule that holds."""
    return reduce(lambda out, r: out.when(r[0], r[1]), rules[1:], F.when(rules[0][0], rules[0][1])).otherwise(default)


def reconcile(catalog: DataFrame, declared: DataFrame) -> DataFrame:
    """(cohort, declared, actual) where the two counts differ; 0 for a cohort that one side lacks."""
    a = catalog.groupBy("cohort").agg(F.count("*").alias("actual"))
    d = declared.select("cohort", F.col("declared_count").cast("long").alias("declared"))
    return d.join(a, "cohort", "full").fillna(0, ["declared", "actual"]).where("declared <> actual").select("cohort", "declared", "actual")


def overlay(catalog: DataFrame, hits: DataFrame, key: str = "key") -> DataFrame:
    """Keys in hits require review; their former status stays in previous_status."""
    h = hits.select(key).distinct().withColumn("_hit", F.lit(True))
    return catalog.join(h, key, "left").withColumn("previous_status", F.when(F.col("_hit"), F.col("gold_status"))).withColumn("gold_status", F.when(F.col("_hit"), "requires_review").otherwise(F.col("gold_status"))).drop("_hit")


def attach_answers(catalog: DataFrame, answers: DataFrame, key: str = "key") -> DataFrame:
    """Questions with their first answers, the digest of the raw text, and whether it is one JSON value (repeated keys and NaN allowed); no answer does not parse."""
    a = answers.select(key, "model", "raw_response", F.sha2("raw_response", 256).alias("raw_text_sha256"), is_json(F.col("raw_response")).alias("parses"))
    return catalog.join(a, key, "left").withColumn("parses", F.coalesce("parses", F.lit(False)))


def facet_pairs(catalog: DataFrame, key: str, single: list[str], several: list[str]) -> DataFrame:
    """(key, facet, value): one row for each value; an empty or null list has the value `none`."""
    one = [F.array(F.struct(F.lit(c).alias("facet"), F.coalesce(F.col(c).cast("string"), F.lit("none")).alias("value"))) for c in single]

    def values(c: str) -> Column:
        listed = F.when(F.size(F.coalesce(c, F.array().cast("array<string>"))) > 0, F.array_distinct(c)).otherwise(F.array(F.lit("none")))
        return F.transform(listed, lambda v: F.struct(F.lit(c).alias("facet"), v.alias("value")))

    many = [values(c) for c in several]
    return catalog.select(key, F.explode(F.concat(*one, *many)).alias("_f")).select(key, "_f.facet", "_f.value")


def facet_counts(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("facet", "value").agg(F.count("*").alias("rows"))


def filter_facets(catalog: DataFrame, wanted: dict[str, list[str]], need_all: dict[str, list[str]] | None = None, term: str = "", searched: tuple[str, ...] = ()) -> DataFrame:
    """Rows that have any wanted value in every facet, all values of need_all, and hold term (any case) in a searched column."""
    out = catalog
    kinds = dict(catalog.dtypes)
    for c, values in wanted.items():
        out = out.where(F.arrays_overlap(c, F.array(*map(F.lit, values))) if kinds[c].startswith("array") else F.col(c).isin(*values))
    for c, values in (need_all or {}).items():
        out = out.where(F.size(F.array_except(F.array(*map(F.lit, values)), F.col(c))) == 0)
    if term:
        out = out.where(reduce(lambda a, b: a | b, (F.coalesce(F.lower(F.col(c)).contains(term.lower()), F.lit(False)) for c in searched)))
    return out


def ranked(column: Column, order: list[str]) -> Column:
    """Place of a value in a custom order; others come last."""
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, order)), column), F.lit(0)), F.lit(len(order) + 1))


def siblings(catalog: DataFrame, key: str = "key") -> DataFrame:
    """(key, sibling): other cases of the same cohort and mother."""
    a = catalog.where(F.col("mother").isNotNull()).select(key, "cohort", "mother")
    return a.join(a.withColumnRenamed(key, "sibling"), ["cohort", "mother"]).where(F.col(key) != F.col("sibling")).select(key, "sibling")


def sibling_counts(catalog: DataFrame, key: str = "key") -> DataFrame:
    """(key, siblings): the number of each key's siblings() where it has any, from the sizes of groups and not from pairs."""
    a = catalog.dropna(subset=[key, "cohort", "mother"]).groupBy("cohort", "mother", key).agg(F.count("*").alias("_m"))
    n = a.groupBy("cohort", "mother").agg(F.sum("_m").alias("_n"))
    return a.join(n, ["cohort", "mother"]).groupBy(key).agg(F.sum(F.col("_m") * (F.col("_n") - F.col("_m"))).alias("siblings")).where("siblings > 0")


def category_counts(rows: DataFrame, column: str, categories: list[str]) -> DataFrame:
    """(value, rows) for every category, zero where there is none, and for any other value that occurs."""
    frame = rows.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, categories))).alias("value"))
    got = rows.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("rows"))
    return frame.join(got, "value", "full").fillna(0, ["rows"])


def grid_violations(rows: DataFrame, question: str, models: list[str], digest: str = "input_sha256") -> DataFrame:
    """(question, check) of questions without exactly one row for each model, or with different inputs."""
    g = rows.groupBy(question).agg(F.count("*").alias("_n"), F.count_distinct("model").alias("_m"), F.count_if(~F.coalesce(F.col("model").isin(*models), F.lit(False))).alias("_x"), F.count_distinct(digest).alias("_d"))
    bad = F.array_compact(F.array(F.when((F.col("_n") != len(models)) | (F.col("_m") != len(models)) | (F.col("_x") > 0), F.lit("models")), F.when(F.col("_d") > 1, F.lit("inputs"))))
    return g.select(question, F.explode(bad).alias("check"))


def assign_owners(rows: DataFrame, family: str, key: str, owners: tuple[str, ...] = ("A", "B")) -> DataFrame:
    """Owners in turn over the rows by family (null last) and key; a large family is split by key like any other range."""
    placed = positions(rows, [F.col(family).asc_nulls_last(), F.col(key).asc()], "_place")
    owner = F.element_at(F.array(*map(F.lit, owners)), (F.col("_place") % len(owners) + 1).cast("int"))
    return placed.select(family, *(c for c in rows.columns if c != family), owner.alias("owner"))


def review_progress(reviews: DataFrame) -> DataFrame:
    """By owner: total, complete and draft reviews. Complete: every unit judged, and each step or verdict that is not correct or accept has a comment.

    reviews has owner, units, judged (counts), uncommented (steps that need a comment and lack it), verdict, comment.
    """
    said = F.coalesce(F.trim("comment"), F.lit("")) != ""
    done = F.col("verdict").isNotNull() & (F.col("judged") == F.col("units")) & (F.col("uncommented") == 0) & ((F.col("verdict") == "accept") | said)
    done = F.coalesce(done, F.lit(False))
    return reviews.groupBy("owner").agg(F.count("*").alias("total"), F.count_if(done).alias("complete"), F.count_if(~done & (F.col("judged") > 0)).alias("draft"))


def latest(entries: DataFrame, keys: list[str], revision: str = "revision") -> DataFrame:
    """The row with the greatest revision for each key, by aggregation; of several such rows the greatest by the other columns in order."""
    rest = [c for c in entries.columns if c not in keys]
    order = F.struct(revision, *(c for c in rest if c != revision))
    return entries.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_v")).select(*keys, *(f"_v.{c}" for c in rest))


def revision_conflicts(entries: DataFrame, keys: list[str], revision: str = "revision", expected: str = "expected_revision") -> DataFrame:
    """Writes whose expected revision is not the one before."""
    w = Window.partitionBy(*keys).orderBy(revision)
    return entries.withColumn("previous", F.coalesce(F.lag(revision).over(w), F.lit(0))).where(~F.col(expected).eqNullSafe(F.col("previous")))


def import_entries(current: DataFrame, export: DataFrame, keys: list[str], value: str = "value") -> tuple[DataFrame, DataFrame]:
    """(new entries, keys skipped because their value differs)."""
    mine = current.select(*keys, F.col(value).alias("_value"))
    both = export.join(mine, keys).where(~F.col(value).eqNullSafe(F.col("_value"))).select(*keys)
    return export.join(current.select(*keys), keys, "left_anti"), both
