"""Digests, keys and checks. Checks return violations (check, key) instead of raising; require_empty() raises for callers who want that."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Patterns of secrets and local paths.
SECRETS = {
    "api_key": r"\bsk-[A-Za-z0-9_-]{12,}",
    "bearer": r"(?i)Bearer\s+[A-Za-z0-9_.-]{16,}",
    "local_path": r"(?i)[A-Z]:[\\/](?:Users|Program\sFiles|个人经历)",
    "escaped_path": r"(?i)C:\\\\Users\\\\",
    "host_token": r"gh[pousr]_[A-Za-z0-9]{20,}",
    "personal_token": r"github_pat_[A-Za-z0-9_]{20,}",
}


def require_empty(violations: DataFrame) -> None:
    """Raise with the first violations, if there are any."""
    some = violations.limit(5).collect()
    if some:
        raise ValueError(f"violations, at least: {some}")


def row_digest(df: DataFrame, columns: list[str] | None = None) -> Column:
    """sha256 of a flat row: its columns by name as JSON, nulls kept."""
    return F.sha2(F.to_json(F.struct(*sorted(columns or df.columns)), {"ignoreNullFields": "false"}), 256)


def fingerprint(df: DataFrame) -> DataFrame:
    """(rows, fingerprint): one digest of a table that does not depend on the order of its rows.

    Digests of rows are summed by 15-digit parts, so that the table is never sorted or gathered.
    """
    d = df.select(row_digest(df).alias("_d"))
    parts = [F.sum(F.conv(F.substring("_d", 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)")).alias(f"_{i}") for i in range(5)]
    return d.agg(F.count("*").alias("rows"), *parts).select("rows", F.sha2(F.concat_ws("|", "rows", *(F.col(f"_{i}").cast("string") for i in range(5))), 256).alias("fingerprint"))


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """(key, rows) of keys that more than one row has."""
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).where("rows > 1")


def coverage(expected: DataFrame, observed: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of one side only: side is missing (expected alone) or unexpected."""
    e, o = expected.select(*keys).distinct(), observed.select(*keys).distinct()
    return e.join(o, keys, "left_anti").withColumn("side", F.lit("missing")).unionByName(o.join(e, keys, "left_anti").withColumn("side", F.lit("unexpected")))


def dangling(rows: DataFrame, key: str, references: str, targets: DataFrame, target: str) -> DataFrame:
    """(key, reference) of array references that no target has."""
    refs = rows.select(key, F.explode(references).alias("reference"))
    return refs.join(targets.select(F.col(target).alias("reference")).distinct(), "reference", "left_anti").select(key, "reference").distinct()


def stale_bindings(bound: DataFrame, actual: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field) where a bound value differs from the actual one, null-safe; rows without an actual one are field `row`."""
    a = actual.select(key, F.lit(True).alias("_there"), *(F.col(f).alias(f"_{f}") for f in fields))
    j = bound.join(a, key, "left")
    bad = F.array_compact(F.array(F.when(F.col("_there").isNull(), F.lit("row")), *(F.when(F.col("_there") & ~F.col(f).eqNullSafe(F.col(f"_{f}")), F.lit(f)) for f in fields)))
    return j.select(key, F.explode(bad).alias("field"))


def split_leaks(rows: DataFrame, digest: str, split: str, keys: list[str] | None = None) -> DataFrame:
    """Digests in more than one split, with the splits sorted. Nulls are left out."""
    g = rows.where(F.col(digest).isNotNull()).groupBy(*(keys or []), digest).agg(F.array_sort(F.collect_set(split)).alias("_s"), F.count("*").alias("rows"))
    return g.where(F.size("_s") > 1).select(*(keys or []), digest, F.array_join("_s", ",").alias("splits"), "rows")


def project(df: DataFrame, allowed: list[str], key: str, salt: str) -> DataFrame:
    """The allowed columns under an opaque id that shows nothing of the key."""
    return df.select(opaque_id(F.concat(F.lit(salt), F.col(key).cast("string"))).alias("id"), *[c for c in allowed if c != key])


def unknown_fields(json: Column, allowed: list[str]) -> Column:
    """Top-level keys of a JSON object outside the allowed ones."""
    return F.array_except(F.json_object_keys(json), F.array(*map(F.lit, allowed)))


def secret_hits(df: DataFrame, key: str, text: str, patterns: dict[str, str] = SECRETS) -> DataFrame:
    """(key, pattern) for each pattern that a row's text matches. Map-only."""
    hits = F.array_compact(F.array(*(F.when(F.col(text).rlike(p), F.lit(n)) for n, p in patterns.items())))
    return df.select(key, F.explode(hits).alias("pattern"))


def reused(df: DataFrame, slot: str, value: str) -> DataFrame:
    """(value, slots): values that two or more slots share; nulls are left out before they meet in one task."""
    return df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count_distinct(slot).alias("slots")).where("slots > 1")


def opaque_id(text: Column, prefix: str = "Q-", digits: int = 16) -> Column:
    """A stable id: prefix and the first hex digits of the sha256."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(text, 256), 1, digits))


def answer_contract(df: DataFrame, key: str, json: str, required: dict[str, str]) -> DataFrame:
    """(key, check) of JSON answers that lack a required key, hold another one or a value of another type.

    required maps a key to its type: string, number, boolean, array or object.
    """
    v = F.try_parse_json(json)
    keys = F.coalesce(F.json_object_keys(json), F.array().cast("array<string>"))
    kinds = {"string": "STRING", "number": "(BIGINT|DOUBLE|DECIMAL.*)", "boolean": "BOOLEAN", "array": "ARRAY<.*", "object": "OBJECT<.*"}
    wrong = [F.when(F.array_contains(keys, k) & ~F.coalesce(F.schema_of_variant(F.try_variant_get(v, f"$.{k}", "variant")).rlike(f"^{kinds[t]}$"), F.lit(False)), F.lit(f"type:{k}")) for k, t in required.items()]
    lacking = F.transform(F.array_except(F.array(*map(F.lit, required)), keys), lambda k: F.concat(F.lit("missing:"), k))
    extra = F.transform(F.array_except(keys, F.array(*map(F.lit, required))), lambda k: F.concat(F.lit("unknown:"), k))
    checks = F.when(v.isNull(), F.array(F.lit("not_json"))).otherwise(F.concat(lacking, extra, F.array_compact(F.array(*wrong))))
    return df.select(key, F.explode(checks).alias("check"))


def plan_violations(slots: DataFrame, case: str = "case_id", ordinal: str = "ordinal", trial: str = "trial_id", request: str = "request_sha256", partition: str = "partition", partitions: tuple[str, ...] = ("primary", "node", "control")) -> DataFrame:
    """(check, key): ordinals that are not 0..n-1, repeated trials, cases with several requests, unknown partitions."""
    w = Window.partitionBy(case).orderBy(ordinal)
    gaps = slots.withColumn("_n", F.row_number().over(w) - 1).where(~F.col(ordinal).eqNullSafe(F.col("_n"))).select(F.lit("ordinal").alias("check"), F.col(case).cast("string").alias("key")).distinct()
    twice = repeated_keys(slots, [trial]).select(F.lit("trial").alias("check"), F.col(trial).cast("string").alias("key"))
    several = slots.groupBy(case).agg(F.count_distinct(request).alias("_n")).where("_n > 1").select(F.lit("request").alias("check"), F.col(case).cast("string").alias("key"))
    odd = slots.where(~F.coalesce(F.col(partition).isin(*partitions), F.lit(False))).select(F.lit("partition").alias("check"), F.col(case).cast("string").alias("key")).distinct()
    return reduce(DataFrame.unionByName, (gaps, twice, several, odd))


def event_counts(rows: DataFrame, events: str = "events") -> DataFrame:
    """(type, n) over nested event arrays."""
    return rows.select(F.explode(events).alias("_e")).groupBy(F.col("_e.type").alias("type")).agg(F.count("*").alias("n"))


def wrong_message_counts(rows: DataFrame, request: str, kind: Column, wanted: int = 1) -> DataFrame:
    """(request, messages) of requests whose number of messages of a kind is not the wanted one."""
    return rows.groupBy(request).agg(F.count_if(kind).alias("messages")).where(F.col("messages") != wanted)


def run_ledger(calls: DataFrame, keys: list[str], session: str = "session_id", attempt: str = "attempt", tokens: str = "tokens", status: str = "status") -> DataFrame:
    """By keys: requests, responses, distinct and repeated sessions, retries, failures, token sum, requests without usage."""
    return calls.groupBy(*keys).agg(
        F.count("*").alias("requests"),
        F.count_if(F.col(status) == "completed").alias("responses"),
        F.count_distinct(session).alias("sessions"),
        (F.count(session) - F.count_distinct(session)).alias("repeated_sessions"),
        F.count_if(F.col(attempt) > 0).alias("retries"),
        F.count_if(F.col(status) != "completed").alias("failures"),
        F.coalesce(F.sum(tokens), F.lit(0)).alias("tokens"),
        F.count_if(F.col(tokens).isNull()).alias("without_usage"),
    )
