"""Row predicates and policies: acquisition routes, request budgets, run states, retries, browser envelopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t

# Allowed run transitions and retryable database errors.
TRANSITIONS = (
    ("queued", "running"), ("queued", "cancelled"), ("running", "succeeded"), ("running", "partial"), ("running", "failed"),
    ("running", "cancelled"), ("partial", "queued"), ("failed", "queued"),
)
RETRYABLE_CODES = ("23505", "40001", "40P01")
UNIQUE_VIOLATION = "23505"


def acquisition_route(ok: Column, quality: Column, enabled: Column, configured: Column) -> Column:
    """struct(route, reason). enabled: the source is on the fallback list."""
    pick = lambda route, reason: F.struct(F.lit(route).alias("route"), F.lit(reason).alias("reason"))
    return (
        F.when(~F.coalesce(ok, F.lit(False)) | (quality == "failed"), pick("failed", "direct-fetch-failed"))
        .when(quality == "ready", pick("direct", "direct-quality-ready"))
        .when(quality == "review", pick("hold-for-review", "direct-review-required"))
        .when((quality == "fallback-required") & configured & enabled, pick("browser-markdown", "browser-fallback-enabled"))
        .otherwise(pick("hold-for-review", "browser-fallback-unavailable"))
    )


def route_from_quality(quality: Column) -> Column:
    return F.when(quality == "ready", "direct").when(quality == "failed", "failed").otherwise("hold-for-review")


def with_routes(results: DataFrame, enabled_sources: DataFrame, configured: bool) -> DataFrame:
    """results(source_id, ok, quality_decision), enabled_sources(source_id): adds route and reason."""
    listed = enabled_sources.select("source_id").distinct().withColumn("__on", F.lit(True))
    joined = results.join(listed, "source_id", "left")
    route = acquisition_route(F.col("ok"), F.col("quality_decision"), F.coalesce("__on", F.lit(False)), F.lit(configured))
    return joined.withColumn("__r", route).select(*results.columns, "__r.route", "__r.reason")


def with_budget(requests: DataFrame, run: list[str], order: list[str], budget: int) -> DataFrame:
    """The first `budget` requests of a run are allowed; later ones get an error."""
    if isinstance(budget, bool) or not isinstance(budget, int) or budget < 0:
        raise ValueError("budget must be a non-negative integer")
    n = F.row_number().over(Window.partitionBy(*run).orderBy(*order))
    used = requests.withColumn("request_number", n)
    return used.withColumn("error", F.when(F.col("request_number") > budget, F.lit(f"Browser request budget of {budget} is used up")))


def persistable(snapshots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ready snapshots, quarantined ones): only ready articles may be stored."""
    ready = F.coalesce(F.col("quality_decision") == "ready", F.lit(False))
    return snapshots.where(ready), snapshots.where(~ready)


def transition_allowed(current: Column, following: Column) -> Column:
    out = F.lit(False)
    for a, b in TRANSITIONS:
        out = out | ((current == a) & (following == b))
    return F.coalesce(out, F.lit(False))


def invalid_transitions(changes: DataFrame) -> DataFrame:
    """changes(current, following, ...) that no edge allows."""
    edges = changes.sparkSession.createDataFrame(TRANSITIONS, "current string, following string")
    return changes.join(F.broadcast(edges), ["current", "following"], "left_anti")  # eight fixed rows


def failure_decision(retryable: Column, attempt: Column, most: Column) -> Column:
    """struct(terminal_status, should_retry, next_attempt, error)."""
    wrong = (attempt < 1) | (most < attempt)
    again = ~wrong & retryable & (attempt < most)
    return F.struct(
        F.when(~wrong, "failed").alias("terminal_status"), F.when(~wrong, again).alias("should_retry"), F.when(again, attempt + 1).alias("next_attempt"),
        F.when(wrong, "Invalid processing failure attempt counters").alias("error"),
    )


def error_code(codes: Column) -> Column:
    """The first code in a chain of at most eight causes."""
    return F.get(F.filter(F.slice(codes, 1, 8), lambda c: c.isNotNull()), F.lit(0))


def is_retryable(codes: Column) -> Column:
    return F.coalesce(error_code(codes).isin(*RETRYABLE_CODES), F.lit(False))


def violated_constraint(codes: Column, constraint: Column) -> Column:
    return F.when(error_code(codes) == UNIQUE_VIOLATION, constraint)


def is_postgres_url(url: Column) -> Column:
    return F.coalesce(url.rlike("(?i)^postgres(ql)?://"), F.lit(False))


def envelope(body: Column) -> Column:
    """struct(text, error, content_hash) of a browser service's JSON answer: result, .markdown or .content as the text."""
    j = lambda path: F.get_json_object(body, path)
    result = j("$.result")
    picked = F.when(result.startswith("{"), F.coalesce(j("$.result.markdown"), j("$.result.content"))).otherwise(result)
    text = t.trim(F.regexp_replace(picked, "\r", ""))
    messages = F.filter(F.transform(F.from_json(j("$.errors"), "array<struct<message:string>>"), lambda e: t.trim(e["message"])), lambda m: m != "")
    said = F.substring(F.coalesce(F.nullif(F.array_join(messages, "; "), F.lit("")), F.lit("unknown error")), 1, 500)
    failed = F.coalesce(j("$.success") != "true", F.lit(False)) | text.isNull()
    short = t.utf16_length(text) < 250
    error = F.when(failed, said).when(short, F.lit("Browser text is too short"))
    return F.struct(F.when(error.isNull(), text).alias("text"), error.alias("error"), F.when(error.isNull(), F.sha2(text, 256)).alias("content_hash"))


def browser_metrics(fetched: DataFrame) -> DataFrame:
    """fetched(id, url, body, error, duration_ms) of a browser service -> what may be kept of an answer: sizes, hash, time and error, but no text."""
    rows = fetched.select("id", "url", "duration_ms", F.col("error").alias("__early"), envelope(F.col("body")).alias("e"))
    failed = F.coalesce("__early", "e.error")
    return rows.select("id", F.col("url").alias("requested_url"), t.utf16_length(F.when(failed.isNull(), F.col("e.text"))).alias("text_length"), F.when(failed.isNull(), F.col("e.content_hash")).alias("content_hash"), "duration_ms", failed.alias("error"))


def compare_direct(direct: Column, browser: Column, direct_hash: Column, browser_hash: Column) -> Column:
    """struct(length_ratio, same_hash): ratio of lengths to three places, null for an empty direct text."""
    ratio = F.round(browser / F.nullif(direct, F.lit(0)), 3)
    return F.struct(ratio.alias("length_ratio"), direct_hash.eqNullSafe(browser_hash).alias("same_hash"))


def retry_schedule(delay_ms: int = 10, attempts: int = 3) -> list[int]:
    """Linear waits in ms after each failed attempt but the last."""
    if attempts < 1 or delay_ms < 0:
        raise ValueError("attempts must be positive and the delay not negative")
    return [delay_ms * k for k in range(1, attempts)]


def with_retry(action, is_retryable_error, delay_ms: int = 10, attempts: int = 3, sleep=None):
    """Runs an idempotent write again after retryable errors; the last error is raised unchanged."""
    import time

    waits = retry_schedule(delay_ms, attempts)
    for k in range(attempts):
        try:
            return action()
        except Exception as error:
            if k == attempts - 1 or not is_retryable_error(error):
                raise
            (sleep or time.sleep)(waits[k] / 1000)
