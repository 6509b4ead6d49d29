"""Labelled evaluation of relation decisions; accepted and provisional labels never mix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .relations import case_pairs, relate

POLICY_VERSION = "event-relation-v1"
# What a case of each kind should be classified as; other kinds are skipped.
EXPECTED = {"same-event": "same-event-candidate", "related-subevent": "related-not-merge", "hard-negative": "different-event"}
KINDS = ("same-event", "related-subevent", "hard-negative", "uncertainty", "numeric-fact", "developing-story")
CATEGORIES = ("technology", "entertainment", "sports")
LABEL_STATUSES = ("provisional", "accepted", "rejected")
# Coverage minimums.
COVERAGE = {"articles": 30, "per_category": 10, "cases": 14, "multi_source": 4, "hard_negative": 4, "uncertainty": 2}


def expected_relation(kind: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in EXPECTED.items() for x in pair)), kind)


def roll_up(cases: DataFrame, decided: DataFrame) -> DataFrame:
    """cases(case_id, kind, label_status), decided(case_id, relation) -> one row per evaluated case.

    One distinct relation is the prediction, none or several are `mixed`; a case without pairs matches."""
    known = cases.withColumn("expected_relation", expected_relation(F.col("kind"))).where("expected_relation is not null")
    found = decided.groupBy("case_id").agg(F.collect_set("relation").alias("relations"))  # at most four values
    out = known.join(found, "case_id", "left").withColumn("relations", F.coalesce("relations", F.array().cast("array<string>")))
    return out.select(
        "case_id", "kind", "label_status", "expected_relation",
        F.when(F.size("relations") == 1, F.col("relations")[0]).otherwise("mixed").alias("predicted_relation"),
        F.forall("relations", lambda r: r == F.col("expected_relation")).alias("matches_expected"),
    )


def summary(evaluated: DataFrame, cases: DataFrame) -> DataFrame:
    """One row: evaluated, skipped, hard-negative failures, and cases, matches and mismatches of both label kinds."""
    good, status = F.col("matches_expected"), F.col("label_status")
    parts = []
    for name in ("accepted", "provisional"):
        own = status == name
        parts += [F.count_if(own).alias(f"{name}_cases"), F.count_if(own & good).alias(f"{name}_matches"), F.count_if(own & ~good).alias(f"{name}_mismatches")]
    counted = evaluated.agg(F.count("*").alias("evaluated_cases"), F.count_if((F.col("kind") == "hard-negative") & ~good).alias("hard_negative_failures"), *parts)
    total = cases.agg(F.count("*").alias("__all"))
    return counted.crossJoin(total).withColumn("skipped_cases", F.col("__all") - F.col("evaluated_cases")).drop("__all")  # one row each


def blocking(evaluated: DataFrame, strict: bool = False) -> DataFrame:
    """Cases that fail a gate: accepted or hard-negative mismatches; with strict, provisional mismatches too."""
    wrong = ~F.col("matches_expected")
    always = (F.col("label_status") == "accepted") | (F.col("kind") == "hard-negative")
    gate = always | (F.col("label_status") == "provisional") if strict else always
    return evaluated.where(wrong & gate).select("case_id").distinct()


def gate_counts(evaluated: DataFrame, strict: bool = False) -> DataFrame:
    """One row: passed, total and the exit code of a run, 1 if a gate fails."""
    failed = blocking(evaluated, strict).withColumn("failed", F.lit(True))
    joined = evaluated.select("case_id").join(failed, "case_id", "left")
    counted = joined.agg(F.count_if(F.col("failed").isNull()).alias("passed"), F.count("*").alias("total"))
    return counted.withColumn("exit_code", F.when(F.col("passed") < F.col("total"), 1).otherwise(0))


def unknown_references(cases: DataFrame, articles: DataFrame) -> DataFrame:
    """(case_id, id) of listed articles that do not exist."""
    listed = cases.select("case_id", F.explode("article_ids").alias("id"))
    return listed.join(articles.select("id"), "id", "left_anti").select("case_id", "id").distinct()


def evaluate(cases: DataFrame, articles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(evaluated cases, summary)."""
    judged = cases.where(F.col("kind").isin(*EXPECTED))
    # a pair with an unknown article matches no expectation, so its case fails
    decided = relate(case_pairs(judged), articles).select("case_id", F.coalesce("decision.relation", F.lit("unknown-article")).alias("relation"))
    evaluated = roll_up(cases, decided)
    return evaluated, summary(evaluated, cases)


def zero_filled(rows: DataFrame, column: str, values: tuple[str, ...]) -> DataFrame:
    """(value, n): a count for every value of a closed set."""
    names = rows.sparkSession.createDataFrame([(v,) for v in values], "value string")
    counts = rows.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return names.join(counts, "value", "left").select("value", F.coalesce("n", F.lit(0)).alias("n"))


def multi_source_cases(cases: DataFrame, articles: DataFrame) -> DataFrame:
    """same-event cases whose known articles come from two sources at least."""
    listed = cases.where("kind = 'same-event'").select("case_id", F.explode("article_ids").alias("id"))
    sources = listed.join(articles.select("id", "source_id"), "id").groupBy("case_id").agg(F.countDistinct("source_id").alias("sources"))
    return sources.where("sources >= 2")


def inventory(cases: DataFrame, articles: DataFrame) -> DataFrame:
    """(dimension, value, n) of categories, kinds, label statuses, and the number of multi-source cases."""
    parts = [("category", articles, "category", CATEGORIES), ("case_kind", cases, "kind", KINDS), ("label_status", cases, "label_status", LABEL_STATUSES)]
    out = multi_source_cases(cases, articles).agg(F.count("*").alias("n")).select(F.lit("multi_source").alias("dimension"), F.lit("same-event").alias("value"), "n")
    for name, rows, column, values in parts:
        out = out.unionByName(zero_filled(rows, column, values).select(F.lit(name).alias("dimension"), "value", "n"))
    return out


def coverage_issues(counts: DataFrame, policy: dict[str, int] = COVERAGE) -> DataFrame:
    """inventory() -> (pos, issue) of every minimum that is missed, in fixed order."""
    n = lambda d, v=None: F.coalesce(F.sum(F.when((F.col("dimension") == d) & (F.lit(True) if v is None else F.col("value") == v), F.col("n"))), F.lit(0))
    checks = [("articleCount", n("category"), policy["articles"])]
    checks += [(f"{c} article count", n("category", c), policy["per_category"]) for c in CATEGORIES]
    checks += [
        ("caseCount", n("case_kind"), policy["cases"]), ("multiSourceSameEventCases", n("multi_source"), policy["multi_source"]),
        ("hardNegativeCases", n("case_kind", "hard-negative"), policy["hard_negative"]), ("uncertaintyCases", n("case_kind", "uncertainty"), policy["uncertainty"]),
    ]
    row = counts.agg(*(value.alias(f"v{i}") for i, (_, value, _) in enumerate(checks)))
    said = [F.when(F.col(f"v{i}") < least, F.concat(F.lit(f"{name} "), F.col(f"v{i}").cast("string"), F.lit(f" is below {least}"))) for i, (name, _, least) in enumerate(checks)]
    return row.select(F.posexplode(F.array(*said)).alias("pos", "issue")).where("issue is not null")
