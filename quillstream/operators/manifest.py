"""Validation of a labelled manifest: JSON text to typed rows, issues as rows (path order), semantics of cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .evaluation import CATEGORIES, KINDS, LABEL_STATUSES

SCHEMA_VERSION = "2.0.0"
# Closed sets of the manifest.
VERIFICATIONS = ("url-observed", "page-fetched", "extraction-ready")
UNCERTAINTIES = ("none", "rumor", "allegation", "estimate", "sensitive")
RELATIONS = ("same-event", "related-not-merge", "different-event", "preserve-uncertainty", "preserve-numeric-facts", "preserve-timeline")
METHODS = ("project-seed", "human-review")
RELATION_OF_KIND = dict(zip(KINDS, RELATIONS))

ARTICLE = ("id", "category", "sourceId", "title", "canonicalUrl", "observedDate", "verification", "contentType", "uncertainty")
CASE = ("id", "kind", "expectedRelation", "expectedClusterId", "evaluationFocus", "knownUncertainty")
PROVENANCE = ("status", "method", "reviewedAt", "notes")


def _text(v: Column, name: str) -> Column:
    """A field that is a JSON string; null for any other kind of value."""
    field = F.try_variant_get(v, f"$.{name}", "variant")
    return F.when(F.schema_of_variant(field) == "STRING", F.try_variant_get(field, "$", "string"))


def _texts(v: Column, name: str) -> Column:
    """A field that is a list, with null for members that are no strings; null for any other kind of value."""
    members = F.try_variant_get(v, f"$.{name}", "array<variant>")
    return F.transform(members, lambda m: F.when(F.schema_of_variant(m) == "STRING", F.try_variant_get(m, "$", "string")))


def blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


def is_date(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(c, "yyyy-MM-dd").isNotNull(), F.lit(False))


def is_https(c: Column) -> Column:
    return F.coalesce(F.lower(F.try_parse_url(c, F.lit("PROTOCOL"))) == "https", F.lit(False))


def not_in(c: Column, values: tuple[str, ...]) -> Column:
    return ~F.coalesce(c.isin(*values), F.lit(False))


def load(spark: SparkSession, path: str) -> DataFrame:
    """The manifest as one row: articles and cases as arrays of JSON texts."""
    text = spark.read.text(path, wholetext=True).withColumnRenamed("value", "body")
    return parse(text)


def parse(manifests: DataFrame) -> DataFrame:
    """manifests(body) -> schema_version, dataset_version, generated_at, legal_boundary, articles, cases (arrays of JSON), kept even where wrong."""
    v = F.col("__v")
    listed = lambda n: F.when(F.schema_of_variant(F.try_variant_get(v, f"$.{n}", "variant")).startswith("ARRAY"), F.transform(F.try_variant_get(v, f"$.{n}", "array<variant>"), lambda m: F.to_json(m)))
    return manifests.select(F.try_parse_json("body").alias("__v")).select(  # parsed once for all fields
        _text(v, "schemaVersion").alias("schema_version"), _text(v, "datasetVersion").alias("dataset_version"), _text(v, "generatedAt").alias("generated_at"),
        _text(v, "legalBoundary").alias("legal_boundary"), listed("articles").alias("articles"), listed("cases").alias("cases"),
    )


def root_issues(manifest: DataFrame) -> DataFrame:
    said = F.array(
        F.when(~F.col("schema_version").eqNullSafe(SCHEMA_VERSION), f"schemaVersion must be {SCHEMA_VERSION}"),
        *(F.when(blank(F.col(c)), f"{name} must be a non-empty string") for c, name in (("dataset_version", "datasetVersion"), ("generated_at", "generatedAt"), ("legal_boundary", "legalBoundary"))),
        F.when(F.col("articles").isNull(), "articles must be an array"), F.when(F.col("cases").isNull(), "cases must be an array"),
    )
    return manifest.select(F.posexplode(said).alias("pos", "issue")).where("issue is not null")


def _listed(manifest: DataFrame, name: str) -> DataFrame:
    """(index, v) of a list's members. An inner explode would have the optimizer infer a filter on the list, for which each text is made and parsed again."""
    rows = manifest.select(F.posexplode_outer(name).alias("index", "json")).where("index is not null")
    return rows.select("index", F.try_parse_json("json").alias("v"))


def articles_of(manifest: DataFrame) -> DataFrame:
    """(index, the fields of an article); values of a wrong JSON type are null."""
    rows = _listed(manifest, "articles")
    return rows.select("index", *(_text(F.col("v"), n).alias(n) for n in ARTICLE), _texts(F.col("v"), "entities").alias("entities"))


def cases_of(manifest: DataFrame) -> DataFrame:
    """(index, the fields of a case); values of a wrong JSON type are null."""
    rows = _listed(manifest, "cases")
    p = F.try_variant_get("v", "$.labelProvenance", "variant")
    provenance = F.when(F.schema_of_variant(p).startswith("OBJECT"), F.struct(*(_text(p, n).alias(n) for n in PROVENANCE), _texts(p, "reviewedBy").alias("reviewedBy")))
    return rows.select("index", *(_text(F.col("v"), n).alias(n) for n in CASE), _texts(F.col("v"), "articleIds").alias("articleIds"), provenance.alias("labelProvenance"))


def _exploded(rows: DataFrame, path: str, said: list[Column]) -> DataFrame:
    listed = rows.select("index", F.posexplode(F.array(*said)).alias("pos", "said")).where("said is not null")
    return listed.select("index", "pos", F.concat(F.lit(f"{path}["), F.col("index").cast("string"), F.lit("]"), "said").alias("issue"))


def article_issues(articles: DataFrame) -> DataFrame:
    """(index, pos, issue) for rows of the ARTICLE shape."""
    required = lambda c: F.when(blank(F.col(c)), f".{c} must be a non-empty string")
    unsupported = lambda c, values: F.when(not_in(F.col(c), values), f".{c} is unsupported")
    names = F.coalesce(F.exists("entities", blank), F.lit(True))
    return _exploded(articles, "articles", [
        required("id"), unsupported("category", CATEGORIES), required("sourceId"), required("title"), required("canonicalUrl"),
        F.when(~blank(F.col("canonicalUrl")) & ~is_https(F.col("canonicalUrl")), ".canonicalUrl must be HTTPS"), required("observedDate"),
        F.when(~blank(F.col("observedDate")) & ~is_date(F.col("observedDate")), ".observedDate must use YYYY-MM-DD"), unsupported("verification", VERIFICATIONS),
        required("contentType"), F.when(names, ".entities must contain non-empty strings"), unsupported("uncertainty", UNCERTAINTIES),
    ])


def repeated(rows: DataFrame, column: str, message: str) -> DataFrame:
    """One row with the message if two rows share a value."""
    return rows.where(~blank(F.col(column))).groupBy(column).count().where("count > 1").limit(1).select(F.lit(message).alias("issue"))


def case_issues(cases: DataFrame, articles: DataFrame) -> DataFrame:
    """(index, pos, issue) for rows of the CASE shape, references to unknown articles last."""
    c = F.col
    required = lambda n: F.when(blank(c(n)), f".{n} must be a non-empty string")
    p = lambda n: c(f"labelProvenance.{n}")
    none = c("labelProvenance").isNull()
    accepted = F.coalesce(p("status") == "accepted", F.lit(False))
    said = [
        required("id"), F.when(not_in(c("kind"), KINDS), ".kind is unsupported"), F.when(F.coalesce(F.size("articleIds"), F.lit(0)) <= 0, ".articleIds must be a non-empty array"),
        F.when(F.size(F.array_distinct("articleIds")) < F.size("articleIds"), ".articleIds must be unique"), F.when(not_in(c("expectedRelation"), RELATIONS), ".expectedRelation is unsupported"),
        required("evaluationFocus"), required("knownUncertainty"), F.when(none, ".labelProvenance must be an object"),
        F.when(~none & not_in(p("status"), LABEL_STATUSES), ".labelProvenance.status is unsupported"), F.when(~none & not_in(p("method"), METHODS), ".labelProvenance.method is unsupported"),
        F.when(~none & F.coalesce(F.exists(p("reviewedBy"), blank), F.lit(True)), ".labelProvenance.reviewedBy must be a string array"),
        F.when(~none & blank(p("notes")), ".labelProvenance.notes must be a non-empty string"), F.when(accepted & ~p("method").eqNullSafe("human-review"), " accepted labels require human-review provenance"),
        F.when(accepted & (F.coalesce(F.size(p("reviewedBy")), F.lit(0)) <= 0), " accepted labels require at least one reviewer"),
        F.when(accepted & F.try_to_timestamp(p("reviewedAt")).isNull(), " accepted labels require reviewedAt"),
    ]
    listed = cases.select("index", F.posexplode("articleIds").alias("at", "id"))
    unknown = listed.join(articles.select("id").where(~blank(c("id"))), "id", "left_anti").select(
        "index", (F.lit(100) + c("at")).alias("pos"), F.concat(F.lit("cases["), c("index").cast("string"), F.lit("].articleIds references unknown article "), "id").alias("issue")
    )
    return _exploded(cases, "cases", said).unionByName(unknown)


def validate(manifest: DataFrame) -> DataFrame:
    """(part, index, pos, issue): order by them for the report. A manifest without both arrays gets root issues only."""
    articles, cases = articles_of(manifest), cases_of(manifest)
    whole = manifest.where("articles is not null and cases is not null")
    both = F.lit(-1)
    parts = [
        root_issues(manifest).select(F.lit(0).alias("part"), both.alias("index"), "pos", "issue"), article_issues(articles_of(whole)).select(F.lit(1).alias("part"), "index", "pos", "issue"),
        case_issues(cases_of(whole), articles).select(F.lit(3).alias("part"), "index", "pos", "issue"),
    ]
    for part, rows, column, message in ((2, articles, "id", "article IDs must be unique"), (2, articles, "canonicalUrl", "canonical URLs must be unique"), (4, cases, "id", "case IDs must be unique")):
        parts.append(repeated(rows, column, message).select(F.lit(part).alias("part"), both.alias("index"), F.lit(0).alias("pos"), "issue"))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def semantic_issues(cases: DataFrame, articles: DataFrame) -> DataFrame:
    """cases(id, kind, articleIds, expectedRelation, expectedClusterId), articles(id, category) -> (id, pos, issue)."""
    seen = cases.where("kind = 'same-event'").select("id", F.explode("articleIds").alias("a"))
    known = articles.select(F.col("id").alias("a"), "category").where("category is not null")
    crossing = seen.join(known, "a").groupBy("id").agg(F.countDistinct("category").alias("categories"))
    rows = cases.join(crossing, "id", "left")
    wanted = F.element_at(F.create_map(*(F.lit(x) for pair in RELATION_OF_KIND.items() for x in pair)), F.col("kind"))
    n, kind = F.coalesce(F.size("articleIds"), F.lit(0)), F.col("kind")
    said = F.array(
        F.when(~F.col("expectedRelation").eqNullSafe(wanted), F.concat(F.lit(" kind "), kind, F.lit(" requires relation "), wanted)),
        F.when(kind.isin(*KINDS[:3]) & (n < 2), " requires at least two articles"),
        F.when((kind == "same-event") & blank(F.col("expectedClusterId")), " same-event case requires expectedClusterId"),
        F.when((kind == "same-event") & (F.col("categories") > 1), " same-event articles cross categories"),
        F.when((kind == "hard-negative") & (F.size(F.array_distinct("articleIds")) < 2), " hard-negative requires distinct articles"),
    )
    return rows.select("id", F.posexplode(said).alias("pos", "said")).where("said is not null").select("id", "pos", F.concat("id", "said").alias("issue"))


def source_issues(sources: DataFrame) -> DataFrame:
    """sources(pos, id, feed_url, poll_minutes) -> (pos, n, issue) in row order; a URL that does not parse skips the checks after it."""
    again = lambda c: F.row_number().over(Window.partitionBy(c).orderBy("pos")) > 1
    rows = sources.withColumn("__id", again("id")).withColumn("__url", again("feed_url"))
    scheme = F.lower(F.try_parse_url("feed_url", F.lit("PROTOCOL")))
    bad = scheme.isNull()
    poll = F.col("poll_minutes").cast("double")
    said = F.array(
        F.when(F.col("__id"), F.concat(F.lit("Duplicate source ID: "), "id")), F.when(F.col("__url"), F.concat(F.lit("Duplicate feed URL: "), "feed_url")),
        F.when(bad, F.concat(F.lit("Invalid feed URL for "), "id", F.lit(": "), "feed_url")), F.when(~bad & (scheme != "https"), F.concat(F.lit("Feed URL must use HTTPS for "), "id")),
        F.when(~bad & ~F.coalesce((poll >= 5) & (poll == F.floor(poll)), F.lit(False)), F.concat(F.lit("pollMinutes must be an integer >= 5 for "), "id")),
    )
    return rows.select("pos", F.posexplode(said).alias("n", "issue")).where("issue is not null")
