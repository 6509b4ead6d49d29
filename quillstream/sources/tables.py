"""Tables of the article store: schemas, parquet and JDBC access, constraint checks, JSON sink."""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "sources": "id string, category string, publisher string, feed_url string, poll_interval_seconds int, acquisition string, legal_status string",
    "source_endpoints": "source_id string, url string, kind string, enabled boolean",
    "articles": "article_id string, canonical_url string, title string, author string, author_status string, published_at timestamp, content_hash string, current_version_number int, first_seen_at timestamp, last_seen_at timestamp",
    "article_sources": "article_id string, source_id string, source_article_id string, first_seen_at timestamp, last_seen_at timestamp",
    "article_versions": "article_id string, version_number int, content_hash string, normalized_text string, text_length int, paragraph_count int, extraction_strategy string, observed_at timestamp",
    "ingestion_runs": "id string, idempotency_key string, kind string, status string, attempt int, max_attempts int",
    "processing_failures": "id string, run_id string, category string, retryable boolean, message string",
}
#: table -> unique keys (rows where a part is null are not compared)
UNIQUE = {
    "sources": [("id",)], "source_endpoints": [("source_id", "url")], "articles": [("article_id",), ("canonical_url",)],
    "article_sources": [("article_id", "source_id"), ("source_id", "source_article_id")], "article_versions": [("article_id", "version_number")],
    "ingestion_runs": [("idempotency_key",)], "processing_failures": [("id",)],
}
#: table -> (name, condition that every row must meet)
CHECKS = {
    "sources": [("poll", "poll_interval_seconds > 0")], "source_endpoints": [("https", "url like 'https://%'")],
    "articles": [("version", "current_version_number > 0"), ("https", "canonical_url like 'https://%'")],
    "article_versions": [("version", "version_number > 0"), ("length", "text_length >= 0"), ("paragraphs", "paragraph_count >= 0")],
    "ingestion_runs": [("attempt", "attempt > 0"), ("attempts", "max_attempts >= attempt")],
}
# Closed sets of columns.
ENUMS = {
    ("sources", "category"): ("technology", "entertainment", "sports", "other"), ("source_endpoints", "kind"): ("rss", "api", "html"), ("articles", "author_status"): ("reported", "unknown"),
    ("ingestion_runs", "kind"): ("source-poll", "article-fetch", "article-process", "story-match", "story-summarize"), ("ingestion_runs", "status"): ("queued", "running", "succeeded", "partial", "failed", "cancelled"),
    ("processing_failures", "category"): ("network", "timeout", "rate-limit", "invalid-feed", "invalid-html", "extraction", "validation", "persistence", "provider", "unknown"),
}
#: (table, column) -> table whose key it must name
REFERENCES = {
    ("source_endpoints", "source_id"): ("sources", "id"), ("article_sources", "article_id"): ("articles", "article_id"),
    ("article_sources", "source_id"): ("sources", "id"), ("article_versions", "article_id"): ("articles", "article_id"), ("processing_failures", "run_id"): ("ingestion_runs", "id"),
}


def _hadoop(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _current(spark: SparkSession, root: str) -> dict[str, str]:
    """table -> folder of its rows, as the newest manifest under root has it."""
    at, fs = _hadoop(spark, f"{root}/_manifests")
    names = sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []
    names = [n for n in names if n.endswith(".json")]
    return json.loads(spark.read.text(f"{root}/_manifests/{names[-1]}", wholetext=True).first().value) if names else {}


def read(spark: SparkSession, root: str, name: str) -> DataFrame:
    folder = _current(spark, root).get(name)
    if folder is None:
        raise ValueError(f"no table {name} under {root}")
    return spark.read.schema(SCHEMAS[name]).parquet(f"{root}/{folder}")


def write_all(tables: dict[str, DataFrame], root: str) -> None:
    """Replaces several tables at once: rows go to new folders, then one manifest names them, so readers see all of the old or all of the new tables.

    The manifest is made by a rename to the next number, which fails if another writer was first; then nothing has changed. Folders of former
    manifests stay until clean()."""
    if not tables:
        return
    spark = next(iter(tables.values())).sparkSession
    held = _current(spark, root)
    at, fs = _hadoop(spark, f"{root}/_manifests")
    fs.mkdirs(at)
    number = 1 + max((int(x.getPath().getName()[:-5]) for x in fs.listStatus(at) if x.getPath().getName().endswith(".json")), default=0)
    for name, df in tables.items():
        folder = f"{name}-{uuid.uuid4().hex}"
        df.write.parquet(f"{root}/{folder}")
        held = held | {name: folder}
    staged, _ = _hadoop(spark, f"{root}/_manifests/{uuid.uuid4().hex}.staged")
    out = fs.create(staged)
    out.write(bytearray(json.dumps(held).encode("utf-8")))
    out.close()
    final, _ = _hadoop(spark, f"{root}/_manifests/{number:012d}.json")
    if fs.exists(final) or not fs.rename(staged, final):
        raise RuntimeError("another writer was first; nothing was changed")


def write(df: DataFrame, root: str, name: str) -> None:
    """Replaces one table."""
    write_all({name: df}, root)


def clean(spark: SparkSession, root: str) -> None:
    """Deletes the folders that the newest manifest does not name; for times without readers of older ones."""
    kept = set(_current(spark, root).values())
    at, fs = _hadoop(spark, root)
    for x in fs.listStatus(at):
        if x.getPath().getName() not in kept | {"_manifests"}:
            fs.delete(x.getPath(), True)


def _postgres(url: str) -> str:
    if not url.lower().removeprefix("jdbc:").startswith(("postgres://", "postgresql://")):
        raise ValueError("a PostgreSQL URL is required")
    return url


def write_jdbc(df: DataFrame, url: str, table: str, connections: int = 5, **options: str) -> None:
    """Appends rows over at most `connections` connections at a time; each partition is one transaction."""
    df.coalesce(connections).write.format("jdbc").mode("append").options(url=_postgres(url), dbtable=table, connectTimeout="10", **options).save()


def read_jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    return spark.read.format("jdbc").options(url=_postgres(url), dbtable=table, **options).load()


def violations(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, constraint, n) of every check, key and reference that rows break."""
    out = []
    for name, df in tables.items():
        for check, condition in CHECKS.get(name, []):
            out.append(df.where(f"not ({condition})").agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), F.lit(f"check {check}").alias("constraint"), "n"))
        for (table, column), values in ENUMS.items():
            if table == name:
                wrong = df.where(F.col(column).isNotNull() & ~F.col(column).isin(*values))
                out.append(wrong.agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), F.lit(f"enum {column}").alias("constraint"), "n"))
        for key in UNIQUE.get(name, []):
            whole = df.na.drop(subset=list(key)).groupBy(*key).agg(F.count("*").alias("c")).where("c > 1")
            out.append(whole.agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), F.lit(f"unique {', '.join(key)}").alias("constraint"), "n"))
        for (table, column), (other, key) in REFERENCES.items():
            if table == name and other in tables:
                lost = df.where(F.col(column).isNotNull()).join(tables[other].select(F.col(key).alias(column)), column, "left_anti")
                out.append(lost.agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), F.lit(f"reference {column}").alias("constraint"), "n"))
    return reduce(DataFrame.unionByName, out).where("n > 0")


def to_json(df: DataFrame) -> DataFrame:
    """One JSON text per row; absent fields are left out."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "true"}).alias("value"))
