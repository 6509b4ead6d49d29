"""Article identity, append-only versions, heads and provenance links, as set operations over an ordered batch of snapshots.

The order is (observed_at, seq). When every canonical URL and every stable id of a batch belongs to one chain, identity is the
URL's group and windows do the rest. Otherwise the rows of one connected component are replayed in order.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut

ORDER = ("observed_at", "seq")
OPTIONAL = ("source_article_id", "author", "extraction_selector", "raw_artifact_key")


def tidy(snapshots: DataFrame) -> DataFrame:
    """Empty optional strings count as absent."""
    return snapshots.withColumns({c: F.nullif(F.col(c), F.lit("")) for c in OPTIONAL if c in snapshots.columns})


def known_sources(snapshots: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(snapshots of known sources, rejected ones): a missing source rejects the whole snapshot."""
    ids = sources.select(F.col("id").alias("source_id")).distinct()
    return snapshots.join(ids, "source_id", "left_semi"), snapshots.join(ids, "source_id", "left_anti")


def ambiguous_urls(snapshots: DataFrame) -> DataFrame:
    """Canonical URLs or stable ids that do not belong to one chain: a (source, id) seen with two URLs."""
    stable = snapshots.where("source_article_id is not null").groupBy("source_id", "source_article_id")
    return stable.agg(F.countDistinct("canonical_url").alias("urls")).where("urls > 1")


def with_versions(snapshots: DataFrame, article: str = "article_id") -> DataFrame:
    """Adds version_number (1 + changes of content_hash so far) and outcome: created, unchanged or version-appended."""
    w = Window.partitionBy(article).orderBy(*ORDER)
    before = F.lag("content_hash").over(w)
    first = F.row_number().over(w) == 1
    changed = first | ~F.col("content_hash").eqNullSafe(before)
    out = snapshots.withColumn("__first", first).withColumn("__changed", changed)
    number = F.sum(F.col("__changed").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    outcome = F.when(F.col("__first"), "created").when(F.col("__changed"), "version-appended").otherwise("unchanged")
    return out.withColumn("version_number", number.cast("int")).withColumn("outcome", outcome).drop("__first", "__changed")


def resolve(snapshots: DataFrame) -> DataFrame:
    """Adds article_id, sha256 of the key of the article's first snapshot, in the order of arrival.

    Stable (source, id) links come first, the article's current URL second. Both may change, so a component of rows that
    share any key is replayed; components are found over keys, and only those with an ambiguous key are replayed."""
    snapshots = tidy(snapshots)
    plain = F.sha2(F.col("canonical_url"), 256)
    if ambiguous_urls(snapshots).isEmpty():
        return snapshots.withColumn("article_id", plain)
    labelled = _components(snapshots)
    schema = snapshots.withColumn("article_id", F.lit("")).schema

    def replay(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(list(ORDER), kind="stable")
        by_link: dict[tuple, str] = {}
        by_url: dict[str, str] = {}
        url_of: dict[str, str] = {}
        found = []
        for source, own, url in zip(rows["source_id"], rows["source_article_id"], rows["canonical_url"]):
            link = None if own is None or pd.isna(own) else (source, own)
            article = by_link.get(link) if link else None
            article = article or by_url.get(url) or _sha(url)
            if by_url.get(url_of.get(article)) == article:
                del by_url[url_of[article]]
            by_url[url] = article
            url_of[article] = url
            if link:
                by_link[link] = article
            found.append(article)
        return rows.drop(columns="__c").assign(article_id=found)[[f.name for f in schema.fields]]

    return labelled.groupBy("__c").applyInPandas(replay, schema)


def _sha(url: str) -> str:
    import hashlib

    return hashlib.sha256((url or "").encode()).hexdigest()


def _components(snapshots: DataFrame) -> DataFrame:
    """Adds __c, one value per component of rows that share a URL or a (source, stable id): labels spread until they settle."""
    keys = snapshots.select("canonical_url", F.sha2(F.concat_ws("\u0000", "source_id", "source_article_id"), 256).alias("k"), F.col("source_article_id").isNotNull().alias("s"))
    edges = keys.where("s").select(F.sha2("canonical_url", 256).alias("u"), "k").distinct()
    label = keys.select(F.sha2("canonical_url", 256).alias("u")).distinct().withColumn("c", F.col("u"))
    while True:
        per_key = edges.join(label, "u").groupBy("k").agg(F.min("c").alias("m"))
        least = edges.join(per_key, "k").groupBy("u").agg(F.min("m").alias("m"))
        after = cut(label.join(least, "u", "left").select("u", F.least("c", F.coalesce("m", "c")).alias("c")))
        settled = after.join(label.withColumnRenamed("c", "b"), "u").where("c <> b").isEmpty()
        label = after
        if settled:
            break
    return snapshots.withColumn("__u", F.sha2("canonical_url", 256)).join(label.select(F.col("u").alias("__u"), F.col("c").alias("__c")), "__u").drop("__u")


def version_rows(versioned: DataFrame) -> DataFrame:
    """The rows that append a version."""
    return versioned.where("outcome <> 'unchanged'")


def heads(versioned: DataFrame, article: str = "article_id") -> DataFrame:
    """The latest processed snapshot of each article, absent fields cleared, with first_seen and last_seen."""
    w = Window.partitionBy(article).orderBy(*(F.col(c).desc() for c in reversed(ORDER)))
    whole = Window.partitionBy(article)
    out = versioned.withColumn("first_seen_at", F.min_by("observed_at", F.struct(*ORDER)).over(whole)).withColumn("__n", F.row_number().over(w))
    return out.where("__n = 1").drop("__n", "outcome").withColumnRenamed("observed_at", "last_seen_at").withColumnRenamed("version_number", "current_version_number")


def links(versioned: DataFrame, article: str = "article_id") -> DataFrame:
    """One row per (article, source): first and last seen, and the source's own id as last reported, null included."""
    last = F.max_by(F.struct("source_article_id", "observed_at"), F.struct(*reversed(ORDER)))
    return versioned.groupBy(article, "source_id").agg(F.min_by("observed_at", F.struct(*ORDER)).alias("first_seen_at"), last.alias("l")).select(
        article, "source_id", F.col("l.source_article_id").alias("source_article_id"), "first_seen_at", F.col("l.observed_at").alias("last_seen_at")
    )


def idempotent(runs: DataFrame, key: str = "idempotency_key", order: str = "seq") -> DataFrame:
    """The first run of each key."""
    return runs.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("__n = 1").drop("__n")


def persist(snapshots: DataFrame, sources: DataFrame) -> dict[str, DataFrame]:
    """The tables that a batch writes: articles, article_versions, article_sources, results; and what it turns away."""
    from .routing import persistable

    ready, quarantined = persistable(snapshots)
    known, rejected = known_sources(ready, sources)
    versioned = with_versions(resolve(known))
    return {
        "articles": heads(versioned), "article_versions": version_rows(versioned), "article_sources": links(versioned),
        "results": versioned.select("seq", "outcome", "article_id", "version_number"), "quarantined": quarantined, "rejected": rejected,
    }


def lookup(incoming: DataFrame, known_links: DataFrame, articles: DataFrame) -> DataFrame:
    """incoming(seq, source_id, source_article_id, canonical_url) -> adds article_id of the stored article: by stable id first, then by URL."""
    by_link = known_links.select("source_id", "source_article_id", F.col("article_id").alias("__link"))
    by_url = articles.select("canonical_url", F.col("article_id").alias("__url"))
    joined = incoming.join(by_link, ["source_id", "source_article_id"], "left").join(by_url, "canonical_url", "left")
    return joined.withColumn("article_id", F.coalesce("__link", "__url")).withColumn("matched_by", F.when(F.col("__link").isNotNull(), "stable-id").when(F.col("__url").isNotNull(), "canonical-url")).drop("__link", "__url")
