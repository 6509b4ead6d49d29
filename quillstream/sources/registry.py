"""The feed registry as a small DataFrame, and lookups by id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "pos int, id string, category string, publisher string, feed_url string, poll_minutes int, acquisition string, legal_status string"
# Id, category, publisher, feed, minutes between polls.
FEEDS = (
    ("vne-tech", "technology", "VnExpress", "https://vnexpress.net/rss/khoa-hoc-cong-nghe.rss", 15),
    ("tto-tech", "technology", "Tuổi Trẻ", "https://tuoitre.vn/nhip-song-so.rss", 15),
    ("tn-tech", "technology", "Thanh Niên", "https://thanhnien.vn/rss/cong-nghe.rss", 15),
    ("vne-ent", "entertainment", "VnExpress", "https://vnexpress.net/rss/giai-tri.rss", 15),
    ("tto-ent", "entertainment", "Tuổi Trẻ", "https://tuoitre.vn/giai-tri.rss", 15),
    ("tn-ent", "entertainment", "Thanh Niên", "https://thanhnien.vn/rss/giai-tri.rss", 15),
    ("vne-sport", "sports", "VnExpress", "https://vnexpress.net/rss/the-thao.rss", 10),
    ("tto-sport", "sports", "Tuổi Trẻ", "https://tuoitre.vn/the-thao.rss", 10),
    ("tn-sport", "sports", "Thanh Niên", "https://thanhnien.vn/rss/the-thao.rss", 10),
)


def sources(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *f, "rss", "poc-only") for i, f in enumerate(FEEDS)], SCHEMA)


def by_id(table: DataFrame, value: str, column: str = "id") -> DataFrame:
    """The row with an id; running it fails if there is none."""
    hit = table.where(F.col(column) == value)
    miss = F.raise_error(F.lit(f"Unknown {column}: {value}"))
    n = hit.agg(F.count("*").alias("n")).select(F.when(F.col("n") == 0, miss.cast("boolean")).otherwise(True).alias("__found"))
    return n.join(hit, F.lit(True), "left").where("__found").drop("__found")  # one row on the left
