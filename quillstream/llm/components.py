"""Connected components by alternating stars; no neighbourhood is ever gathered in one row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop_written, written


def connected_components(edges: DataFrame) -> DataFrame:
    """edges(a, b) -> (node, root): root is the smallest node that can be reached.

    Only nodes that have an edge to another node appear. Each round hooks every larger
    neighbour to the smallest one (large star), then every node to its smallest smaller
    neighbour (small star). Minima are aggregates with map-side partial results, and the
    edge table of a round is written to the shared folder, so lineage stays short. Ends when
    the edges form stars, which is when a round changes nothing; every round before lowers some neighbour, so it does end.
    """
    now = written(
        edges.where("a <> b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct(), "edges"
    )

    def mark(df: DataFrame):
        row = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)")).alias("h")).first()
        return row["n"], row["h"]

    seen = mark(now)
    while True:
        both = now.select(F.col("lo").alias("u"), F.col("hi").alias("v")).unionByName(now.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("lo"), F.col("v").alias("hi")).where("lo <> hi").distinct()
        small_least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(small_least, "hi").select(F.col("m"), F.col("lo"), F.col("hi"))
        after = written(
            small.select(F.explode(F.array("lo", "hi")).alias("x"), "m").where("x <> m").select(F.col("m").alias("lo"), F.col("x").alias("hi")).distinct(),
            "edges",
        )
        drop_written(now)
        now, before, seen = after, seen, mark(after)
        if seen == before:
            break
    stars = now.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    return stars.unionByName(now.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
