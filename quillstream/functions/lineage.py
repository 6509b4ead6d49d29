"""Cutting lineage so that plans stay small and lost executors cost little."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """df in as many partitions as there are cores at least: a small table that makes much work lies in one or a few."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(4 * cores)


def cut(df: DataFrame) -> DataFrame:
    """df as a checkpoint in the folder named by spark.checkpoint.dir; a machine-local one only in local mode."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(folder or "spark-warehouse/checkpoints")
    return df.checkpoint()
