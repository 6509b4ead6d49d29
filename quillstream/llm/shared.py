"""Storage shared by driver and executors, and session settings of the operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch handed to Python; bounds a worker's memory on long texts.
ARROW_ROWS = 1000
#: Hadoop starts a `chmod` for each file and folder that it makes on a local disk, and until that has begun it shares all memory of the executor, which counts
#: twice meanwhile. Without checksum files these are two a task, not three. Other file systems are not concerned.
FEWER_PROCESSES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def prepare(spark: SparkSession) -> None:
    """Bounds the Arrow batches of the plans that follow (never raises a lower setting)."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def give_back() -> None:
    """Returns to the system what this worker's earlier tasks have freed; for tasks that begin by loading something large."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a machine-local one only in local mode, where driver and executors are one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="quillstream-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: lineage ends here and
    a lost executor costs nothing that was computed before."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/quillstream/{name}-{uuid.uuid4().hex}"
    df.write.options(**FEWER_PROCESSES).parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._quillstream_path = path
    return back


def drop_written(df: DataFrame) -> None:
    """Deletes a table made by written() that no later plan reads."""
    path = getattr(df, "_quillstream_path", None)
    if path:
        drop_folder(df.sparkSession, path)


def drop_folder(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def keyed_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only (doc_id long, text string); a null text counts as empty, rows without an id go."""
    return docs.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )


def with_row(docs: DataFrame, id_col: str = "doc_id", name: str = "__row") -> DataFrame:
    """docs with a long column that is different in every row and the same whenever the plan is run again:
    the id where it is unique and never null, else a number from a table written once."""
    twice = docs.groupBy(id_col).agg(F.count("*").alias("n")).where((F.col("n") > 1) | F.col(id_col).isNull())
    if twice.isEmpty():
        return docs.withColumn(name, F.col(id_col).cast("long"))
    numbered = written(docs.withColumn(name, F.monotonically_increasing_id()), "numbered")
    numbered._quillstream_numbered = True
    return numbered


def is_numbered(docs: DataFrame) -> bool:
    """Whether with_row() had to make numbers."""
    return getattr(docs, "_quillstream_numbered", False)


#: Ids that a broadcast may hold (8 bytes each); beyond it rows are dropped by a shuffled join.
BROADCAST_IDS = 1_000_000


def without(docs: DataFrame, gone: DataFrame, name: str, most: int = BROADCAST_IDS) -> DataFrame:
    """docs without the rows whose column `name` is in the one column of gone; texts move only if gone is too large to broadcast."""
    ids = written(gone.toDF("__gone").distinct(), "gone")
    if ids.count() <= most:
        ids = F.broadcast(ids)
    return docs.join(ids, docs[name] == ids["__gone"], "left_anti")
