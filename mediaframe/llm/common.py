"""What the operators of this subpackage share: the shared folder, saved tables, column checks."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid

import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir, or, where it is unset and the
    session runs in this process alone, a new temporary folder that the session then keeps. On a cluster an unset folder is an error."""
    conf = spark.sparkContext.getConf()
    folder = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="mediaframe-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def saved(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends there, so a lost executor costs a read and not the stages before. The files go when the application ends."""
    spark = df.sparkSession
    bound_batches(spark)
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**{"compression": "zstd"} | options).parquet(path)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of an Arrow batch, where the session has Spark's own default: a batch of 10,000 texts and its copies would take most of an executor's memory.
BATCH_ROWS = 1_000


def bound_batches(spark: SparkSession) -> None:
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(BATCH_ROWS))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns that most operators read, under fixed names; other columns may be called anything."""
    bound_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_kept: dict[str, dict] = {}


def kept_by(owner: str) -> dict:
    """What this worker process keeps for an operator from one task to the next. A worker serves the stages of all operators: what
    others have kept is dropped here, or a pipeline's workers would hold the sum of all."""
    stale = [kept for name, kept in _kept.items() if name != owner and kept]
    for kept in stale:
        kept.clear()
    if stale:
        gc.collect()
        trim()
    return _kept.setdefault(owner, {})


def trim() -> None:
    """Gives memory that is free in this process back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    give = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give:
        give(0)
