"""What the operators of this package share: table access, cut points of a lineage, words."""

from __future__ import annotations

import atexit
import re
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but space and the five ASCII control blanks.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = b" \t\n\x0b\x0c\r"
#: Rows a task hands to Python at a time; texts can be long.
ARROW_ROWS = 256


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Hand rows with whole texts to Python in small batches, so that a batch fits in memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir; on a single machine one is set here where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="lexloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def _path(spark: SparkSession, where: str):
    return spark._jvm.org.apache.hadoop.fs.Path(where)


def _files(spark: SparkSession, where: str):
    return _path(spark, where).getFileSystem(spark._jsc.hadoopConfiguration())


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is there goes when the driver ends."""
    where = f"{shared_folder(spark)}/lexloom-{name}-{uuid.uuid4().hex}"
    atexit.register(_forget_quietly, spark, where)
    return where


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df in the shared folder once and read it back.

    A lost executor then costs no more than the tasks it ran. The files go when the driver ends,
    or earlier with forget().
    """
    spark = df.sparkSession
    where = scratch(spark, name)
    df.write.parquet(where)
    out = spark.read.schema(df.schema).parquet(where)
    out._lexloom_path = where
    return out


def forget(df: DataFrame) -> None:
    """Delete the files behind a written() table that no later plan reads."""
    where = getattr(df, "_lexloom_path", None)
    if where:
        _files(df.sparkSession, where).delete(_path(df.sparkSession, where), True)


def release(spark: SparkSession) -> None:
    """Let Spark's context cleaner delete the shuffle files of jobs that are over.

    It learns of them when the driver collects its garbage, which an idle driver does rarely. What the
    first collection finds dead still holds the shuffles' records; a second one, a moment later, frees those.
    """
    spark._jvm.System.gc()
    time.sleep(0.3)
    spark._jvm.System.gc()


def _forget_quietly(spark: SparkSession, where: str) -> None:
    try:
        _files(spark, where).delete(_path(spark, where), True)
    except Exception:  # the JVM may be gone by then
        return


def input_bytes(docs: DataFrame) -> int:
    """The size of a table of texts, for choosing partition counts: Catalyst's estimate, or the texts' length where it has none."""
    estimate = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if estimate < 1 << 60:
        return estimate
    return docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))
