"""Writers: compact JSON lines, keyed compaction, and streams that append each key once."""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexloom.sources.manifests import files


def json_lines(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def compacted(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key, by order."""
    last = Window.partitionBy(key).orderBy(F.col(order).desc())
    return df.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def replace(df: DataFrame, path: str, format: str = "parquet") -> None:
    """df in place of what is at path: written beside it and moved there when it is whole, so readers find the old or the new table and a job that fails changes nothing."""
    spark = df.sparkSession
    beside, old = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    df.write.format(format).save(beside)
    there, new, gone = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (path, beside, old))
    store = there.getFileSystem(spark._jsc.hadoopConfiguration())
    if store.exists(there) and not store.rename(there, gone):
        raise OSError(f"{path} can't be moved")
    if not store.rename(new, there):
        raise OSError(f"{beside} can't be moved to {path}")
    store.delete(gone, True)


def document(spark: SparkSession, value: Any, path: str) -> None:
    """A small report as a JSON document, in place of what is at path; manifests.document() reads it."""
    replace(spark.createDataFrame([(json.dumps(value, ensure_ascii=False, indent=2, sort_keys=True),)], "value string").coalesce(1), path, "text")


def compact(df: DataFrame, key: str, order: str, path: str) -> None:
    """The last row of each key, sorted by key over all files, in place of what is at path (which df may read)."""
    replace(compacted(df, key, order).orderBy(key), path)


def outcomes(df: DataFrame, path: str) -> None:
    """Accepted and rejected rows in folders of their own, in one pass."""
    df.withColumn("outcome", F.when(F.col("reject_reason").isNull(), "accepted").otherwise("rejected")).write.mode("overwrite").partitionBy("outcome").parquet(path)


def append_once(stream: DataFrame, key: str, path: str, checkpoint: str) -> StreamingQuery:
    """A stream appended to a table of its own; a key that came before, or comes again, is left out.

    The keys seen are the stream's state: a batch costs what its rows and their keys' partitions of the state cost,
    however large the table has grown (with the session's RocksDB state store, only the keys asked for are read).
    State and table are committed by batch, so a restart from the checkpoint neither loses nor repeats a row.
    """
    first = stream.dropDuplicates([key])
    return first.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ledger(sessions: DataFrame, path: str) -> DataFrame:
    """Appends sessions (session, seconds) and gives the totals of all that were written: session, runs, seconds."""
    # Microseconds as decimals, so that the sum doesn't depend on the order.
    sessions.select("session", F.col("seconds").cast("decimal(24,6)").alias("seconds")).write.mode("append").parquet(path)
    every = sessions.sparkSession.read.parquet(path)
    return every.groupBy("session").agg(F.count("*").alias("runs"), F.sum("seconds").alias("seconds"))


def release(rows: DataFrame, key: str, groups: str, expected: dict[str, int], path: str) -> DataFrame:
    """Writes rows as a release if keys are unique and each group has its expected size, else an error before anything is written.

    Gives (path, bytes, digest) of the written files.
    """
    sizes = {r[groups]: r.n for r in rows.groupBy(groups).agg(F.count("*").alias("n")).collect()}  # a catalogue
    if sizes != expected:
        wrong = sorted((k for k in {*sizes, *expected} if sizes.get(k) != expected.get(k)), key=str)
        raise ValueError("group sizes differ: " + "; ".join(f"{k}: {sizes.get(k, 0)} rows for {expected.get(k, 0)}" for k in wrong))
    twice = rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").orderBy(key).limit(5).collect()
    if twice:
        raise ValueError("repeated keys: " + ", ".join(str(r[key]) for r in twice))
    json_lines(rows.orderBy(key), path)
    return files(rows.sparkSession, path, "part-*")
