"""Files and their digests: trees of files, and scans that a manifest vouches for.

Digests are taken by the tasks that read the files (Spark's binaryFile source: any store Spark reads, files
up to 2 GB), and a tree's digest is a tree of digests over the sorted paths.
"""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.operators.ranks import tree_digest
from lexloom.sources.tables import json_lines


def document(spark: SparkSession, path: str) -> Any | None:
    """A JSON document, None where there is no file."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return None
    return json.loads(spark.read.text(path, wholetext=True).first().value)


def files(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """(path, bytes, digest) of all files under a folder, paths as below it."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)
    below = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", "/"), "^" + _plain(folder) + "/*", "")
    return found.select(below.alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("digest"))


def _plain(folder: str) -> str:
    """A folder's path as a pattern: without its store, each sign for itself."""
    import re

    return re.escape(re.sub("^[a-z]+:/*", "/", folder).rstrip("/"))


def tree(found: DataFrame) -> DataFrame:
    """(n, digest) of files(): one row, that changes if a file's path or content does."""
    return tree_digest(found, F.concat_ws("\n", "path", "digest"), "path")


def differing(now: DataFrame, then: DataFrame) -> DataFrame:
    """(path, change) of two files(): gone, new or changed."""
    a, b = now.select("path", F.col("digest").alias("_now")), then.select("path", F.col("digest").alias("_then"))
    change = F.when(F.col("_now").isNull(), "gone").when(F.col("_then").isNull(), "new").when(F.col("_now") != F.col("_then"), "changed")
    return a.join(b, "path", "full_outer").select("path", change.alias("change")).where("change IS NOT NULL")


def verified(spark: SparkSession, path: str, schema: str, manifest: dict[str, Any], flag: str | None = None) -> DataFrame:
    """The JSON lines at path, if they are those of the manifest; else an error, before any row is given out.

    manifest: sha256 (of the one file, or the tree's digest for a folder), rows, and status, which must be "ready".
    flag: a column that must be true in every row.
    """
    if manifest.get("status") != "ready":
        raise ValueError(f"{path}: the manifest isn't ready")
    found = files(spark, path)
    rows = found.limit(2).collect()
    digest = rows[0].digest if len(rows) == 1 else tree(found).first().digest if rows else None
    if digest != manifest["sha256"]:
        raise ValueError(f"{path}: digest {digest} isn't the manifest's {manifest['sha256']}")
    lines = json_lines(spark, path, schema)
    good = F.coalesce(F.col(flag), F.lit(False)) if flag else F.lit(True)
    seen = lines.agg(F.count("*").alias("n"), F.count_if("bad").alias("bad"), F.count_if(~good).alias("unflagged")).first()
    if seen.n != manifest["rows"]:
        raise ValueError(f"{path}: {seen.n} rows, the manifest has {manifest['rows']}")
    if seen.bad or seen.unflagged:
        raise ValueError(f"{path}: {seen.bad} rows can't be read, {seen.unflagged} lack {flag}")
    return lines.drop("bad", "raw", "file", "line")


def manifest_of(spark: SparkSession, path: str, rows: int) -> dict[str, Any]:
    """What verified() asks for, of files as they are."""
    found = files(spark, path)
    few = found.limit(2).collect()
    digest = few[0].digest if len(few) == 1 else tree(found).first().digest
    return {"status": "ready", "sha256": digest, "rows": rows}
