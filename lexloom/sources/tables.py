"""Readers: Parquet splits, text and JSON lines with file and line, dictionary-coded columns, delimited records."""

from __future__ import annotations

import atexit
import functools
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Splits whose counts (about 150 bytes each) are sent to all tasks; more are joined by a shuffle.
FEW_SPLITS = 100_000
#: Lines of a file that are put in order together.
PART_LINES = 1 << 16
#: Tasks a core, where rows are dealt to all of them.
SPREAD = 3


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """df dealt by key to SPREAD tasks a core: for small rows that much work is done on, as few files would leave most cores idle. One shuffle."""
    return df.repartition(SPREAD * df.sparkSession.sparkContext.defaultParallelism, key)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see, which the session names in spark.checkpoint.dir; on one machine a folder is made where it names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return folder or _own_folder()


@functools.lru_cache(maxsize=1)
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="lexloom-")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there goes when the driver ends."""
    where = f"{shared_folder(spark)}/lexloom-{name}-{uuid.uuid4().hex}"
    atexit.register(_forget, spark, where)
    return where


def _forget(spark: SparkSession, where: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the JVM may be gone by then
        return


def kept(df: DataFrame, name: str = "") -> DataFrame:
    """Written where all executors read it again: a reliable checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def splits(spark: SparkSession, folder: str, names: list[str], schema: str) -> DataFrame:
    """<folder>/<split> of each name, with a column split; a filter on split reads only that folder."""
    parts = [spark.read.schema(schema).parquet(f"{folder}/{n}").withColumn("split", F.lit(n)) for n in names]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """(raw, file, line) of text files: line counts from 1 in each file, blank lines too.

    Files are read in splits by many tasks. Each split's lines are counted, and a line's number is its place in its
    split after the lines of the splits before; only these counts are shuffled, or sent to all tasks where they are few.
    """
    at = F.monotonically_increasing_id()  # rises within a split, by one a line
    block = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    lines = spark.read.text(path).select(F.col("value").alias("raw"), *block, at.alias("at"))
    counts = lines.groupBy("file", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row a split
    shifts = counts.select("file", "block", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first") + 1).alias("shift"))
    shifts = kept(shifts)
    shifts = F.broadcast(shifts) if shifts.count() <= FEW_SPLITS else shifts
    return lines.join(shifts, ["file", "block"]).select("raw", "file", (F.col("at") + F.col("shift")).alias("line"))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Parsed rows with raw, file, line and bad (text that isn't a JSON object of the schema); blank lines are left out, bad ones kept."""
    lines = numbered(spark, path).where(F.trim("raw") != "")
    typed = StructType.fromDDL(schema).add("_bad", "string")
    parsed = lines.withColumn("row", F.from_json("raw", typed, {"columnNameOfCorruptRecord": "_bad"}))
    return parsed.select("row.*", "raw", "file", "line").withColumn("bad", F.col("_bad").isNotNull()).drop("_bad")


def samples(spark: SparkSession, path: str) -> DataFrame:
    """(id, utt, raw, file, line, problem) of JSON lines that each should hold a sample object with an id and a text; problem is null for good ones."""
    lines = numbered(spark, path).where(F.trim("raw") != "")
    record = lines.withColumn("_v", F.try_parse_json("raw"))
    sample = F.try_variant_get("_v", "$.sample", "variant")
    kind = lambda v: F.coalesce(F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0), F.lit("none"))
    text = lambda path: F.when(kind(F.try_variant_get("_v", path, "variant")) == "STRING", F.try_variant_get("_v", path, "string"))
    out = record.select(text("$.sample.id").alias("id"), text("$.sample.utt").alias("utt"), "raw", "file", "line", F.col("_v").isNull().alias("_no"), kind(sample).alias("_kind"))
    problem = (
        F.when(F.col("_no"), "not JSON")
        .when(F.col("_kind") != "OBJECT", "missing sample object")
        .when(F.coalesce(F.col("id") == "", F.lit(True)), "missing sample id")
        .when(F.coalesce(~F.col("utt").rlike(r"(?U)\S"), F.lit(True)), "missing utterance")
    )
    return out.withColumn("problem", problem).drop("_no", "_kind")


def required(rows: DataFrame, *unique: str, told: int = 5) -> DataFrame:
    """rows, all of which have no problem and, together, no repeated key: checked now, before any row is given out.

    rows have problem, file and line, as samples() gives. The error has the first places of problems, or repeated keys."""
    bad = rows.where("problem IS NOT NULL").select("problem", "file", "line").orderBy("file", "line").limit(told).collect()
    if bad:
        raise ValueError("; ".join(f"{r.problem} at {r.file}:{r.line}" for r in bad))
    if unique:
        twice = rows.groupBy(*unique).agg(F.count("*").alias("n")).where("n > 1").orderBy(*unique).limit(told).collect()
        if twice:
            raise ValueError("repeated keys: " + "; ".join(", ".join(str(r[u]) for u in unique) for r in twice))
    return rows


def checkpointed(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """Rows of an append-only checkpoint of JSON lines: a line that can't be read, a missing key or one that comes twice is an error, before any row is given out."""
    rows = json_lines(spark, path, schema)
    problem = F.when(F.col("bad"), "a line that can't be read").when(F.col(key).isNull(), f"no {key}")
    return required(rows.withColumn("problem", problem), key).drop("problem", "bad", "raw", "file", "line")


def predictions(spark: SparkSession, path: str, schema: str, index: str) -> DataFrame:
    """Rows of JSON lines whose index counts from 0 in the order of each file's lines; anything else is an error, before any row is given out."""
    rows = json_lines(spark, path, schema)
    at = Window.partitionBy("file", "_part").orderBy("line")
    parts = rows.withColumn("_part", F.floor(F.col("line") / PART_LINES))
    # Lines before a part, counted by part; a blank line has no index.
    sizes = parts.groupBy("file", "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("file").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a part
    shifts = sizes.select("file", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    placed = parts.withColumn("_at", F.row_number().over(at) - 1).join(shifts, ["file", "_part"])
    off = F.coalesce(F.col(index) != F.col("_at") + F.col("_shift"), F.lit(True))
    problem = F.when(F.col("bad"), "a line that can't be read").when(off, F.concat(F.lit("index "), F.coalesce(F.col(index).cast("string"), F.lit("null")), F.lit(" out of order")))
    return required(placed.withColumn("problem", problem)).drop("problem", "bad", "raw", "file", "line", "_part", "_at", "_shift")


def decoded(df: DataFrame, code: str, names: list[str]) -> DataFrame:
    """A column of codes replaced by their names."""
    return df.withColumn(code, F.try_element_at(F.array(*map(F.lit, names)), F.col(code) + 1))


def delimited(line: Column, separator: str, names: list[str]) -> Column:
    """A struct of the fields of a line, null if their number differs."""
    parts = F.split(line, separator)
    return F.when(F.size(parts) == len(names), F.struct(*[parts[k].alias(n) for k, n in enumerate(names)]))
