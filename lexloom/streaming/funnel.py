"""The validation funnel on a stream: its checks hold no state, so the same expressions serve."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexloom.operators import funnel
from lexloom.sources import writers


def validated_stream(spark: SparkSession, folder: str, schema: str, intents: list[str], kinds: list[str]) -> DataFrame:
    """Records that arrive as Parquet files in a folder, with stage, reason and scores."""
    return funnel.validated(spark.readStream.schema(schema).parquet(folder), intents, kinds)


def run(spark: SparkSession, folder: str, schema: str, intents: list[str], kinds: list[str], key: str, path: str, checkpoint: str):
    """Validate what has arrived and append it, each key once."""
    return writers.append_once(validated_stream(spark, folder, schema, intents, kinds), key, path, checkpoint)
