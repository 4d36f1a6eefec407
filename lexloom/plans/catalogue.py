"""All queries of the library outside its corpus-building subpackage, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexloom.plans import contracts, corpus, models, records, reports, requests


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return contracts.QUERIES | corpus.QUERIES | models.QUERIES | records.QUERIES | reports.QUERIES | requests.QUERIES


def oracle_sql() -> dict[str, str]:
    return contracts.SQL | corpus.SQL | models.SQL | records.SQL | reports.SQL | requests.SQL
