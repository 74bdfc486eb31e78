"""A registered query: the Spark frame and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession


class Query(NamedTuple):
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None
