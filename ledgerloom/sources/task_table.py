"""A durable task table that takes outcomes by copy-on-write.

Tasks are dealt out to buckets by a hash of their order.  A merge reads and writes only the buckets that its outcomes
touch, into a new folder, and then publishes which folder holds which bucket.  Until that moment, and if the
merge fails before it, readers see the table as it was.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerloom.operators.outcomes import TASK_KEY, merge_outcomes
from ledgerloom.sources.versions import State, current, fresh_name, names_in, publish

BUCKETS = 64
_MANIFEST = "bucket int, folder string, buckets int, schema string"


def bucket_of(buckets: int) -> Column:
    """Both parts of an order's name decide; null reads as a value of its own."""
    return F.pmod(F.xxhash64("platform", "order_id"), F.lit(buckets)).cast("int")


def _write(tasks: DataFrame, folder: str, buckets: int) -> str:
    path = fresh_name(folder)
    dealt = tasks.withColumn("bucket", bucket_of(buckets))
    # A bucket may hold a third of all rows, so its rows go to several tasks, each of which writes a file of it.
    dealt.repartition("bucket", F.pmod(F.xxhash64("row_no"), F.lit(8))).write.partitionBy("bucket").parquet(path)
    return path


def _publish(spark: SparkSession, rows: list[tuple], folder: str, after: int) -> int:
    return publish(spark.createDataFrame(rows, _MANIFEST), folder, after)


def _tasks(spark: SparkSession, state: State, only: set[int] | None = None) -> DataFrame:
    schema = StructType.fromJson(json.loads(state.rows[0].schema))
    paths = [f"{r.folder}/bucket={r.bucket}" for r in state.rows if r.folder and (only is None or r.bucket in only)]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def create_table(tasks: DataFrame, folder: str, buckets: int = BUCKETS) -> int:
    """Write the table anew; the version it is."""
    spark, before = tasks.sparkSession, current(tasks.sparkSession, folder).version
    path = _write(tasks, folder, buckets)
    held = {int(name.removeprefix("bucket=")) for name in names_in(spark, path) if name.startswith("bucket=")}
    rows = [(b, path if b in held else None, buckets, tasks.schema.json()) for b in range(buckets)]
    return _publish(spark, rows, folder, before)


def read_table(spark: SparkSession, folder: str) -> DataFrame:
    """The table as of its last finished version."""
    state = current(spark, folder)
    if not state.rows:
        raise ValueError(f"no task table in {folder}")
    return _tasks(spark, state)


def merge_into_table(folded: DataFrame, folder: str, key: list[str] = TASK_KEY) -> list[int]:
    """Write outcomes (as ``merge_outcomes`` takes them) to their tasks; the buckets that were written anew."""
    spark, state = folded.sparkSession, current(folded.sparkSession, folder)
    buckets = state.rows[0].buckets
    asked = folded.select(bucket_of(buckets).alias("bucket")).distinct().collect()
    touched = {r.bucket for r in asked} & {r.bucket for r in state.rows if r.folder}
    if not touched:
        return []
    path = _write(merge_outcomes(_tasks(spark, state, touched), folded, key), folder, buckets)
    rows = [(r.bucket, path if r.bucket in touched else r.folder, buckets, r.schema) for r in state.rows]
    _publish(spark, rows, folder, state.version)
    return sorted(touched)
