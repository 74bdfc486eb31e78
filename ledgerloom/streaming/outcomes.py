"""A stream of outcome events folded into the task table.

The stream appends events to a log with one folder per run and micro-batch.  A run is
the life of a checkpoint: Spark keeps its id there, so a batch that is delivered again
overwrites its own folder, and another checkpoint, whose batches count from 0 again, writes
beside it.  An event that comes again is dropped by its id when the log is folded, so replays
change nothing.  The task table is the fold of the log over the imported tasks.

``compact`` folds what the log holds into a snapshot: the outcome and the log text of every task, and the events
behind them by buckets of their order.  A later read takes the snapshot and the batches after it.  Only tasks that
a new event - or another copy of a known one - names are folded again, from their own events; replays name none.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StructField, StructType

from ledgerloom.operators.lookups import lookup, matching
from ledgerloom.operators.outcomes import TASK_KEY, fold_events, merge_outcomes
from ledgerloom.schemas import OUTCOME_EVENT
from ledgerloom.session import pin
from ledgerloom.sources.versions import State, current, fresh_name, names_in, publish

BUCKETS = 64  # of a snapshot's events, by a hash of their order


def event_stream(
    spark: SparkSession, folder: str, fmt: str = "parquet", schema: StructType = OUTCOME_EVENT, **options: str
) -> DataFrame:
    """Outcome events from files arriving in a folder."""
    return spark.readStream.schema(schema).format(fmt).options(**options).load(folder)


def append_to_log(events: DataFrame, log: str, checkpoint: str) -> StreamingQuery:
    """Start the stream over everything available now; it ends by itself."""

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        run = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        batch.distinct().write.mode("overwrite").parquet(f"{log}/run={run}/batch_id={batch_id}")

    return (
        events.writeStream.foreachBatch(write_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_log(spark: SparkSession, log: str, schema: StructType = OUTCOME_EVENT) -> DataFrame:
    return spark.read.schema(schema).option("basePath", log).parquet(f"{log}/run=*/batch_id=*")


def current_tasks(tasks: DataFrame, log: DataFrame, key: list[str] = TASK_KEY) -> DataFrame:
    """The task table as of the log."""
    return merge_outcomes(tasks, fold_events(log, key), key)


def _snapshots(log: str) -> str:
    return f"{log}/snapshots"


def _covered(state: State) -> dict[str, int]:
    """The last batch of each run that a snapshot holds; a run's batches are numbered in the order they were written."""
    return {r.name: r.number for r in state.rows if r.kind == "run"}


def batches_after(spark: SparkSession, log: str, state: State) -> dict[str, list[int]]:
    """The finished batches of each run that the snapshot does not hold."""
    covered, found = _covered(state), {}
    for run in names_in(spark, log):
        if run.startswith("run="):
            numbers = [int(b.removeprefix("batch_id=")) for b in names_in(spark, f"{log}/{run}") if b.startswith("batch_id=")]
            after = [n for n in sorted(numbers) if n > covered.get(run, -1) and "_SUCCESS" in names_in(spark, f"{log}/{run}/batch_id={n}")]
            if after:
                found[run] = after
    return found


def _bucket() -> Column:
    return F.pmod(F.xxhash64("platform", "order_id"), F.lit(BUCKETS)).cast("int")


def _held_events(spark: SparkSession, state: State, schema: StructType) -> DataFrame:
    """The events behind the snapshot, each kept by the compaction that first saw it."""
    paths = [r.name for r in state.rows if r.kind == "events"]
    read = spark.read.schema(StructType([*schema, StructField("bucket", IntegerType())]))
    return reduce(DataFrame.unionByName, [read.option("basePath", p).parquet(p) for p in paths])


def _new_events(spark: SparkSession, log: str, state: State, after: dict[str, list[int]], schema: StructType) -> DataFrame:
    """The events of the batches after the snapshot that it does not hold as they are."""
    paths = [f"{log}/{run}/batch_id={n}" for run, numbers in after.items() for n in numbers]
    arrived = spark.read.schema(schema).parquet(*paths)
    if len(paths) > 1:  # a batch was written without repeated rows
        arrived = arrived.distinct()
    if not state.rows:
        return pin(arrived) if len(paths) > 1 else arrived
    values = [F.col(c) for c in schema.names]
    row = F.xxhash64(*values, *[value.isNull() for value in values])  # the hash passes over nulls
    held = _held_events(spark, state, schema).select("event_id", row.alias("_row"))
    return pin(lookup(arrived.withColumn("_row", row), held, ["event_id", "_row"], "left_anti").drop("_row"))


def _fold(spark: SparkSession, state: State, events: DataFrame, schema: StructType, key: list[str]) -> DataFrame:
    """The fold of all events: that of the snapshot, but for the tasks that the new ``events`` name."""
    if not state.rows:
        return fold_events(events, key)
    folded = spark.read.parquet(next(r.name for r in state.rows if r.kind == "fold"))
    if events.isEmpty():
        return folded
    held = _held_events(spark, state, schema)
    # An event that was held with other values may have named another task.
    before = lookup(held.select("event_id", *key), events.select("event_id").distinct(), ["event_id"], "left_semi")
    touched = pin(events.select(*key).unionByName(before.select(*key)).distinct())
    buckets = [r.bucket for r in touched.select(_bucket().alias("bucket")).distinct().collect()]  # BUCKETS at most
    history = matching(held.where(F.col("bucket").isin(buckets)), touched, key).drop("bucket")
    again = fold_events(history.unionByName(events), key)
    return matching(folded, touched, key, keep=False).unionByName(again)


def current_fold(spark: SparkSession, log: str, schema: StructType = OUTCOME_EVENT, key: list[str] = TASK_KEY) -> DataFrame:
    """One outcome per task as of the log, from its snapshot and the batches after it."""
    state = current(spark, _snapshots(log))
    after = batches_after(spark, log, state)
    events = _new_events(spark, log, state, after, schema) if after else spark.createDataFrame([], schema)
    return _fold(spark, state, events, schema, key)


def compact(spark: SparkSession, log: str, schema: StructType = OUTCOME_EVENT, key: list[str] = TASK_KEY) -> int:
    """Bring the snapshot up to the finished batches; its version.  Readers keep the former one until it is complete."""
    state = current(spark, _snapshots(log))
    after = batches_after(spark, log, state)
    if not after:
        return state.version
    events = _new_events(spark, log, state, after, schema)
    kept, folded = fresh_name(_snapshots(log)), fresh_name(_snapshots(log))
    _fold(spark, state, events, schema, key).write.parquet(folded)
    # A bucket may hold a third of all events, so its rows are written by several tasks.
    dealt = events.withColumn("bucket", _bucket()).repartition("bucket", F.pmod(F.xxhash64("event_id"), F.lit(8)))
    dealt.write.partitionBy("bucket").parquet(kept)
    runs = _covered(state) | {run: numbers[-1] for run, numbers in after.items()}
    rows = [(r.kind, r.name, r.number) for r in state.rows if r.kind == "events"]
    if not events.isEmpty():
        rows.append(("events", kept, 0))
    rows += [("fold", folded, 0), *(("run", run, n) for run, n in runs.items())]
    return publish(spark.createDataFrame(rows, "kind string, name string, number long"), _snapshots(log), state.version)


def tasks_of_log(spark: SparkSession, tasks: DataFrame, log: str, schema: StructType = OUTCOME_EVENT, key: list[str] = TASK_KEY) -> DataFrame:
    """The task table as of the log, read from its snapshot and the batches after it."""
    return merge_outcomes(tasks, current_fold(spark, log, schema, key), key)
