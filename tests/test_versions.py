"""States that are published whole: result sets, loads, the task table and snapshots of the event log."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ledgerloom import schemas
from ledgerloom.operators import outcomes
from ledgerloom.sources import results, task_table, transactions, versions
from ledgerloom.streaming import outcomes as stream


def rows(df):
    return sorted(map(str, df.collect()))


def test_unfinished_and_outrun_states_are_not_seen(spark, tmp_path):
    folder = str(tmp_path / "f")
    assert versions.current(spark, folder) == (0, [])
    one = spark.createDataFrame([("a",)], "name string")
    assert versions.publish(one, folder, 0) == 1
    (tmp_path / "f" / "manifests" / "version=000000002").mkdir()
    assert versions.current(spark, folder).version == 1
    assert versions.publish(one, folder, 1) == 3  # past what a failed writer left
    with pytest.raises(RuntimeError, match="newer"):
        versions.publish(one, folder, 1)


def test_a_failing_result_leaves_the_former_set(spark, tmp_path):
    folder = str(tmp_path / "answers")
    sets = [{"a": spark.range(n), "b": spark.range(n).withColumn("x", F.lit("y"))} for n in (2, 3)]
    results.write_results(sets[0], folder)
    broken = {**sets[1], "c": spark.range(3).withColumn("x", F.raise_error(F.lit("no")))}
    with pytest.raises(Exception, match="no"):
        results.write_results(broken, folder)
    assert results.read_result(spark, folder, "a").count() == 2 and results.result_names(spark, folder) == ["a", "b"]
    results.write_results(sets[1], folder)
    assert rows(results.read_result(spark, folder, "b")) == rows(sets[1]["b"])
    with pytest.raises(ValueError, match="no result"):
        results.read_result(spark, folder, "c")


def test_a_strict_load_is_published_whole_or_not_at_all(spark, tmp_path):
    folder, good = str(tmp_path / "tx"), "1/5/2020 7 1342IMPS DEBIT ab12 1 1"
    clean = spark.createDataFrame([(good,), (None,), (" ",), ("Transaction_time user",), (good + " " + good,)], "value string")
    assert transactions.publish_printed(clean, folder) == 1
    torn = clean.unionByName(spark.range(25).select(F.concat(F.lit("torn "), "id").alias("value")))
    with pytest.raises(transactions.UnparsedLines, match="25 unparsed") as failed:
        transactions.publish_printed(torn, folder)
    assert str(failed.value).count("torn ") == transactions.REPORTED_REJECTS
    found = transactions.read_published(spark, folder)
    assert rows(found) == rows(transactions.typed(transactions.printed_records(clean))) and found.count() == 3
    with pytest.raises(ValueError, match="no transactions"):
        transactions.read_published(spark, str(tmp_path / "none"))


TASKS = (
    "row_no long, platform string, order_id string, task_status string, return_id string, return_status string, "
    "refund_amount double, timestamp timestamp, log string"
)


def table(spark, n):
    return spark.createDataFrame([(i, "P", f"O{i // 2}", "Pending", None, None, None, None, "") for i in range(n)], TASKS)


def events(spark, *made):
    start = datetime(2026, 7, 1, 9)
    data = [(e, "P", f"O{r // 2}", r, 1, start + timedelta(minutes=m), s, None, None, f"msg {e}") for e, r, m, s in made]
    return spark.createDataFrame(data, schemas.OUTCOME_EVENT)


def test_a_merge_writes_the_buckets_it_touches(spark, tmp_path):
    folder, tasks = str(tmp_path / "t"), table(spark, 40)
    task_table.create_table(tasks, folder, buckets=8)
    assert rows(task_table.read_table(spark, folder)) == rows(tasks)
    before = set(task_table.read_table(spark, folder).inputFiles())
    folded = outcomes.fold_events(events(spark, ("e1", 0, 1, "Placed"), ("e2", 1, 2, "Failed"), ("e3", 30, 3, "Placed")))
    touched = task_table.merge_into_table(folded, folder)
    asked = {r[0] for r in folded.select(task_table.bucket_of(8)).collect()}
    assert set(touched) == asked and len(asked) <= 2
    after = task_table.read_table(spark, folder)
    assert rows(after) == rows(outcomes.merge_outcomes(tasks, folded))
    kept = {f for f in before if int(f.split("bucket=")[1].split("/")[0]) not in asked}
    assert kept and kept == before & set(after.inputFiles())
    assert all(int(f.split("bucket=")[1].split("/")[0]) in asked for f in set(after.inputFiles()) - before)


def test_a_crash_before_the_switch_leaves_the_table(spark, tmp_path, monkeypatch):
    folder, tasks = str(tmp_path / "t"), table(spark, 10)
    task_table.create_table(tasks, folder, buckets=4)
    folded = outcomes.fold_events(events(spark, ("e1", 0, 1, "Placed")))
    with monkeypatch.context() as broken:
        broken.setattr(task_table, "publish", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            task_table.merge_into_table(folded, folder)
    assert rows(task_table.read_table(spark, folder)) == rows(tasks)
    task_table.merge_into_table(folded, folder)
    assert rows(task_table.read_table(spark, folder)) == rows(outcomes.merge_outcomes(tasks, folded))
    nobody = outcomes.fold_events(events(spark, ("e9", 900, 1, "Placed"))).where("false")
    assert task_table.merge_into_table(nobody, folder) == []
    empty = str(tmp_path / "empty")
    task_table.create_table(tasks.limit(0), empty, buckets=4)
    assert task_table.read_table(spark, empty).collect() == [] and task_table.merge_into_table(folded, empty) == []


def deliver(spark, tmp_path, n, made):
    made.write.parquet(str(tmp_path / f"in{n}"))
    stream.append_to_log(stream.event_stream(spark, str(tmp_path / f"in{n}")), str(tmp_path / "log"), str(tmp_path / f"state{n}")).awaitTermination()


def test_a_compacted_log_folds_like_the_whole_log(spark, tmp_path):
    log, tasks = str(tmp_path / "log"), table(spark, 8)
    old = events(spark, ("e1", 0, 1, "Failed"), ("e2", 0, 5, "Placed"), ("e3", 1, 1, "Failed"), ("e4", 4, 1, "Placed"))
    deliveries = [
        old,
        old,  # a replay
        events(spark, ("e5", 0, 3, "Failed"), ("e6", 6, 1, "Placed")),  # a late entry between two others, and a new task
        events(spark, ("e3", 1, 1, "Placed"), ("e4", 5, 1, "Support Needed")),  # other copies, one of another task
    ]
    for n, made in enumerate(deliveries):
        deliver(spark, tmp_path, n, made)
        whole = rows(stream.current_tasks(tasks, stream.read_log(spark, log)))
        assert rows(stream.tasks_of_log(spark, tasks, log)) == whole
        assert stream.compact(spark, log) == n + 1
        assert rows(stream.tasks_of_log(spark, tasks, log)) == whole
    assert stream.compact(spark, log) == len(deliveries)  # nothing new
    assert stream.batches_after(spark, log, versions.current(spark, f"{log}/snapshots")) == {}


def test_after_a_compaction_only_the_snapshot_is_read(spark, tmp_path):
    log = str(tmp_path / "log")
    for n, made in enumerate([("e1", 0, 1, "Failed"), ("e2", 3, 1, "Placed")]):
        deliver(spark, tmp_path, n, events(spark, made))
    stream.compact(spark, log)
    files = stream.current_fold(spark, log).inputFiles()
    assert files and all("/snapshots/" in f for f in files)
    deliver(spark, tmp_path, 2, events(spark, ("e1", 0, 1, "Failed")))  # a replay: the fold stands as it is
    files = stream.current_fold(spark, log).inputFiles()
    assert files and all("/snapshots/" in f for f in files)
    state = versions.current(spark, f"{log}/snapshots")
    assert sum(map(len, stream.batches_after(spark, log, state).values())) == 1


def test_a_new_batch_and_the_events_held_are_shuffled_once(spark, tmp_path, monkeypatch):
    log = str(tmp_path / "log")
    deliver(spark, tmp_path, 0, events(spark, ("e1", 0, 1, "Failed"), ("e2", 3, 1, "Placed")))
    stream.compact(spark, log)
    deliver(spark, tmp_path, 1, events(spark, ("e1", 0, 1, "Failed"), ("e2", 3, 1, None), ("e3", 3, 1, "Placed")))
    state = versions.current(spark, f"{log}/snapshots")
    monkeypatch.setattr(stream, "pin", lambda df: df)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        new = stream._new_events(spark, log, state, stream.batches_after(spark, log, state), schemas.OUTCOME_EVENT)
        plan = new._jdf.queryExecution().executedPlan().toString()
        assert sorted(r.event_id for r in new.collect()) == ["e2", "e3"]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 2
