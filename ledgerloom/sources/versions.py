"""Folders whose content changes from one complete state to the next.

A state is a manifest: a small table that names what belongs to it, written after everything it names.  Manifests
are numbered; the last one that Spark has finished writing (its ``_SUCCESS`` file stands) is the state that readers see.
Whoever fails before that leaves files that no manifest names, and readers go on with the former state.  Two
writers of one number cannot both succeed, since a manifest is never overwritten.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame, Row, SparkSession


class State(NamedTuple):
    version: int  # 0 before the first
    rows: list[Row]


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """What a folder holds, by name; nothing if there is no such folder.  Only names are read."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not store.exists(path):
        return []
    return sorted(found.getPath().getName() for found in store.listStatus(path))


def _manifest(folder: str, version: int) -> str:
    return f"{folder}/manifests/version={version:09d}"


def current(spark: SparkSession, folder: str) -> State:
    """The last finished state.  A manifest is bounded by what it names, never by rows of data."""
    for name in reversed(names_in(spark, f"{folder}/manifests")):
        version = int(name.removeprefix("version="))
        if "_SUCCESS" in names_in(spark, _manifest(folder, version)):
            return State(version, spark.read.parquet(_manifest(folder, version)).collect())
    return State(0, [])


def fresh_name(folder: str) -> str:
    """A new folder for data that the next manifest will name; every attempt has its own."""
    return f"{folder}/data/{uuid.uuid4().hex}"


def publish(named: DataFrame, folder: str, after: int) -> int:
    """Make the rows of ``named`` the state that follows the version ``after``; an error if another writer was faster."""
    spark = named.sparkSession
    if (newest := current(spark, folder).version) != after:
        raise RuntimeError(f"version {newest} of {folder} is newer than {after}")
    # Numbers that failed writers have begun are passed over.
    begun = [int(name.removeprefix("version=")) for name in names_in(spark, f"{folder}/manifests")]
    version = max([after, *begun]) + 1
    named.coalesce(1).write.mode("errorifexists").parquet(_manifest(folder, version))
    return version
