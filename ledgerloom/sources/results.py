"""Named results written side by side as one set: readers see all of a set or the one before."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.sources.versions import current, fresh_name, publish


def write_results(results: dict[str, DataFrame], folder: str, fmt: str = "parquet") -> int:
    """Write all results and publish them together; the version they are.  If one fails, the former set stands."""
    if not results:
        raise ValueError("no results")
    spark = next(iter(results.values())).sparkSession
    before, path = current(spark, folder).version, fresh_name(folder)
    for name, df in results.items():
        df.write.format(fmt).save(f"{path}/{name}")
    rows = [(name, f"{path}/{name}", fmt, df.schema.json()) for name, df in results.items()]
    return publish(spark.createDataFrame(rows, "name string, path string, format string, schema string"), folder, before)


def result_names(spark: SparkSession, folder: str) -> list[str]:
    return sorted(r.name for r in current(spark, folder).rows)


def read_result(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A result of the last set that was written whole."""
    found = [r for r in current(spark, folder).rows if r.name == name]
    if not found:
        raise ValueError(f"no result {name!r} in {folder}")
    return spark.read.format(found[0].format).load(found[0].path)
