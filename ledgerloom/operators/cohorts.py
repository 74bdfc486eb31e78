"""Cohorts: users grouped by the period of their first activity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_active_period(activity: DataFrame, period: str = "txn_month") -> DataFrame:
    """The first period of each user: ``user_id, cohort_month``."""
    return activity.groupBy("user_id").agg(F.min(period).alias("cohort_month"))


def cohort_cells(activity: DataFrame, period: str = "txn_month") -> DataFrame:
    """Distinct users per (cohort, active period).

    Users and periods are deduplicated first, so a user of any size shrinks to
    one row per period before the window that finds the first period; no join.
    """
    seen = activity.select("user_id", F.col(period).alias("active_month")).where(
        F.col("user_id").isNotNull() & F.col("active_month").isNotNull()
    )
    return (
        seen.distinct()
        .withColumn("cohort_month", F.min("active_month").over(Window.partitionBy("user_id")))
        .groupBy("cohort_month", "active_month")
        .agg(F.count(F.lit(1)).alias("active_users"))
    )


def periods_of(everything: DataFrame, period: str = "txn_month", full_calendar: bool = False) -> DataFrame:
    """The distinct periods as ``p``; with ``full_calendar`` every month (``yyyy-MM``) from the first to the last one."""
    if not full_calendar:
        return everything.select(F.col(period).alias("p")).where(F.col(period).isNotNull()).distinct()

    def first_day(month: Column) -> Column:
        return F.to_date(F.concat(month, F.lit("-01")))

    span = everything.agg(F.min(period).alias("first"), F.max(period).alias("last"))
    months = F.sequence(first_day(F.col("first")), first_day(F.col("last")), F.make_ym_interval(F.lit(0), F.lit(1)))
    return span.select(F.explode(F.transform(months, lambda day: F.date_format(day, "yyyy-MM"))).alias("p"))


def cohort_grid(
    everything: DataFrame, activity: DataFrame, period: str = "txn_month", full_calendar: bool = False
) -> DataFrame:
    """Every pair of periods with its user count: ``cohort_month, active_month, active_users``.

    Periods come from all rows, cohorts only from the activity.  A cell before its
    cohort, or of a period that formed no cohort, is null; a cell of an existing
    cohort in which nobody was active is 0.  With ``full_calendar`` months without any row
    appear too.  The periods of a calendar are few, so their list travels as one array.
    """
    periods = periods_of(everything, period, full_calendar)
    calendar = periods.agg(F.array_sort(F.collect_set("p"))).scalar()
    cells = cohort_cells(activity, period)
    formed = cells.select("cohort_month").distinct().withColumn("formed", F.lit(True))
    return (
        periods.select(F.col("p").alias("cohort_month"), F.explode(calendar).alias("active_month"))
        .join(cells, ["cohort_month", "active_month"], "left")
        .join(formed, "cohort_month", "left")
        .select(
            "cohort_month",
            "active_month",
            F.when(
                F.col("formed") & (F.col("active_month") >= F.col("cohort_month")),
                F.coalesce("active_users", F.lit(0).cast("bigint")),
            ).alias("active_users"),
        )
    )


def cohort_matrix(
    everything: DataFrame, activity: DataFrame, period: str = "txn_month", full_calendar: bool = False
) -> DataFrame:
    """The grid with one column per period.

    The column names are data, so the distinct periods - a calendar's worth - are
    read first; naming them also spares the pivot a second pass.
    """
    names = [str(row.p) for row in periods_of(everything, period, full_calendar).orderBy("p").collect()]
    grid = cohort_grid(everything, activity, period, full_calendar).withColumn("active_month", F.col("active_month").cast("string"))
    return grid.groupBy("cohort_month").pivot("active_month", names).agg(F.max("active_users")).orderBy("cohort_month")
