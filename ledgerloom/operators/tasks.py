"""Queues, groups and counts over the task table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.verdicts import task_label
from ledgerloom.operators.lookups import lookup, matching
from ledgerloom.schemas import NEEDS_REVIEW, PENDING

ORDER_KEY = ["platform", "order_id"]


def pending(tasks: DataFrame) -> DataFrame:
    return tasks.where(F.col("task_status") == PENDING)


def review_queue(tasks: DataFrame) -> DataFrame:
    """Tasks a human must look at, with their label and last log line (line ends at the end of a log are none)."""
    last = F.coalesce(F.element_at(F.split(F.regexp_replace(F.coalesce("log", F.lit("")), r"\n+\z", ""), "\n"), -1), F.lit(""))
    return tasks.where(F.col("task_status") == NEEDS_REVIEW).withColumns(
        {
            "label": task_label(*[F.col(c) for c in (*ORDER_KEY, "sku", "product_name", "product_link")]),
            "last_line": last,
        }
    )


def of_orders(tasks: DataFrame, orders: DataFrame) -> DataFrame:
    """The tasks of the named orders (``order_id``)."""
    return matching(tasks, orders, ["order_id"])


def order_groups(tasks: DataFrame, row: str = "row_no") -> DataFrame:
    """One row per order: its first row and number of tasks."""
    return tasks.groupBy(*ORDER_KEY).agg(F.min(row).alias("first_row"), F.count(F.lit(1)).alias("items"))


def grouped_by_order(tasks: DataFrame, row: str = "row_no") -> DataFrame:
    """The tasks with their group's first row and size.

    Ordered by ``(first_row, row)`` they stand group by group in sheet order.  The
    groups stay rows; an order of any size is never gathered into one value.
    """
    return lookup(tasks, order_groups(tasks, row), ORDER_KEY)


def settled_orders(tasks: DataFrame) -> DataFrame:
    """One row per order: whether none of its tasks is pending any more."""
    return tasks.groupBy(*ORDER_KEY).agg(F.every(F.col("task_status") != PENDING).alias("settled"))


def status_counts(tasks: DataFrame) -> DataFrame:
    return tasks.groupBy("task_status").agg(F.count(F.lit(1)).alias("n")).orderBy("task_status")
