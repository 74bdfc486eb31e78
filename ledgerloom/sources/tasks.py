"""The canonical task table: reading, numbering, empty table, nested orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.cells import (
    blank_to_null,
    choice,
    first_integer,
    money,
    sheet_date,
    sheet_timestamp,
    strip,
    task_status,
)
from ledgerloom.functions.text import slug
from ledgerloom.operators.lookups import lookup
from ledgerloom.operators.positions import row_numbers
from ledgerloom.schemas import PENDING, PLATFORMS, RETURN_STATUSES, TASK, TASK_COLUMNS


class TaskTableError(ValueError):
    """The table is not a task table."""


def empty_tasks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], TASK)


def check_columns(df: DataFrame) -> None:
    """Raise when any canonical column is missing; order and extra columns do not matter."""
    missing = [c for c in TASK_COLUMNS if c not in df.columns]
    if missing:
        raise TaskTableError(f"missing column(s): {', '.join(missing)}")


def _not_blank(column: str) -> Column:
    return F.col(column).isNotNull() & (F.col(column) != "")


def read_tasks(raw: DataFrame, fallback_year: int | None = None) -> DataFrame:
    """Text rows as typed tasks.

    Rows without an order id are dropped; rows of an unknown platform are left to
    ``unknown_platforms``.  Columns beyond the canonical ones are kept as they are.
    """
    check_columns(raw)
    rows = raw.where(_not_blank("order_id"))
    year = F.lit(fallback_year).cast("int")
    order_date = sheet_date(F.col("order_date"), year)
    window = first_integer(F.col("return_window_days"))
    typed = {
        "platform": choice(F.col("platform"), PLATFORMS),
        "order_id": strip(F.col("order_id")),
        "sku": blank_to_null(F.col("sku")),
        "product_name": blank_to_null(F.col("product_name")),
        "product_link": strip(F.coalesce("product_link", F.lit(""))),
        "quantity": first_integer(F.col("quantity"), F.lit(1)),
        "amount": money(F.col("amount")),
        "order_date": order_date,
        "delivery_date": sheet_date(F.col("delivery_date"), F.coalesce(F.year(order_date), year)),
        "return_window_days": window,
        "task_status": task_status(F.col("task_status")),
        "return_id": blank_to_null(F.col("return_id")),
        "return_status": choice(F.col("return_status"), RETURN_STATUSES),
        "refund_amount": money(F.col("refund_amount")),
        "timestamp": sheet_timestamp(F.col("timestamp")),
        "log": F.coalesce("log", F.lit("")),
    }
    return rows.select(*[typed[c].alias(c) if c in typed else F.col(c) for c in raw.columns]).where(
        F.col("platform").isNotNull()
    )


def unknown_platforms(raw: DataFrame) -> DataFrame:
    """The rows whose platform is none of the known ones."""
    return raw.where(_not_blank("order_id") & choice(F.col("platform"), PLATFORMS).isNull())


def read_tasks_strictly(raw: DataFrame, fallback_year: int | None = None, reported: int = 10) -> DataFrame:
    """``read_tasks``, or ``TaskTableError`` when any row has an unknown platform."""
    rejects = unknown_platforms(raw).select("order_id", "platform").limit(reported).collect()
    if rejects:
        found = ", ".join(f"{r.platform!r} on order {r.order_id}" for r in rejects)
        raise TaskTableError(f"unrecognised platform: {found}")
    return read_tasks(raw, fallback_year)


def number_tasks(items: DataFrame, order_by: list[str]) -> DataFrame:
    """Give the items task ids ``T001, T002, ...`` in the order of the given columns, which identify an item, all pending.

    Only these columns are sorted; the rows receive their number by a join.
    """
    numbers = row_numbers(items.select(*order_by), [F.col(c) for c in order_by], "_number")
    numbered = lookup(items.drop("task_id", "task_status"), numbers, order_by)
    return (
        numbered.withColumn("task_id", F.format_string("T%03d", "_number"))
        .withColumn("task_status", F.lit(PENDING))
        .drop("_number")
    )


CSV = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def write_tasks(tasks: DataFrame, path: str) -> None:
    """The task table in its canonical columns, as CSV files with a header that ``read_written_tasks`` reads."""
    stamp = F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("timestamp")
    columns = [stamp if c == "timestamp" else F.col(c).cast("string").alias(c) for c in TASK_COLUMNS]
    tasks.select(*columns).write.options(**CSV, emptyValue="").mode("overwrite").csv(path)


def read_written_tasks(spark: SparkSession, path: str) -> DataFrame:
    """The task table that ``write_tasks`` wrote."""
    schema = ", ".join(f"`{c}` string" for c in TASK_COLUMNS)
    raw = spark.read.schema(schema).options(**CSV, multiLine=True).csv(path)
    return read_tasks(raw)


def flatten_orders(orders: DataFrame, link_template: Column | None = None) -> DataFrame:
    """Nested orders (``items`` array) as one task row per item.

    ``link_template`` is a printf pattern given the title's slug and the product
    id; an item's amount is its price times its quantity.
    """
    item = orders.select("*", F.explode("items").alias("_item")).drop("items")
    template = F.lit("https://%s/p/item?pid=%s") if link_template is None else link_template
    parts = F.split(template, "%s")
    link = F.concat(
        F.get(parts, F.lit(0)), slug(F.col("_item.title")),
        F.get(parts, F.lit(1)), F.col("_item.product_id"),
        F.coalesce(F.get(parts, F.lit(2)), F.lit("")),
    )
    return item.select(
        *[c for c in orders.columns if c != "items"],
        F.col("_item.product_id").alias("sku"),
        F.col("_item.title").alias("product_name"),
        link.alias("product_link"),
        F.col("_item.quantity").cast("int").alias("quantity"),
        (F.col("_item.amount").try_cast("decimal(18,2)") * F.col("_item.quantity").try_cast("int"))
        .cast("double")
        .alias("amount"),
        F.col("_item.return_window_days").alias("return_window_days"),
    )
