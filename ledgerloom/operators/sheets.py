"""Order sheets of unknown layout, normalised to one row per line item.

Input is a raw grid ``sheet_id, row_no, cells``.  Which column means what is found
per sheet; the header is the first row that names an order id and a product link.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
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
from ledgerloom.functions.text import header_field, products, title_case
from ledgerloom.schemas import (
    DEFAULT_PLATFORM,
    HEADER_ALIASES,
    PENDING,
    REQUIRED_SHEET_FIELDS,
    RETURN_STATUSES,
)
from ledgerloom.session import broadcast_if_small, pin

SHEET_FIELDS = tuple(HEADER_ALIASES)


class SheetError(ValueError):
    """A sheet has no usable header."""


def header_candidates(grid: DataFrame, scan_rows: int | None = None) -> DataFrame:
    """Rows with the column of each field (first wins, 0 when absent); the first ``scan_rows`` of each sheet if given."""
    named = F.transform("cells", lambda cell: F.coalesce(header_field(cell), F.lit("")))
    places = [F.array_position("_named", F.lit(field)).alias(field) for field in SHEET_FIELDS]
    return (
        (grid if scan_rows is None else grid.where(F.col("row_no") <= scan_rows))
        .withColumn("_named", named)
        .select("sheet_id", "row_no", F.struct(*places).alias("columns"))
    )


def _names(field: str) -> Column:
    """Whether some cell of a row names the field: its spellings with anything but letters and digits around and between.

    The pattern is anchored, so a cell of data is given up at its first letter or digit that no spelling has.
    """
    apart = "[^a-z0-9]*"
    spellings = "|".join(apart.join(name) for name in HEADER_ALIASES[field])
    return F.exists("cells", lambda cell: F.coalesce(F.lower(cell).rlike(f"^{apart}(?:{spellings}){apart}$"), F.lit(False)))


def sheet_layouts(grid: DataFrame, scan_rows: int | None = None) -> DataFrame:
    """One row per sheet with a header: ``sheet_id, header_row, columns``.

    All rows are only looked through for one cell that names an order id and one that names a product link; the
    columns are worked out for the few that have both.
    """
    usable = (F.col("columns.order_id") > 0) & (F.col("columns.product_link") > 0)
    return (
        header_candidates(grid.where(_names("order_id") & _names("product_link")), scan_rows)
        .where(usable)
        .groupBy("sheet_id")
        .agg(F.min("row_no").alias("header_row"), F.min_by("columns", "row_no").alias("columns"))
    )


def sheet_errors(grid: DataFrame, layouts: DataFrame | None = None) -> DataFrame:
    """Sheets that cannot be imported and why: ``sheet_id, error``.  ``layouts`` if they are known already."""
    layouts = sheet_layouts(grid) if layouts is None else layouts
    sheets = grid.select("sheet_id").distinct()
    absent = F.array_compact(
        F.array(*[F.when(F.col(f"columns.{f}") == 0, F.lit(f)) for f in REQUIRED_SHEET_FIELDS])
    )
    error = F.when(F.col("header_row").isNull(), F.lit("no header row with order id and product link")).when(
        F.size(absent) > 0,
        F.concat(F.lit("no column for: "), F.array_join(absent, ", ")),
    )
    return sheets.join(layouts, "sheet_id", "left").select("sheet_id", error.alias("error")).where("error is not null")


def mapped_rows(grid: DataFrame, layouts: DataFrame | None = None) -> DataFrame:
    """The data rows of importable sheets with one text column per field.

    Rows with a blank order id are spacers and are dropped.  Layouts are worked out once, or given.
    """
    layouts = pin(sheet_layouts(grid)) if layouts is None else layouts
    for field in REQUIRED_SHEET_FIELDS:
        layouts = layouts.where(F.col(f"columns.{field}") > 0)
    # One row per sheet, so this broadcasts unless there are very many sheets.
    rows = grid.join(broadcast_if_small(layouts), "sheet_id").where(F.col("row_no") > F.col("header_row"))

    def cell(field: str) -> Column:
        place = F.col(f"columns.{field}")
        return F.when(place > 0, F.get("cells", (place - 1).cast("int"))).alias(field)

    cells = rows.select("sheet_id", "row_no", *[cell(f) for f in SHEET_FIELDS])
    return cells.where(F.col("order_id").isNotNull() & (F.col("order_id") != ""))


def _share(total: Column, items: Column, item_no: Column, allocate_remainder: bool) -> Column:
    cents = (total.try_cast("decimal(18,2)") * 100).cast("bigint")
    if allocate_remainder:
        each = F.floor(cents / items)
        extra = F.when(item_no <= F.pmod(cents, items), 1).otherwise(0)
        return ((each + extra).cast("decimal(20,0)") / 100).cast("double")
    return F.round(total.try_cast("decimal(18,2)") / items.cast("decimal(10,0)"), 2).cast("double")


def line_items(
    rows: DataFrame,
    carry_status: bool = True,
    allocate_remainder: bool = False,
    fallback_year: int | None = None,
) -> DataFrame:
    """One row per product of each mapped row.

    The order total is split evenly over the products, rounded half up;
    ``allocate_remainder`` hands out whole cents so the parts add up again.  The
    status on the sheet is kept unless ``carry_status`` is off, when every row
    starts pending.  A date without a year takes the order date's year, else
    ``fallback_year``.
    """
    default_year = F.lit(fallback_year).cast("int")
    platform = title_case(strip(F.coalesce(F.nullif("platform", F.lit("")), F.lit(DEFAULT_PLATFORM))))
    delivery_year = F.coalesce(F.year("_ordered"), default_year)
    status = (
        {
            "task_status": task_status(F.col("task_status")),
            "return_id": blank_to_null(F.col("return_id")),
            "return_status": choice(F.col("return_status"), RETURN_STATUSES),
            "refund_amount": money(F.col("refund_amount")),
            "timestamp": sheet_timestamp(F.col("timestamp")),
            "log": F.coalesce("log", F.lit("")),
        }
        if carry_status
        else {
            "task_status": F.lit(PENDING),
            "return_id": F.lit(None).cast("string"),
            "return_status": F.lit(None).cast("string"),
            "refund_amount": F.lit(None).cast("double"),
            "timestamp": F.lit(None).cast("timestamp"),
            "log": F.lit(""),
        }
    )
    # A row's cells are read once, before it becomes as many rows as it has products.
    typed = rows.withColumn("_ordered", sheet_date(F.col("order_date"), default_year)).select(
        "sheet_id",
        "row_no",
        platform.alias("platform"),
        strip(F.col("order_id")).alias("order_id"),
        products(F.col("product_link")).alias("_products"),
        money(F.col("amount")).alias("_total"),
        F.col("_ordered").alias("order_date"),
        sheet_date(F.col("delivery_date"), delivery_year).alias("delivery_date"),
        first_integer(F.col("return_window_days")).alias("return_window_days"),
        *[expression.alias(name) for name, expression in status.items()],
        "address",
        "contact_number",
    )
    # The outer form: the plain one has the array computed again to filter on it.
    exploded = typed.select("*", F.posexplode_outer("_products").alias("_pos", "_product")).where(
        F.col("_product").isNotNull()
    )
    item_no = F.col("_pos") + 1
    return exploded.select(
        "sheet_id",
        "row_no",
        item_no.cast("int").alias("item_no"),
        "platform",
        "order_id",
        F.nullif("_product.pid", F.lit("")).alias("sku"),
        F.nullif("_product.name", F.lit("")).alias("product_name"),
        F.col("_product.link").alias("product_link"),
        F.lit(1).alias("quantity"),
        _share(F.col("_total"), F.size("_products"), item_no, allocate_remainder).alias("amount"),
        "order_date",
        "delivery_date",
        "return_window_days",
        *status,
        "address",
        "contact_number",
    )


def count_mismatches(rows: DataFrame) -> DataFrame:
    """Rows whose declared number of products is not the number found: ``..., declared, found``."""
    found = F.size(products(F.col("product_link")))
    return (
        rows.select("sheet_id", "row_no", "order_id", "quantity", found.alias("found"))
        .withColumn("declared", first_integer(F.col("quantity"), F.col("found")))
        .where(F.col("declared") != F.col("found"))
        .drop("quantity")
    )


def rejected_rows(rows: DataFrame) -> DataFrame:
    """Order rows whose product cell is blank, which give no line item, and those whose amount is no money value."""
    total = money(F.col("amount"))
    too_large = total.isNotNull() & total.try_cast("decimal(18,2)").isNull()
    return rows.where((F.size(products(F.col("product_link"))) == 0) | too_large)


def sheet_counts(items: DataFrame) -> DataFrame:
    """Line items, orders, multi-item orders, items without window or delivery date, one row."""
    by_order = items.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("return_window_days").isNull()).alias("no_window"),
        F.count_if(F.col("delivery_date").isNull()).alias("no_delivery"),
    )

    def total(name: str) -> Column:
        return F.coalesce(F.sum(name), F.lit(0)).cast("bigint")

    return by_order.agg(
        total("n").alias("line_items"),
        F.count(F.lit(1)).alias("orders"),
        F.count_if(F.col("n") > 1).alias("multi_item_orders"),
        total("no_window").alias("no_window"),
        total("no_delivery").alias("no_delivery"),
    )


def check_sheets(grid: DataFrame, reported: int = 10) -> None:
    """Raise ``SheetError`` when any sheet cannot be imported."""
    errors = sheet_errors(grid).limit(reported).collect()
    if errors:
        raise SheetError("; ".join(f"{e.sheet_id}: {e.error}" for e in errors))
