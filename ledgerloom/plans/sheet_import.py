"""A raw sheet grid as a numbered task table with its warnings and rejects."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators import sheets
from ledgerloom.schemas import TASK_COLUMNS
from ledgerloom.session import pin
from ledgerloom.sources.tasks import number_tasks


@dataclass(frozen=True)
class SheetImport:
    tasks: DataFrame
    mismatches: DataFrame
    rejects: DataFrame
    errors: DataFrame
    counts: DataFrame


def import_sheets(grid: DataFrame, carry_status: bool = True, fallback_year: int | None = None) -> SheetImport:
    """All sheets of a grid.  Task ids follow sheet, row and product order."""
    layouts = pin(sheets.sheet_layouts(grid))  # looked for once, read by rows and errors
    rows = sheets.mapped_rows(grid, layouts)
    # Parsed once; numbering and counting read the parsed items.
    items = pin(sheets.line_items(rows, carry_status=carry_status, fallback_year=fallback_year))
    numbered = number_tasks(items.withColumn("_status", F.col("task_status")), ["sheet_id", "row_no", "item_no"])
    tasks = numbered.withColumn("task_status", F.col("_status")).select(
        "sheet_id", "row_no", "item_no", *TASK_COLUMNS
    )
    return SheetImport(
        tasks, sheets.count_mismatches(rows), sheets.rejected_rows(rows), sheets.sheet_errors(grid, layouts), sheets.sheet_counts(items)
    )
