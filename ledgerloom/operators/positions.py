"""Positions in one global order, without a window over the whole table.

A window with ORDER BY and no PARTITION BY sorts all rows in one task.  Here the
rows are range-partitioned by their (unique) order key, each range sums its own
rows, and the range totals - one row per partition - give every range its offset.

Ranges must be the same for the totals and for the rows, so the partitioned rows
are pinned before either is computed.  Tied values never make a fat range: values
are counted first, so each value is one row however often it occurs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.session import pin, shuffle_partitions


def running_total(
    df: DataFrame,
    order_by: list[Column],
    weight: Column | None = None,
    before: str = "before",
    total: str = "total",
    ranges: int | None = None,
) -> DataFrame:
    """Add, per row, the weight of all rows before it and the weight of all rows.

    ``order_by`` must identify a row.  The weight is a whole number, 1 by default.  ``ranges`` is
    how many tasks share the rows, by default the session's shuffle partitions.

    Rows are sorted inside their range before they are pinned.  With the weight 1 a row's place
    there is its number in its partition, so nothing is shuffled again.
    """
    parts = ranges or shuffle_partitions(df.sparkSession)
    dealt = df.withColumn("_weight", F.lit(1) if weight is None else weight.cast("bigint")).repartitionByRange(parts, *order_by)
    # The number of a row in its partition is the low 33 bits of its id.
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranges = pin(dealt.sortWithinPartitions(*order_by).select("*", F.spark_partition_id().alias("_range"), place.alias("_inside")))
    # One row per range: the unpartitioned windows below never see more than that.
    by_range = ranges.groupBy("_range").agg(F.sum("_weight").alias("_in_range"))
    offsets = by_range.select(
        "_range",
        F.coalesce(
            F.sum("_in_range").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0).cast("bigint"),
        ).alias("_offset"),
        F.sum("_in_range").over(Window.partitionBy()).alias(total),
    )
    if weight is not None:
        inside = Window.partitionBy("_range").orderBy("_inside").rowsBetween(Window.unboundedPreceding, -1)
        ranges = ranges.withColumn("_inside", F.coalesce(F.sum("_weight").over(inside), F.lit(0).cast("bigint")))
    return (
        ranges.join(F.broadcast(offsets), "_range")
        .withColumn(before, F.col("_offset") + F.col("_inside"))
        .drop("_weight", "_range", "_inside", "_offset")
    )


def row_numbers(df: DataFrame, order_by: list[Column], out: str = "row_number", ranges: int | None = None) -> DataFrame:
    """ROW_NUMBER over one global, unique order."""
    return (
        running_total(df, order_by, before="_before", total="_total", ranges=ranges)
        .withColumn(out, F.col("_before") + 1)
        .drop("_before", "_total")
    )


def value_positions(df: DataFrame, value: str, keep_nulls: bool = False) -> DataFrame:
    """One row per distinct value: ``value, n, before, total`` in ascending order.

    The value takes positions ``before + 1 .. before + n`` of ``total``.  Nulls are
    left out, or sort first with ``keep_nulls``.
    """
    source = df.select(value) if keep_nulls else df.select(value).where(F.col(value).isNotNull())
    counts = source.groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    return running_total(counts, [F.col(value).asc_nulls_first()], F.col("n"))


def dense_ranks(df: DataFrame, value: str, out: str = "amount_rank") -> DataFrame:
    """DENSE_RANK, highest value first, as one row per distinct value."""
    distinct = df.select(value).distinct()
    return row_numbers(distinct, [F.col(value).desc_nulls_last()], out)


def kth_highest(df: DataFrame, value: str, k: int, method: str = "dense", out: str = "amount_rank") -> DataFrame:
    """The k-th highest distinct value (``dense``) or row (``row``); empty when there is none."""
    if method not in ("dense", "row"):
        raise ValueError(f"unknown method {method!r}")
    values = df.select(value).distinct() if method == "dense" else df.select(value)
    # Top-k is the feature: each task keeps k values, and k of those survive.
    top = values.orderBy(F.col(value).desc_nulls_last()).limit(k)
    ranked = top.agg(
        F.count(F.lit(1)).alias(out),
        F.when(F.count_if(F.col(value).isNull()) == 0, F.min(value)).alias(value),
    )
    return ranked.where(F.col(out) == k).select(F.col(out).cast("bigint").alias(out), value)


def ntile_of(row_number: Column, total: Column, buckets: int) -> Column:
    """NTILE in closed form: the first ``total % buckets`` buckets hold one row more."""
    each = F.floor(total / buckets).cast("bigint")
    larger = total % buckets
    in_larger = larger * (each + 1)
    return F.when(row_number <= in_larger, F.ceil(row_number / (each + 1))).otherwise(
        larger + F.ceil((row_number - in_larger) / F.greatest(each, F.lit(1)))
    ).cast("bigint")


def ntiles(df: DataFrame, order_by: list[Column], buckets: int, out: str) -> DataFrame:
    """NTILE over one global, unique order."""
    return (
        running_total(df, order_by, before="_before", total="_total")
        .withColumn(out, ntile_of(F.col("_before") + 1, F.col("_total"), buckets))
        .drop("_before", "_total")
    )


def ntile_maxima(positions: DataFrame, value: str, buckets: int, names: dict[int, str]) -> DataFrame:
    """The highest value of the named NTILE buckets, as one row.

    ``positions`` comes from ``value_positions``.  Bucket j ends at position
    ``j * (n div k) + min(j, n mod k)``; a bucket without rows gives null.
    """
    each = F.floor(F.col("total") / buckets)
    larger = F.col("total") % buckets

    def last_of(j: int) -> Column:
        end = F.lit(j) * each + F.least(F.lit(j), larger)
        here = (F.col("before") < end) & (end <= F.col("before") + F.col("n"))
        return F.max(F.when(here & ((each > 0) | (larger >= j)), F.col(value)))

    return positions.agg(*[last_of(j).alias(name) for j, name in names.items()])


def interpolated(value: str, share: float) -> Column:
    """Aggregate over ``value_positions``: the quantile with linear interpolation."""
    place = (F.col("total") - 1) * F.lit(share)
    low, high = F.floor(place), F.ceil(place)
    number = F.col(value).cast("double")

    def at(position: Column) -> Column:
        here = (F.col("before") <= position) & (position < F.col("before") + F.col("n"))
        return F.max(F.when(here, number))

    return at(low) + (at(high) - at(low)) * F.max(place - low)
