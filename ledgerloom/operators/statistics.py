"""Descriptive statistics of one numeric column.

Quartiles come from ``selection``, which sorts nothing.  What needs every value's place comes from
``value_positions`` - the distinct values with their counts and positions - so ties cost nothing and no task
sees the whole column.  A caller with several questions about one column passes them along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.normal import normal_density
from ledgerloom.operators.positions import interpolated, value_positions
from ledgerloom.operators.selection import ACCURACY, approximate_quantiles, quantiles

HISTOGRAM_BINS = 24
CURVE_POINTS = 400
FENCE_FACTOR = 1.5
QUARTILES = {"q1": 0.25, "median": 0.50, "q3": 0.75}

SUMMARY = (
    ("count", "n"),
    ("mean", "mean"),
    ("median", "median"),
    ("std dev", "std_dev"),
    ("min", "min"),
    ("max", "max"),
    ("Q1", "q1"),
    ("Q3", "q3"),
    ("IQR", "iqr"),
    ("skewness", "skewness"),
    ("excess kurtosis", "excess_kurtosis"),
    ("lower fence", "lower_fence"),
    ("upper fence", "upper_fence"),
    ("outliers (1.5×IQR)", "outliers"),
)


def _with_fences(row: DataFrame) -> DataFrame:
    iqr = F.col("q3") - F.col("q1")
    return row.withColumns(
        {
            "iqr": iqr,
            "lower_fence": F.col("q1") - FENCE_FACTOR * iqr,
            "upper_fence": F.col("q3") + FENCE_FACTOR * iqr,
        }
    )


def _quartiles(positions: DataFrame, value: str) -> DataFrame:
    return positions.agg(
        interpolated(value, 0.25).alias("q1"),
        interpolated(value, 0.50).alias("median"),
        interpolated(value, 0.75).alias("q3"),
    )


def quartiles(df: DataFrame, value: str, positions: DataFrame | None = None) -> DataFrame:
    """Q1, median and Q3 with linear interpolation, one row."""
    return quantiles(df, value, QUARTILES) if positions is None else _quartiles(positions, value)


def approximate_quartiles(df: DataFrame, value: str, accuracy: int = ACCURACY) -> DataFrame:
    """Q1, median and Q3 as values of the column, off their rank by ``n / accuracy`` at most, from one pass."""
    return approximate_quantiles(df, value, QUARTILES, accuracy)


def tukey_fences(df: DataFrame, value: str, positions: DataFrame | None = None) -> DataFrame:
    """Quartiles, IQR, the 1.5 IQR fences and how many values lie outside, one row."""
    positions = value_positions(df, value) if positions is None else positions
    return _count_outliers(positions, value)


def _one_row(df: DataFrame, name: str) -> Column:
    """A one-row frame as a struct-valued scalar subquery."""
    return df.select(F.struct(*df.columns).alias(name)).scalar()


def _count_outliers(positions: DataFrame, value: str) -> DataFrame:
    fences = _with_fences(_quartiles(positions, value))
    number = F.col(value).cast("double")
    marked = positions.withColumn("_f", _one_row(fences, "f"))
    outside = (number < F.col("_f.lower_fence")) | (number > F.col("_f.upper_fence"))
    return marked.agg(
        *[F.first(f"_f.{c}").alias(c) for c in fences.columns],
        F.coalesce(F.sum(F.when(outside, F.col("n"))), F.lit(0)).cast("bigint").alias("outliers"),
    )


def outlier_rows(df: DataFrame, value: str) -> DataFrame:
    """The rows whose value lies outside the fences."""
    fences = _with_fences(quartiles(df, value))
    number = F.col(value).cast("double")
    bounds = df.withColumn("_f", _one_row(fences, "f"))
    return bounds.where((number < F.col("_f.lower_fence")) | (number > F.col("_f.upper_fence"))).drop("_f")


def moments(df: DataFrame, value: str) -> DataFrame:
    """Sample standard deviation, population skewness and excess kurtosis, one row."""
    number = F.col(value).cast("double")
    return df.agg(
        F.count(number).alias("n"),
        F.avg(number).alias("mean"),
        F.stddev_samp(number).alias("std_dev"),
        F.skewness(number).alias("skewness"),
        F.kurtosis(number).alias("excess_kurtosis"),
    )


def box_plot(df: DataFrame, value: str, positions: DataFrame | None = None) -> DataFrame:
    """Quartiles, whisker ends (last values inside the fences) and number of fliers, one row."""
    positions = value_positions(df, value) if positions is None else positions
    fences = _with_fences(_quartiles(positions, value))
    number = F.col(value).cast("double")
    marked = positions.withColumn("_f", _one_row(fences, "f"))
    low, high = F.col("_f.lower_fence"), F.col("_f.upper_fence")
    return marked.agg(
        F.first("_f.q1").alias("q1"),
        F.first("_f.median").alias("median"),
        F.first("_f.q3").alias("q3"),
        F.min(F.when(number >= low, number)).alias("whisker_low"),
        F.max(F.when(number <= high, number)).alias("whisker_high"),
        F.coalesce(F.sum(F.when((number < low) | (number > high), F.col("n"))), F.lit(0))
        .cast("bigint")
        .alias("fliers"),
    ).withColumns(
        {
            "whisker_low": F.least("whisker_low", "q1"),
            "whisker_high": F.greatest("whisker_high", "q3"),
        }
    )


def histogram(df: DataFrame, value: str, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Equal-width density histogram: ``bin, bin_start, bin_end, n, density``, empty bins included.

    The last bin includes its upper edge.  A column with one distinct value is
    spread over an interval of width 1 around it.
    """
    number = F.col(value).cast("double")
    values = df.where(number.isNotNull()).select(number.alias("x"))
    span = values.agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("x").alias("n")).select(
        F.when(F.col("hi") > F.col("lo"), F.col("lo")).otherwise(F.col("lo") - 0.5).alias("lo"),
        F.when(F.col("hi") > F.col("lo"), F.col("hi")).otherwise(F.col("hi") + 0.5).alias("hi"),
        "n",
    )
    place = (F.col("x") - F.col("_s.lo")) / (F.col("_s.hi") - F.col("_s.lo")) * bins
    counted = (
        values.withColumn("_s", _one_row(span, "s"))
        .groupBy(F.least(F.floor(place), F.lit(bins - 1)).cast("bigint").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    width = (F.col("_s.hi") - F.col("_s.lo")) / bins
    return (
        df.sparkSession.range(bins)
        .withColumnRenamed("id", "bin")
        .join(counted, "bin", "left")
        .withColumn("_s", _one_row(span, "s"))
        .select(
            "bin",
            (F.col("_s.lo") + F.col("bin") * width).alias("bin_start"),
            (F.col("_s.lo") + (F.col("bin") + 1) * width).alias("bin_end"),
            F.coalesce("n", F.lit(0)).cast("bigint").alias("n"),
            (F.coalesce("n", F.lit(0)) / (F.col("_s.n") * width)).alias("density"),
        )
    )


def normal_curve(df: DataFrame, value: str, points: int = CURVE_POINTS) -> DataFrame:
    """The fitted normal density on an even grid over the range: ``point, x, density``."""
    number = F.col(value).cast("double")
    fit = df.agg(
        F.min(number).alias("lo"),
        F.max(number).alias("hi"),
        F.avg(number).alias("mean"),
        F.stddev_samp(number).alias("sd"),
    )
    return (
        df.sparkSession.range(points)
        .withColumnRenamed("id", "point")
        .withColumn("_f", _one_row(fit, "f"))
        .withColumn("x", F.col("_f.lo") + (F.col("_f.hi") - F.col("_f.lo")) * F.col("point") / (points - 1))
        .select("point", "x", normal_density(F.col("x"), F.col("_f.mean"), F.col("_f.sd")).alias("density"))
    )


def summary_row(df: DataFrame, value: str, positions: DataFrame | None = None) -> DataFrame:
    """All fourteen summary statistics as one row, from one pass over ``df``.

    Moments are taken over the distinct values and their counts, which are pinned
    already: the mean first, then the central moments around it.
    """
    positions = value_positions(df, value) if positions is None else positions
    number, n = F.col(value).cast("double"), F.col("n")
    outliers = _count_outliers(positions, value)
    centre = positions.agg((F.sum(number * n) / F.sum(n))).scalar()
    gap = number - F.col("_mean")
    spread = (
        positions.withColumn("_mean", centre)
        .agg(
            F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n"),
            F.first("_mean").alias("mean"),
            F.min(number).alias("min"),
            F.max(number).alias("max"),
            *[F.sum(F.pow(gap, p) * n).alias(f"m{p}") for p in (2, 3, 4)],
        )
        .withColumns(
            {
                "std_dev": F.sqrt(F.try_divide("m2", F.col("n") - 1)),
                "skewness": F.try_divide(F.col("m3") / F.col("n"), F.pow(F.col("m2") / F.col("n"), F.lit(1.5))),
                "excess_kurtosis": F.try_divide(F.col("m4") * F.col("n"), F.col("m2") * F.col("m2")) - 3.0,
            }
        )
        .drop("m2", "m3", "m4")
    )
    return spread.withColumn("_o", _one_row(outliers, "o")).select(
        *spread.columns, *[F.col(f"_o.{c}").alias(c) for c in outliers.columns]
    )


def summary_table(df: DataFrame, value: str, positions: DataFrame | None = None) -> DataFrame:
    """The summary as ``position, statistic, value`` rows in reporting order."""
    rows = F.array(
        *[
            F.struct(
                F.lit(i).alias("position"),
                F.lit(label).alias("statistic"),
                F.col(name).cast("double").alias("value"),
            )
            for i, (label, name) in enumerate(SUMMARY, start=1)
        ]
    )
    return summary_row(df, value, positions).select(F.inline(rows))
