"""Two distribution tests: distributed aggregates, and p-values as column expressions of the one row of sums."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.normal import normal_quantile, normal_upper_tail, polynomial
from ledgerloom.operators.positions import value_positions

KS_TERMS = 20  # the 21st is below 1e-15 wherever the series is used
SHAPIRO_CALIBRATED_MAX_N = 5_000
RANKS_PER_ROW = 10_000

# Polynomial coefficients of Royston's AS R94 (1995), lowest power first.
WEIGHT_LAST = (0.0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056)
WEIGHT_SECOND = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
SMALL_N_MEAN = (0.544, -0.39978, 0.025054, -6.714e-4)
SMALL_N_LOG_SD = (1.3822, -0.77857, 0.062767, -0.0020322)
LARGE_N_MEAN = (-1.5861, -0.31082, -0.083751, 0.0038915)
LARGE_N_LOG_SD = (-0.4803, -0.082676, 0.0030302)
SMALL_N_GAMMA = (-2.273, 0.459)


def ks_upper_tail(n: Column, d: Column) -> Column:
    """P(D_n >= d): Kolmogorov's limit at Vrbik's corrected distance (2018), for every n."""
    n = n.cast("double")
    plain = d * F.sqrt(n)
    t = plain + 1 / (6 * F.sqrt(n)) + (plain - 1) / (4 * n)
    terms = [F.exp(-2.0 * k * k * t * t) * (2.0 if k % 2 else -2.0) for k in range(1, KS_TERMS + 1)]
    tail = F.aggregate(F.array(*terms), F.lit(0.0), lambda a, x: a + x)
    return F.when((n >= 1) & d.isNotNull(), F.when(d >= 1, 0.0).when(t < 0.2, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), tail))))


def ks_uniform(df: DataFrame, value: str, positions: DataFrame | None = None) -> DataFrame:
    """Kolmogorov-Smirnov distance to the uniform distribution over [min, max]: ``n, d, p``.

    The range is fitted on the same data, so p is optimistic.
    """
    positions = value_positions(df, value) if positions is None else positions
    number = F.col(value).cast("double")
    ends = positions.agg(F.struct(F.min(number).alias("lo"), F.max(number).alias("hi"))).scalar()
    u = F.try_divide(number - F.col("_e.lo"), F.col("_e.hi") - F.col("_e.lo"))
    above = (F.col("before") + F.col("n")) / F.col("total") - u
    below = u - F.col("before") / F.col("total")
    distance = positions.withColumn("_e", ends).agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n"),
        F.max(F.greatest(above, below)).alias("d"),
    )
    return distance.withColumn("p", ks_upper_tail(F.col("n"), F.col("d")))


def shapiro_upper_tail(n: Column, w: Column) -> Column:
    """P(W <= w) by Royston's approximation; exact for three values."""
    n = n.cast("double")
    three = F.greatest(F.lit(0.0), 6 / math.pi * (F.asin(F.sqrt(w)) - math.asin(math.sqrt(0.75))))
    y = F.log(1 - w)
    gamma = polynomial(SMALL_N_GAMMA, n)
    small = (-F.log(gamma - y) - polynomial(SMALL_N_MEAN, n)) / F.exp(polynomial(SMALL_N_LOG_SD, n))
    size = F.log(n)
    large = (y - polynomial(LARGE_N_MEAN, size)) / F.exp(polynomial(LARGE_N_LOG_SD, size))
    p = F.when(n == 3, three).when(w >= 1, 1.0).when((n <= 11) & (y >= gamma), 1e-99)
    return F.when((n >= 3) & w.isNotNull(), p.otherwise(normal_upper_tail(F.when(n <= 11, small).otherwise(large))))


def _expected_score_sums(positions: DataFrame, value: str) -> DataFrame:
    """Sums over all ranks of the expected normal scores m, and of m times the value.

    A value that occurs n times covers n ranks.  Its ranks are dealt out in runs of
    at most ``RANKS_PER_ROW`` and shuffled before they are expanded, so a value
    that holds a third of the column is spread over all tasks.
    """
    first, last = F.col("before") + 1, F.col("before") + F.col("n")
    runs = (
        positions.select(
            F.col(value).cast("double").alias("x"),
            "total",
            last.alias("last"),
            F.explode(F.sequence(first, last, F.lit(RANKS_PER_ROW).cast("bigint"))).alias("run"),
        )
        .repartition("run")
        .select(
            "x",
            "total",
            F.explode(
                F.sequence("run", F.least(F.col("run") + (RANKS_PER_ROW - 1), F.col("last")))
            ).alias("rank"),
        )
    )
    score = normal_quantile((F.col("rank") - 0.375) / (F.col("total") + 0.25))
    return runs.select("x", score.alias("m")).agg(
        F.sum(F.col("m") * F.col("m")).alias("mm"), F.sum(F.col("m") * F.col("x")).alias("mx")
    )


def shapiro_wilk(df: DataFrame, value: str, positions: DataFrame | None = None) -> DataFrame:
    """Shapiro-Wilk test of normality: ``n, w, p, p_calibrated``.

    p follows Royston's approximation, calibrated up to 5,000 values; above that it
    is still given and ``p_calibrated`` is false.
    """
    positions = value_positions(df, value) if positions is None else positions
    number = F.col(value).cast("double")
    count = F.col("total")

    def at(position: Column) -> Column:
        return F.max(F.when((F.col("before") < position) & (position <= F.col("before") + F.col("n")), number))

    centre = positions.agg(F.sum(number * F.col("n")) / F.sum("n")).scalar()
    gap = number - F.col("_mean")
    ends = positions.withColumn("_mean", centre).agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n"),
        F.sum(gap * gap * F.col("n")).alias("ss"),
        at(F.lit(1)).alias("x1"),
        at(F.lit(2)).alias("x2"),
        at(count - 1).alias("y2"),
        at(count).alias("y1"),
    )
    sums = _expected_score_sums(positions, value).select(F.struct("mm", "mx").alias("s")).scalar()
    n = F.col("n").cast("double")
    root = 1.0 / F.sqrt(n)
    scored = ends.withColumn("_s", sums).withColumns(
        {
            "mm": F.col("_s.mm"),
            "m1": normal_quantile(0.625 / (n + 0.25)),
            "m2": normal_quantile(F.least(F.lit(1.625), n - 0.375) / (n + 0.25)),
        }
    )
    norm = F.sqrt("mm")
    last = F.when(F.col("n") == 3, math.sqrt(0.5)).otherwise(
        polynomial(WEIGHT_LAST, root) - F.col("m1") / norm
    )
    second = polynomial(WEIGHT_SECOND, root) - F.col("m2") / norm
    weighed = scored.withColumns({"a1": last, "a2": second})
    m1, m2, a1, a2 = (F.col(c) for c in ("m1", "m2", "a1", "a2"))
    wide = F.col("n") > 5
    scale = F.when(
        wide, (F.col("mm") - 2 * m1 * m1 - 2 * m2 * m2) / (1 - 2 * a1 * a1 - 2 * a2 * a2)
    ).when(F.col("n") > 3, (F.col("mm") - 2 * m1 * m1) / (1 - 2 * a1 * a1))
    outer, inner = F.col("y1") - F.col("x1"), F.col("y2") - F.col("x2")
    middle = F.col("_s.mx") + m1 * outer + F.when(wide, m2 * inner).otherwise(0.0)
    combined = (
        a1 * outer
        + F.when(wide, a2 * inner).otherwise(0.0)
        + F.when(F.col("n") > 3, middle / F.sqrt(scale)).otherwise(0.0)
    )
    w = F.when((F.col("n") >= 3) & (F.col("ss") > 0), F.least(combined * combined / F.col("ss"), F.lit(1.0)))
    return (
        weighed.select("n", w.alias("w"))
        .withColumn("p", shapiro_upper_tail(F.col("n"), F.col("w")))
        .withColumn("p_calibrated", F.col("n") <= SHAPIRO_CALIBRATED_MAX_N)
    )
