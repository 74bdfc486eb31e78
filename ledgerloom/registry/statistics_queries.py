"""Descriptive statistics and distribution tests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import normal
from ledgerloom.operators import hypothesis, ledger, statistics
from ledgerloom.registry import views
from ledgerloom.registry.base import Query
from ledgerloom.registry.views import with_views

AMOUNT = ledger.AMOUNT
LOADS = with_views("tx") + (
    ", loads AS (SELECT CAST(transaction_amt AS DOUBLE) AS x FROM tx WHERE transaction_type = 'CREDIT')"
)


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _loads(build):
    return lambda spark, sf: build(ledger.credits(views.transactions(spark, sf)))


def _values(build):
    return lambda spark, sf: build(views.table(spark, sf, "events"))


def _quantiles(column: str, table: str) -> str:
    return f"""q AS (SELECT quantile_cont({column}, 0.25) AS q1, quantile_cont({column}, 0.5) AS median,
  quantile_cont({column}, 0.75) AS q3 FROM {table}),
f AS (SELECT *, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lower_fence, q3 + 1.5 * (q3 - q1) AS upper_fence FROM q)"""


def _horner_sql(coefficients: tuple[float, ...], x: str) -> str:
    result = repr(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        result = f"({result} * {x} + {c!r})"
    return f"{result}::DOUBLE"


def _normal_quantile_sql(p: str) -> str:
    tail = f"sqrt(-ln(least({p}, 1.0 - {p})))"
    centre = f"(0.180625::DOUBLE - ({p} - 0.5) * ({p} - 0.5))"
    ratio = "(" + _horner_sql(normal.CENTRE_NUM, centre) + ") / (" + _horner_sql(normal.CENTRE_DEN, centre) + ")"
    near = _horner_sql(normal.TAIL_NUM, f"({tail} - 1.6)") + " / " + _horner_sql(normal.TAIL_DEN, f"({tail} - 1.6)")
    far = _horner_sql(normal.FAR_NUM, f"({tail} - 5.0)") + " / " + _horner_sql(normal.FAR_DEN, f"({tail} - 5.0)")
    return (
        f"CASE WHEN abs({p} - 0.5) <= 0.425 THEN ({p} - 0.5) * {ratio} "
        f"ELSE sign({p} - 0.5) * CASE WHEN {tail} <= 5.0 THEN {near} ELSE {far} END END"
    )


_SHAPIRO_SQL = (
    LOADS
    + f""", ranked AS (SELECT x, row_number() OVER (ORDER BY x) AS i, count(*) OVER ()::DOUBLE AS n FROM loads),
probs AS (SELECT *, (i - 0.375)::DOUBLE / (n + 0.25) AS p FROM ranked),
scores AS (SELECT *, {_normal_quantile_sql('p')} AS m FROM probs),
base AS (SELECT max(n) AS n, sum(m * m) AS mm, max(m) FILTER (i = n) AS mn, max(m) FILTER (i = n - 1) AS mn1 FROM scores),
ends AS (SELECT *, {_horner_sql(hypothesis.WEIGHT_LAST, '(1 / sqrt(n))')} + mn / sqrt(mm) AS a1,
  {_horner_sql(hypothesis.WEIGHT_SECOND, '(1 / sqrt(n))')} + mn1 / sqrt(mm) AS a2 FROM base),
phi AS (SELECT *, sqrt((mm - 2 * mn * mn - 2 * mn1 * mn1) / (1 - 2 * a1 * a1 - 2 * a2 * a2)) AS scale FROM ends),
weights AS (SELECT x, CASE WHEN i = 1 THEN -a1 WHEN i = s.n THEN a1 WHEN i = 2 THEN -a2 WHEN i = s.n - 1 THEN a2
  ELSE m / scale END AS a FROM scores s, phi)
SELECT count(*) AS n, round(power(sum(a * x), 2) / (var_pop(x) * count(*)), 8) AS w FROM weights"""
)

_KS_SQL = """ranked AS (SELECT {x} AS x, row_number() OVER (ORDER BY {x}) AS i, count(*) OVER () AS n,
  min({x}) OVER () AS lo, max({x}) OVER () AS hi FROM {src}),
dist AS (SELECT max(n) AS n, max(greatest(i / n - (x - lo) / (hi - lo), (x - lo) / (hi - lo) - (i - 1) / n)) AS d FROM ranked)"""

# Kolmogorov's series and the normal integral as sums over numbered terms.
_KS_T = "(d * sqrt(n) + 1 / (6 * sqrt(n)) + (d * sqrt(n) - 1) / (4 * n))"
_KS_P = f"""round(CASE WHEN d >= 1 THEN 0.0 WHEN {_KS_T} < 0.2 THEN 1.0 ELSE least(1.0, greatest(0.0, (
    SELECT sum(2 * power(-1, k - 1) * exp(-2 * k * k * power({_KS_T}, 2)))
    FROM (SELECT unnest(range(1, 101)) AS k)))) END, 9)"""

_SHAPIRO_P = f"""WITH tested AS ({_SHAPIRO_SQL}),
z AS (SELECT n, w, (ln(1 - w) - {_horner_sql(hypothesis.LARGE_N_MEAN, 'ln(n)')})
        / exp({_horner_sql(hypothesis.LARGE_N_LOG_SD, 'ln(n)')}) AS z FROM tested),
tail AS (SELECT n, w, z, (SELECT sum(CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END
        * exp(-power(abs(z) + i * 0.003, 2) / 2)) * 0.001 / sqrt(2 * pi()) FROM (SELECT unnest(range(4001)) AS i)) AS t FROM z)
SELECT n, w, CASE WHEN t = 0 THEN 0 ELSE round(CASE WHEN z >= 0 THEN t ELSE 1 - t END, 9) END AS p, n <= 5000 AS p_calibrated FROM tail"""

_HISTOGRAM_SQL = """s AS (SELECT min(x) AS lo, max(x) AS hi, count(*) AS n FROM loads),
counted AS (SELECT CAST(least(floor((x - lo) / (hi - lo) * 24), 23) AS BIGINT) AS bin, count(*) AS c FROM loads, s GROUP BY 1)
SELECT b.bin, round(lo + b.bin * ((hi - lo) / 24), 6) AS bin_start, round(lo + (b.bin + 1) * ((hi - lo) / 24), 6) AS bin_end,
       coalesce(c, 0) AS n, round(coalesce(c, 0) / (n * ((hi - lo) / 24)), 12) AS density
FROM (SELECT unnest(range(24)) AS bin) b LEFT JOIN counted ON counted.bin = b.bin, s"""

_POWERS = """m AS (SELECT avg(x) AS mu, count(*)::DOUBLE AS n FROM loads),
c AS (SELECT max(n) AS n, max(mu) AS mean, sum(power(x - mu, 2)) AS s2, sum(power(x - mu, 3)) AS s3,
  sum(power(x - mu, 4)) AS s4 FROM loads, m),
mo AS (SELECT CAST(n AS BIGINT) AS n, mean, sqrt(s2 / (n - 1)) AS std_dev,
  (s3 / n) / power(s2 / n, 1.5) AS skewness, n * s4 / (s2 * s2) - 3 AS excess_kurtosis FROM c)"""

_SUMMARY_SQL = (
    f"{LOADS}, {_quantiles('x', 'loads')}, {_POWERS},"
    + """ e AS (SELECT min(x) AS mn, max(x) AS mx FROM loads),
o AS (SELECT count(*) FILTER (x < lower_fence OR x > upper_fence) AS outliers FROM loads, f)
SELECT unnest(range(1, 15)) AS position,
  unnest(['count', 'mean', 'median', 'std dev', 'min', 'max', 'Q1', 'Q3', 'IQR', 'skewness', 'excess kurtosis',
          'lower fence', 'upper fence', 'outliers (1.5×IQR)']) AS statistic,
  unnest([round(v, 6) FOR v IN [n::DOUBLE, mean, median, std_dev, mn, mx, q1, q3, iqr, skewness, excess_kurtosis,
          lower_fence, upper_fence, outliers::DOUBLE]]) AS value
FROM mo, f, e, o"""
)
_FENCES = ("q1", "median", "q3", "iqr", "lower_fence", "upper_fence")


def _round_sql(columns: tuple[str, ...], digits: int) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in columns)


def approximate_line_price_quartiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each approximate quartile's true rank is within its stated error."""
    lines = views.table(spark, sf_dir, "lineitem").select("l_extendedprice")
    found = statistics.approximate_quartiles(lines, "l_extendedprice", accuracy=1000).first()
    shares = statistics.QUARTILES
    value = F.col("l_extendedprice").cast("double")
    counts = lines.agg(
        F.count(value).alias("n"), *[F.count_if(value < found[q]).alias(f"b_{q}") for q in shares], *[F.count_if(value <= found[q]).alias(f"u_{q}") for q in shares]
    )

    def row(q: str, share: float):
        near = (F.col(f"b_{q}") <= F.col("n") * (share + 1e-3) + 1) & (F.col(f"u_{q}") >= F.col("n") * (share - 1e-3) - 1)
        return F.struct(F.lit(share).cast("decimal(3,2)").cast("double").alias("share"), near.alias("within"))

    return counts.select(F.inline(F.array(*[row(q, share) for q, share in shares.items()])))


QUERIES = [
    Query(
        "load_quartiles",
        _loads(lambda df: rounded(statistics.quartiles(df, AMOUNT), 6, "q1", "median", "q3")),
        LOADS + ", " + _quantiles("x", "loads") + f" SELECT {_round_sql(('q1', 'median', 'q3'), 6)} FROM q",
    ),
    Query(
        "line_price_quartiles",
        lambda spark, sf: rounded(
            statistics.quartiles(views.table(spark, sf, "lineitem"), "l_extendedprice"), 6, "q1", "median", "q3"
        ),
        "WITH " + _quantiles("l_extendedprice", "lineitem") + f" SELECT {_round_sql(('q1', 'median', 'q3'), 6)} FROM q",
    ),
    Query(
        "approximate_line_price_quartiles",
        approximate_line_price_quartiles,
        "WITH x AS (SELECT count(l_extendedprice) AS n FROM lineitem) SELECT 0.25::DOUBLE AS share, true AS within FROM x UNION ALL SELECT 0.5, true FROM x "
        "UNION ALL SELECT 0.75, true FROM x",
    ),
    Query(
        "value_fences",
        _values(lambda df: rounded(statistics.tukey_fences(df, "value"), 6, *_FENCES)),
        "WITH " + _quantiles("value", "events") + f""" SELECT {_round_sql(_FENCES, 6)}, outliers FROM f,
  (SELECT count(*) FILTER (value < lower_fence OR value > upper_fence) AS outliers FROM events, f)""",
    ),
    Query(
        "value_outliers",
        _values(lambda df: statistics.outlier_rows(df.select("event_id", "user_id", "value"), "value")),
        "WITH " + _quantiles("value", "events") + """ SELECT event_id, user_id, value FROM events, f
WHERE value < lower_fence OR value > upper_fence""",
    ),
    Query(
        "load_moments",
        _loads(lambda df: rounded(statistics.moments(df, AMOUNT), 6, "mean", "std_dev", "skewness", "excess_kurtosis")),
        f"{LOADS}, {_POWERS} SELECT n, {_round_sql(('mean', 'std_dev', 'skewness', 'excess_kurtosis'), 6)} FROM mo",
    ),
    Query(
        "load_box_plot",
        _loads(
            lambda df: rounded(
                statistics.box_plot(df, AMOUNT), 6, "q1", "median", "q3", "whisker_low", "whisker_high"
            )
        ),
        LOADS + ", " + _quantiles("x", "loads") + """, w AS (
  SELECT min(x) FILTER (x >= lower_fence) AS lo, max(x) FILTER (x <= upper_fence) AS hi,
         count(*) FILTER (x < lower_fence OR x > upper_fence) AS fliers FROM loads, f)
SELECT round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
       round(least(lo, q1), 6) AS whisker_low, round(greatest(hi, q3), 6) AS whisker_high, fliers FROM w, f""",
    ),
    Query(
        "value_box_plot",
        _values(
            lambda df: rounded(
                statistics.box_plot(df, "value"), 6, "q1", "median", "q3", "whisker_low", "whisker_high"
            )
        ),
        "WITH " + _quantiles("value", "events") + """, w AS (
  SELECT min(value) FILTER (value >= lower_fence) AS lo, max(value) FILTER (value <= upper_fence) AS hi,
         count(*) FILTER (value < lower_fence OR value > upper_fence) AS fliers FROM events, f)
SELECT round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
       round(least(lo, q1), 6) AS whisker_low, round(greatest(hi, q3), 6) AS whisker_high, fliers FROM w, f""",
    ),
    Query(
        "load_histogram",
        _loads(
            lambda df: rounded(rounded(statistics.histogram(df, AMOUNT), 6, "bin_start", "bin_end"), 12, "density")
        ),
        f"{LOADS}, {_HISTOGRAM_SQL}",
    ),
    Query(
        "load_normal_curve",
        _loads(lambda df: rounded(rounded(statistics.normal_curve(df, AMOUNT), 4, "x"), 14, "density")),
        LOADS
        + """, fit AS (SELECT min(x) AS lo, max(x) AS hi, avg(x) AS mean, stddev_samp(x) AS sd FROM loads),
grid AS (SELECT point, lo + (hi - lo) * point / 399 AS x, mean, sd FROM (SELECT unnest(range(400)) AS point), fit)
SELECT point, round(x, 4) AS x, round(exp(-power((x - mean) / sd, 2) / 2) / (sd * sqrt(2 * pi())), 14) AS density FROM grid""",
    ),
    Query(
        "load_statistics",
        _loads(lambda df: rounded(statistics.summary_table(df, AMOUNT), 6, "value").withColumn("position", F.col("position").cast("bigint"))),
        _SUMMARY_SQL,
    ),
    Query(
        "load_uniformity_distance",
        _loads(lambda df: rounded(hypothesis.ks_uniform(df, AMOUNT).select("n", "d"), 9, "d")),
        f"{LOADS}, {_KS_SQL.format(x='x', src='loads')} SELECT n, round(d, 9) AS d FROM dist",
    ),
    Query(
        "line_price_uniformity",
        lambda spark, sf: rounded(
            hypothesis.ks_uniform(views.table(spark, sf, "lineitem"), "l_extendedprice"), 9, "d", "p"
        ),
        "WITH "
        + _KS_SQL.format(x="l_extendedprice", src="lineitem")
        + f" SELECT n, round(d, 9) AS d, {_KS_P} AS p FROM dist",
    ),
    Query(
        "load_normality_w",
        _loads(lambda df: rounded(hypothesis.shapiro_wilk(df, AMOUNT).select("n", "w"), 8, "w")),
        _SHAPIRO_SQL,
    ),
    Query(
        "load_uniformity",
        _loads(lambda df: rounded(hypothesis.ks_uniform(df, AMOUNT), 9, "d", "p")),
        f"{LOADS}, {_KS_SQL.format(x='x', src='loads')} SELECT n, round(d, 9) AS d, {_KS_P} AS p FROM dist",
    ),
    Query(
        "load_normality",
        _loads(lambda df: rounded(rounded(hypothesis.shapiro_wilk(df, AMOUNT), 8, "w"), 9, "p")),
        _SHAPIRO_P,
    ),
]
