"""Rankings, categories, cohorts and statistics against hand-made and brute-force answers."""

from __future__ import annotations

import math
import random
from datetime import date
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerloom.functions import normal
from ledgerloom.operators import cohorts, hypothesis, ledger, positions, statistics
from ledgerloom.plans.answers import transaction_answers
from ledgerloom.sources import results, transactions

ROWS = [
    # user, amount, category, type, month
    (1, "100.00", "UPI", "DEBIT", "2024-01"), (1, "50.00", "IFT", "CREDIT", "2024-01"),
    (1, "70.00", "UPI", "DEBIT", "2024-03"), (2, "100.00", "UPI", "DEBIT", "2024-02"),
    (2, "20.00", "NEFT", "CREDIT", "2024-02"), (2, None, "UPI", "DEBIT", "2024-03"),
    (3, "5.00", "NEFT", "CREDIT", "2024-04"), (3, "9.99", "NEFT", "CREDIT", "2024-01"),
    (4, "70.00", "UPI", "DEBIT", "2024-03"),
]


@pytest.fixture(scope="module")
def tx(spark):
    df = spark.createDataFrame(ROWS, "user_id long, amt string, narration string, transaction_type string, txn_month string")
    return df.withColumn("transaction_amt", F.col("amt").cast("decimal(18,2)")).drop("amt").cache()


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_kth_highest(tx):
    assert float(ledger.kth_highest_debit(tx, "UPI", 2).first().transaction_amt) == 70.0
    assert float(ledger.kth_highest_debit(tx, "UPI", 2, "row").first().transaction_amt) == 100.0
    assert ledger.kth_highest_debit(tx, "UPI", 7).count() == 0
    with pytest.raises(ValueError):
        positions.kth_highest(tx, "transaction_amt", 1, "other")


def test_categories(tx):
    found = rows(ledger.undeclared_categories(tx))
    assert found == [
        ("UPI", 5, 5, 0, 340.0, 55.56, True), ("NEFT", 3, 0, 3, 34.99, 33.33, True), ("IFT", 1, 0, 1, 50.0, 11.11, False),
    ]


def test_share_of_categories_without_a_window(tx):
    """The total is a partial sum over the categories: no task holds all of them."""
    summary = ledger.category_summary(tx)
    plan = summary._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
    rows = summary.collect()
    whole = sum(r.txn_count for r in rows)
    assert rows and all(r.pct_of_txns == pytest.approx(100 * r.txn_count / whole, abs=0.005) for r in rows)


def test_users_and_totals(tx):
    assert rows(ledger.table_totals(tx)) == [(9, 4, 4)]
    ranking = ledger.user_net_ranking(tx)
    assert [r.user_id for r in ranking.collect()] == [1, 2, 4, 3]
    # Fewer users than deciles: one user per bucket.
    assert [r.user_id for r in ledger.top_decile_users(tx).collect()] == [1]
    assert sorted(r.decile for r in ledger.user_deciles(tx).collect()) == [1, 2, 3, 4]


def test_cohorts_tell_zero_from_impossible(tx):
    matrix = rows(cohorts.cohort_matrix(tx, ledger.debits(tx)))
    assert matrix == [
        ("2024-01", 1, 0, 1, 0), ("2024-02", None, 1, 1, 0), ("2024-03", None, None, 1, 0), ("2024-04", None, None, None, None),
    ]
    assert rows(cohorts.first_active_period(ledger.debits(tx)).orderBy("user_id")) == [(1, "2024-01"), (2, "2024-02"), (4, "2024-03")]


def skewed(seed=7, n=3001):
    """Values of which a third are one and the same, with nulls."""
    rng = random.Random(seed)
    return [None if rng.random() < 0.02 else 50.0 if rng.random() < 0.34 else round(rng.lognormvariate(3, 1), 1) for _ in range(n)]


@pytest.fixture(scope="module")
def numbers(spark):
    df = spark.createDataFrame(list(enumerate(skewed())), "id long, x double")
    return df.repartition(5).cache()


@pytest.mark.parametrize("buckets", [4, 7, 10, 5000])
def test_ntiles_agree_with_one_window(numbers, buckets):
    order = [F.col("x").desc_nulls_last(), F.col("id")]
    ours = positions.ntiles(numbers, order, buckets, "t")
    plain = numbers.withColumn("t", F.ntile(buckets).over(Window.orderBy(*order)).cast("bigint"))
    assert sorted(rows(ours.select("id", "t"))) == sorted(rows(plain.select("id", "t")))


def test_dense_ranks_and_ntile_maxima_agree_with_one_window(numbers):
    ours = positions.dense_ranks(numbers, "x")
    plain = numbers.select("x", F.dense_rank().over(Window.orderBy(F.col("x").desc_nulls_last())).alias("r")).distinct()
    assert set(rows(ours)) == set(rows(plain))
    names = {j: f"t{j}" for j in range(1, 6)}
    found = positions.ntile_maxima(positions.value_positions(numbers, "x", keep_nulls=True), "x", 5, names)
    tiles = numbers.withColumn("t", F.ntile(5).over(Window.orderBy(F.col("x").asc_nulls_first())))
    plain = tiles.groupBy("t").agg(F.max("x")).orderBy("t")
    assert list(found.first()) == [r[1] for r in plain.collect()]


def test_statistics_agree_with_numpy(numbers):
    values = np.array([v for v in skewed() if v is not None])
    q1, q2, q3 = np.percentile(values, [25, 50, 75])
    row = statistics.summary_row(numbers, "x").first()
    gap = values - values.mean()
    m2, m3, m4 = ((gap**p).mean() for p in (2, 3, 4))
    low, high = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    outside = (values < low) | (values > high)
    assert (row.n, row.outliers) == (len(values), outside.sum())
    expected = [values.mean(), q1, q2, q3, values.std(ddof=1), m3 / m2**1.5, m4 / m2**2 - 3, low, high]
    found = [row.mean, row.q1, row.median, row.q3, row.std_dev, row.skewness, row.excess_kurtosis, row.lower_fence, row.upper_fence]
    assert found == pytest.approx(expected, rel=1e-9)
    assert statistics.outlier_rows(numbers, "x").count() == outside.sum()
    box = statistics.box_plot(numbers, "x").first()
    assert (box.whisker_low, box.whisker_high, box.fliers) == (values[values >= low].min(), values[values <= high].max(), outside.sum())
    bins = statistics.histogram(numbers, "x").orderBy("bin").collect()
    counts, edges = np.histogram(values, bins=24)
    assert [b.n for b in bins] == counts.tolist()
    assert [b.bin_start for b in bins] == pytest.approx(edges[:-1].tolist())
    assert sum(b.density for b in bins) * (edges[1] - edges[0]) == pytest.approx(1.0)
    assert len(rows(statistics.summary_table(numbers, "x"))) == 14


def test_a_constant_column_fills_one_bin(spark):
    df = spark.createDataFrame([(3.0,)] * 4, "x double")
    bins = statistics.histogram(df, "x").orderBy("bin").collect()
    assert [b.n for b in bins] == np.histogram([3.0] * 4, bins=24)[0].tolist()


def shapiro_by_hand(values):
    x = np.sort(values)
    n = len(x)
    m = np.array([NormalDist().inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    mm = (m**2).sum()

    def poly(c, u):
        return sum(k * u**i for i, k in enumerate(c))

    last = poly(hypothesis.WEIGHT_LAST, 1 / math.sqrt(n)) + m[-1] / math.sqrt(mm)
    second = poly(hypothesis.WEIGHT_SECOND, 1 / math.sqrt(n)) + m[-2] / math.sqrt(mm)
    phi = (mm - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * second**2)
    a = m / math.sqrt(phi)
    a[-1], a[0], a[-2], a[1] = last, -last, second, -second
    return (a * x).sum() ** 2 / ((x - x.mean()) ** 2).sum()


def test_distribution_tests(numbers):
    values = np.array([v for v in skewed() if v is not None])
    found = hypothesis.shapiro_wilk(numbers, "x").first()
    assert found.w == pytest.approx(shapiro_by_hand(values), rel=1e-9)
    assert found.p < 1e-10 and found.p_calibrated
    u = (np.sort(values) - values.min()) / (values.max() - values.min())
    n = len(u)
    i = np.arange(1, n + 1)
    ks = hypothesis.ks_uniform(numbers, "x").first()
    assert ks.d == pytest.approx(max((i / n - u).max(), (u - (i - 1) / n).max()), rel=1e-12)


def test_p_values(spark):
    def value(expression):
        return spark.range(1).select(expression.alias("x")).first().x

    def ks(n, d):
        return value(hypothesis.ks_upper_tail(F.lit(n), F.lit(d)))

    # Exact by Marsaglia, Tsang and Wang: P(D_10 < 0.274) = 0.6284796154565805.  One formula serves every n.
    assert ks(10, 0.274) == pytest.approx(1 - 0.62847961545658, abs=1e-3)
    assert ks(10_000, 0.012) == pytest.approx(ks(10_001, 0.012), abs=1e-4)
    assert ks(10**9, 1.36 / math.sqrt(1e9)) == pytest.approx(0.0495, abs=1e-3)
    assert (ks(50, 0.0), ks(50, 1.0)) == (1.0, pytest.approx(0.0, abs=1e-12))

    # Royston's forms: three values have a closed form, W = 1 leaves no doubt.
    def shapiro(n, w):
        return value(hypothesis.shapiro_upper_tail(F.lit(n), F.lit(w)))

    assert shapiro(3, 0.75) == pytest.approx(0.0, abs=1e-12)
    assert shapiro(3, 1.0) == pytest.approx(1.0, abs=1e-12)
    assert (shapiro(20, 1.0), shapiro(2, 0.9)) == (1.0, None)
    assert shapiro(8, 0.9) == pytest.approx(0.2893, abs=2e-3)
    # Published for 352 load amounts, statistics rounded to four digits.
    assert shapiro(352, 0.9493) == pytest.approx(1.22e-9, rel=0.05)
    assert ks(352, 0.0436) == pytest.approx(0.501, abs=2e-3)


@pytest.mark.parametrize("z", [-9.0, -2.5, 0.0, 0.3, 4.0, 12.0, 30.0])
def test_normal_tail(spark, z):
    found = spark.range(1).select(normal.normal_upper_tail(F.lit(z)).alias("x")).first().x
    assert found == pytest.approx(0.5 * math.erfc(z / math.sqrt(2)), rel=1e-9)


def test_runs_of_ranks_are_dealt_out(numbers, monkeypatch):
    whole = hypothesis.shapiro_wilk(numbers, "x").first().w
    monkeypatch.setattr(hypothesis, "RANKS_PER_ROW", 10)
    assert hypothesis.shapiro_wilk(numbers, "x").first().w == pytest.approx(whole, rel=1e-12)


def test_a_full_calendar_has_the_months_without_rows(spark):
    made = [(1, "2021-11"), (2, "2022-02"), (1, "2022-02"), (1, None)]
    tx = spark.createDataFrame(made, "user_id long, txn_month string")
    months = ["2021-11", "2021-12", "2022-01", "2022-02"]
    found = cohorts.cohort_matrix(tx, tx, full_calendar=True)
    assert found.columns == ["cohort_month", *months]
    assert [tuple(r) for r in found.collect()] == [
        ("2021-11", 1, 0, 0, 1), ("2021-12", None, None, None, None), ("2022-01", None, None, None, None), ("2022-02", None, None, None, 1),
    ]
    assert cohorts.cohort_matrix(tx, tx).columns == ["cohort_month", "2021-11", "2022-02"]
    assert cohorts.cohort_grid(tx.limit(0), tx, full_calendar=True).collect() == []


LINES = [
    "1/5/2020 7 1342IMPS DEBIT ab12 1 1",
    "1/6/2020 8 20upi CREDIT cd34 1 1 2/7/2020 9 30NEFT DEBIT ef56 2 2",
    "",
    "Transaction_time user",
]


def test_printed_lines(spark):
    lines = spark.createDataFrame([(x,) for x in LINES], "value string")
    found = transactions.typed(transactions.load_printed(lines)).orderBy("user_id").collect()
    assert [(r.user_id, float(r.transaction_amt), r.narration, r.txn_date, r.txn_month) for r in found] == [
        (7, 1342.0, "IMPS", date(2020, 1, 5), "2020-01"), (8, 20.0, "UPI", date(2020, 1, 6), "2020-01"),
        (9, 30.0, "NEFT", date(2020, 2, 7), "2020-02"),
    ]
    broken = lines.union(spark.createDataFrame([("1/5/2020 7 IMPS DEBIT x 1 1",), ("Transaction torn",)], "value string"))
    with pytest.raises(transactions.UnparsedLines):
        transactions.load_printed(broken)
    assert transactions.unparsed_lines(broken).count() == 1
    assert transactions.unparsed_lines(broken, exact_header="Transaction_time user").count() == 2


def test_csv_and_results(spark, tx, tmp_path):
    lines = spark.createDataFrame([(x,) for x in LINES], "value string")
    transactions.write_csv(transactions.printed_records(lines), str(tmp_path / "csv"))
    read = transactions.read_csv(spark, str(tmp_path / "csv"))
    assert sorted(r.txn_id for r in read.collect()) == ["ab12", "cd34", "ef56"]
    results.write_results(transaction_answers(tx, "UPI", 2), str(tmp_path / "answers"))
    totals = results.read_result(spark, str(tmp_path / "answers"), "totals")
    assert rows(totals) == [(9, 4, 4)]
    assert results.read_result(spark, str(tmp_path / "answers"), "kth_highest_debit").count() == 1
