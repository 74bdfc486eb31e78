"""Transaction sources, rankings, category, user and cohort queries."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import cohorts, ledger, positions, selection
from ledgerloom.plans.answers import transaction_answers
from ledgerloom.registry import views
from ledgerloom.registry.base import Query
from ledgerloom.registry.views import with_views
from ledgerloom.session import checkpoint_dir
from ledgerloom.sources import results, transactions

CATEGORY = "1-URGENT"
DECLARED = ("1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW")
TX = with_views("tx")
DAILY = with_views("daily_tx")


def _scratch(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _as_csv_records(tx: DataFrame) -> DataFrame:
    return tx.withColumns({"month": F.month("txn_date"), "month2": F.month("txn_date")})


def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _scratch(spark, "transactions-csv")
    transactions.write_csv(_as_csv_records(views.transactions(spark, sf_dir)), path)
    return money_as_double(transactions.read_csv(spark, path))


def results_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _scratch(spark, "results")
    tx = views.transactions(spark, sf_dir)
    results.write_results({"categories": ledger.category_summary(tx)}, folder)
    return results.read_result(spark, folder, "categories")


def all_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every transaction answer as a set: its name and how many rows it has."""
    answers = transaction_answers(views.transactions(spark, sf_dir), CATEGORY, declared=DECLARED)
    counted = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("answer"), "n") for name, df in answers.items()]
    return reduce(DataFrame.unionByName, counted)


def money_as_double(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in (columns or ("transaction_amt",))})


def transaction_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = views.transactions(spark, sf_dir).select("txn_id", "transaction_time", F.lit(1).alias("month"), F.lit(1).alias("month2"))
    return transactions.with_dates(raw)


def debit_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger.debits(views.transactions(spark, sf_dir), CATEGORY)
    return money_as_double(rows.select("txn_id", "user_id", "transaction_amt"))


def line_price_ntiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = views.table(spark, sf_dir, "lineitem")
    return selection.ntile_highest(lines, "l_extendedprice", 7, {j: f"t{j}" for j in range(1, 8)})


def order_row_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = views.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return positions.row_numbers(orders, [F.col("o_totalprice").desc(), F.col("o_orderkey")])


def _tx(build):
    return lambda spark, sf_dir: build(views.transactions(spark, sf_dir))


_CATEGORY_SQL = """
SELECT narration AS category, count(*) AS txn_count,
       count(*) FILTER (transaction_type = 'DEBIT') AS debit_count,
       count(*) FILTER (transaction_type = 'CREDIT') AS credit_count,
       CAST(sum(transaction_amt) AS DOUBLE) AS total_amount,
       round(100.0 * count(*) / (SELECT count(*) FROM {src}), 2)::DOUBLE AS pct_of_txns{more}
FROM {src} GROUP BY narration"""

_USER_TOTALS = """per_user AS (
  SELECT user_id, sum(CASE WHEN transaction_type = 'DEBIT' THEN transaction_amt ELSE 0 END) AS total_debit,
         sum(CASE WHEN transaction_type = 'CREDIT' THEN transaction_amt ELSE 0 END) AS total_credit
  FROM tx GROUP BY user_id),
scored AS (
  SELECT *, total_debit - total_credit AS net_amount,
         ntile(10) OVER (ORDER BY total_debit - total_credit DESC NULLS LAST, user_id) AS decile FROM per_user)"""
_USER_COLUMNS = (
    "user_id, CAST(total_debit AS DOUBLE) AS total_debit, CAST(total_credit AS DOUBLE) AS total_credit, "
    "CAST(net_amount AS DOUBLE) AS net_amount"
)

_COHORTS = """debits AS (SELECT user_id, txn_month FROM {src} WHERE transaction_type = 'DEBIT'),
cohorts AS (SELECT user_id, min(txn_month) AS cohort_month FROM debits GROUP BY user_id),
cells AS (SELECT c.cohort_month, d.txn_month AS active_month, count(DISTINCT d.user_id) AS active_users
          FROM debits d JOIN cohorts c ON c.user_id = d.user_id GROUP BY ALL)"""
_GRID = """months AS (SELECT DISTINCT txn_month AS m FROM tx),
grid AS (SELECT a.m AS cohort_month, b.m AS active_month,
           CASE WHEN b.m >= a.m AND a.m IN (SELECT cohort_month FROM cells) THEN coalesce(active_users, 0) END AS active_users
         FROM months a CROSS JOIN months b
         LEFT JOIN cells ON cells.cohort_month = a.m AND cells.active_month = b.m)"""
MONTHS = [f"{y}-{m:02d}" for y in range(1995, 2002) for m in range(1, 13) if (y, m) <= (2001, 8)]

_ANSWERS_SQL = TX + """, d AS (SELECT * FROM tx WHERE transaction_type = 'DEBIT'),
months AS (SELECT count(DISTINCT txn_month) AS m FROM tx),
firsts AS (SELECT user_id, min(txn_month) AS cohort FROM d GROUP BY 1)
SELECT unnest(['totals', 'kth_highest_debit', 'categories', 'load_summary', 'load_statistics', 'load_normality',
    'load_uniformity', 'load_histogram', 'load_normal_curve', 'load_box_plot', 'cohort_cells', 'cohort_matrix',
    'top_decile_users', 'user_net_ranking']) AS answer,
  unnest([1, (SELECT CASE WHEN count(DISTINCT transaction_amt) >= 7 THEN 1 ELSE 0 END FROM d WHERE narration = '1-URGENT'),
    (SELECT count(DISTINCT narration) FROM tx), 1, 14, 1, 1, 24, 400, 1,
    (SELECT count(*) FROM (SELECT DISTINCT cohort, d.txn_month FROM d JOIN firsts USING (user_id))),
    (SELECT m FROM months), (SELECT CAST(ceil(count(DISTINCT user_id) / 10) AS BIGINT) FROM tx), (SELECT count(DISTINCT user_id) FROM tx)]) AS n"""

QUERIES = [
    Query("all_answers", all_answers, _ANSWERS_SQL),
    Query(
        "transaction_dates",
        transaction_dates,
        TX + "SELECT txn_id, transaction_time, txn_date, txn_month FROM tx",
    ),
    Query(
        "csv_round_trip",
        csv_round_trip,
        TX + "SELECT * REPLACE (CAST(transaction_amt AS DOUBLE) AS transaction_amt) FROM tx",
    ),
    Query(
        "results_round_trip",
        results_round_trip,
        TX + _CATEGORY_SQL.format(src="tx", more=""),
    ),
    Query(
        "printed_records",
        lambda spark, sf: transactions.printed_records(views.printed_lines(spark, sf)),
        with_views("printed")
        + r"""SELECT regexp_extract(r, p, 1) AS transaction_time, regexp_extract(r, p, 2) AS user_id,
       regexp_extract(r, p, 3) AS transaction_amt, upper(regexp_extract(r, p, 4)) AS narration,
       regexp_extract(r, p, 5) AS transaction_type, regexp_extract(r, p, 6) AS txn_id,
       regexp_extract(r, p, 7) AS month, regexp_extract(r, p, 8) AS month2
FROM (SELECT unnest(regexp_extract_all(value, p)) AS r, p
      FROM printed, (SELECT '(\d{1,2}/\d{1,2}/\d{4})\s+(\d+)\s+(\d+)([A-Za-z]+)\s+(CREDIT|DEBIT)\s+(\S+)\s+(\d+)\s+(\d+)' AS p))""",
    ),
    Query(
        "printed_transactions",
        lambda spark, sf: money_as_double(
            transactions.typed(transactions.printed_records(views.printed_lines(spark, sf)))
        )
        .groupBy("txn_month", "narration")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("transaction_amt").alias("total")),
        TX
        + """, whole AS (SELECT txn_month, upper(regexp_replace(narration, '[^A-Za-z]', '', 'g')) AS narration,
                  CAST(floor(transaction_amt) AS DOUBLE) AS amt, CAST(txn_id AS BIGINT) % 10 AS k FROM tx)
SELECT txn_month, narration, count(*) AS n, sum(amt) AS total
FROM (SELECT * FROM whole WHERE k NOT IN (0, 2, 3) UNION ALL SELECT * FROM whole WHERE k = 1) GROUP BY ALL""",
    ),
    Query(
        "unparsed_lines",
        lambda spark, sf: transactions.unparsed_lines(views.printed_lines(spark, sf)),
        with_views("printed")
        + r"""SELECT value FROM printed WHERE trim(value) <> '' AND NOT contains(value, 'Transaction')
AND NOT regexp_matches(value, '\d{1,2}/\d{1,2}/\d{4}\s+\d+\s+\d+[A-Za-z]+\s+(CREDIT|DEBIT)\s+\S+\s+\d+\s+\d+')""",
    ),
    Query(
        "debit_amounts",
        debit_amounts,
        TX
        + f"""SELECT txn_id, user_id, CAST(transaction_amt AS DOUBLE) AS transaction_amt FROM tx
WHERE transaction_type = 'DEBIT' AND narration = '{CATEGORY}'""",
    ),
    Query(
        "kth_highest_debit",
        lambda spark, sf: money_as_double(ledger.kth_highest_debit(views.transactions(spark, sf), CATEGORY)),
        TX
        + f"""SELECT DISTINCT amount_rank, CAST(transaction_amt AS DOUBLE) AS transaction_amt FROM (
  SELECT transaction_amt, dense_rank() OVER (ORDER BY transaction_amt DESC) AS amount_rank
  FROM tx WHERE transaction_type = 'DEBIT' AND narration = '{CATEGORY}') WHERE amount_rank = 7""",
    ),
    Query(
        "kth_highest_debit_row",
        lambda spark, sf: money_as_double(
            ledger.kth_highest_debit(views.daily_transactions(spark, sf), "signup", 25, "row")
        ),
        DAILY
        + """SELECT amount_rank, CAST(transaction_amt AS DOUBLE) AS transaction_amt FROM (
  SELECT transaction_amt, row_number() OVER (ORDER BY transaction_amt DESC) AS amount_rank
  FROM daily_tx WHERE transaction_type = 'DEBIT' AND narration = 'signup') WHERE amount_rank = 25""",
    ),
    Query(
        "amount_ranks",
        lambda spark, sf: money_as_double(
            positions.dense_ranks(views.daily_transactions(spark, sf), "transaction_amt")
        ),
        DAILY
        + """SELECT DISTINCT CAST(transaction_amt AS DOUBLE) AS transaction_amt,
       dense_rank() OVER (ORDER BY transaction_amt DESC NULLS LAST) AS amount_rank FROM daily_tx""",
    ),
    Query(
        "order_row_numbers",
        order_row_numbers,
        """SELECT o_orderkey, o_totalprice,
       row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS row_number FROM orders""",
    ),
    Query("category_summary", _tx(ledger.category_summary), TX + _CATEGORY_SQL.format(src="tx", more="")),
    Query(
        "event_category_summary",
        lambda spark, sf: ledger.category_summary(views.daily_transactions(spark, sf)),
        DAILY + _CATEGORY_SQL.format(src="daily_tx", more=""),
    ),
    Query(
        "undeclared_categories",
        _tx(lambda tx: ledger.undeclared_categories(tx, DECLARED)),
        TX + _CATEGORY_SQL.format(src="tx", more=f", narration IN {DECLARED} AS is_declared"),
    ),
    Query(
        "load_summary",
        _tx(ledger.load_summary),
        TX
        + """, loads AS (SELECT transaction_amt AS a FROM tx WHERE transaction_type = 'CREDIT'),
quartiles AS (SELECT a, ntile(4) OVER (ORDER BY a NULLS FIRST) AS t FROM loads)
SELECT count(*) AS n, round(CAST(sum(a) AS DOUBLE) / count(a), 2) AS mean, CAST(min(a) AS DOUBLE) AS min,
       CAST(max(a) AS DOUBLE) AS max, CAST(max(a) FILTER (t = 1) AS DOUBLE) AS q1,
       CAST(max(a) FILTER (t = 2) AS DOUBLE) AS median, CAST(max(a) FILTER (t = 3) AS DOUBLE) AS q3
FROM quartiles""",
    ),
    Query(
        "line_price_ntiles",
        line_price_ntiles,
        "SELECT "
        + ", ".join(f"max(p) FILTER (t = {j}) AS t{j}" for j in range(1, 8))
        + " FROM (SELECT l_extendedprice AS p, ntile(7) OVER (ORDER BY l_extendedprice NULLS FIRST) AS t FROM lineitem)",
    ),
    Query(
        "user_totals",
        _tx(lambda tx: money_as_double(ledger.user_totals(tx), "total_debit", "total_credit", "net_amount")),
        TX + f", {_USER_TOTALS} SELECT {_USER_COLUMNS} FROM scored",
    ),
    Query(
        "user_net_ranking",
        _tx(ledger.user_net_ranking),
        TX + f", {_USER_TOTALS} SELECT {_USER_COLUMNS} FROM scored ORDER BY net_amount DESC, user_id",
    ),
    Query(
        "top_decile_users",
        _tx(ledger.top_decile_users),
        TX + f", {_USER_TOTALS} SELECT {_USER_COLUMNS} FROM scored WHERE decile = 1",
    ),
    Query(
        "user_deciles",
        _tx(lambda tx: money_as_double(ledger.user_deciles(tx), "total_debit", "total_credit", "net_amount")),
        TX + f", {_USER_TOTALS} SELECT {_USER_COLUMNS}, decile FROM scored",
    ),
    Query(
        "first_active_month",
        _tx(lambda tx: cohorts.first_active_period(ledger.debits(tx))),
        TX + ", " + _COHORTS.format(src="tx") + " SELECT user_id, cohort_month FROM cohorts",
    ),
    Query(
        "cohort_cells",
        _tx(lambda tx: cohorts.cohort_cells(ledger.debits(tx))),
        TX + ", " + _COHORTS.format(src="tx") + " SELECT * FROM cells",
    ),
    Query(
        "daily_cohort_cells",
        lambda spark, sf: cohorts.cohort_cells(ledger.debits(views.daily_transactions(spark, sf))),
        DAILY + ", " + _COHORTS.format(src="daily_tx") + " SELECT * FROM cells",
    ),
    Query(
        "cohort_grid",
        _tx(lambda tx: cohorts.cohort_grid(tx, ledger.debits(tx))),
        TX + ", " + _COHORTS.format(src="tx") + ", " + _GRID + " SELECT * FROM grid",
    ),
    Query(
        "cohort_matrix",
        _tx(lambda tx: cohorts.cohort_matrix(tx, ledger.debits(tx))),
        TX + ", " + _COHORTS.format(src="tx") + ", " + _GRID + " SELECT cohort_month, "
        + ", ".join(f"""max(active_users) FILTER (active_month = '{m}') AS "{m}\"""" for m in MONTHS)
        + " FROM grid GROUP BY cohort_month",
    ),
    Query(
        "table_totals",
        _tx(ledger.table_totals),
        TX + "SELECT count(*) AS transactions, count(DISTINCT user_id) AS users, count(DISTINCT txn_month) AS months FROM tx",
    ),
]
