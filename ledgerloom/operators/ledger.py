"""Aggregates over a table of transactions.

Every operator reads columns of the typed transactions table: ``user_id,
transaction_amt, narration, transaction_type, txn_date, txn_month``.  Amounts are
summed as decimals, so totals do not depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.positions import kth_highest, ntiles
from ledgerloom.operators.selection import ntile_highest
from ledgerloom.schemas import DECLARED_CATEGORIES
from ledgerloom.session import pin

AMOUNT = "transaction_amt"


def debits(tx: DataFrame, category: str | None = None) -> DataFrame:
    rows = tx.where(F.col("transaction_type") == "DEBIT")
    return rows if category is None else rows.where(F.col("narration") == category)


def credits(tx: DataFrame) -> DataFrame:
    """The "load amount" rows: money put into an account."""
    return tx.where(F.col("transaction_type") == "CREDIT")


def kth_highest_debit(tx: DataFrame, category: str, k: int = 7, method: str = "dense") -> DataFrame:
    """The k-th highest debit of a category: ``amount_rank, transaction_amt``."""
    return kth_highest(debits(tx, category), AMOUNT, k, method)


def category_summary(tx: DataFrame) -> DataFrame:
    """Counts, total and share of all transactions per category, busiest first."""
    categories = pin(
        tx.groupBy(F.col("narration").alias("category"))
        .agg(
            F.count(F.lit(1)).alias("txn_count"),
            F.count_if(F.col("transaction_type") == "DEBIT").alias("debit_count"),
            F.count_if(F.col("transaction_type") == "CREDIT").alias("credit_count"),
            F.sum(AMOUNT).cast("double").alias("total_amount"),
        )
    )
    everything = categories.agg(F.sum("txn_count").alias("n")).scalar()  # partial sums over the categories, not the table
    return categories.withColumn("pct_of_txns", F.round(100.0 * F.col("txn_count") / everything, 2)).orderBy(
        F.col("txn_count").desc(), "category"
    )


def undeclared_categories(tx: DataFrame, declared: tuple[str, ...] = DECLARED_CATEGORIES) -> DataFrame:
    """The category summary with each category marked declared or not; none is dropped."""
    known = F.coalesce(F.col("category").isin(*declared), F.lit(False))
    return category_summary(tx).withColumn("is_declared", known)


def load_summary(tx: DataFrame) -> DataFrame:
    """Count, mean, range and positional (NTILE) quartiles of the load amounts, one row."""
    loads, amount = credits(tx), F.col(AMOUNT)
    totals = loads.agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.sum(amount.cast("decimal(28,2)")).cast("double") / F.count(amount), 2).alias("mean"),
        F.min(amount).cast("double").alias("min"),
        F.max(amount).cast("double").alias("max"),
    )
    quartiles = ntile_highest(loads, AMOUNT, 4, {1: "q1", 2: "median", 3: "q3"})
    picked = quartiles.select(
        F.struct(*[F.col(c).cast("double").alias(c) for c in ("q1", "median", "q3")]).alias("q")
    ).scalar()
    return totals.withColumn("_q", picked).select("n", "mean", "min", "max", "_q.q1", "_q.median", "_q.q3")


def user_totals(tx: DataFrame) -> DataFrame:
    """Debit, credit and net (debit - credit) per user, as decimals."""

    def total(kind: str) -> Column:
        return F.sum(F.when(F.col("transaction_type") == kind, F.col(AMOUNT)).otherwise(0))

    return (
        tx.groupBy("user_id")
        .agg(total("DEBIT").alias("total_debit"), total("CREDIT").alias("total_credit"))
        .withColumn("net_amount", F.col("total_debit") - F.col("total_credit"))
    )


def _as_double(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in ("net_amount", "total_debit", "total_credit")})


def user_net_ranking(tx: DataFrame) -> DataFrame:
    """Every user by net amount, highest first; any type but DEBIT counts as negative."""
    signed = F.when(F.col("transaction_type") == "DEBIT", F.col(AMOUNT)).otherwise(-F.col(AMOUNT))

    def total(kind: str) -> Column:
        return F.sum(F.when(F.col("transaction_type") == kind, F.col(AMOUNT)).otherwise(0))

    ranking = tx.groupBy("user_id").agg(
        total("DEBIT").alias("total_debit"),
        total("CREDIT").alias("total_credit"),
        F.sum(signed).alias("net_amount"),
    )
    return _as_double(ranking).orderBy(F.col("net_amount").desc(), "user_id")


def user_deciles(tx: DataFrame, buckets: int = 10) -> DataFrame:
    """Every user with the NTILE bucket of the net amount, highest net in bucket 1."""
    order = [F.col("net_amount").desc_nulls_last(), F.col("user_id").asc_nulls_first()]
    return ntiles(user_totals(tx), order, buckets, "decile")


def top_decile_users(tx: DataFrame, buckets: int = 10) -> DataFrame:
    top = user_deciles(tx, buckets).where(F.col("decile") == 1).drop("decile")
    return _as_double(top).orderBy(F.col("net_amount").desc(), "user_id")


def table_totals(tx: DataFrame) -> DataFrame:
    """Transactions, distinct users and distinct months, one row."""
    cells = tx.groupBy("user_id", "txn_month").agg(F.count(F.lit(1)).alias("n"))
    return cells.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("transactions"),
        F.countDistinct("user_id").alias("users"),
        F.countDistinct("txn_month").alias("months"),
    )
