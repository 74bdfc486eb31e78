"""The transaction answers, as one named set of frames."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ledgerloom.operators import cohorts, hypothesis, ledger, statistics
from ledgerloom.operators.positions import value_positions
from ledgerloom.schemas import DECLARED_CATEGORIES
from ledgerloom.session import pin


def transaction_answers(
    tx: DataFrame,
    category: str = "IMPS",
    k: int = 7,
    declared: tuple[str, ...] = DECLARED_CATEGORIES,
) -> dict[str, DataFrame]:
    """Every answer and every chart's data over one transactions table."""
    loads = ledger.credits(tx)
    amount = ledger.AMOUNT
    # Four answers ask for places in the order of one column: sorted once.
    places = pin(value_positions(loads, amount))
    return {
        "totals": ledger.table_totals(tx),
        "kth_highest_debit": ledger.kth_highest_debit(tx, category, k),
        "categories": ledger.undeclared_categories(tx, declared),
        "load_summary": ledger.load_summary(tx),
        "load_statistics": statistics.summary_table(loads, amount, places),
        "load_normality": hypothesis.shapiro_wilk(loads, amount, places),
        "load_uniformity": hypothesis.ks_uniform(loads, amount, places),
        "load_histogram": statistics.histogram(loads, amount),
        "load_normal_curve": statistics.normal_curve(loads, amount),
        "load_box_plot": statistics.box_plot(loads, amount, places),
        "cohort_cells": cohorts.cohort_cells(ledger.debits(tx)),
        "cohort_matrix": cohorts.cohort_matrix(tx, ledger.debits(tx)),
        "top_decile_users": ledger.top_decile_users(tx),
        "user_net_ranking": ledger.user_net_ranking(tx),
    }
