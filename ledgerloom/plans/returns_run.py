"""One run over the return tasks: screen, match, reconcile, merge, report."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.verdicts import eligibility, flow_model, refusal_verdict
from ledgerloom.operators.lookups import key_marks, lookup, matching, may_match
from ledgerloom.operators.matching import match_line_items
from ledgerloom.operators.outcomes import OUTCOME_FIELDS, merge_outcomes, outcome_log, run_orders, run_report
from ledgerloom.operators.reconcile import confirmation_outcome, reconcile
from ledgerloom.operators.tasks import pending
from ledgerloom.schemas import PENDING, PLACED, SUPPORT_NEEDED
from ledgerloom.session import pin

ORDER_KEY = ["platform", "order_id"]
ALREADY_PLACED = "a return of this item is on record"
SAME_ITEM = "an earlier task of the run is for the same item"


@dataclass(frozen=True)
class ReturnsRun:
    outcomes: DataFrame
    tasks: DataFrame
    report: DataFrame
    orders: DataFrame  # platform, order_id, settled of every order the run touched
    placed: DataFrame  # platform, order_id, product_id of every return it placed, which the next run takes


def _plain(status: Column, message: Column) -> Column:
    return F.struct(
        status.alias("return_status"),
        F.lit(None).cast("string").alias("return_id"),
        F.lit(None).cast("double").alias("refund_amount"),
        message.alias("message"),
    )


def screened(tasks: DataFrame, today: date | Column) -> DataFrame:
    """Pending tasks with the verdict of their own dates."""
    return pending(tasks).withColumn(
        "verdict", eligibility(F.col("delivery_date"), F.col("return_window_days"), today)
    )


def decide(
    tasks: DataFrame,
    items: DataFrame,
    orders: DataFrame,
    confirmations: DataFrame,
    today: date | Column,
    key: list[str],
    placed: DataFrame | None = None,
    chosen: Column | None = None,
) -> DataFrame:
    """One outcome per pending task: the key, the outcome fields and the ``product_id`` that was submitted, if any.

    No item is submitted twice: not one with a return in ``placed`` (``platform, order_id,
    product_id``), and of tasks that mean one item only the first by key.

    The sheet's own dates are asked first; an ineligible task never reaches the
    platform.  After that the platform's word counts: an order it does not show, an
    item it does not have or does not take back, and last what its confirmation says.
    Of the platform's tables only the orders that an eligible task asks about are moved.
    """
    queue = screened(tasks if chosen is None else tasks.where(chosen), today)
    skipped = queue.where(~F.col("verdict.eligible")).select(
        *key,
        _plain(F.col("verdict.status"), F.concat(F.lit("Skipped: "), F.col("verdict.reason"))).alias("outcome"),
    )
    eligible = queue.where(F.col("verdict.eligible")).drop("verdict")
    marks = pin(key_marks(eligible, ORDER_KEY))
    items, orders, confirmations = (may_match(df, eligible, marks, ORDER_KEY) for df in (items, orders, confirmations))
    placed = None if placed is None else may_match(placed, eligible, marks, ORDER_KEY)
    known = orders.select(*ORDER_KEY, flow_model(F.col("has_batch_entry")).alias("flow"))
    details = items.select(
        *ORDER_KEY,
        "item_index",
        F.col("product_id").alias("item_product_id"),
        F.col("title").alias("item_title"),
        "returnable",
        "reason_unreturnable",
    )
    wanted = ("platform", "order_id", "sku", "product_name", "product_link")
    slim = eligible.select(*dict.fromkeys([*key, *wanted]))
    means = match_line_items(slim, items).select(*dict.fromkeys([*key, *ORDER_KEY]), "item_index")
    matched = lookup(means, details, [*ORDER_KEY, "item_index"])
    entered = lookup(matched, known, ORDER_KEY).withColumn(
        "refusal",
        refusal_verdict(
            F.col("item_index").isNotNull(),
            F.coalesce("returnable", F.lit(True)),
            F.col("reason_unreturnable"),
            F.col("platform"),
        ),
    )
    # Read several times below; matched once.
    entered = pin(_once_per_item(entered, key, placed))
    unreachable = F.col("flow").isNull()
    refused = entered.where(unreachable | F.col("refusal").isNotNull()).select(
        *key,
        F.when(
            unreachable,
            _plain(F.lit(SUPPORT_NEEDED), F.concat(F.lit("order "), F.col("order_id"), F.lit(" not reachable"))),
        )
        .otherwise(_plain(F.col("refusal.status"), F.col("refusal.message")))
        .alias("outcome"),
    )
    submitted = entered.where(~unreachable & F.col("refusal").isNull()).select(
        *dict.fromkeys([*key, *ORDER_KEY]), "item_product_id", "item_title", "flow"
    )
    confirmed = confirmation_outcome(reconcile(submitted, confirmations), F.col("flow"))
    confirmed = confirmed.select(*key, "outcome", F.col("item_product_id").alias("product_id"))
    decided = skipped.unionByName(refused).unionByName(confirmed, allowMissingColumns=True)
    return decided.select(*key, *[F.col(f"outcome.{f}").alias(f) for f in OUTCOME_FIELDS], "product_id")


def _once_per_item(entered: DataFrame, key: list[str], placed: DataFrame | None) -> DataFrame:
    """Refuse tasks whose item has a return already, or is meant by an earlier task of the run."""
    item = [*ORDER_KEY, "item_index"]
    may_enter = F.col("flow").isNotNull() & F.col("refusal").isNull()
    firsts = entered.where(may_enter).groupBy(*item).agg(F.min(F.struct(*key)).alias("_first"))
    found = lookup(entered, firsts, item)
    if placed is None:
        found = found.withColumn("_placed", F.lit(None).cast("boolean"))
    else:
        known = placed.select(*ORDER_KEY, F.lower("product_id").alias("_product")).distinct().withColumn("_placed", F.lit(True))
        found = lookup(found.withColumn("_product", F.lower("item_product_id")), known, [*ORDER_KEY, "_product"]).drop("_product")

    def review(message: str) -> Column:
        return F.struct(F.lit(SUPPORT_NEEDED).alias("status"), F.lit(message).alias("message"))

    refusal = F.when(~may_enter, F.col("refusal")).when(F.col("_placed"), review(ALREADY_PLACED))
    refusal = refusal.when(F.struct(*key) != F.col("_first"), review(SAME_ITEM))
    return found.withColumn("refusal", refusal).drop("_first", "_placed")


def _merged(tasks: DataFrame, outcomes: DataFrame, when: Column, key: list[str]) -> DataFrame:
    """The task table with the outcomes.  Only pending tasks have any, so no other row is moved - unless one bears the
    key of a pending one, when all are merged."""
    log = outcome_log(outcomes, when, key)
    closed = tasks.where(~F.coalesce(F.col("task_status") == PENDING, F.lit(False)))
    if not matching(closed.select(*key), outcomes, key).isEmpty():
        return merge_outcomes(tasks, log, key)
    return merge_outcomes(pending(tasks), log, key).unionByName(closed)


def run_returns(
    tasks: DataFrame,
    items: DataFrame,
    orders: DataFrame,
    confirmations: DataFrame,
    today: date | Column,
    when: Column,
    key: list[str] | None = None,
    placed: DataFrame | None = None,
    chosen: Column | None = None,
) -> ReturnsRun:
    """Outcomes of all pending tasks - or those ``chosen`` - the task table after them, and the report.

    ``key`` identifies a task and must include platform and order; ``placed`` are returns of
    earlier runs (``platform, order_id, product_id``).
    """
    key = [*ORDER_KEY, "row_no"] if key is None else key
    # Outcomes are durable before anything is made of them.
    decided = pin(decide(tasks, items, orders, confirmations, today, key, placed, chosen))
    outcomes = decided.drop("product_id")
    merged = _merged(tasks, outcomes, when, key)
    returned = decided.where((F.col("return_status") == PLACED) & F.col("product_id").isNotNull()).select(*ORDER_KEY, "product_id")
    return ReturnsRun(outcomes, merged, run_report(outcomes, merged), run_orders(outcomes, merged), returned)
