"""Cell, text and verdict expressions against hand-written cases."""

from __future__ import annotations

import statistics as py_statistics
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import cells, normal, text, verdicts


def apply(spark, build, values, schema="v string"):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i int, {schema}")
    return [r.out for r in df.select("i", build(F.col("v")).alias("out")).orderBy("i").collect()]


DATES = {
    "2026-06-24": date(2026, 6, 24),
    "24 June 2026": date(2026, 6, 24),
    "June 24 2026": date(2026, 6, 24),
    "24 jun 2026": date(2026, 6, 24),
    " 27 June ": date(2026, 6, 27),
    "Sep 5": date(2026, 9, 5),
    "5-6 July": date(2026, 7, 6),
    "8 to 9 July": date(2026, 7, 9),
    "8–9 July, evening": date(2026, 7, 9),
    "5-6 July 2025": date(2025, 7, 6),
    "6/7/2026": date(2026, 7, 6),
    "6/27/2026": date(2026, 6, 27),
    "31/4/2026": None,
    "29 Feb": None,
    "29 February 2028": date(2028, 2, 29),
    "sometime next week": None,
    "5 Foo": None,
    "2026-13-01": None,
    "2026": None,
    "": None,
    None: None,
}


def test_sheet_dates(spark):
    found = apply(spark, lambda c: cells.sheet_date(c, F.lit(2026)), list(DATES))
    assert found == list(DATES.values())


def test_a_year_less_date_needs_a_year(spark):
    assert apply(spark, lambda c: cells.sheet_date(c, F.lit(None).cast("int")), ["27 June"]) == [None]


def test_timestamps(spark):
    values = ["2026-07-31 12:05:06", "2026-07-31 12:05", "2026-07-31", "2026-07-31T12:05", "noon", None]
    assert apply(spark, cells.sheet_timestamp, values) == [
        datetime(2026, 7, 31, 12, 5, 6), datetime(2026, 7, 31, 12, 5), datetime(2026, 7, 31), None, None, None,
    ]


def test_money(spark):
    values = ["1,299.50", "₹ 350", " 7 ", "n/a", "1d", "-2e3", "", None]
    assert apply(spark, cells.money, values) == [1299.5, 350.0, 7.0, None, None, -2000.0, None, None]


def test_first_integer(spark):
    values = ["10 Days", "7 Day", "10.0", "in -3 days", "none", "", None]
    assert apply(spark, cells.first_integer, values) == [10, 7, 10, -3, None, None, None]
    assert apply(spark, lambda c: cells.first_integer(c, F.lit(1)), ["x", None, "4 pcs"]) == [1, 1, 4]


@pytest.mark.parametrize(
    ("words", "status"),
    [
        (["Pending", "To Do", "todo", "TO-DO", "Open", "New", "", None, " not started "], "Pending"),
        (["Done", "Complete", "Completed", "Closed", "finished"], "Done"),
        (["Halted", "parked till May", "ask the shop", "5", "n.a."], "Needs human review"),
    ],
)
def test_task_status(spark, words, status):
    assert set(apply(spark, cells.task_status, words)) == {status}


def test_choice(spark):
    members = ("Flipkart", "Amazon")
    assert apply(spark, lambda c: cells.choice(c, members), [" FLIPKART ", "amazon", "shop", None]) == [
        "Flipkart", "Amazon", None, None,
    ]


CELL = (
    "three to send back: https://shop.test/red-bag-35l/p/itm1?pid=AA1&lid=9\n"
    "https://shop.test/dl/blue-jeans/p/x?lid=1&PID=bb2, again (https://shop.test/red-bag-35l/p/itm1?pid=AA1&lid=7).\n"
    "https://shop.test/plain), https://shop.test/plain"
)


def test_products_of_a_cell(spark):
    found = apply(spark, text.products, [CELL, "Blue kurta, no link", "  ", None, "x" * 130])
    assert [(p.pid, p.name) for p in found[0]] == [("AA1", "Red Bag 35L"), ("bb2", "Blue Jeans"), ("", "")]
    assert found[0][0].link.endswith("lid=9") and found[0][2].link == "https://shop.test/plain"
    assert [tuple(p) for p in found[1]] == [("", "", "Blue kurta, no link")]
    assert found[2] == [] and found[3] == []
    assert len(found[4][0].name) == 130
    assert len(apply(spark, lambda c: text.products(c, name_chars=120), ["x" * 130])[0][0].name) == 120


def test_title_tokens_and_overlap(spark):
    assert apply(spark, text.title_tokens, ["https://www.Flipkart.com/Red-bag 2024 35l/p x9z", None, "a in 12"]) == [
        ["35l", "bag", "red", "x9z"], [], [],
    ]
    df = spark.createDataFrame([(["a", "b"], ["b", "c"]), ([], ["a"])], "a array<string>, b array<string>")
    assert [r.s for r in df.select(text.overlap(F.col("a"), F.col("b")).alias("s")).collect()] == [1 / 3, 0.0]


def test_refusals_keep_their_order(spark):
    cases = {
        "Cancelled within the window": "Already Cancelled & Refunded",
        "amount refunded": "Already Cancelled & Refunded",
        "Out for delivery": "Not yet delivered",
        "item was not delivered": "Not yet delivered",
        "Not yet delivered": "Support Needed",
        "Return period expired": "Out of window",
        "not eligible": "Out of window",
        "": "Support Needed",
        None: "Support Needed",
    }
    assert apply(spark, text.refusal_status, list(cases)) == list(cases.values())


def test_further_refusal_phrases(spark):
    notes = ["Not yet delivered", "NOT YET delivered, cancelled", "too late (a+b)", "shipped", None]
    more = {"Not yet delivered": ("not yet delivered",), "Out of window": ("(a+b)",)}
    assert apply(spark, lambda c: text.refusal_status(c, more), notes) == [
        "Not yet delivered", "Already Cancelled & Refunded", "Out of window", "Not yet delivered", "Support Needed",
    ]
    with pytest.raises(ValueError, match="Lost"):
        text.refusal_status(F.lit("x"), {"Lost": ("x",)})


def test_ids_and_amounts_in_text(spark):
    assert apply(spark, lambda c: text.return_id(c, text.LETTER_RETURN_ID), ["Return ID: cr2606000000", "later", " "]) == [
        "cr2606000000", "later", None,
    ]
    # A heading in capitals wins over the id that follows it: first match.
    assert apply(spark, lambda c: text.return_id(c, text.RMA_RETURN_ID), ["id RMA8800-17 ok", "RETURN RMA88001"]) == [
        "RMA8800-17", "RETURN",
    ]
    assert apply(spark, text.amount_in_text, ["₹1,299.50 total", "Refund of 20", "none", None]) == [1299.5, 20.0, None, None]


def test_eligibility(spark):
    today = date(2024, 3, 5)  # five days after a leap day
    rows = [
        (date(2024, 2, 24), 21), (date(2024, 2, 13), 21), (date(2024, 2, 12), 21), (date(2024, 3, 6), 21),
        (None, 21), (None, None), (date(2024, 3, 6), None),
    ]
    df = spark.createDataFrame(rows, "d date, w int").coalesce(1)
    found = [r.v for r in df.select(verdicts.eligibility(F.col("d"), F.col("w"), today).alias("v")).collect()]
    assert [(v.eligible, v.status, v.days_left) for v in found] == [
        (True, None, 11), (True, None, 0), (False, "Out of window", -1), (False, "Not yet delivered", None),
        (False, "Not yet delivered", None), (True, None, None), (True, None, None),
    ]
    assert found[2].reason.endswith("over since 1 days")


def test_label_prefers_sku_then_name_then_link(spark):
    df = spark.createDataFrame([("S", "n", "l" * 60), ("", "n", "l" * 60), (None, None, "l" * 60)], "s string, n string, l string")
    label = verdicts.task_label(F.lit("P"), F.lit("O"), F.col("s"), F.col("n"), F.col("l"))
    assert [r.x for r in df.select(label.alias("x")).collect()] == ["P/O/S", "P/O/n", "P/O/" + "l" * 60]
    cut = verdicts.task_label(F.lit("P"), F.lit("O"), F.col("s"), F.col("n"), F.col("l"), link_chars=48)
    assert df.select(cut.alias("x")).collect()[2].x == "P/O/" + "l" * 48


def test_normal_quantile(spark):
    shares = [1e-300, 1e-12, 1e-4, 0.02, 0.075, 0.3, 0.5, 0.7, 0.9999, 1 - 1e-12]
    found = apply(spark, normal.normal_quantile, shares, "v double")
    exact = [py_statistics.NormalDist().inv_cdf(p) for p in shares]
    assert found == pytest.approx(exact, rel=1e-12, abs=1e-15)
