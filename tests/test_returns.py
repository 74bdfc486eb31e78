"""Sheets, tasks, matching, reconciliation and outcomes."""

from __future__ import annotations

import random
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from ledgerloom import schemas
from ledgerloom.functions import cells
from ledgerloom.operators import lookups, matching, outcomes, reconcile, sheets, tasks
from ledgerloom.plans import returns_run
from ledgerloom.plans.returns_run import run_returns
from ledgerloom.plans.sheet_import import import_sheets
from ledgerloom.registry import views
from ledgerloom.sources import tasks as task_source
from ledgerloom.streaming import outcomes as stream

HEADER = ["Address", "Product Link", "Amount", "No of Product", "Order date", "Order Id", "Delivery date",
          "Return Window", "Status", "Platform", "Refund ID"]


def link(pid, slug="red-bag"):
    return f"https://shop.test/{slug}/p/itm?pid={pid}"


def sheet_row(order, cell, amount="300", qty="", status="Pending", platform="Flipkart"):
    return ["Home", cell, amount, qty, "24 June 2026", order, "5-6 July", "10 Days", status, platform, ""]


@pytest.fixture(scope="module")
def grid(spark):
    rows = [
        ("a", 1, ["Title of the sheet"]), ("a", 3, HEADER),
        ("a", 4, sheet_row("OD1", link("A1"))),
        ("a", 5, sheet_row("OD2", f"{link('B1')} chat {link('B2')} {link('B1')}&x=1 {link('B3')}", "100", "4", "Complete")),
        ("a", 6, sheet_row("", link("C1"))),
        ("a", 7, sheet_row("OD3", "", platform="")),
        ("a", 8, sheet_row("OD4", "A blue kurta", platform="", status="who knows")),
        ("b", 1, ["ORDER  id", "link", "Shop"]), ("b", 2, ["OD9", link("Z"), "Flipkart"]),
        ("c", 41, ["Order No", "Shop"]), ("c", 42, ["OD8", link("Y")]),
        ("d", 1, ["Order No", "Order Number", "product", "PLATFORM"]), ("d", 2, ["first", "second", link("W"), "amazon"]),
    ]
    return spark.createDataFrame(rows, schemas.GRID)


def test_sheet_import(grid):
    done = import_sheets(grid)
    found = done.tasks.orderBy("task_id").collect()
    assert [(t.task_id, t.order_id, t.sku, t.amount, t.platform, t.task_status) for t in found] == [
        ("T001", "OD1", "A1", 300.0, "Flipkart", "Pending"), ("T002", "OD2", "B1", 33.33, "Flipkart", "Done"),
        ("T003", "OD2", "B2", 33.33, "Flipkart", "Done"), ("T004", "OD2", "B3", 33.33, "Flipkart", "Done"),
        ("T005", "OD4", None, 300.0, "Flipkart", "Needs human review"), ("T006", "first", "W", None, "Amazon", "Pending"),
    ]
    assert found[0].delivery_date == date(2026, 7, 6) and found[0].return_window_days == 10
    assert found[4].product_name == "A blue kurta" and found[0].product_name == "Red Bag"
    assert [(m.order_id, m.declared, m.found) for m in done.mismatches.collect()] == [("OD2", 4, 3)]
    assert [r.order_id for r in done.rejects.collect()] == ["OD3"]
    assert sorted((e.sheet_id, "platform" in e.error) for e in done.errors.collect()) == [("b", True), ("c", False)]
    assert tuple(done.counts.first()) == (6, 4, 1, 1, 1)
    with pytest.raises(sheets.SheetError):
        sheets.check_sheets(grid)


def test_sheet_options(grid):
    rows = sheets.mapped_rows(grid)
    reset = sheets.line_items(rows, carry_status=False, allocate_remainder=True)
    assert {r.task_status for r in reset.collect()} == {"Pending"}
    assert [r.amount for r in reset.where("order_id = 'OD2'").orderBy("item_no").collect()] == [33.34, 33.33, 33.33]


def test_cells_are_read_before_a_row_becomes_its_products(grid):
    items = sheets.line_items(sheets.mapped_rows(grid), fallback_year=1999)
    plan = items._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Generate posexplode")
    assert "regexp" not in above and "regexp" in below


def test_text_that_is_no_number_is_not_cast(spark):
    made = spark.createDataFrame([("n/a",), ("",), ("7 Days",), (None,)], "v string")
    read = made.select(cells.first_integer(F.col("v")).alias("i"), cells.money(F.col("v")).alias("m"))
    plan = read._jdf.queryExecution().optimizedPlan().toString()
    assert "try_cast(regexp" not in plan
    assert [tuple(r) for r in read.collect()] == [(None, None), (None, None), (7, None), (None, None)]


def test_the_grid_is_the_only_view_written_for_it(spark, monkeypatch):
    written = []
    monkeypatch.setattr(views, "stored", lambda spark, sf_dir, name, view: written.append(name) or view)
    assert views.sheet_grid(spark, "/root/testdata/sf0.001").columns == ["sheet_id", "row_no", "cells"] and written == ["sheet_grid"]


def test_layouts_are_worked_out_once_for_an_import(grid, monkeypatch):
    found, plain = [], sheets.sheet_layouts
    monkeypatch.setattr(sheets, "sheet_layouts", lambda *a, **k: found.append(1) or plain(*a, **k))
    done = import_sheets(grid)
    done.tasks.count(), done.errors.count(), done.rejects.count(), done.mismatches.count()
    assert len(found) == 1


def test_headers_in_odd_spellings(spark):
    rows = [
        ("a", 1, ["~Order~~No!", None, "ordered number"]), ("a", 2, ["order   number", "PRODUCT (URL)"]),
        ("b", 1, ["my order id", "link"]), ("c", 1, ["O.R.D.E.R.I.D", "---link---", "Platform"]),
    ]
    found = {r.sheet_id: r.header_row for r in sheets.sheet_layouts(spark.createDataFrame(rows, schemas.GRID)).collect()}
    assert found == {"a": 2, "c": 1}


def raw_tasks(spark, *changes):
    base = dict.fromkeys(schemas.TASK_COLUMNS, "") | {"platform": "flipkart", "order_id": "OD1"}
    rows = [tuple((base | c).values()) for c in changes]
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in schemas.TASK_COLUMNS))


def test_reading_tasks(spark):
    raw = raw_tasks(
        spark, {"sku": " S ", "order_date": "24 June 2026", "delivery_date": "27 June", "quantity": "2 pcs", "log": None},
        {"order_id": "", "platform": "nobody"}, {"platform": "AMAZON", "task_status": "Complete", "sku": " "},
    )
    found = task_source.read_tasks_strictly(raw).orderBy("platform").collect()
    assert [(t.platform, t.sku, t.quantity, t.task_status) for t in found] == [
        ("Amazon", None, 1, "Done"), ("Flipkart", "S", 2, "Pending"),
    ]
    assert found[1].delivery_date == date(2026, 6, 27) and found[1].log == ""
    with pytest.raises(task_source.TaskTableError, match="nobody"):
        task_source.read_tasks_strictly(raw_tasks(spark, {"platform": "nobody"}))
    with pytest.raises(task_source.TaskTableError, match="sku"):
        task_source.check_columns(raw.drop("sku"))
    assert task_source.empty_tasks(spark).columns == schemas.TASK_COLUMNS


def test_more_than_999_tasks_keep_whole_ids(spark):
    numbered = task_source.number_tasks(spark.range(1205), ["id"])
    assert {r.task_id for r in numbered.where("id in (0, 998, 1204)").collect()} == {"T001", "T999", "T1205"}


TASK = "row_no long, platform string, order_id string, sku string, product_name string, product_link string"
ITEM = "platform string, order_id string, item_index int, title string, product_id string"


def test_matching_rules(spark):
    """Each rule decides once, and each condition fails once by the least that it can."""
    shelf = {
        "ids": [("oak desk lamp", "L7"), ("oak desk lamp", "l8"), ("oak desk lamp", "L9")],
        "twins": [("copper wall clock", "C1"), ("copper wall clock", "c1"), ("velvet footstool", None)],
        "lone": [("garden hose", "H")],
        "nine": [("alpha bravo charlie delta echo foxtrot golf hotel india", "N"), ("zulu", "Z")],
        "close": [("alpha bravo charlie delta", "A"), ("alpha bravo charlie", "B")],
    }
    wishes = [
        # order, id, words, item, rule
        ("ids", "l9", "velvet footstool", 2, "sku"),
        ("ids", "L0", "oak desk lamp", None, "none"),  # three titles tie
        ("twins", "C1", "velvet footstool", 2, "title"),  # the id is on two items
        ("twins", "C1", None, None, "none"),
        ("lone", "X", "copper wall clock", 0, "single"),
        ("nine", None, "alpha bravo charlie delta", None, "none"),  # 4 of 9 words: 0.444
        ("nine", None, "alpha bravo charlie delta echo", 0, "title"),  # 5 of 9
        ("close", None, "alpha bravo charlie delta", 0, "title"),  # 1.0 before 0.75
        ("close", None, "alpha bravo charlie delta echo foxtrot", 0, "title"),  # 0.667 before 0.5
        ("close", None, "alpha bravo charlie delta echo foxtrot golf", None, "none"),  # 0.571 before 0.429
        ("elsewhere", "L7", "oak desk lamp", None, "none"),
    ]
    items = spark.createDataFrame([("P", o, n, t, p) for o, rows in shelf.items() for n, (t, p) in enumerate(rows)], ITEM)
    asked = spark.createDataFrame([(n, "P", o, s, w, "") for n, (o, s, w, *_) in enumerate(wishes)], TASK)
    found = matching.match_line_items(asked, items).orderBy("row_no").collect()
    assert [(r.item_index, r.match_rule) for r in found] == [(i, rule) for *_, i, rule in wishes]


def reference_match(sku, needle, items):
    exact = [i for i in items if sku and i[3] and i[3].lower() == sku.lower()]
    if len(exact) == 1:
        return exact[0][1]
    if needle:
        scores = sorted(((len(needle & set(i[2].split())) / len(needle | set(i[2].split())), i[1]) for i in items), reverse=True)
        second = scores[1][0] if len(scores) > 1 else 0.0
        if scores[0][0] >= 0.45 and scores[0][0] - second >= 0.15:
            return scores[0][1]
    return items[0][1] if len(items) == 1 else None


def test_matching_agrees_with_comparing_all_pairs(spark):
    rng = random.Random(5)
    words = ["women", "blue", "red", "jeans", "dress", "loose", "kurta", "cotton", "midi", "satin", "silk", "black"]
    sizes = {"hot": 250, **{f"o{n}": rng.randint(1, 6) for n in range(150)}}
    items = [
        (o, n, " ".join(rng.sample(words, rng.randint(1, 6))), f"P{rng.randint(0, 9)}" if rng.random() < 0.7 else None)
        for o, size in sizes.items() for n in range(size)
    ]
    asked = [
        (o, f"p{rng.randint(0, 9)}" if rng.random() < 0.3 else None, " ".join(rng.sample(words, rng.randint(1, 6))))
        for o, size in sizes.items() for _ in range(size)
    ]
    by_order = {}
    for item in items:
        by_order.setdefault(item[0], []).append(item)
    expected = [reference_match(s, set(name.split()), by_order[o]) for o, s, name in asked]
    item_df = spark.createDataFrame([("P", *i) for i in items], ITEM)
    asked_df = spark.createDataFrame([(n, "P", *a, "") for n, a in enumerate(asked)], TASK)
    found = matching.match_line_items(asked_df, item_df).orderBy("row_no").collect()
    assert [r.item_index for r in found] == expected
    assert {r.match_rule for r in found} == {"sku", "title", "single", "none"}


CONFIRMATION = "platform string, order_id string, position int, product_id string, title string, return_id_text string, refund_text string"
SUBMITTED = "row_no int, platform string, order_id string, item_product_id string, item_title string"


def test_reconciliation_agrees_with_comparing_all_pairs(spark):
    rng = random.Random(11)

    def title():
        return " ".join(rng.choice(["Red", "blue", "Bag ", "jeans"]) for _ in range(rng.randint(0, 12)))

    orders = ["hot"] * 60 + [f"o{rng.randint(0, 30)}" for _ in range(150)]
    submitted = [(n, "P", o, rng.choice([None, "A", "B", f"C{n}"]), title()) for n, o in enumerate(orders)]
    listed = [
        ("P", o, n, rng.choice([None, "A", "B", "D"]), "  " + title() + " extra", f"ID{n}", "₹5")
        for n, o in enumerate(rng.sample(orders, 120))
    ]

    def flat(s):
        return " ".join(s.lower().split())

    def expected(product, name, order):
        here = sorted((c for c in listed if c[1] == order), key=lambda c: c[2])
        by_id = [c[2] for c in here if product is not None and c[3] == product]
        by_title = [c[2] for c in here if flat(name) in flat(f"{c[4]} {c[5]} {c[6]}")]
        return next(iter(by_id or by_title), None), bool(here)

    found = reconcile.reconcile(spark.createDataFrame(submitted, SUBMITTED), spark.createDataFrame(listed, CONFIRMATION))
    got = {r.row_no: (r.position, r.page_shown) for r in found.select("row_no", "entry.position", "page_shown").collect()}
    assert got == {s[0]: expected(s[3], s[4], s[2]) for s in submitted}
    assert {r.confirmed_by for r in found.collect()} == {"product", "title", None}


def test_small_pages_large_pages_and_crowds_give_the_same(spark, monkeypatch):
    """Small pages cut no text into pieces; whichever way a page takes, the answers are the same."""
    rng = random.Random(5)
    words = ["Red", "blue", "Bag ", "jeans"]
    submitted = [
        (n, rng.choice(["P", "Q", None]), f"o{rng.randint(0, 12)}", rng.choice([None, "A", "B"]), rng.choice([None, " ".join(rng.choices(words, k=rng.randint(0, 3)))]))
        for n in range(150)
    ]
    listed = [
        (rng.choice(["P", "Q", None]), f"o{rng.randint(0, 14)}", rng.choice([None, 1, 2, 3]), rng.choice([None, "A", "B", "C"]), rng.choice([None, " ".join(rng.choices(words, k=3))]), f"ID{n % 9}", None)
        for n in range(160)
    ]
    items, page = spark.createDataFrame(submitted, SUBMITTED), spark.createDataFrame(listed, CONFIRMATION)

    def answers():
        return sorted(map(str, reconcile.reconcile(items, page).collect()))

    with monkeypatch.context() as plain:
        plain.setattr(reconcile, "_by_title", None)
        small = answers()
    monkeypatch.setattr(lookups, "CROWD", 3)
    assert answers() == small
    for few in (0, 9):
        monkeypatch.setattr(reconcile, "FEW", few)
        assert answers() == small


def test_a_list_is_gathered_and_joined_in_one_shuffle(spark):
    tasks = spark.createDataFrame([("P", f"o{i % 7}", i, None, "red cotton shirt", "") for i in range(50)], "platform string, order_id string, row_no int, sku string, product_name string, product_link string")
    items = spark.createDataFrame([("P", f"o{i % 7}", i, "red cotton shirt", "X") for i in range(14)], "platform string, order_id string, item_index int, title string, product_id string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = matching._in_small_orders(tasks, items)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 2


def test_views_read_only_the_columns_they_show(spark):
    """A view that is read once is joined for its columns; views of one query share their lines as given."""
    sf = "/root/testdata/sf0.001"
    before = set(views._stored)
    status = views.tasks(spark, sf).select("platform", "order_id", "row_no", "return_status")
    assert set(views._stored) == before
    assert "p_name" not in status._jdf.queryExecution().executedPlan().toString()
    for view in (views.tasks, views.task_items, views.confirmations, views.placed_returns):
        assert sorted(map(str, view(spark, sf, shared=True).collect())) == sorted(map(str, view(spark, sf).collect()))
    assert {name for _, of, name in set(views._stored) - before if of == sf} <= {"lines"}


def test_a_closed_task_with_the_key_of_a_pending_one(spark):
    """Rows that have no outcome stay where they are; a closed row that shares its key with a pending one is written too."""
    def run(rows):
        tasks = spark.createDataFrame(rows, "platform string, order_id string, row_no int, sku string, product_name string, product_link string, delivery_date date, return_window_days int, task_status string, return_id string, return_status string, refund_amount double, timestamp timestamp, log string")
        items = spark.createDataFrame([], "platform string, order_id string, item_index int, title string, product_id string, amount double, returnable boolean, reason_unreturnable string")
        orders = spark.createDataFrame([], "platform string, order_id string, has_batch_entry boolean")
        done = run_returns(tasks, items, orders, spark.createDataFrame([], CONFIRMATION), date(2026, 7, 1), F.lit("2026-07-31").cast("timestamp"))
        return done.tasks

    def task(row, status):
        return ("P", "o", row, None, "shirt", "", None, None, status, None, None, None, None, "")

    apart = run([task(1, "Pending"), task(2, "Done"), task(3, None)])
    assert {(t.row_no, t.return_status) for t in apart.collect()} == {(1, "Support Needed"), (2, None), (3, None)}
    assert "Union" in apart._jdf.queryExecution().optimizedPlan().toString()
    shared = run([task(1, "Pending"), task(1, "Done"), task(2, "Done")])
    assert sorted((t.row_no, str(t.return_status)) for t in shared.collect()) == [(1, "Support Needed"), (1, "Support Needed"), (2, "None")]


def test_key_marks_lose_no_key_and_let_few_others_through(spark, monkeypatch):
    keys = ["platform", "order_id"]
    odd = spark.createDataFrame([(None, "o1"), ("P", None)], "platform string, order_id string")
    asked = spark.range(0, 9000, 9).selectExpr("'P' AS platform", "concat('o', id) AS order_id").unionByName(odd)
    rows = spark.range(9000).selectExpr("if(id % 7 = 0, 'Q', 'P') AS platform", "concat('o', id) AS order_id", "id AS `a.b`", "id AS _slot")
    rows = rows.unionByName(odd.selectExpr("*", "0L AS `a.b`", "0L AS _slot"))

    def let_through():
        found = lookups.may_match(rows, asked, lookups.key_marks(asked, keys), keys)
        assert found.columns == rows.columns
        return {tuple(r) for r in found.collect()}

    own = {tuple(r) for r in rows.join(asked, keys, "left_semi").collect()}
    assert let_through() >= own and len(let_through()) < len(own) + 5 and len(own) > 800
    monkeypatch.setattr(lookups, "MARK_BITS", 12)  # two other keys of three share a mark
    assert let_through() > own and lookups.key_marks(rows, keys).count() == 1
    other = rows.withColumn("order_id", F.col("order_id").cast("binary"))
    assert lookups.may_match(other, asked, lookups.key_marks(asked, keys), keys) is other  # hashes of other types do not compare


def _two_orders(spark):
    """An order with an eligible task and one whose task is out of its window, with all that the platform has of both."""
    tasks = spark.createDataFrame(
        [("P", o, n, None, "red cotton shirt", "", day, 10, status, None, None, None, None, "") for o, n, day, status in
         [("in", 1, date(2026, 7, 28), "Pending"), ("in", 2, date(2026, 7, 28), "Done"), ("out", 1, date(2026, 1, 1), "Pending"), ("closed", 1, None, "Done")]],
        "platform string, order_id string, row_no int, sku string, product_name string, product_link string, delivery_date date, return_window_days int, task_status string, return_id string, return_status string, refund_amount double, timestamp timestamp, log string")
    both = ("in", "out", "closed")
    items = spark.createDataFrame([("P", o, 1, "red cotton shirt", "A", 5.0, True, "") for o in both], f"{ITEM}, amount double, returnable boolean, reason_unreturnable string")
    orders = spark.createDataFrame([("P", o, True) for o in both], "platform string, order_id string, has_batch_entry boolean")
    page = spark.createDataFrame([("P", o, 1, "A", "Red cotton shirt", "CR0000000001", "5") for o in both], CONFIRMATION)
    earlier = spark.createDataFrame([("P", "out", "A")], "platform string, order_id string, product_id string")
    return run_returns(tasks, items, orders, page, date(2026, 7, 31), F.lit("2026-07-31").cast("timestamp"), placed=earlier)


def test_a_run_moves_only_the_orders_that_an_eligible_task_asks_about(spark, monkeypatch):
    moved, match, answer, once = {}, returns_run.match_line_items, returns_run.reconcile, returns_run._once_per_item

    def of(name, frame):
        moved[name] = {r.order_id for r in frame.select("order_id").collect()}

    monkeypatch.setattr(returns_run, "match_line_items", lambda tasks, items: of("items", items) or match(tasks, items))
    monkeypatch.setattr(returns_run, "reconcile", lambda submitted, page: of("page", page) or answer(submitted, page))
    monkeypatch.setattr(returns_run, "_once_per_item", lambda entered, key, placed: of("placed", placed) or once(entered, key, placed))
    found = _two_orders(spark).outcomes.collect()
    assert moved == {"items": {"in"}, "page": {"in"}, "placed": set()}
    assert {(o.order_id, o.return_status, o.return_id) for o in found} == {("in", "Placed", "CR0000000001"), ("out", "Out of window", None)}


def test_returns_placed_are_those_of_the_orders_asked_about(spark):
    assert [tuple(r) for r in _two_orders(spark).placed.collect()] == [("P", "in", "A")]


def test_tasks_become_orders_in_one_shuffle(spark):
    """Tasks are not moved to find the orders a run touched, and again to settle them."""
    tasks = spark.createDataFrame([("P", "a", "Done"), ("P", "a", None), ("P", "b", "Pending"), ("P", "c", "Done"), ("P", "d", "Done"), (None, "a", "Done")], "platform string, order_id string, task_status string")
    touched = spark.createDataFrame([("P", o) for o in "aabd"] + [(None, "a"), ("P", None)], "platform string, order_id string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = outcomes.run_orders(touched, tasks)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert {tuple(r) for r in found.collect()} == {("P", "a", True), ("P", "b", False), ("P", "d", True)}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 2


def test_needles_of_every_length_are_found_wherever_they_stand(spark):
    rng = random.Random(21)
    texts = ["".join(rng.choices("abé ", k=rng.randint(1, 60))).strip() + "." for _ in range(40)]
    cuts = [(t, a, a + n) for t in texts for n in (1, 7, 8, 9, 14, 15, 16, 30) for a in [rng.randint(0, 50)] if a + n <= len(t)]
    needles = sorted({" ".join(t[a:b].split()) for t, a, b in cuts} | {"absent words of some length", "zz"})
    submitted = [(i, "P", "o", None, w) for i, w in enumerate(needles)]
    listed = [("P", "o", i, None, t, None, None) for i, t in enumerate(texts)]
    found = reconcile.reconcile(spark.createDataFrame(submitted, SUBMITTED), spark.createDataFrame(listed, CONFIRMATION))
    flat = [" ".join(t.split()) for t in texts]
    expected = {i: next((n for n, t in enumerate(flat) if w in t), None) for i, w in enumerate(needles)}
    assert {r.row_no: r.position for r in found.select("row_no", "entry.position").collect()} == expected


def test_titles_with_a_common_beginning_do_not_all_meet(spark, monkeypatch):
    joined, plain = [], reconcile.title_candidates

    def counted(*args):
        joined.append(plain(*args).count())
        return plain(*args)

    monkeypatch.setattr(reconcile, "title_candidates", counted)
    n, shared = 400, "Long sleeved cotton shirt, colour "
    submitted = [(i, "P", "hot", None, f"{shared}{i:04d}") for i in range(n)] + [(n, "P", "hot", None, "cotton SHIRT"), (n + 1, "P", "hot", None, "shirt, colour 9999")]
    listed = [("P", "hot", n - i, None, f"{shared}{i:04d} size {i % 7}", f"ID{i}", "") for i in range(n)]
    found = reconcile.reconcile(spark.createDataFrame(submitted, SUBMITTED), spark.createDataFrame(listed, CONFIRMATION))
    got = {r.row_no: r.position for r in found.select("row_no", "entry.position").collect()}
    assert got == {**{i: n - i for i in range(n)}, n: 1, n + 1: None}
    assert sum(joined) <= 2 * n


def test_a_whole_run(spark):
    """Seven orders and thirteen items on two platforms, one fate each."""
    today = date(2026, 7, 31)
    recent, old, future = date(2026, 7, 28), date(2026, 7, 1), date(2026, 8, 4)
    # order, sku, delivery, returnable, note, expected status, expected task status
    F1, A1 = "Flipkart", "Amazon"
    plan = [
        (F1, "F-1", "S1", recent, True, "", "Placed"), (F1, "F-2", "S2", old, True, "", "Out of window"),
        (F1, "F-3", "S3", recent, False, "Cancelled and refunded", "Already Cancelled & Refunded"),
        (F1, "F-4", "S4", future, True, "", "Not yet delivered"), (F1, "F-5", "S5", recent, True, "", "Placed"),
        (F1, "F-5", "S6", recent, True, "", "Placed"), (F1, "F-5", "S7", old, True, "", "Out of window"),
        (F1, "F-5", "S8", recent, False, "", "Support Needed"), (A1, "A-1", "S9", recent, True, "", "Placed"),
        (A1, "A-1", "S10", recent, True, "", "Placed"), (A1, "A-1", "S11", recent, False, "Return window closed", "Out of window"),
        (A1, "A-2", "S12", recent, True, "", "Placed"), (A1, "A-2", "S13", recent, True, "", "Placed"),
    ]
    table = [(n, p, o, s, f"Item {s}", "", d, 10, "Pending", "note" if s == "S1" else "") for n, (p, o, s, d, *_) in enumerate(plan)]
    table.append((98, F1, "F-9", "S98", "", "", recent, 10, "Pending", ""))
    table.append((99, F1, "F-1", "S99", "", "", recent, 10, "Done", "kept"))
    schema = TASK + ", delivery_date date, return_window_days int, task_status string, log string"
    task_df = spark.createDataFrame(table, schema).selectExpr(
        "*", "cast(null as string) AS return_id", "cast(null as string) AS return_status",
        "cast(null as double) AS refund_amount", "cast(null as timestamp) AS timestamp",
    )
    items = spark.createDataFrame(
        [(p, o, n, f"Item {s}", s, r, note) for n, (p, o, s, _, r, note, _) in enumerate(plan)],
        ITEM + ", returnable boolean, reason_unreturnable string",
    )
    orders = spark.createDataFrame(
        sorted({(p, o, o == "A-1") for p, o, *_ in plan}), "platform string, order_id string, has_batch_entry boolean"
    )
    confirmed = [
        (p, o, -n, s, f"Item {s}", f"RMA88000{100 + n}" if p == A1 else f"CR26060000000{100 + n}", "₹1,200.50")
        for n, (p, o, s, *_, status) in enumerate(plan) if status == "Placed"
    ]
    run = run_returns(
        task_df, items, orders, spark.createDataFrame(confirmed, CONFIRMATION), today, F.lit("2026-07-31 12:00:00").cast("timestamp")
    )
    after = {t.row_no: t for t in run.tasks.collect()}
    assert [after[n].return_status for n in range(13)] == [p[-1] for p in plan]
    assert after[8].return_id == "RMA88000108" and after[0].return_id == "CR26060000000100"
    assert after[0].refund_amount == 1200.5 and after[0].timestamp == datetime(2026, 7, 31, 12)
    assert after[0].log == "note\n[2026-07-31 12:00:00] accepted by Flipkart, sequential return"
    assert "batch return" in after[8].log and "sequential return" in after[11].log
    assert after[98].return_status == "Support Needed" and "not reachable" in after[98].log
    assert (after[99].log, after[99].return_status) == ("kept", None)
    assert all(t.task_status != "Pending" for t in after.values())
    assert run.report.first().asDict() == {
        "attempted": 14, "placed": 7, "out_of_window": 3, "needs_review": 3, "orders_settled": 8, "orders_partial": 0,
    }


ATTEMPT = "platform string, order_id string, row_no long, attempt_no int, return_status string, return_id string, refund_amount double, message string"


def test_attempts(spark):
    made = [
        (1, 1, "Failed", "a"), (1, 2, "Placed", "b"), (2, 1, "Failed", "a"), (2, 2, "Failed", "b"), (2, 3, "Placed", "c"),
        (3, 1, "Out of window", "a"), (3, 2, "Placed", "b"), (4, 1, "Failed", "only"),
    ]
    df = spark.createDataFrame([("P", "O", r, n, s, None, None, m) for r, n, s, m in made], ATTEMPT)
    found = outcomes.resolve_attempts(df).orderBy("row_no").collect()
    assert [(r.return_status, r.message) for r in found] == [
        ("Placed", "b"), ("Failed", "b"), ("Out of window", "a"), ("Failed", "only"),
    ]


def events(spark, *made):
    rows = [(e, "P", "O", r, 1, datetime(2026, 7, 1, 9, m), s, i, None, f"msg {e}") for e, r, m, s, i in made]
    return spark.createDataFrame(rows, schemas.OUTCOME_EVENT)


def blank_tasks(spark, n):
    rows = [(r, "P", "O", "Pending", None, None, None, None, "") for r in range(n)]
    return spark.createDataFrame(
        rows, "row_no long, platform string, order_id string, task_status string, return_id string, "
        "return_status string, refund_amount double, timestamp timestamp, log string",
    )


def test_events_fold_once_and_in_order(spark):
    made = events(spark, ("e1", 0, 1, "Failed", None), ("e2", 0, 2, "Placed", "CR1"), ("e3", 1, 1, "Failed", None))
    table = blank_tasks(spark, 3)
    once = outcomes.merge_outcomes(table, outcomes.fold_events(made))
    twice = outcomes.merge_outcomes(table, outcomes.fold_events(made.union(made)))
    assert sorted(once.collect()) == sorted(twice.collect())
    after = {t.row_no: t for t in once.collect()}
    assert after[0].task_status == "Done" and after[0].return_id == "CR1"
    assert after[0].log == "[2026-07-01 09:01:00] msg e1\n[2026-07-01 09:02:00] msg e2"
    assert after[1].task_status == "Needs human review" and after[2].task_status == "Pending"
    # A second run finds only what is still pending and not placed elsewhere.
    waiting = once.withColumn("sku", F.concat(F.lit("S"), "row_no"))
    waiting = waiting.selectExpr("*", "'' AS product_name", "'' AS product_link")
    own = spark.createDataFrame([("P", "O", 1, "x", "S1"), ("P", "O", 2, "y", "s2")], ITEM)
    placed = spark.createDataFrame([("P", "O", "S9"), ("Q", "O", "S2")], "platform string, order_id string, product_id string")
    assert [t.row_no for t in outcomes.next_queue(waiting, own, placed).collect()] == [2]
    here = spark.createDataFrame([("P", "O", "S2")], placed.schema)
    assert outcomes.next_queue(waiting, own, here).collect() == []
    assert tasks.settled_orders(once).first().settled is False


def test_short_logs_are_gathered_with_the_outcome(spark, monkeypatch):
    """Both ways give the same, also for events without a time or without the key of a task."""
    day = datetime(2026, 7, 1)
    made = [("e1", "P", "o", 1, 1, day, "Failed", None, None, "b"), ("e2", "P", "o", 1, 1, day.replace(hour=9), "Placed", "R", 2.0, None),
            ("e2", "P", "o", 1, 1, day.replace(hour=9), "Placed", "R", 2.0, None), ("e3", "P", "o", 2, 1, None, "Failed", None, None, "x"),
            ("e4", "P", "o", 2, 1, None, "Placed", None, None, "y"), ("e5", "P", "o", 2, 1, day, "Placed", None, None, "z"),
            ("e6", "P", "o", 3, 1, None, None, None, None, "w"), ("e7", None, "o", 4, 1, day, "Failed", None, None, "v"),
            (None, "P", "o", 5, 1, day, "Failed", None, None, "u"), ("e8", "P", "o", 1, 1, day.replace(minute=5), "Failed", None, None, "a")]
    made = spark.createDataFrame(made, schemas.OUTCOME_EVENT)
    short = outcomes.fold_events(made)
    assert short._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
    monkeypatch.setattr(outcomes, "ENTRIES_PER_PIECE", 2)
    long = outcomes.fold_events(made)
    assert long._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") > 2
    assert sorted(map(str, short.collect())) == sorted(map(str, long.collect()))


def test_a_long_log_is_joined_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(outcomes, "ENTRIES_PER_PIECE", 7)
    df = spark.range(100).selectExpr("id % 2 AS k", "id AS at", "concat('e', id) AS entry")
    found = outcomes.log_text(df, ["k"], ["at"], "entry", "log").orderBy("k").collect()
    assert [r.log for r in found] == ["\n".join(f"e{i}" for i in range(k, 100, 2)) for k in (0, 1)]
    tens = outcomes.log_text(df.repartition(3), ["k"], ["at"], "entry", "log", F.floor(F.col("at") / 10)).orderBy("k")
    assert tens.collect() == found


def test_a_bulk_load_within_an_hour_never_meets_in_one_group(spark):
    n = 20_000
    rows = spark.range(n).selectExpr(
        "concat('e', lpad(id, 6, '0')) AS event_id", "'P' AS platform", "'O' AS order_id", "id % 100 div 99 AS row_no",
        "1 AS attempt_no", "timestamp'2026-07-01 09:00:00' + make_interval(0, 0, 0, 0, 0, 0, id % 3600) AS event_ts",
        "'Failed' AS return_status", "cast(null as string) AS return_id", "cast(null as double) AS refund_amount", "concat('m', id) AS message",
    )

    folded = outcomes.fold_events(rows)
    kept = {r.row_no: r.log_entries for r in folded.select("row_no", "log_entries").collect()}
    expected = {0: [], 1: []}
    for i in sorted(range(n), key=lambda i: (i % 3600, i)):
        expected[i % 100 // 99].append(f"] m{i}")
    assert {k: [line[20:] for line in v.split("\n")] for k, v in kept.items()} == expected
    pieces = outcomes.log_pieces(rows, outcomes.TASK_KEY, ["event_ts", "event_id"], "message", F.date_trunc("hour", "event_ts"))
    counts = pieces.groupBy(*outcomes.TASK_KEY, "_bucket", "_piece").count().collect()
    assert max(r["count"] for r in counts) <= outcomes.ENTRIES_PER_PIECE and sum(r["count"] for r in counts) == n


def test_failed_orders_and_defaults(spark):
    table = blank_tasks(spark, 2).withColumn("task_status", F.when(F.col("row_no") == 1, "Done").otherwise("Pending"))
    failed = spark.createDataFrame([("P", "O", "Failed", "no login")], "platform string, order_id string, return_status string, message string")
    after = outcomes.fail_orders(table, failed, F.lit("2026-01-01 00:00:00").cast("timestamp")).orderBy("row_no").collect()
    assert [(t.task_status, t.return_status) for t in after] == [("Needs human review", "Failed"), ("Done", None)]
    reported = spark.createDataFrame([("P", "O", 1, 1, "Placed", "CR", 2.0, "ok")], ATTEMPT).drop("attempt_no")
    found = outcomes.with_default_outcome(table, reported).orderBy("row_no").collect()
    assert [r.return_status for r in found] == ["Support Needed", "Placed"]


def test_conflicting_copies_of_an_event_give_one_outcome(spark):
    made = events(spark, ("e1", 0, 1, "Failed", None), ("e1", 0, 1, "Placed", "CR1"))
    found = [outcomes.fold_events(x).collect() for x in (made, made.orderBy(F.desc("return_status")), made.repartition(3))]
    assert found[0] == found[1] == found[2]
    assert (found[0][0].return_status, found[0][0].return_id) == ("Placed", "CR1")


def test_another_run_on_the_same_log_loses_no_event(spark, tmp_path):
    log = str(tmp_path / "log")
    for n, made in enumerate((events(spark, ("e1", 0, 1, "Failed", None)), events(spark, ("e2", 1, 1, "Placed", "CR1")))):
        made.write.parquet(str(tmp_path / f"in{n}"))
        for _ in range(2):
            arriving = stream.event_stream(spark, str(tmp_path / f"in{n}"))
            stream.append_to_log(arriving, log, str(tmp_path / f"state{n}")).awaitTermination()
    assert sorted(r.event_id for r in stream.read_log(spark, log).collect()) == ["e1", "e2"]


def test_no_item_is_submitted_twice(spark):
    """Two tasks on one item, in mixed case and without an id, and an item that has a return already."""
    rows = [(1, "p1"), (2, "P1"), (3, None), (4, "P2"), (5, "P3")]
    table = spark.createDataFrame(
        [(n, "Amazon", "O", s, "Deep blue bag" if s is None else "", "", None, None, "Pending", "") for n, s in rows],
        TASK + ", delivery_date date, return_window_days int, task_status string, log string",
    ).selectExpr(
        "*", "cast(null as string) AS return_id", "cast(null as string) AS return_status",
        "cast(null as double) AS refund_amount", "cast(null as timestamp) AS timestamp",
    )
    titles = {"P1": "deep blue bag", "P2": "green kurta", "P3": "yellow lamp"}
    items = spark.createDataFrame(
        [("Amazon", "O", n, t, p, True, "") for n, (p, t) in enumerate(titles.items())], ITEM + ", returnable boolean, reason_unreturnable string"
    )
    orders = spark.createDataFrame([("Amazon", "O", True)], "platform string, order_id string, has_batch_entry boolean")
    shown = spark.createDataFrame([("Amazon", "O", n, p, t, f"RMA88000{n}", "₹5") for n, (p, t) in enumerate(titles.items())], CONFIRMATION)
    placed = spark.createDataFrame([("Amazon", "O", "p3"), ("Flipkart", "O", "P2")], "platform string, order_id string, product_id string")
    when = F.lit("2026-07-31 12:00:00").cast("timestamp")
    run = run_returns(table, items, orders, shown, date(2026, 7, 31), when, placed=placed)
    found = {r.row_no: (r.return_status, r.message) for r in run.outcomes.collect()}
    assert {n: s for n, (s, _) in found.items()} == {1: "Placed", 2: "Support Needed", 3: "Support Needed", 4: "Placed", 5: "Support Needed"}
    assert found[2][1] == found[3][1] != found[5][1]
    part = run_returns(table, items, orders, shown, date(2026, 7, 31), when, placed=placed, chosen=F.col("row_no") < 3)
    assert [tuple(r) for r in part.orders.collect()] == [("Amazon", "O", False)]
    assert (part.report.first().orders_settled, part.report.first().orders_partial) == (0, 1)


def test_amounts_beyond_money_are_rejected_alone(spark):
    rows = [("a", 1, HEADER), ("a", 2, sheet_row("OD1", link("A"))), ("a", 3, sheet_row("OD2", link("B"), "99999999999999999999")), ("a", 4, sheet_row("OD3", link("C"), "1e300"))]
    done = import_sheets(spark.createDataFrame(rows, schemas.GRID))
    assert {t.order_id: t.amount for t in done.tasks.collect()} == {"OD1": 300.0, "OD2": None, "OD3": None}
    assert sorted(r.order_id for r in done.rejects.collect()) == ["OD2", "OD3"]


def test_a_late_header_and_a_log_that_ends_in_a_line_end(spark):
    rows = [("a", 33, HEADER), ("a", 34, sheet_row("OD1", link("A")))]
    assert [t.order_id for t in import_sheets(spark.createDataFrame(rows, schemas.GRID)).tasks.collect()] == ["OD1"]
    df = spark.createDataFrame(
        [("Needs human review", "P", "O", "S", "", "", log) for log in ("one\ntwo\n\n", "one", "")],
        "task_status string, platform string, order_id string, sku string, product_name string, product_link string, log string",
    )
    assert sorted(r.last_line for r in tasks.review_queue(df).collect()) == ["", "one", "two"]


def test_the_stream_replays_without_effect(spark, tmp_path):
    arriving, log, state = (str(tmp_path / n) for n in ("in", "log", "state"))
    made = events(spark, ("e1", 0, 1, "Failed", None), ("e2", 0, 2, "Placed", "CR1"))
    table = blank_tasks(spark, 2)

    def run():
        stream.append_to_log(stream.event_stream(spark, arriving), log, state).awaitTermination()
        return sorted(stream.current_tasks(table, stream.read_log(spark, log)).collect())

    made.write.mode("append").parquet(arriving)
    first = run()
    assert run() == first
    made.write.mode("append").parquet(arriving)
    assert run() == first
    events(spark, ("e3", 1, 3, "Placed", "CR2")).write.mode("append").parquet(arriving)
    assert [t.task_status for t in run()] == ["Done", "Done"]
    assert len(first[0].log.split("\n")) == 2
