"""The given tables seen as transactions, sheets, tasks and outcomes.

Each view is whole: it has a row for every row of its table.  Where an operator
needs untidy input (a missing id, a broken line), the untidiness is computed from
the row's own values.  ``SQL`` holds the same views as common table expressions.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.session import checkpoint_dir

SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_stored: dict[tuple[str, str, str], str] = {}


def stored(spark: SparkSession, sf_dir: str, name: str, view: DataFrame) -> DataFrame:
    """The view as a table in the shared folder, written once per application.

    Sheets arrive as tables; reading one keeps the long expressions that make up
    this view out of the plans of the queries over it.
    """
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _stored:
        path = f"{checkpoint_dir(spark)}/view-{name}-{uuid.uuid4().hex}"
        view.write.parquet(path)
        _stored[key] = path
    return spark.read.schema(view.schema).parquet(_stored[key])


def with_views(*names: str) -> str:
    """A WITH clause defining the named views and what they need."""
    needs = {
        "task_items": ["lines"],
        "tasks": ["lines"],
        "confirmations": ["lines"],
        "shown_entries": ["confirmations"],
        "placed_returns": ["lines"],
        "reachable_orders": ["platform_orders"],
        "sheet_grid": ["order_cells"],
    }
    ordered: list[str] = []

    def add(name: str) -> None:
        for need in needs.get(name, []):
            add(need)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in ordered) + " "


# -- transactions ---------------------------------------------------------------


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as transactions: the customer is the user, the priority the category."""
    orders = table(spark, sf_dir, "orders")
    return orders.select(
        F.date_format("o_orderdate", "M/d/yyyy").alias("transaction_time"),
        F.col("o_custkey").alias("user_id"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("transaction_amt"),
        F.col("o_orderpriority").alias("narration"),
        F.when(F.col("o_orderstatus") == "F", "DEBIT").otherwise("CREDIT").alias("transaction_type"),
        F.col("o_orderkey").cast("string").alias("txn_id"),
        F.col("o_orderdate").cast("date").alias("txn_date"),
        F.date_format("o_orderdate", "yyyy-MM").alias("txn_month"),
    )


SQL["tx"] = """
SELECT strftime(o_orderdate, '%-m/%-d/%Y') AS transaction_time, o_custkey AS user_id,
       CAST(o_totalprice AS DECIMAL(18,2)) AS transaction_amt, o_orderpriority AS narration,
       CASE WHEN o_orderstatus = 'F' THEN 'DEBIT' ELSE 'CREDIT' END AS transaction_type,
       CAST(o_orderkey AS VARCHAR) AS txn_id, CAST(o_orderdate AS DATE) AS txn_date,
       strftime(o_orderdate, '%Y-%m') AS txn_month
FROM orders"""


def daily_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as transactions whose period is the day."""
    events = table(spark, sf_dir, "events")
    return events.select(
        "user_id",
        F.col("value").cast("decimal(18,2)").alias("transaction_amt"),
        F.col("event_type").alias("narration"),
        F.when(F.col("event_type").isin("purchase", "signup"), "DEBIT")
        .otherwise("CREDIT")
        .alias("transaction_type"),
        F.col("ts").cast("date").alias("txn_date"),
        F.date_format("ts", "yyyy-MM-dd").alias("txn_month"),
    )


SQL["daily_tx"] = """
SELECT user_id, CAST(value AS DECIMAL(18,2)) AS transaction_amt, event_type AS narration,
       CASE WHEN event_type IN ('purchase', 'signup') THEN 'DEBIT' ELSE 'CREDIT' END AS transaction_type,
       CAST(ts AS DATE) AS txn_date, strftime(ts, '%Y-%m-%d') AS txn_month
FROM events"""


def printed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as printed lines: some broken, blank, headers, or holding two records."""
    orders = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    letters = F.regexp_replace("o_orderpriority", "[^A-Za-z]", "")
    amount = F.floor("o_totalprice").cast("bigint").cast("string")
    month = F.month("o_orderdate").cast("string")

    def record(kind: str, narration: Column) -> Column:
        return F.concat(
            F.date_format("o_orderdate", "M/d/yyyy"), F.lit(" "), F.col("o_custkey").cast("string"),
            F.lit(" "), amount, narration, F.lit(f" {kind} TX"), key.cast("string"),
            F.lit(" "), month, F.lit(" "), month,
        )

    line = (
        F.when(key % 10 == 0, F.regexp_replace(record("DEBIT", letters), " DEBIT ", " "))
        .when(key % 10 == 1, F.concat(record("DEBIT", letters), F.lit(" "), record("CREDIT", letters)))
        .when(key % 10 == 2, F.lit("  "))
        .when(key % 10 == 3, F.concat(F.lit("Transaction_time page "), key.cast("string")))
        .when(key % 10 == 4, record("CREDIT", F.lower(letters)))
        .otherwise(record("CREDIT", letters))
    )
    return orders.select(line.alias("value"))


SQL["printed"] = """
SELECT CASE o_orderkey % 10
         WHEN 0 THEN replace(d, ' DEBIT ', ' ')
         WHEN 1 THEN d || ' ' || c
         WHEN 2 THEN '  '
         WHEN 3 THEN 'Transaction_time page ' || o_orderkey
         WHEN 4 THEN replace(c, letters, lower(letters))
         ELSE c END AS value
FROM (SELECT *, head || letters || ' DEBIT TX' || tail AS d, head || letters || ' CREDIT TX' || tail AS c
      FROM (SELECT o_orderkey, regexp_replace(o_orderpriority, '[^A-Za-z]', '', 'g') AS letters,
                   strftime(o_orderdate, '%-m/%-d/%Y') || ' ' || o_custkey || ' '
                     || CAST(floor(o_totalprice) AS BIGINT) AS head,
                   o_orderkey || ' ' || month(o_orderdate) || ' ' || month(o_orderdate) AS tail
            FROM orders))"""

# -- sheets ---------------------------------------------------------------------

LAYOUTS = {
    "F": (1, ["Order Number", "Platform", "Task Status", "Total Amount", "Units", "Product URL", "Date of Order",
              "Delivered Date", "Return Period", "Return ID", "Return Status", "Refund Amount", "Time", "Remarks",
              "Phone", "Address"]),
    "O": (4, ["qty.", "Order-No", "PRICE", "date of delivery", "Return Window (Days)", "order   date", "PlatForm",
              "Product"]),
    "P": (20, ["Order No", "Link", "Order Value", "Platform", "Order Number", "Date of Order",
               "Delivered Date", "Return Period", "Units", "Remarks"]),
}
# Fields in the order of each layout's columns.
LAYOUT_FIELDS = {
    "F": ["order_id", "platform", "status", "amount", "qty", "link", "ordered", "delivered", "period", "rid", "rstatus",
          "refund", "stamp", "log", "contact", "address"],
    "O": ["qty", "order_id", "amount", "delivered", "period", "ordered", "platform", "link"],
    "P": ["order_id", "link", "amount", "platform", "rid", "ordered", "delivered", "period", "qty", "log"],
}
LATE_SHEET = "5-LOW/P"  # its header stands right above the data
NO_HEADER_SHEET = "3-MEDIUM/P"
NO_PLATFORM_SHEET = "4-NOT SPECIFIED/P"


def _order_cells(orders: DataFrame) -> DataFrame:
    return orders.selectExpr(
        "o_orderpriority", "o_orderstatus", "o_orderkey",
        "concat('House ', o_custkey) AS address",
        "concat('9', lpad(cast(o_custkey AS string), 9, '0')) AS contact",
        "concat('https://shop.example.com/', lower(regexp_replace(o_orderpriority, '[^A-Za-z0-9]+', '-')), "
        "'-bag-35l/p/itm', o_custkey, '?pid=P', o_custkey, '&lid=1') AS l1",
        "concat('https://shop.example.com/dl/blue-jeans/p/itm?lid=2&PID=Q', o_custkey) AS l2",
        "concat('http://shop.example.com/item/', o_custkey) AS l3",
        "CASE o_orderkey % 6 WHEN 0 THEN concat('₹ ', format_number(o_totalprice, 2)) "
        "WHEN 1 THEN format_number(o_totalprice, 2) WHEN 2 THEN cast(cast(o_totalprice AS bigint) AS string) "
        "WHEN 3 THEN 'n/a' WHEN 4 THEN '' ELSE concat(' ', format_number(o_totalprice, 2), ' ') END AS amount",
        "CASE o_orderkey % 4 WHEN 0 THEN '2' WHEN 1 THEN 'one' WHEN 2 THEN '3 pcs' ELSE '' END AS qty",
        "CASE o_orderkey % 5 WHEN 0 THEN date_format(o_orderdate, 'd MMMM yyyy') "
        "WHEN 1 THEN date_format(o_orderdate, 'yyyy-MM-dd') WHEN 2 THEN date_format(o_orderdate, 'd/M/yyyy') "
        "WHEN 3 THEN date_format(o_orderdate, 'MMM d yyyy') ELSE 'unknown' END AS ordered",
        "CASE o_orderkey % 9 WHEN 0 THEN date_format(o_orderdate, 'd MMMM') "
        "WHEN 1 THEN concat(day(o_orderdate), '-', date_format(o_orderdate, 'd MMMM')) "
        "WHEN 2 THEN concat(day(o_orderdate), ' to ', date_format(o_orderdate, 'd MMM yyyy')) "
        "WHEN 3 THEN date_format(o_orderdate, 'MM/dd/yyyy') WHEN 4 THEN date_format(o_orderdate, 'MMMM d') "
        "WHEN 5 THEN 'sometime next week' WHEN 6 THEN '' WHEN 7 THEN '29 Feb' "
        "ELSE date_format(o_orderdate, 'MMMM d yyyy') END AS delivered",
        "CASE o_orderkey % 5 WHEN 0 THEN '10 Days' WHEN 1 THEN '7 Day' WHEN 2 THEN '' WHEN 3 THEN 'n/a' "
        "ELSE '15' END AS period",
        "CASE o_orderkey % 8 WHEN 0 THEN 'Pending' WHEN 1 THEN 'TO-DO' WHEN 2 THEN 'Complete' "
        "WHEN 3 THEN 'on hold' WHEN 4 THEN '' WHEN 5 THEN ' Closed ' WHEN 6 THEN 'review' ELSE 'Open' END AS status",
        "CASE o_orderkey % 3 WHEN 0 THEN 'flipkart' WHEN 1 THEN 'AMAZON' ELSE '' END AS platform",
        "CASE o_orderkey % 11 WHEN 0 THEN '' ELSE concat(' OD', o_orderkey, ' ') END AS order_id",
        "CASE o_orderkey % 2 WHEN 0 THEN concat('CR', o_orderkey) ELSE ' ' END AS rid",
        "CASE o_orderkey % 3 WHEN 0 THEN 'PLACED' WHEN 1 THEN 'out of window' ELSE 'who knows' END AS rstatus",
        "CASE o_orderkey % 3 WHEN 0 THEN '1,250.5' WHEN 1 THEN '₹99' ELSE '' END AS refund",
        "CASE o_orderkey % 4 WHEN 0 THEN date_format(o_orderdate, 'yyyy-MM-dd HH:mm:ss') "
        "WHEN 1 THEN date_format(o_orderdate, 'yyyy-MM-dd HH:mm') "
        "WHEN 2 THEN date_format(o_orderdate, 'yyyy-MM-dd') ELSE 'today' END AS stamp",
        "CASE o_orderkey % 2 WHEN 0 THEN concat('first\\nnote ', o_orderkey) ELSE '' END AS log",
    ).selectExpr(
        "*",
        "CASE o_orderkey % 7 WHEN 0 THEN l1 "
        "WHEN 1 THEN concat('both of these: ', l1, '\\n', l2, ' thanks\\n', l1, '&again=1 too') "
        "WHEN 2 THEN concat('  Blue item for customer ', substring(address, 7), ', no link ') "
        "WHEN 3 THEN ' ' WHEN 4 THEN concat(l3, ' ', l3, ').\\n', l1) "
        "WHEN 5 THEN concat('(see ', l2, ').') ELSE concat(l1, ' ', l2, ' ', l3) END AS link",
    )


def order_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as the hand-written cells of an order sheet."""
    return stored(spark, sf_dir, "order_cells", _order_cells(table(spark, sf_dir, "orders")))


SQL["order_cells"] = """
SELECT *, CASE o_orderkey % 7 WHEN 0 THEN l1
    WHEN 1 THEN 'both of these: ' || l1 || chr(10) || l2 || ' thanks' || chr(10) || l1 || '&again=1 too'
    WHEN 2 THEN '  Blue item for customer ' || o_custkey || ', no link '
    WHEN 3 THEN ' ' WHEN 4 THEN l3 || ' ' || l3 || ').' || chr(10) || l1
    WHEN 5 THEN '(see ' || l2 || ').' ELSE l1 || ' ' || l2 || ' ' || l3 END AS link
FROM (SELECT o_orderpriority, o_orderstatus, o_orderkey, o_custkey, 'House ' || o_custkey AS address,
    '9' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS contact,
    'https://shop.example.com/' || lower(regexp_replace(o_orderpriority, '[^A-Za-z0-9]+', '-', 'g'))
      || '-bag-35l/p/itm' || o_custkey || '?pid=P' || o_custkey || '&lid=1' AS l1,
    'https://shop.example.com/dl/blue-jeans/p/itm?lid=2&PID=Q' || o_custkey AS l2,
    'http://shop.example.com/item/' || o_custkey AS l3,
    CASE o_orderkey % 6 WHEN 0 THEN '₹ ' || format('{:,.2f}', o_totalprice)
      WHEN 1 THEN format('{:,.2f}', o_totalprice) WHEN 2 THEN CAST(CAST(trunc(o_totalprice) AS BIGINT) AS VARCHAR)
      WHEN 3 THEN 'n/a' WHEN 4 THEN '' ELSE ' ' || format('{:,.2f}', o_totalprice) || ' ' END AS amount,
    CASE o_orderkey % 4 WHEN 0 THEN '2' WHEN 1 THEN 'one' WHEN 2 THEN '3 pcs' ELSE '' END AS qty,
    CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%-d %B %Y') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d')
      WHEN 2 THEN strftime(o_orderdate, '%-d/%-m/%Y') WHEN 3 THEN strftime(o_orderdate, '%b %-d %Y')
      ELSE 'unknown' END AS ordered,
    CASE o_orderkey % 9 WHEN 0 THEN strftime(o_orderdate, '%-d %B')
      WHEN 1 THEN day(o_orderdate) || '-' || strftime(o_orderdate, '%-d %B')
      WHEN 2 THEN day(o_orderdate) || ' to ' || strftime(o_orderdate, '%-d %b %Y')
      WHEN 3 THEN strftime(o_orderdate, '%m/%d/%Y') WHEN 4 THEN strftime(o_orderdate, '%B %-d')
      WHEN 5 THEN 'sometime next week' WHEN 6 THEN '' WHEN 7 THEN '29 Feb'
      ELSE strftime(o_orderdate, '%B %-d %Y') END AS delivered,
    CASE o_orderkey % 5 WHEN 0 THEN '10 Days' WHEN 1 THEN '7 Day' WHEN 2 THEN '' WHEN 3 THEN 'n/a'
      ELSE '15' END AS period,
    CASE o_orderkey % 8 WHEN 0 THEN 'Pending' WHEN 1 THEN 'TO-DO' WHEN 2 THEN 'Complete' WHEN 3 THEN 'on hold'
      WHEN 4 THEN '' WHEN 5 THEN ' Closed ' WHEN 6 THEN 'review' ELSE 'Open' END AS status,
    CASE o_orderkey % 3 WHEN 0 THEN 'flipkart' WHEN 1 THEN 'AMAZON' ELSE '' END AS platform,
    CASE o_orderkey % 11 WHEN 0 THEN '' ELSE ' OD' || o_orderkey || ' ' END AS order_id,
    CASE o_orderkey % 2 WHEN 0 THEN 'CR' || o_orderkey ELSE ' ' END AS rid,
    CASE o_orderkey % 3 WHEN 0 THEN 'PLACED' WHEN 1 THEN 'out of window' ELSE 'who knows' END AS rstatus,
    CASE o_orderkey % 3 WHEN 0 THEN '1,250.5' WHEN 1 THEN '₹99' ELSE '' END AS refund,
    CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')
      WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M') WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d')
      ELSE 'today' END AS stamp,
    CASE o_orderkey % 2 WHEN 0 THEN 'first' || chr(10) || 'note ' || o_orderkey ELSE '' END AS log
  FROM orders)"""


def sheet_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw grids: one sheet per priority and status, three layouts, two sheets unusable."""
    # Its cells are written once, as the grid's; those of single columns are another view.
    known = table(spark, sf_dir, "orders")
    orders = _order_cells(known)
    sheet = F.concat_ws("/", "o_orderpriority", "o_orderstatus")
    cells = F.array(*[F.col(f) for f in LAYOUT_FIELDS["F"]])
    header, header_row = F.array(*[F.lit(h) for h in LAYOUTS["F"][1]]), F.lit(LAYOUTS["F"][0])
    for status in ("O", "P"):
        here = F.col("o_orderstatus") == status
        cells = F.when(here, F.array(*[F.col(f) for f in LAYOUT_FIELDS[status]])).otherwise(cells)
        header = F.when(here, F.array(*[F.lit(h) for h in LAYOUTS[status][1]])).otherwise(header)
        header_row = F.when(here, LAYOUTS[status][0]).otherwise(header_row)
    rows = orders.select(sheet.alias("sheet_id"), (F.col("o_orderkey") + 25).alias("row_no"), cells.alias("cells"))
    named = F.transform(
        header,
        lambda h: F.when((sheet == NO_PLATFORM_SHEET) & (h == "Platform"), "Shop")
        .when((sheet == NO_HEADER_SHEET) & (h == "Link"), "Where")
        .otherwise(h),
    )
    at = F.when(sheet == LATE_SHEET, 25).otherwise(header_row)
    headers = (
        known.select("o_orderpriority", "o_orderstatus")
        .distinct()
        .select(sheet.alias("sheet_id"), at.cast("bigint").alias("row_no"), named.alias("cells"))
    )
    return stored(spark, sf_dir, "sheet_grid", rows.unionByName(headers))


def _layout_sql() -> str:
    cells, header, at = "CASE o_orderstatus", "CASE o_orderstatus", "CASE o_orderstatus"
    for status, (row, names) in LAYOUTS.items():
        cells += f" WHEN '{status}' THEN [{', '.join(LAYOUT_FIELDS[status])}]"
        header += f" WHEN '{status}' THEN [" + ", ".join(f"'{n}'" for n in names) + "]"
        at += f" WHEN '{status}' THEN {row}"
    sheet = "o_orderpriority || '/' || o_orderstatus"
    return f"""
SELECT {sheet} AS sheet_id, o_orderkey + 25 AS row_no, {cells} END AS cells FROM order_cells
UNION ALL
SELECT sheet_id, CASE WHEN sheet_id = '{LATE_SHEET}' THEN 25 ELSE head_at END AS row_no,
       CASE WHEN sheet_id = '{NO_PLATFORM_SHEET}' THEN list_transform(names, lambda x: replace(x, 'Platform', 'Shop'))
            WHEN sheet_id = '{NO_HEADER_SHEET}' THEN list_transform(names, lambda x: replace(x, 'Link', 'Where'))
            ELSE names END AS cells
FROM (SELECT DISTINCT {sheet} AS sheet_id, {header} END AS names, {at} END AS head_at FROM orders)"""


SQL["sheet_grid"] = _layout_sql()

# -- tasks, items, confirmations ----------------------------------------------------

TODAY = "1998-06-15"

_LINE_COLUMNS = {
    "platform": "CASE WHEN o_orderstatus = 'O' THEN 'Amazon' ELSE 'Flipkart' END",
    "order_id": "concat('OD', l_orderkey)",
    "row_no": "((l_partkey * 10000 + l_suppkey) * 10 + l_linenumber) * 100 + CAST(l_quantity AS BIGINT)",
    "title": "concat(p_name, ' ', p_brand, ' ', p_type)",
}


def _joined_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, part, order = (table(spark, sf_dir, t) for t in ("lineitem", "part", "orders"))
    # The part comes last, so that its texts are not shuffled once more with every line.
    return line.join(order, F.col("l_orderkey") == F.col("o_orderkey")).join(part, F.col("l_partkey") == F.col("p_partkey"))


def _named(joined: DataFrame) -> DataFrame:
    return joined.select("*", *[F.expr(sql).alias(name) for name, sql in _LINE_COLUMNS.items()])


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with their part and order; ``row_no`` is unique within an order."""
    return _named(_joined_lines(spark, sf_dir))


# What tasks, items, confirmations and placed returns are made of.
_LINE_SOURCES = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag", "l_shipdate",
    "o_orderstatus", "o_orderdate", "o_custkey", "p_name", "p_brand", "p_type", "p_size",
]


def _view_lines(spark: SparkSession, sf_dir: str, shared: bool) -> DataFrame:
    """The lines for a view: joined for it alone with the columns it needs or, if ``shared``, once for all views of a query.

    Shared lines are a table in the shared folder, whose columns as they are given take far less room than the texts
    that each view makes of them.
    """
    if not shared:
        return lines(spark, sf_dir)
    return _named(stored(spark, sf_dir, "lines", _joined_lines(spark, sf_dir).select(*_LINE_SOURCES)))


SQL["lines"] = (
    "SELECT *, "
    + ", ".join(f"{sql} AS {name}" for name, sql in _LINE_COLUMNS.items())
    + " FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey"
)

_TASK_COLUMNS = {
    "platform": "platform",
    "order_id": "order_id",
    "row_no": "row_no",
    "sku": "CASE l_partkey % 3 WHEN 0 THEN concat('p', l_partkey) WHEN 1 THEN NULL ELSE concat('X', l_partkey) END",
    "product_name": "CASE WHEN l_suppkey % 4 = 0 THEN NULL ELSE concat(p_name, ' ', p_type) END",
    "product_link": "concat('https://www.shop.com/', replace(p_name, ' ', '-'), '-', lower(p_type), '/p/itm?lid=1')",
    "quantity": "CAST(l_quantity AS INT)",
    "amount": "l_extendedprice",
    "order_date": "CAST(o_orderdate AS DATE)",
    "delivery_date": "CASE WHEN l_linenumber < 7 THEN CAST(l_shipdate AS DATE) END",
    "return_window_days": "nullif(p_size % 31, 0)",
    "task_status": "CASE l_returnflag WHEN 'N' THEN 'Pending' WHEN 'A' THEN 'Done' ELSE 'Needs human review' END",
    "return_id": "CASE WHEN l_returnflag = 'A' THEN concat('CR', l_partkey) END",
    "return_status": "CASE l_returnflag WHEN 'N' THEN NULL WHEN 'A' THEN 'Placed' ELSE 'Support Needed' END",
    "refund_amount": "CASE WHEN l_returnflag = 'A' THEN l_extendedprice END",
    "timestamp": "CASE WHEN l_returnflag <> 'N' THEN l_shipdate END",
    "log": "CASE WHEN l_returnflag = 'N' THEN '' ELSE concat('opened{n}closed ', l_partkey) END",
    "address": "concat('House ', o_custkey)",
    "contact_number": "CAST(o_custkey AS {text})",
}


def tasks(spark: SparkSession, sf_dir: str, shared: bool = False) -> DataFrame:
    """Order lines as return tasks; the return flag is how far each has come."""
    columns = [F.expr(sql.format(n="\\n", text="string")).alias(name) for name, sql in _TASK_COLUMNS.items()]
    return _view_lines(spark, sf_dir, shared).select(*columns)


SQL["tasks"] = (
    "SELECT "
    + ", ".join(f'{sql} AS "{name}"' for name, sql in _TASK_COLUMNS.items()).format(n="' || chr(10) || '", text="VARCHAR")
    + " FROM lines"
)

_ITEM_COLUMNS = {
    "platform": "platform",
    "order_id": "order_id",
    "item_index": "row_no",
    "title": "title",
    "product_id": "CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE concat('P', l_partkey) END",
    "amount": "l_extendedprice",
    "returnable": "l_suppkey % 6 <> 0",
    "reason_unreturnable": "CASE WHEN l_suppkey % 6 = 0 THEN CASE l_suppkey % 24 WHEN 0 THEN 'Order cancelled' "
    "WHEN 6 THEN 'Out for delivery' WHEN 12 THEN 'Return window closed' ELSE '' END ELSE '' END",
}


def task_items(spark: SparkSession, sf_dir: str, shared: bool = False) -> DataFrame:
    """Order lines as the platform's own line items."""
    columns = [F.expr(sql).alias(name) for name, sql in _ITEM_COLUMNS.items()]
    return _view_lines(spark, sf_dir, shared).select(*columns)


SQL["task_items"] = "SELECT " + ", ".join(f"{s} AS {n}" for n, s in _ITEM_COLUMNS.items()) + " FROM lines"

_CONFIRMATION_COLUMNS = {
    "platform": "platform",
    "order_id": "order_id",
    "position": "-row_no",
    "product_id": "CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE concat('P', l_partkey) END",
    "title": "concat('  ', upper(p_name), '  ', p_brand, ' ', p_type)",
    "return_id_text": "CASE WHEN l_linenumber = 5 THEN ' ' WHEN o_orderstatus = 'O' "
    "THEN concat('RMA', 88000000 + l_partkey) "
    "ELSE concat('Return ID: cr', 260600000000 + l_partkey) END",
    "refund_text": "concat('₹', {money})",
}


def confirmations(spark: SparkSession, sf_dir: str, shared: bool = False) -> DataFrame:
    """The confirmation entries of all lines, in reversed order."""
    money = "format_number(l_extendedprice, 2)"
    columns = [F.expr(sql.format(money=money)).alias(name) for name, sql in _CONFIRMATION_COLUMNS.items()]
    return _view_lines(spark, sf_dir, shared).select("l_returnflag", *columns)


SQL["confirmations"] = (
    "SELECT l_returnflag, "
    + ", ".join(f"{s} AS {n}" for n, s in _CONFIRMATION_COLUMNS.items()).replace(
        "{money}", "format('{:,.2f}', l_extendedprice)"
    )
    + " FROM lines"
)


def shown_entries(spark: SparkSession, sf_dir: str, shared: bool = False) -> DataFrame:
    """The entries that a page shows: those of lines flagged R are missing, which reconciling must notice."""
    return confirmations(spark, sf_dir, shared).where(F.col("l_returnflag") != "R").drop("l_returnflag")


SQL["shown_entries"] = "SELECT * EXCLUDE (l_returnflag) FROM confirmations WHERE l_returnflag <> 'R'"

_PLACED_COLUMNS = {
    "platform": "platform",
    "order_id": "order_id",
    "product_id": "concat(CASE WHEN l_linenumber % 2 = 0 THEN 'p' ELSE 'P' END, l_partkey)",
}


def placed_returns(spark: SparkSession, sf_dir: str, shared: bool = False) -> DataFrame:
    """Returns of earlier runs: one in seven lines, ids in either case."""
    placed = _view_lines(spark, sf_dir, shared).where(F.col("l_suppkey") % 7 == 0)
    return placed.select(*[F.expr(sql).alias(name) for name, sql in _PLACED_COLUMNS.items()])


SQL["placed_returns"] = (
    "SELECT " + ", ".join(f"{s} AS {n}" for n, s in _PLACED_COLUMNS.items()) + " FROM lines WHERE l_suppkey % 7 = 0"
)


def platform_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as the platform knows them."""
    return table(spark, sf_dir, "orders").select(
        F.expr("CASE WHEN o_orderstatus = 'O' THEN 'Amazon' ELSE 'Flipkart' END AS platform"),
        F.expr("concat('OD', o_orderkey) AS order_id"),
        F.expr("o_orderstatus = 'O' AND o_orderpriority <> '1-URGENT' AS has_batch_entry"),
        F.expr("o_orderpriority <> '5-LOW' AS reachable"),
    )


def reachable_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Low-priority orders are not shown any more, which a run must notice."""
    return platform_orders(spark, sf_dir).where("reachable").drop("reachable")


SQL["platform_orders"] = """
SELECT CASE WHEN o_orderstatus = 'O' THEN 'Amazon' ELSE 'Flipkart' END AS platform,
       concat('OD', o_orderkey) AS order_id,
       o_orderstatus = 'O' AND o_orderpriority <> '1-URGENT' AS has_batch_entry,
       o_orderpriority <> '5-LOW' AS reachable
FROM orders"""

SQL["reachable_orders"] = "SELECT platform, order_id, has_batch_entry FROM platform_orders WHERE reachable"

# -- attempts and outcome events ----------------------------------------------------

_ATTEMPT_STATUS = (
    "CASE (o_orderkey * 7 + attempt_no * 3) % 5 WHEN 0 THEN 'Placed' WHEN 1 THEN 'Out of window' "
    "ELSE 'Failed' END"
)
_ATTEMPT_COLUMNS = {
    "platform": "'Flipkart'",
    "order_id": "concat('OD', o_orderkey)",
    "row_no": "o_custkey",
    "attempt_no": "attempt_no",
    "return_status": _ATTEMPT_STATUS,
    "return_id": f"CASE WHEN {_ATTEMPT_STATUS} = 'Placed' THEN concat('CR', o_orderkey) END",
    "refund_amount": f"CASE WHEN {_ATTEMPT_STATUS} = 'Placed' THEN o_totalprice END",
    "message": "concat('attempt ', attempt_no)",
}


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three attempts at each order."""
    three = table(spark, sf_dir, "orders").withColumn("attempt_no", F.explode(F.array(*map(F.lit, (1, 2, 3)))))
    return three.select(*[F.expr(sql).alias(name) for name, sql in _ATTEMPT_COLUMNS.items()])


SQL["attempts"] = (
    "SELECT "
    + ", ".join(f"{s} AS {n}" for n, s in _ATTEMPT_COLUMNS.items())
    + " FROM orders, (VALUES (1), (2), (3)) AS a(attempt_no)"
)

_EVENT_COLUMNS = {
    "event_id": "CAST(event_id AS {text})",
    "platform": "'Flipkart'",
    "order_id": "concat('OD', user_id)",
    "row_no": "user_id",
    "attempt_no": "1",
    "event_ts": "ts",
    "return_status": "CASE event_type WHEN 'purchase' THEN 'Placed' WHEN 'error' THEN 'Failed' "
    "WHEN 'view' THEN 'Out of window' WHEN 'click' THEN 'Support Needed' ELSE 'Not yet delivered' END",
    "return_id": "CASE WHEN event_type = 'purchase' THEN concat('CR', event_id) END",
    "refund_amount": "CASE WHEN event_type = 'purchase' THEN value END",
    "message": "concat(event_type, ' ', event_id)",
}


def as_outcome_events(events: DataFrame) -> DataFrame:
    return events.select(*[F.expr(s.format(text="string")).alias(n) for n, s in _EVENT_COLUMNS.items()])


def outcome_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_outcome_events(table(spark, sf_dir, "events"))


SQL["outcome_events"] = (
    "SELECT " + ", ".join(f"{s} AS {n}" for n, s in _EVENT_COLUMNS.items()).replace("{text}", "VARCHAR") + " FROM events"
)

_CUSTOMER_TASKS = {
    "platform": "'Flipkart'",
    "order_id": "concat('OD', c_custkey)",
    "row_no": "c_custkey",
    "sku": "concat('P', c_nationkey)",
    "task_status": "CASE WHEN c_acctbal < 0 THEN 'Done' ELSE 'Pending' END",
    "return_id": "CAST(NULL AS {text})",
    "return_status": "CASE WHEN c_acctbal < 0 THEN 'Placed' END",
    "refund_amount": "CASE WHEN c_acctbal < 0 THEN c_acctbal END",
    "timestamp": "CAST(NULL AS TIMESTAMP)",
    "log": "CASE WHEN c_acctbal < 0 THEN 'older entry' ELSE '' END",
}


def customer_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as tasks; users of the events table are among them."""
    return table(spark, sf_dir, "customer").select(
        *[F.expr(s.format(text="string")).alias(n) for n, s in _CUSTOMER_TASKS.items()]
    )


SQL["customer_tasks"] = (
    "SELECT "
    + ", ".join(f'{s} AS "{n}"' for n, s in _CUSTOMER_TASKS.items()).replace("{text}", "VARCHAR")
    + " FROM customer"
)
