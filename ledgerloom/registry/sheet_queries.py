"""Sheet normalisation, cell parsing and link functions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import cells, text
from ledgerloom.operators import sheets
from ledgerloom.plans.sheet_import import import_sheets
from ledgerloom.registry import views
from ledgerloom.registry.base import Query
from ledgerloom.registry.views import with_views
from ledgerloom.schemas import (
    DONE_WORDS,
    HEADER_ALIASES,
    PENDING_WORDS,
    PLATFORMS,
    RETURN_STATUSES,
    TASK_COLUMNS,
    TITLE_STOP_WORDS,
)
from ledgerloom.session import checkpoint_dir
from ledgerloom.sources import tasks as task_source

YEAR = 1999
FIELDS = list(HEADER_ALIASES)


def _strings(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


# -- SQL pieces -------------------------------------------------------------------

_ALIASES = ", ".join(f"('{n}', '{f}')" for f, names in HEADER_ALIASES.items() for n in names)
_WIDE = f"""alias(name, field) AS (VALUES {_ALIASES}),
spread AS (SELECT sheet_id, row_no, unnest(cells) AS cell, generate_subscripts(cells, 1) AS pos
           FROM sheet_grid),
mapped AS (SELECT sheet_id, row_no, field, min(pos) AS pos FROM spread
           JOIN alias ON regexp_replace(lower(cell), '[^a-z0-9]', '', 'g') = name GROUP BY ALL),
heads AS (SELECT sheet_id, row_no FROM mapped GROUP BY ALL
          HAVING count(*) FILTER (field = 'order_id') > 0 AND count(*) FILTER (field = 'product_link') > 0),
layout AS (SELECT sheet_id, min(row_no) AS header_row FROM heads GROUP BY 1),
wide AS (SELECT l.sheet_id, l.header_row, {", ".join(
    f'coalesce(max(pos) FILTER (field = {chr(39)}{f}{chr(39)}), 0) AS "{f}"' for f in FIELDS)}
  FROM layout l JOIN mapped m ON m.sheet_id = l.sheet_id AND m.row_no = l.header_row GROUP BY ALL)"""

_ROWS = f"""rows AS (SELECT * FROM (SELECT g.sheet_id, g.row_no, {", ".join(
    f'CASE WHEN w."{f}" > 0 THEN g.cells[w."{f}"] END AS "{f}"' for f in FIELDS)}
  FROM sheet_grid g JOIN wide w ON g.sheet_id = w.sheet_id
  WHERE g.row_no > w.header_row AND w.platform > 0) WHERE order_id <> '')"""


def _url_list(column: str) -> str:
    return (
        f"list_transform(regexp_extract_all(coalesce({column}, ''), 'https?://[^\\s\"''<>]+'), "
        "lambda u: regexp_replace(u, '[.,);]+$', ''))"
    )


def _title_sql(expression: str) -> str:
    runs = f"regexp_extract_all(lower({expression}), '[a-z]+|[^a-z]+')"
    return f"array_to_string(list_transform({runs}, lambda r: upper(r[1]) || r[2:]), '')"


_PID = "nullif(regexp_extract(u, '(?i)[?&]pid=([A-Za-z0-9]+)', 1), '')"
_SLUG = "replace(regexp_extract(u, '(?i)https?://[^/]+/(?:dl/)?([a-z0-9-]{6,})/p/', 1), '-', ' ')"
_PRODUCTS = f"""found AS (SELECT sheet_id, row_no, unnest(us) AS u, generate_subscripts(us, 1) AS pos
    FROM (SELECT sheet_id, row_no, {_url_list('product_link')} AS us FROM rows)),
firsts AS (SELECT *, {_PID} AS pid FROM found
    QUALIFY row_number() OVER (PARTITION BY sheet_id, row_no, coalesce({_PID}, u) ORDER BY pos) = 1),
products AS (
    SELECT sheet_id, row_no, row_number() OVER (PARTITION BY sheet_id, row_no ORDER BY pos)::INT AS item_no,
           u AS link, pid AS sku, nullif({_title_sql(_SLUG)}, '') AS name FROM firsts
    UNION ALL
    SELECT sheet_id, row_no, 1, '', NULL, trim(product_link) FROM rows
    WHERE trim(product_link) <> '' AND len({_url_list('product_link')}) = 0),
sizes AS (SELECT sheet_id, row_no, count(*) AS found FROM products GROUP BY ALL)"""

_RANGE = r"'^\s*(\d{1,2})\s*[-–—to]+\s*(\d{1,2})\s+(\w+)(?:\s+(\d{4})\b)?'"


def _date_sql(column: str, year: str) -> str:
    text2 = (
        f"CASE WHEN regexp_matches({column}, {_RANGE}) THEN trim(regexp_extract({column}, {_RANGE}, 2) || ' ' "
        f"|| regexp_extract({column}, {_RANGE}, 3) || ' ' || regexp_extract({column}, {_RANGE}, 4)) "
        f"ELSE trim({column}) END"
    )
    months = "'%d %B %Y', '%d %b %Y', '%B %d %Y', '%b %d %Y'"
    return (
        f"CAST(coalesce(try_strptime({text2}, ['%Y-%m-%d', '%d/%m/%Y', '%m/%d/%Y', {months}]), "
        f"try_strptime({text2} || ' ' || {year}, [{months}])) AS DATE)"
    )


def _money_sql(column: str) -> str:
    return f"try_cast(trim(replace(replace({column}, ',', ''), '₹', '')) AS DOUBLE)"


def _integer_sql(column: str) -> str:
    return f"try_cast(regexp_extract({column}, '-?[0-9]+') AS INT)"


def _status_sql(column: str) -> str:
    word = f"lower(trim(coalesce({column}, '')))"
    return (
        f"CASE WHEN {word} IN ({_strings(PENDING_WORDS)}) THEN 'Pending' "
        f"WHEN {word} IN ({_strings(DONE_WORDS)}) THEN 'Done' ELSE 'Needs human review' END"
    )


def _choice_sql(column: str, members) -> str:
    return (
        f"CASE lower(trim({column})) "
        + " ".join(f"WHEN {_strings([m.lower()])} THEN {_strings([m])}" for m in members)
        + " END"
    )


def _stamp_sql(column: str) -> str:
    return f"try_strptime(trim({column}), ['%Y-%m-%d %H:%M:%S', '%Y-%m-%d %H:%M', '%Y-%m-%d'])"


_ITEMS = f"""ordered AS (SELECT *, {_date_sql('order_date', str(YEAR))} AS od,
    {_money_sql('amount')} AS total FROM rows),
items AS (SELECT o.sheet_id, o.row_no, p.item_no,
    {_title_sql("trim(coalesce(nullif(platform, ''), 'Flipkart'))")} AS platform, trim(order_id) AS order_id,
    p.sku, p.name AS product_name, p.link AS product_link, 1 AS quantity,
    ((2 * CAST(round(total * 100) AS BIGINT) + found) // (2 * found)) / 100 AS amount, od AS order_date,
    {_date_sql('delivery_date', f"coalesce(year(od), {YEAR})")} AS delivery_date,
    {_integer_sql('return_window_days')} AS return_window_days, {_status_sql('task_status')} AS task_status,
    nullif(trim(return_id), '') AS return_id, {_choice_sql('return_status', RETURN_STATUSES)} AS return_status,
    {_money_sql('refund_amount')} AS refund_amount, {_stamp_sql('timestamp')} AS "timestamp",
    coalesce(log, '') AS log, address, contact_number
  FROM ordered o JOIN products p ON p.sheet_id = o.sheet_id AND p.row_no = o.row_no
  JOIN sizes s ON s.sheet_id = o.sheet_id AND s.row_no = o.row_no)"""

GRID = with_views("sheet_grid") + ", " + _WIDE
ROWS = f"{GRID}, {_ROWS}"
PRODUCTS = f"{ROWS}, {_PRODUCTS}"
ITEMS = f"{PRODUCTS}, {_ITEMS}"

# -- Spark sides --------------------------------------------------------------------


def _rows(build):
    return lambda spark, sf: build(sheets.mapped_rows(views.sheet_grid(spark, sf)))


def sheet_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    layouts = sheets.sheet_layouts(views.sheet_grid(spark, sf_dir))
    return layouts.select("sheet_id", "header_row", *[F.col(f"columns.{f}").cast("bigint").alias(f) for f in FIELDS])


def sheet_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    order_date = cells.sheet_date(F.col("ordered"), F.lit(YEAR))
    return views.order_cells(spark, sf_dir).select(
        "o_orderkey",
        order_date.alias("order_date"),
        cells.sheet_date(F.col("delivered"), F.coalesce(F.year(order_date), F.lit(YEAR))).alias("delivery_date"),
    )


def sheet_cell_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.order_cells(spark, sf_dir).select(
        "o_orderkey",
        cells.money(F.col("amount")).alias("amount"),
        cells.first_integer(F.col("qty"), F.lit(1)).alias("quantity"),
        cells.first_integer(F.col("period")).alias("window"),
        cells.task_status(F.col("status")).alias("status"),
        cells.choice(F.col("platform"), PLATFORMS).alias("platform"),
        cells.choice(F.col("rstatus"), RETURN_STATUSES).alias("return_status"),
        cells.sheet_timestamp(F.col("stamp")).alias("stamp"),
    )


def cell_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.order_cells(spark, sf_dir).select("o_orderkey", F.posexplode(text.products(F.col("link"))))
    return rows.select("o_orderkey", (F.col("pos") + 1).cast("bigint").alias("item_no"), "col.link", "col.pid", "col.name")


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat(
        F.lit("See ("), F.col("url"), F.lit("), also "), F.col("url"),
        F.lit("&pid=G"), F.col("page_id").cast("string"), F.lit("; done."),
    )
    links = views.table(spark, sf_dir, "pages").select("page_id", F.posexplode(text.urls(said)).alias("at", "link"))
    return links.withColumn("at", F.col("at").cast("bigint")).withColumn("pid", text.product_id(F.col("link")))


def page_text_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links in whole page sources, and the size of each source."""
    pages = views.table(spark, sf_dir, "pages")
    return pages.select("page_id", F.size(text.urls(F.col("html"))).cast("bigint").alias("links"), F.length("html").cast("bigint").alias("chars"))


def document_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = text.title_tokens(F.col("text"))
    return (
        views.table(spark, sf_dir, "documents")
        .select("doc_id", tokens.alias("t"))
        .select(
            "doc_id",
            F.size("t").cast("bigint").alias("tokens"),
            F.array_min("t").alias("first_token"),
            F.array_max("t").alias("last_token"),
        )
    )


def part_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = views.table(spark, sf_dir, "part")
    a = text.title_tokens(F.concat_ws(" ", "p_name", "p_brand", "p_type"))
    b = text.title_tokens(F.concat_ws("-", "p_type", "p_name", F.lit("www 2024 large")))
    return part.select("p_partkey", F.round(text.overlap(a, b), 9).alias("score"), text.slug(F.concat_ws(" ", "p_name", "p_brand", "p_type")).alias("slug"))


def read_canonical_tasks(spark: SparkSession, sf_dir: str, unknown: bool = False) -> DataFrame:
    renamed = {
        "product_link": "link", "quantity": "qty", "order_date": "ordered", "delivery_date": "delivered",
        "return_window_days": "period", "task_status": "status", "return_id": "rid", "return_status": "rstatus",
        "refund_amount": "refund", "timestamp": "stamp", "contact_number": "contact",
    }
    raw = views.order_cells(spark, sf_dir)
    made = {
        "task_id": F.concat(F.lit("T"), F.col("o_orderkey")),
        "sku": F.concat(F.lit(" S"), F.col("o_orderkey")),
        "product_name": F.lit(" "),
    }
    columns = [
        made[c].alias(c) if c in made else F.col(renamed.get(c, c)).cast("string").alias(c) for c in TASK_COLUMNS
    ]
    raw = raw.select(*columns)
    if unknown:
        return task_source.unknown_platforms(raw).select("task_id", "order_id", "platform")
    return task_source.read_tasks(raw, YEAR)


def written_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The imported tasks, written as a task table and read back."""
    path = f"{checkpoint_dir(spark)}/task-table-{uuid.uuid4().hex}"
    task_source.write_tasks(import_sheets(views.sheet_grid(spark, sf_dir), fallback_year=YEAR).tasks, path)
    return task_source.read_written_tasks(spark, path)


def missing_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical columns that each sheet's header leaves out; such a sheet is no task table."""
    layouts = sheets.sheet_layouts(views.sheet_grid(spark, sf_dir))
    absent = F.array(*[F.when(F.col(f"columns.{f}") == 0, F.lit(f)) for f in FIELDS])
    return layouts.select("sheet_id", F.explode(F.array_compact(absent)).alias("missing"))


def flattened_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = views.table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey",
        "array(named_struct('title', concat(o_orderpriority, ' Bag No.', o_custkey), 'product_id', concat('P', o_custkey), "
        "'quantity', 2, 'amount', o_totalprice, 'return_window_days', 10), "
        "named_struct('title', 'Blue Jeans', 'product_id', concat('Q', o_orderkey), "
        "'quantity', 1, 'amount', 99.5D, 'return_window_days', 7)) AS items",
    )
    return task_source.flatten_orders(nested, F.lit("https://shop.example.com/%s/p/itm?pid=%s&lid=1"))


_PRODUCT_SQL = _PRODUCTS.replace("FROM rows", "FROM cells").replace("sheet_id, row_no", "o_orderkey").replace("product_link", "link")
_READ_SQL = f"""raw AS (SELECT *, {_date_sql('ordered', str(YEAR))} AS od FROM order_cells WHERE order_id <> '')
SELECT concat('T', o_orderkey) AS task_id, {_choice_sql('platform', PLATFORMS)} AS platform, trim(order_id) AS order_id,
  concat('S', o_orderkey) AS sku, CAST(NULL AS VARCHAR) AS product_name,
  regexp_replace(regexp_replace(link, '^\\s+', ''), '\\s+$', '') AS product_link,
  coalesce({_integer_sql('qty')}, 1) AS quantity, {_money_sql('amount')} AS amount, od AS order_date,
  {_date_sql('delivered', f"coalesce(year(od), {YEAR})")} AS delivery_date, {_integer_sql('period')} AS return_window_days,
  {_status_sql('status')} AS task_status, nullif(trim(rid), '') AS return_id,
  {_choice_sql('rstatus', RETURN_STATUSES)} AS return_status, {_money_sql('refund')} AS refund_amount,
  {_stamp_sql('stamp')} AS "timestamp", log, address, contact AS contact_number
FROM raw WHERE {_choice_sql('platform', PLATFORMS)} IS NOT NULL"""


def tokens_sql(column: str) -> str:
    return (
        f"list_distinct(list_filter(regexp_split_to_array(lower(coalesce({column}, '')), '[^a-z0-9]+'), "
        f"lambda w: len(w) > 2 AND w NOT IN ({_strings(TITLE_STOP_WORDS)}) AND NOT regexp_full_match(w, '[0-9]+')))"
    )


def overlap_sql(a: str, b: str) -> str:
    return (
        f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0 "
        f"ELSE len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))) END"
    )


QUERIES = [
    Query(
        "sheet_layouts",
        sheet_layouts,
        GRID + " SELECT * FROM wide",
    ),
    Query(
        "sheet_errors",
        lambda spark, sf: sheets.sheet_errors(views.sheet_grid(spark, sf)),
        GRID + """ SELECT s.sheet_id, CASE WHEN w.sheet_id IS NULL THEN 'no header row with order id and product link'
    ELSE 'no column for: platform' END AS error
FROM (SELECT DISTINCT sheet_id FROM sheet_grid) s LEFT JOIN wide w ON w.sheet_id = s.sheet_id
WHERE w.sheet_id IS NULL OR w.platform = 0""",
    ),
    Query("sheet_rows", _rows(lambda rows: rows), ROWS + " SELECT * FROM rows"),
    Query(
        "sheet_line_items",
        _rows(lambda rows: sheets.line_items(rows, fallback_year=YEAR)),
        ITEMS + " SELECT * FROM items",
    ),
    Query(
        "sheet_line_items_reset",
        _rows(
            lambda rows: sheets.line_items(rows, carry_status=False, allocate_remainder=True, fallback_year=YEAR).select(
                "sheet_id", "row_no", "item_no", "order_id", "amount", "task_status", "return_id", "return_status"
            )
        ),
        ITEMS + """ SELECT i.sheet_id, i.row_no, i.item_no, i.order_id,
    (CAST(round(total * 100) AS BIGINT) // found
       + CASE WHEN i.item_no <= CAST(round(total * 100) AS BIGINT) % found THEN 1 ELSE 0 END) / 100 AS amount,
    'Pending' AS task_status, CAST(NULL AS VARCHAR) AS return_id, CAST(NULL AS VARCHAR) AS return_status
  FROM items i JOIN ordered o ON o.sheet_id = i.sheet_id AND o.row_no = i.row_no
  JOIN sizes s ON s.sheet_id = i.sheet_id AND s.row_no = i.row_no""",
    ),
    Query(
        "sheet_count_mismatches",
        _rows(sheets.count_mismatches),
        PRODUCTS + f""" SELECT * FROM (SELECT r.sheet_id, r.row_no, r.order_id, coalesce(s.found, 0)::INT AS found,
    coalesce({_integer_sql('r.quantity')}, coalesce(s.found, 0))::INT AS declared
  FROM rows r LEFT JOIN sizes s ON s.sheet_id = r.sheet_id AND s.row_no = r.row_no) WHERE declared <> found""",
    ),
    Query(
        "sheet_rejected_rows",
        _rows(lambda rows: sheets.rejected_rows(rows).select("sheet_id", "row_no", "order_id", "product_link")),
        PRODUCTS + """ SELECT sheet_id, row_no, order_id, product_link FROM rows
WHERE coalesce(trim(product_link), '') = ''""",
    ),
    Query(
        "sheet_counts",
        _rows(lambda rows: sheets.sheet_counts(sheets.line_items(rows, fallback_year=YEAR))),
        ITEMS + """ SELECT CAST(sum(n) AS BIGINT) AS line_items, count(*) AS orders, count(*) FILTER (n > 1) AS multi_item_orders,
    CAST(sum(w) AS BIGINT) AS no_window, CAST(sum(d) AS BIGINT) AS no_delivery
  FROM (SELECT order_id, count(*) AS n, count(*) FILTER (return_window_days IS NULL) AS w,
               count(*) FILTER (delivery_date IS NULL) AS d FROM items GROUP BY order_id)""",
    ),
    Query(
        "imported_tasks",
        lambda spark, sf: import_sheets(views.sheet_grid(spark, sf), fallback_year=YEAR).tasks,
        ITEMS + """ SELECT *, printf('T%03d', row_number() OVER (ORDER BY sheet_id, row_no, item_no)) AS task_id FROM items""",
    ),
    Query(
        "written_tasks",
        written_tasks,
        ITEMS + f""" SELECT {", ".join(f'"{c}"' for c in TASK_COLUMNS if c != "task_id")},
    printf('T%03d', row_number() OVER (ORDER BY sheet_id, row_no, item_no)) AS task_id FROM items""",
    ),
    Query(
        "missing_columns",
        missing_columns,
        GRID + " SELECT sheet_id, missing FROM (UNPIVOT (SELECT * EXCLUDE (header_row) FROM wide) "
        "ON COLUMNS(* EXCLUDE (sheet_id)) INTO NAME missing VALUE pos) WHERE pos = 0",
    ),
    Query(
        "sheet_dates",
        sheet_dates,
        with_views("order_cells") + f"""SELECT o_orderkey, od AS order_date,
  {_date_sql('delivered', f"coalesce(year(od), {YEAR})")} AS delivery_date
FROM (SELECT *, {_date_sql('ordered', str(YEAR))} AS od FROM order_cells)""",
    ),
    Query(
        "sheet_cell_values",
        sheet_cell_values,
        with_views("order_cells") + f"""SELECT o_orderkey, {_money_sql('amount')} AS amount,
  coalesce({_integer_sql('qty')}, 1) AS quantity, {_integer_sql('period')} AS "window",
  {_status_sql('status')} AS status, {_choice_sql('platform', PLATFORMS)} AS platform,
  {_choice_sql('rstatus', RETURN_STATUSES)} AS return_status, {_stamp_sql('stamp')} AS stamp FROM order_cells""",
    ),
    Query(
        "cell_products",
        cell_products,
        with_views("order_cells")
        + ", cells AS (SELECT o_orderkey, link FROM order_cells), "
        + _PRODUCT_SQL
        + " SELECT o_orderkey, item_no, link, coalesce(sku, '') AS pid, coalesce(name, '') AS name FROM products",
    ),
    Query(
        "page_links",
        page_links,
        f"""SELECT page_id, spot - 1 AS "at", u AS link, {_PID} AS pid FROM (
  SELECT page_id, unnest(us) AS u, generate_subscripts(us, 1) AS spot FROM (
    SELECT page_id, {_url_list("'See (' || url || '), also ' || url || '&pid=G' || page_id || '; done.'")} AS us FROM pages))""",
    ),
    Query(
        "page_text_links",
        page_text_links,
        f"SELECT page_id, len({_url_list('html')}) AS links, length(html) AS chars FROM pages",
    ),
    Query(
        "document_tokens",
        document_tokens,
        f"""SELECT doc_id, len(t) AS tokens, list_min(t) AS first_token, list_max(t) AS last_token
FROM (SELECT doc_id, {tokens_sql('text')} AS t FROM documents)""",
    ),
    Query(
        "part_overlaps",
        part_overlaps,
        f"""SELECT p_partkey, round({overlap_sql('a', 'b')}, 9) AS score,
  regexp_replace(lower(p_name || p_brand || p_type), '[^a-z0-9]', '', 'g') AS slug
FROM (SELECT *, {tokens_sql("p_name || ' ' || p_brand || ' ' || p_type")} AS a,
  {tokens_sql("p_type || '-' || p_name || '-www 2024 large'")} AS b FROM part)""",
    ),
    Query("canonical_tasks", read_canonical_tasks, with_views("order_cells") + ", " + _READ_SQL),
    Query(
        "unknown_platform_rows",
        lambda spark, sf: read_canonical_tasks(spark, sf, unknown=True),
        with_views("order_cells") + """SELECT concat('T', o_orderkey) AS task_id, order_id, platform FROM order_cells
WHERE order_id <> '' AND lower(trim(platform)) NOT IN ('flipkart', 'amazon')""",
    ),
    Query(
        "flattened_orders",
        flattened_orders,
        """SELECT o_orderkey, sku, product_name, 'https://shop.example.com/'
    || regexp_replace(lower(product_name), '[^a-z0-9]', '', 'g') || '/p/itm?pid=' || sku || '&lid=1' AS product_link,
  quantity, CAST(price * quantity AS DOUBLE) AS amount, return_window_days
FROM (SELECT o_orderkey, concat('P', o_custkey) AS sku, o_orderpriority || ' Bag No.' || o_custkey AS product_name,
        2 AS quantity, CAST(o_totalprice AS DECIMAL(18,2)) AS price, 10 AS return_window_days FROM orders
      UNION ALL
      SELECT o_orderkey, concat('Q', o_orderkey), 'Blue Jeans', 1, 99.5, 7 FROM orders)""",
    ),
]
