"""Task queues, eligibility, matching, reconciliation, outcomes and the event stream."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import verdicts
from ledgerloom.functions.text import LETTER_RETURN_ID, RMA_RETURN_ID, amount_in_text, return_id
from ledgerloom.operators import matching, outcomes, reconcile, tasks
from ledgerloom.plans.returns_run import run_returns
from ledgerloom.registry import views
from ledgerloom.registry.base import Query
from ledgerloom.registry.sheet_queries import overlap_sql, tokens_sql
from ledgerloom.registry.views import with_views
from ledgerloom.schemas import FAILED, SUPPORT_NEEDED
from ledgerloom.session import checkpoint_dir, pin
from ledgerloom.sources import task_table
from ledgerloom.streaming import outcomes as stream

TODAY = date.fromisoformat(views.TODAY)
WHEN = "2026-07-31 12:00:00"
KEY = ["platform", "order_id", "row_no"]
TASKS = with_views("tasks")

# -- SQL pieces -------------------------------------------------------------------

_LABEL = (
    "concat_ws('/', platform, order_id, coalesce(nullif(sku, ''), nullif(product_name, ''), product_link))"
)
_REVIEW_SQL = "('Failed', 'Support Needed', 'Not yet delivered')"


def _settled_sql(column: str) -> str:
    return f"CASE WHEN {column} IN {_REVIEW_SQL} THEN 'Needs human review' ELSE 'Done' END"


_VERDICT = f"""verdicts AS (SELECT *,
  CASE WHEN return_window_days IS NULL THEN true WHEN delivery_date IS NULL OR delivery_date > t THEN false
       ELSE days >= 0 END AS eligible,
  CASE WHEN return_window_days IS NULL THEN 'window unknown, the platform decides'
       WHEN delivery_date IS NULL THEN 'delivery date unknown, window not computable'
       WHEN delivery_date > t THEN 'delivery expected on ' || delivery_date
       WHEN days < 0 THEN 'delivered on ' || delivery_date || ', window of ' || return_window_days
         || ' days over since ' || -days || ' days'
       ELSE days || ' days of the window left' END AS reason,
  CASE WHEN return_window_days IS NULL THEN NULL WHEN delivery_date IS NULL OR delivery_date > t THEN 'Not yet delivered'
       WHEN days < 0 THEN 'Out of window' END AS status,
  CASE WHEN return_window_days IS NOT NULL AND delivery_date <= t THEN days END AS days_left
FROM (SELECT *, CAST('{views.TODAY}' AS DATE) AS t,
             return_window_days - (CAST('{views.TODAY}' AS DATE) - delivery_date) AS days FROM tasks))"""

_MATCH = f"""t AS (SELECT *, {tokens_sql("coalesce(nullif(product_name, ''), product_link)")} AS needle FROM {{src}}),
i AS (SELECT *, {tokens_sql('title')} AS words, count(*) OVER (PARTITION BY platform, order_id) AS siblings FROM task_items),
pairs AS (SELECT t.platform, t.order_id, t.row_no, i.item_index, i.siblings,
    coalesce(t.sku <> '' AND i.product_id <> '' AND lower(t.sku) = lower(i.product_id), false) AS exact,
    len(needle) > 0 AS has_needle, {overlap_sql('t.needle', 'i.words')}::DOUBLE AS score
  FROM t JOIN i ON t.platform = i.platform AND t.order_id = i.order_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY platform, order_id, row_no ORDER BY score DESC, item_index) AS rn FROM pairs),
facts AS (SELECT platform, order_id, row_no, max(siblings) AS siblings, count(*) FILTER (exact) AS hits,
    max(item_index) FILTER (exact) AS sku_item, bool_and(has_needle) AS has_needle,
    max(score) FILTER (rn = 1) AS best, coalesce(max(score) FILTER (rn = 2), 0) AS second,
    max(item_index) FILTER (rn = 1) AS best_item, max(item_index) AS any_item FROM ranked GROUP BY ALL),
ruled AS (SELECT *, CASE WHEN hits = 1 THEN 'sku' WHEN has_needle AND best >= 0.45 AND best - second >= 0.15 THEN 'title'
    WHEN siblings = 1 THEN 'single' ELSE 'none' END AS match_rule FROM facts),
matches AS (SELECT t.platform, t.order_id, t.row_no, coalesce(match_rule, 'none') AS match_rule,
    CASE match_rule WHEN 'sku' THEN sku_item WHEN 'title' THEN best_item WHEN 'single' THEN any_item END AS item_index,
    CASE WHEN match_rule = 'title' THEN best END AS score
  FROM t LEFT JOIN ruled r ON r.platform = t.platform AND r.order_id = t.order_id AND r.row_no = t.row_no)"""


def _flat_sql(expression: str) -> str:
    return f"lower(trim(regexp_replace({expression}, '\\s+', ' ', 'g')))"


_RECONCILE = f"""c AS (SELECT *, {_flat_sql("concat_ws(' ', title, return_id_text, refund_text)")} AS block FROM shown_entries),
by_product AS (SELECT s.platform, s.order_id, s.row_no, min(c.position) AS position FROM submitted s
  JOIN c ON c.platform = s.platform AND c.order_id = s.order_id AND c.product_id = s.item_product_id GROUP BY ALL),
by_title AS (SELECT s.platform, s.order_id, s.row_no, min(c.position) AS position FROM submitted s
  JOIN c ON c.platform = s.platform AND c.order_id = s.order_id
   AND contains(c.block, {_flat_sql("coalesce(s.item_title, '')")}) GROUP BY ALL),
reconciled AS (SELECT s.*, coalesce(p.position, q.position) AS position,
    CASE WHEN p.position IS NOT NULL THEN 'product' WHEN q.position IS NOT NULL THEN 'title' END AS confirmed_by,
    (s.platform, s.order_id) IN (SELECT (platform, order_id) FROM shown_entries) AS page_shown
  FROM submitted s
  LEFT JOIN by_product p ON p.platform = s.platform AND p.order_id = s.order_id AND p.row_no = s.row_no
  LEFT JOIN by_title q ON q.platform = s.platform AND q.order_id = s.order_id AND q.row_no = s.row_no)"""


def _return_id_sql(text: str, pattern: str) -> str:
    return f"nullif(coalesce(nullif(regexp_extract(trim({text}), '{pattern}', 1), ''), trim({text})), '')"


_ID_SQL = (
    f"CASE WHEN platform = 'Amazon' THEN {_return_id_sql('return_id_text', RMA_RETURN_ID)} "
    f"ELSE {_return_id_sql('return_id_text', LETTER_RETURN_ID)} END"
)
_AMOUNT_SQL = (
    "try_cast(replace(regexp_extract(replace(refund_text, '₹', ''), "
    "'([0-9][0-9,]*(?:\\.\\d{1,2})?)', 1), ',', '') AS DOUBLE)"
)
_OUTCOME = f"""confirmed AS (SELECT platform, order_id, row_no,
    CASE WHEN NOT page_shown THEN 'Failed' WHEN position IS NULL OR rid IS NULL THEN 'Support Needed' ELSE 'Placed' END AS return_status,
    rid AS return_id, refund AS refund_amount,
    CASE WHEN NOT page_shown THEN flow || ' return was sent, yet nothing came back to confirm it'
      WHEN position IS NULL THEN flow || ' confirmation leaves this item out; look at the order before another try'
      WHEN rid IS NULL THEN 'confirmation names the item without a return number'
      ELSE 'accepted by ' || platform || ', ' || flow || ' return' END AS message
  FROM (SELECT r.platform, r.order_id, r.row_no, r.position, r.page_shown, r.flow, {_ID_SQL.replace('platform =', 'r.platform =')} AS rid,
          {_AMOUNT_SQL} AS refund
        FROM reconciled r LEFT JOIN shown_entries e
          ON e.platform = r.platform AND e.order_id = r.order_id AND e.position = r.position))"""

_REFUSAL_SQL = """CASE WHEN lower({0}) LIKE '%cancel%' OR lower({0}) LIKE '%refunded%' THEN 'Already Cancelled & Refunded'
    WHEN regexp_matches(lower({0}), 'not delivered|out for delivery|shipped') THEN 'Not yet delivered'
    WHEN regexp_matches(lower({0}), 'window|period|expired|eligib') THEN 'Out of window' ELSE 'Support Needed' END"""
_NOTE = "coalesce(nullif(reason_unreturnable, ''), platform || ' takes no return of this item')"

_DECIDED = f"""{_VERDICT}, queue AS (SELECT * FROM verdicts WHERE task_status = 'Pending' AND {{chosen}}),
{_MATCH.format(src="(SELECT * FROM queue WHERE eligible)")},
matched AS (SELECT m.platform, m.order_id, m.row_no, m.item_index, x.product_id AS item_product_id, x.title AS item_title,
    coalesce(x.returnable, true) AS returnable, {_NOTE.replace('platform', 'm.platform')} AS note,
    CASE WHEN o.order_id IS NOT NULL THEN CASE WHEN o.has_batch_entry THEN 'batch' ELSE 'sequential' END END AS flow
  FROM matches m LEFT JOIN task_items x ON x.platform = m.platform AND x.order_id = m.order_id AND x.item_index = m.item_index
  LEFT JOIN reachable_orders o ON o.platform = m.platform AND o.order_id = m.order_id),
firsts AS (SELECT platform, order_id, item_index, min(row_no) AS first_row FROM matched
  WHERE flow IS NOT NULL AND item_index IS NOT NULL AND returnable GROUP BY ALL),
entered AS (SELECT a.*, CASE
    WHEN f.first_row IS NULL THEN NULL
    WHEN (a.platform, a.order_id, lower(a.item_product_id)) IN (SELECT (platform, order_id, lower(product_id)) FROM placed_returns)
    THEN 'a return of this item is on record'
    WHEN a.row_no <> f.first_row THEN 'an earlier task of the run is for the same item' END AS twice
  FROM matched a LEFT JOIN firsts f ON f.platform = a.platform AND f.order_id = a.order_id AND f.item_index = a.item_index
    AND a.flow IS NOT NULL AND a.returnable),
submitted AS (SELECT * FROM entered WHERE flow IS NOT NULL AND item_index IS NOT NULL AND returnable AND twice IS NULL),
{_RECONCILE}, {_OUTCOME},
decided AS (
  SELECT platform, order_id, row_no, status AS return_status, NULL AS return_id, CAST(NULL AS DOUBLE) AS refund_amount,
         'Skipped: ' || reason AS message FROM queue WHERE NOT eligible
  UNION ALL
  SELECT platform, order_id, row_no,
         CASE WHEN flow IS NULL OR item_index IS NULL OR twice IS NOT NULL THEN 'Support Needed' ELSE {_REFUSAL_SQL.format('note')} END, NULL, NULL,
         CASE WHEN flow IS NULL THEN 'order ' || order_id || ' not reachable'
              WHEN item_index IS NULL THEN 'no item of the order fits the task' WHEN twice IS NOT NULL THEN twice ELSE note END
  FROM entered WHERE flow IS NULL OR item_index IS NULL OR NOT returnable OR twice IS NOT NULL
  UNION ALL SELECT * FROM confirmed)"""
_RUN_VIEWS = with_views("tasks", "task_items", "shown_entries", "reachable_orders", "placed_returns")
RUN = _RUN_VIEWS + ", " + _DECIDED.replace("{chosen}", "true")
RUN_OF_PART = _RUN_VIEWS + ", " + _DECIDED.replace("{chosen}", "quantity <= 25")

_MERGED_COLUMNS = f"""CASE WHEN known THEN {_settled_sql('n_status')} ELSE task_status END AS task_status,
  CASE WHEN known THEN nullif(n_id, '') ELSE return_id END AS return_id,
  CASE WHEN known THEN n_status ELSE return_status END AS return_status,
  CASE WHEN known THEN n_refund ELSE refund_amount END AS refund_amount,
  CASE WHEN known THEN n_ts ELSE "timestamp" END AS "timestamp",
  CASE WHEN known THEN concat_ws(chr(10), nullif(log, ''), n_log) ELSE log END AS log"""
_FOLD = """once AS (SELECT DISTINCT * FROM outcome_events),
newest AS (SELECT * FROM once QUALIFY row_number() OVER (PARTITION BY row_no ORDER BY event_ts DESC, event_id DESC) = 1),
logs AS (SELECT row_no, string_agg('[' || strftime(event_ts, '%Y-%m-%d %H:%M:%S') || '] ' || message, chr(10)
           ORDER BY event_ts, event_id) AS log_entries FROM once GROUP BY 1),
folded AS (SELECT n.platform, n.order_id, n.row_no, return_status, return_id, refund_amount, event_ts, log_entries
           FROM newest n JOIN logs USING (row_no))"""
EVENTS = with_views("outcome_events") + ", " + _FOLD
_MERGE_EVENTS = (
    with_views("outcome_events", "customer_tasks")
    + f", {_FOLD} SELECT platform, order_id, row_no, sku, {_MERGED_COLUMNS} FROM ("
    + """SELECT c.*, f.row_no IS NOT NULL AS known, f.return_status AS n_status, f.return_id AS n_id,
    f.refund_amount AS n_refund, f.event_ts AS n_ts, f.log_entries AS n_log
  FROM customer_tasks c LEFT JOIN folded f ON f.row_no = c.row_no)"""
)
_RESOLVED = """resolved AS (SELECT platform, order_id, row_no, return_status, return_id, refund_amount, message, attempt_no
  FROM attempts WHERE attempt_no <= 2
  QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY return_status = 'Failed',
            CASE WHEN return_status = 'Failed' THEN -attempt_no ELSE attempt_no END) = 1)"""

# -- Spark sides --------------------------------------------------------------------


def _tasks(build):
    return lambda spark, sf: build(views.tasks(spark, sf))


def eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdict = verdicts.eligibility(F.col("delivery_date"), F.col("return_window_days"), TODAY)
    rows = views.tasks(spark, sf_dir).withColumn("v", verdict)
    return rows.select(*KEY, "v.eligible", "v.reason", "v.status", F.col("v.days_left").cast("bigint").alias("days_left"))


def task_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = verdicts.task_label(*[F.col(c) for c in ("platform", "order_id", "sku", "product_name", "product_link")])
    return views.tasks(spark, sf_dir).select(*KEY, label.alias("label"))


def refusal_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdict = verdicts.refusal_verdict(
        F.col("product_id").isNotNull(), F.col("returnable"), F.col("reason_unreturnable"), F.col("platform")
    )
    return (
        views.task_items(spark, sf_dir)
        .withColumn("v", verdict)
        .select("platform", "order_id", "item_index", "v.status", "v.message")
    )


def refund_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    refund = verdicts.refund_amount(F.col("amount"), F.col("quantity"))
    return views.tasks(spark, sf_dir).select(*KEY, refund.alias("refund"))


def confirmation_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.confirmations(spark, sf_dir).select(
        "platform", "order_id", "position",
        return_id(F.col("return_id_text"), LETTER_RETURN_ID).alias("letter_id"),
        return_id(F.col("return_id_text"), RMA_RETURN_ID).alias("rma_id"),
        amount_in_text(F.col("refund_text")).alias("refund"),
    )


def _submitted_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.task_items(spark, sf_dir, shared=True).select(
        "platform",
        "order_id",
        F.col("item_index").alias("row_no"),
        F.col("product_id").alias("item_product_id"),
        F.col("title").alias("item_title"),
        F.when(F.col("platform") == "Amazon", "batch").otherwise("sequential").alias("flow"),
    )


_SUBMITTED = """submitted AS (SELECT platform, order_id, item_index AS row_no, product_id AS item_product_id,
  title AS item_title, CASE WHEN platform = 'Amazon' THEN 'batch' ELSE 'sequential' END AS flow FROM task_items)"""


def reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reconcile.reconcile(_submitted_items(spark, sf_dir), views.shown_entries(spark, sf_dir, shared=True))
    return found.select(*KEY, F.col("entry.position").alias("position"), "confirmed_by", "page_shown")


def confirmation_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reconcile.reconcile(_submitted_items(spark, sf_dir), views.shown_entries(spark, sf_dir, shared=True))
    return reconcile.confirmation_outcome(found, F.col("flow")).select(*KEY, "outcome.*")


def line_item_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matching.match_line_items(views.tasks(spark, sf_dir, shared=True), views.task_items(spark, sf_dir, shared=True))
    return found.select(*KEY, "item_index", "match_rule", F.round("score", 9).alias("score"))


def _run(spark: SparkSession, sf_dir: str, chosen: Column | None = None):
    return run_returns(
        views.tasks(spark, sf_dir, shared=True),
        views.task_items(spark, sf_dir, shared=True),
        views.reachable_orders(spark, sf_dir),
        views.shown_entries(spark, sf_dir, shared=True),
        TODAY,
        F.lit(WHEN).cast("timestamp"),
        placed=views.placed_returns(spark, sf_dir, shared=True),
        chosen=chosen,
    )


def default_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    resolved = outcomes.resolve_attempts(views.attempts(spark, sf_dir))
    reported = resolved.where(F.col("return_status") != FAILED).select(*KEY, *outcomes.OUTCOME_FIELDS)
    return outcomes.with_default_outcome(views.attempts(spark, sf_dir).select(*KEY).distinct(), reported)


def merged_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = views.outcome_events(spark, sf_dir)
    replayed = events.unionByName(events)
    return outcomes.merge_outcomes(views.customer_tasks(spark, sf_dir), outcomes.fold_events(replayed))


def streamed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream, delivered by two runs into one log, folded into the tasks."""
    folder = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    raw = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    for delivery in ("first", "again"):
        arriving = stream.event_stream(spark, sf_dir, schema=raw, pathGlobFilter="events.parquet")
        run = stream.append_to_log(views.as_outcome_events(arriving), f"{folder}/log", f"{folder}/{delivery}-checkpoint")
        run.awaitTermination()
    return stream.current_tasks(views.customer_tasks(spark, sf_dir), stream.read_log(spark, f"{folder}/log"))


def compacted_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream: two thirds of the users, compacted, then all of them, twice, with another compaction between."""
    folder = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    raw = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    for delivery in ("some", "all", "again"):
        arriving = stream.event_stream(spark, sf_dir, schema=raw, pathGlobFilter="events.parquet")
        arriving = arriving.where("user_id % 3 > 0") if delivery == "some" else arriving
        stream.append_to_log(views.as_outcome_events(arriving), f"{folder}/log", f"{folder}/{delivery}-checkpoint").awaitTermination()
        if delivery != "again":
            stream.compact(spark, f"{folder}/log")
    return stream.tasks_of_log(spark, views.customer_tasks(spark, sf_dir), f"{folder}/log")


def table_of_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The task table after two merges, each of the outcomes of every other task."""
    folder = f"{checkpoint_dir(spark)}/tasks-{uuid.uuid4().hex}"
    task_table.create_table(views.customer_tasks(spark, sf_dir), folder)
    folded = pin(outcomes.fold_events(views.outcome_events(spark, sf_dir)))
    for odd in (0, 1):
        task_table.merge_into_table(folded.where(F.col("row_no") % 2 == odd), folder)
    return task_table.read_table(spark, folder)


def failed_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = views.table(spark, sf_dir, "orders").where(F.col("o_orderpriority") == "1-URGENT")
    failed = orders.selectExpr(
        "CASE WHEN o_orderstatus = 'O' THEN 'Amazon' ELSE 'Flipkart' END AS platform",
        "concat('OD', o_orderkey) AS order_id",
        f"'{SUPPORT_NEEDED}' AS return_status",
        "concat('order ', o_orderkey, ' not reachable') AS message",
    )
    marked = outcomes.fail_orders(views.tasks(spark, sf_dir), failed, F.lit(WHEN).cast("timestamp"))
    return marked.select(*KEY, "task_status", "return_id", "return_status", "refund_amount", "timestamp", "log")


def _returned(spark: SparkSession, sf_dir: str, keep: bool) -> DataFrame:
    pick = outcomes.already_returned if keep else outcomes.not_yet_returned
    found = pick(views.task_items(spark, sf_dir, shared=True), views.placed_returns(spark, sf_dir, shared=True))
    return found.select("platform", "order_id", "item_index", "product_id")


def next_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = outcomes.next_queue(
        *(view(spark, sf_dir, shared=True) for view in (views.tasks, views.task_items, views.placed_returns))
    )
    return found.select(*KEY, "sku")


_KEYS = "platform, order_id, row_no"
_PLACED_KEY = "(SELECT (platform, order_id, lower(product_id)) FROM placed_returns)"
_RETURNED_SQL = (
    with_views("task_items", "placed_returns")
    + f"""SELECT platform, order_id, item_index, product_id FROM task_items
WHERE coalesce((platform, order_id, lower(product_id)) IN {_PLACED_KEY}, false) = {{0}}"""
)
_RUN_COUNTS = f""", touched AS (
  SELECT bool_and(t.task_status <> 'Pending' OR d.row_no IS NOT NULL) AS settled
  FROM tasks t LEFT JOIN decided d ON d.platform = t.platform AND d.order_id = t.order_id AND d.row_no = t.row_no
  WHERE (t.platform, t.order_id) IN (SELECT (platform, order_id) FROM decided) GROUP BY t.platform, t.order_id)
SELECT count(*) AS attempted, count(*) FILTER (return_status = 'Placed') AS placed,
  count(*) FILTER (return_status = 'Out of window') AS out_of_window,
  count(*) FILTER (return_status IN {_REVIEW_SQL}) AS needs_review,
  (SELECT count(*) FROM touched WHERE settled) AS orders_settled, (SELECT count(*) FROM touched WHERE NOT settled) AS orders_partial
FROM decided"""

QUERIES = [
    Query(
        "pending_tasks",
        _tasks(lambda t: tasks.pending(t).select(*KEY, "task_status")),
        TASKS + f"SELECT {_KEYS}, task_status FROM tasks WHERE task_status = 'Pending'",
    ),
    Query(
        "review_queue",
        _tasks(lambda t: tasks.review_queue(t).select(*KEY, "label", "last_line")),
        TASKS + f"SELECT {_KEYS}, {_LABEL} AS label, string_split(rtrim(log, chr(10)), chr(10))[-1] AS last_line FROM tasks WHERE task_status = 'Needs human review'",
    ),
    Query("task_labels", task_labels, TASKS + f"SELECT {_KEYS}, {_LABEL} AS label FROM tasks"),
    Query(
        "order_tasks",
        lambda spark, sf: tasks.of_orders(
            views.tasks(spark, sf),
            views.reachable_orders(spark, sf).where("has_batch_entry"),
        ).select(*KEY),
        with_views("tasks", "reachable_orders")
        + f"SELECT {_KEYS} FROM tasks WHERE order_id IN (SELECT order_id FROM reachable_orders WHERE has_batch_entry)",
    ),
    Query(
        "order_groups",
        _tasks(tasks.order_groups),
        TASKS + 'SELECT platform, order_id, min(row_no) AS first_row, count(*) AS "items" FROM tasks GROUP BY ALL',
    ),
    Query(
        "grouped_by_order",
        _tasks(lambda t: tasks.grouped_by_order(t).select(*KEY, "first_row", "items")),
        TASKS + f"""SELECT {_KEYS}, min(row_no) OVER (PARTITION BY platform, order_id) AS first_row,
  count(*) OVER (PARTITION BY platform, order_id) AS "items" FROM tasks""",
    ),
    Query(
        "settled_orders",
        _tasks(tasks.settled_orders),
        TASKS + "SELECT platform, order_id, bool_and(task_status <> 'Pending') AS settled FROM tasks GROUP BY ALL",
    ),
    Query(
        "status_counts",
        _tasks(tasks.status_counts),
        TASKS + "SELECT task_status, count(*) AS n FROM tasks GROUP BY 1",
    ),
    Query(
        "settled_status",
        _tasks(lambda t: t.select(*KEY, verdicts.settled_status(F.col("return_status")).alias("status"))),
        TASKS + f"SELECT {_KEYS}, {_settled_sql('return_status')} AS status FROM tasks",
    ),
    Query(
        "eligibility",
        eligibility,
        TASKS + f", {_VERDICT} SELECT {_KEYS}, eligible, reason, status, days_left FROM verdicts",
    ),
    Query(
        "refusal_verdicts",
        refusal_verdicts,
        with_views("task_items") + f"""SELECT platform, order_id, item_index,
  CASE WHEN product_id IS NULL THEN 'Support Needed' WHEN NOT returnable THEN {_REFUSAL_SQL.format(_NOTE)} END AS status,
  CASE WHEN product_id IS NULL THEN 'no item of the order fits the task'
       WHEN NOT returnable THEN {_NOTE} END AS message FROM task_items""",
    ),
    Query(
        "refund_amounts",
        refund_amounts,
        TASKS + f"SELECT {_KEYS}, CAST(CAST(amount AS DECIMAL(18,2)) * quantity AS DOUBLE) AS refund FROM tasks",
    ),
    Query(
        "flow_models",
        lambda spark, sf: views.platform_orders(spark, sf).select(
            "platform", "order_id", verdicts.flow_model(F.col("has_batch_entry")).alias("flow")
        ),
        with_views("platform_orders")
        + "SELECT platform, order_id, CASE WHEN has_batch_entry THEN 'batch' ELSE 'sequential' END AS flow FROM platform_orders",
    ),
    Query(
        "confirmation_values",
        confirmation_values,
        with_views("confirmations") + f"""SELECT platform, order_id, position,
  {_return_id_sql('return_id_text', LETTER_RETURN_ID)} AS letter_id,
  {_return_id_sql('return_id_text', RMA_RETURN_ID)} AS rma_id, {_AMOUNT_SQL} AS refund FROM confirmations""",
    ),
    Query(
        "line_item_matches",
        line_item_matches,
        with_views("tasks", "task_items")
        + ", "
        + _MATCH.format(src="tasks")
        + f" SELECT {_KEYS}, item_index, match_rule, round(score, 9) AS score FROM matches",
    ),
    Query(
        "reconciled_confirmations",
        reconciled,
        with_views("task_items", "shown_entries")
        + f", {_SUBMITTED}, {_RECONCILE} SELECT {_KEYS}, position, confirmed_by, page_shown FROM reconciled",
    ),
    Query(
        "confirmation_outcomes",
        confirmation_outcomes,
        with_views("task_items", "shown_entries")
        + f", {_SUBMITTED}, {_RECONCILE}, {_OUTCOME} SELECT * FROM confirmed",
    ),
    Query(
        "resolved_attempts",
        lambda spark, sf: outcomes.resolve_attempts(views.attempts(spark, sf)),
        with_views("attempts") + f", {_RESOLVED} SELECT * FROM resolved",
    ),
    Query(
        "default_outcomes",
        default_outcomes,
        with_views("attempts") + f""", {_RESOLVED} SELECT {_KEYS},
  CASE WHEN return_status = 'Failed' THEN 'Support Needed' ELSE return_status END AS return_status,
  CASE WHEN return_status <> 'Failed' THEN return_id END AS return_id,
  CASE WHEN return_status <> 'Failed' THEN refund_amount END AS refund_amount,
  CASE WHEN return_status = 'Failed' THEN 'the batch came back without a word on this item' ELSE message END AS message
FROM resolved""",
    ),
    Query(
        "folded_events",
        lambda spark, sf: outcomes.fold_events(views.outcome_events(spark, sf)),
        EVENTS + " SELECT * FROM folded",
    ),
    Query("merged_events", merged_events, _MERGE_EVENTS),
    Query("streamed_events", streamed_events, _MERGE_EVENTS),
    Query("compacted_events", compacted_events, _MERGE_EVENTS),
    Query("table_of_tasks", table_of_tasks, _MERGE_EVENTS),
    Query(
        "failed_orders",
        failed_orders,
        TASKS + f""", failed AS (SELECT concat('OD', o_orderkey) AS order_id FROM orders WHERE o_orderpriority = '1-URGENT')
SELECT {_KEYS}, {_MERGED_COLUMNS} FROM (
  SELECT *, task_status = 'Pending' AND order_id IN (SELECT order_id FROM failed) AS known, 'Support Needed' AS n_status,
    '' AS n_id, CAST(NULL AS DOUBLE) AS n_refund, TIMESTAMP '{WHEN}' AS n_ts,
    '[{WHEN}] order ' || order_id[3:] || ' not reachable' AS n_log FROM tasks)""",
    ),
    Query("not_yet_returned", lambda spark, sf: _returned(spark, sf, False), _RETURNED_SQL.format("false")),
    Query("already_returned", lambda spark, sf: _returned(spark, sf, True), _RETURNED_SQL.format("true")),
    Query(
        "next_queue",
        next_queue,
        with_views("tasks", "task_items", "placed_returns")
        + f", waiting AS (SELECT * FROM tasks WHERE task_status = 'Pending'), {_MATCH.format(src='waiting')}"
        + f""" SELECT w.platform, w.order_id, w.row_no, w.sku FROM waiting w
  JOIN matches m ON m.platform = w.platform AND m.order_id = w.order_id AND m.row_no = w.row_no
  LEFT JOIN task_items x ON x.platform = m.platform AND x.order_id = m.order_id AND x.item_index = m.item_index
WHERE NOT coalesce((x.platform, x.order_id, lower(x.product_id)) IN {_PLACED_KEY}, false)""",
    ),
    Query(
        "returns_outcomes",
        lambda spark, sf: _run(spark, sf).outcomes,
        RUN + f" SELECT {_KEYS}, return_status, return_id, refund_amount, message FROM decided",
    ),
    Query(
        "returns_tasks",
        lambda spark, sf: _run(spark, sf).tasks,
        RUN + f""" SELECT * EXCLUDE (known, n_status, n_id, n_refund, n_ts, n_log)
  REPLACE ({_MERGED_COLUMNS}) FROM (
  SELECT t.*, d.row_no IS NOT NULL AS known, d.return_status AS n_status, d.return_id AS n_id,
    d.refund_amount AS n_refund, TIMESTAMP '{WHEN}' AS n_ts, '[{WHEN}] ' || d.message AS n_log
  FROM tasks t LEFT JOIN decided d ON d.platform = t.platform AND d.order_id = t.order_id AND d.row_no = t.row_no)""",
    ),
    Query(
        "returns_placed",
        lambda spark, sf: _run(spark, sf).placed,
        RUN + """ SELECT s.platform, s.order_id, s.item_product_id AS product_id FROM submitted s
  JOIN confirmed c ON c.platform = s.platform AND c.order_id = s.order_id AND c.row_no = s.row_no
  WHERE c.return_status = 'Placed' AND s.item_product_id IS NOT NULL""",
    ),
    Query("returns_report", lambda spark, sf: _run(spark, sf).report, RUN + " " + _RUN_COUNTS),
    Query(
        "returns_orders",
        lambda spark, sf: _run(spark, sf).orders,
        RUN + """ SELECT t.platform, t.order_id, bool_and(t.task_status <> 'Pending' OR d.row_no IS NOT NULL) AS settled
  FROM tasks t LEFT JOIN decided d ON d.platform = t.platform AND d.order_id = t.order_id AND d.row_no = t.row_no
  WHERE (t.platform, t.order_id) IN (SELECT (platform, order_id) FROM decided) GROUP BY ALL""",
    ),
    Query(
        "returns_orders_of_part",
        lambda spark, sf: _run(spark, sf, F.col("quantity") <= 25).orders,
        RUN_OF_PART + """ SELECT t.platform, t.order_id, bool_and(t.task_status <> 'Pending' OR d.row_no IS NOT NULL) AS settled
  FROM tasks t LEFT JOIN decided d ON d.platform = t.platform AND d.order_id = t.order_id AND d.row_no = t.row_no
  WHERE (t.platform, t.order_id) IN (SELECT (platform, order_id) FROM decided) GROUP BY ALL""",
    ),
    Query(
        "returns_report_of_part",
        lambda spark, sf: _run(spark, sf, F.col("quantity") <= 25).report,
        RUN_OF_PART + " " + _RUN_COUNTS,
    ),
]
