"""Table schemas and the fixed vocabularies of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)

TRANSACTION_CSV = T.StructType(
    [
        T.StructField("transaction_time", T.StringType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("transaction_amt", MONEY),
        T.StructField("narration", T.StringType()),
        T.StructField("transaction_type", T.StringType()),
        T.StructField("txn_id", T.StringType()),
        T.StructField("month", T.IntegerType()),
        T.StructField("month2", T.IntegerType()),
    ]
)

TASK = T.StructType(
    [
        T.StructField("task_id", T.StringType()),
        T.StructField("platform", T.StringType()),
        T.StructField("order_id", T.StringType()),
        T.StructField("sku", T.StringType()),
        T.StructField("product_name", T.StringType()),
        T.StructField("product_link", T.StringType()),
        T.StructField("quantity", T.IntegerType()),
        T.StructField("amount", T.DoubleType()),
        T.StructField("order_date", T.DateType()),
        T.StructField("delivery_date", T.DateType()),
        T.StructField("return_window_days", T.IntegerType()),
        T.StructField("task_status", T.StringType()),
        T.StructField("return_id", T.StringType()),
        T.StructField("return_status", T.StringType()),
        T.StructField("refund_amount", T.DoubleType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("log", T.StringType()),
        T.StructField("address", T.StringType()),
        T.StructField("contact_number", T.StringType()),
    ]
)
TASK_COLUMNS = TASK.fieldNames()

GRID = T.StructType(
    [
        T.StructField("sheet_id", T.StringType()),
        T.StructField("row_no", T.LongType()),
        T.StructField("cells", T.ArrayType(T.StringType())),
    ]
)

LINE_ITEM = T.StructType(
    [
        T.StructField("platform", T.StringType()),
        T.StructField("order_id", T.StringType()),
        T.StructField("item_index", T.IntegerType()),
        T.StructField("title", T.StringType()),
        T.StructField("product_id", T.StringType()),
        T.StructField("amount", T.DoubleType()),
        T.StructField("returnable", T.BooleanType()),
        T.StructField("reason_unreturnable", T.StringType()),
    ]
)

CONFIRMATION = T.StructType(
    [
        T.StructField("platform", T.StringType()),
        T.StructField("order_id", T.StringType()),
        T.StructField("position", T.IntegerType()),
        T.StructField("product_id", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("return_id_text", T.StringType()),
        T.StructField("refund_text", T.StringType()),
    ]
)

OUTCOME_EVENT = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("platform", T.StringType()),
        T.StructField("order_id", T.StringType()),
        T.StructField("row_no", T.LongType()),
        T.StructField("attempt_no", T.IntegerType()),
        T.StructField("event_ts", T.TimestampType()),
        T.StructField("return_status", T.StringType()),
        T.StructField("return_id", T.StringType()),
        T.StructField("refund_amount", T.DoubleType()),
        T.StructField("message", T.StringType()),
    ]
)

# The vocabularies that results must spell exactly.
PLATFORMS = ("Flipkart", "Amazon")
DEFAULT_PLATFORM = "Flipkart"

PENDING = "Pending"
DONE = "Done"
NEEDS_REVIEW = "Needs human review"
TASK_STATUSES = (PENDING, DONE, NEEDS_REVIEW)

PLACED = "Placed"
FAILED = "Failed"
OUT_OF_WINDOW = "Out of window"
ALREADY_REFUNDED = "Already Cancelled & Refunded"
NOT_DELIVERED = "Not yet delivered"
SUPPORT_NEEDED = "Support Needed"
RETURN_STATUSES = (PLACED, FAILED, OUT_OF_WINDOW, ALREADY_REFUNDED, NOT_DELIVERED, SUPPORT_NEEDED)
REVIEW_STATUSES = (FAILED, SUPPORT_NEEDED, NOT_DELIVERED)

DECLARED_CATEGORIES = ("UPI", "IMPS", "RTGS", "NEFT")

PENDING_WORDS = ("", "pending", "to do", "todo", "to-do", "open", "new", "not started", "none")
DONE_WORDS = ("done", "complete", "completed", "closed", "finished")

TITLE_STOP_WORDS = (
    "www", "com", "flipkart", "amazon", "dl", "in", "p", "pid", "lid", "marketplace", "https", "http",
)

# Accepted header spellings (lower case, letters and digits only) per field.
HEADER_ALIASES = {
    "platform": ["platform"],
    "order_id": ["orderid", "orderno", "ordernumber"],
    "product_link": ["productlink", "producturl", "link", "product"],
    "amount": ["amount", "ordervalue", "totalamount", "price"],
    "quantity": ["noofproduct", "noofproducts", "qty", "quantity", "units"],
    "order_date": ["orderdate", "dateoforder"],
    "delivery_date": ["deliverydate", "delivereddate", "dateofdelivery"],
    "return_window_days": ["returnwindow", "returnwindowdays", "returnperiod"],
    "task_status": ["status", "taskstatus"],
    "return_id": ["refundid", "returnid", "rmaid"],
    "return_status": ["returnstatus"],
    "refund_amount": ["refundamount"],
    "timestamp": ["timestamp", "time"],
    "log": ["log", "notes", "remarks"],
    "address": ["address"],
    "contact_number": ["contactnumber", "phone", "mobile", "contact"],
}
REQUIRED_SHEET_FIELDS = ("platform", "order_id", "product_link")

# Phrases of a refusal and the status each stands for, first match counts.
REFUSAL_PHRASES = {
    ALREADY_REFUNDED: ("cancel", "refunded"),
    NOT_DELIVERED: ("not delivered", "out for delivery", "shipped"),
    OUT_OF_WINDOW: ("window", "period", "expired", "eligib"),
}

# Agent-written columns, the only ones an outcome may touch.
AGENT_WRITTEN = ("task_status", "return_id", "return_status", "refund_amount", "timestamp", "log")
