"""Transactions from CSV or parquet files, and from printed text lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.cells import strip
from ledgerloom.schemas import MONEY, TRANSACTION_CSV
from ledgerloom.sources.versions import current, fresh_name, publish

# The layout of one printed record; amount and narration are fused.
PRINTED_RECORD = (
    r"(\d{1,2}/\d{1,2}/\d{4})\s+(\d+)\s+(\d+)([A-Za-z]+)\s+(CREDIT|DEBIT)\s+(\S+)\s+(\d+)\s+(\d+)"
)
PRINTED_FIELDS = TRANSACTION_CSV.fieldNames()
HEADER_WORD = "Transaction"
REPORTED_REJECTS = 10


class UnparsedLines(ValueError):
    """Some printed lines hold no record; nothing may be loaded from them."""


def with_dates(raw: DataFrame) -> DataFrame:
    """Add ``txn_date`` and ``txn_month`` from the printed ``m/d/yyyy``; drop the unused months."""
    day = F.try_to_timestamp("transaction_time", F.lit("M/d/yyyy")).cast("date")
    return raw.withColumn("txn_date", day).withColumn("txn_month", F.date_format("txn_date", "yyyy-MM")).drop(
        "month", "month2"
    )


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """The typed transactions table from CSV files with a header."""
    return with_dates(spark.read.schema(TRANSACTION_CSV).option("header", True).csv(path))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return with_dates(spark.read.schema(TRANSACTION_CSV).parquet(path))


def printed_records(lines: DataFrame, line: str = "value") -> DataFrame:
    """Every record in every line, all fields still text; one line may hold several."""
    found = F.regexp_extract_all(F.col(line), F.lit(PRINTED_RECORD), F.lit(0))
    records = lines.select(F.explode(found).alias("_record"))
    fields = [F.regexp_extract("_record", PRINTED_RECORD, i + 1).alias(f) for i, f in enumerate(PRINTED_FIELDS)]
    return records.select(*fields).withColumn("narration", F.upper("narration"))


def unparsed_lines(lines: DataFrame, line: str = "value", exact_header: str | None = None) -> DataFrame:
    """The non-blank lines that hold no record and are no header.

    By default any line that mentions the header word counts as a header;
    ``exact_header`` narrows that to one exact line.
    """
    text = F.coalesce(F.col(line), F.lit(""))
    header = text.contains(HEADER_WORD) if exact_header is None else text == exact_header
    return lines.where((strip(text) != "") & ~header & ~text.rlike(PRINTED_RECORD))


def load_printed(lines: DataFrame, line: str = "value") -> DataFrame:
    """The records of the lines, or ``UnparsedLines`` when any line is left over."""
    rejects = unparsed_lines(lines, line).select(line).limit(REPORTED_REJECTS).collect()
    if rejects:
        raise UnparsedLines("unparsed lines, nothing loaded:\n" + "\n".join(r[0] for r in rejects))
    return printed_records(lines, line)


def publish_printed(lines: DataFrame, folder: str, line: str = "value", exact_header: str | None = None) -> int:
    """Load printed lines into a versioned folder, all or nothing; the version they are.

    The lines are read once: rejects are counted while the records are written to a place that no reader knows, which
    becomes the table only when there were none.  Otherwise ``UnparsedLines`` tells how many and shows the first found.
    """
    spark = lines.sparkSession
    before, path, seen = current(spark, folder).version, fresh_name(folder), Observation()
    text = F.coalesce(F.col(line), F.lit(""))
    header = text.contains(HEADER_WORD) if exact_header is None else text == exact_header
    found = lines.select(text.alias("_line"), F.regexp_extract_all(text, F.lit(PRINTED_RECORD), F.lit(0)).alias("_records"), header.alias("_header"))
    left_over = (F.size("_records") == 0) & ~F.col("_header") & (strip(F.col("_line")) != "")
    counted = found.observe(seen, F.count_if(left_over).alias("rejects"))
    records = counted.select(F.explode("_records").alias("_record"))
    fields = [F.regexp_extract("_record", PRINTED_RECORD, i + 1).alias(f) for i, f in enumerate(PRINTED_FIELDS)]
    typed(records.select(*fields).withColumn("narration", F.upper("narration"))).write.parquet(path)
    if rejects := seen.get["rejects"]:
        first = unparsed_lines(lines, line, exact_header).select(line).limit(REPORTED_REJECTS).collect()
        raise UnparsedLines(f"{rejects} unparsed lines, nothing loaded:\n" + "\n".join(r[0] for r in first))
    return publish(spark.createDataFrame([(path,)], "path string"), folder, before)


def read_published(spark: SparkSession, folder: str) -> DataFrame:
    """The transactions of the last load that left no line over."""
    state = current(spark, folder)
    if not state.rows:
        raise ValueError(f"no transactions in {folder}")
    return spark.read.parquet(state.rows[0].path)


def typed(records: DataFrame) -> DataFrame:
    """Text records as the typed transactions table."""
    return with_dates(
        records.withColumns(
            {
                "user_id": F.col("user_id").try_cast("bigint"),
                "transaction_amt": F.col("transaction_amt").try_cast(MONEY),
            }
        )
    )


def write_csv(records: DataFrame, path: str) -> None:
    """Write the extracted fields as CSV files with a header."""
    records.select(*PRINTED_FIELDS).write.mode("overwrite").option("header", True).csv(path)
