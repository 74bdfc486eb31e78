"""Secret scans over an incremental blob ledger.

A blob is a text under the name of its SHA-256.  The ledger is a Parquet table with, per
blob, the rule versions that have read it and what they found.  A scan takes every version
of every path, reads only the blobs that some current rule version has not seen, once
however many paths hold them, appends to the ledger, and joins the findings back to all paths.

Defined cases: a null text is the empty blob, without findings; null and repeated keys keep a row
each; positions are code points, ends exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.words import pieces, text_array
from ledgerloom.operators.lookups import lookup
from ledgerloom.session import BROADCAST_MAX_ROWS, pin
from ledgerloom.sources.versions import names_in

FINDING = "struct<rule:string,start_at:bigint,end_at:bigint>"
LEDGER = f"blob string, rules array<string>, findings array<{FINDING}>"

# The asked-for patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a run of hex digits is one match, so shorter ones may be passed over
# The body up to the first end mark, with header lines (Proc-Type, DEK-Info) and escaped line ends.
PEM = re.compile(r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----[A-Za-z0-9+/=\s:,\\-]+?-----END [A-Z ]{0,20}PRIVATE KEY-----", re.ASCII)
TOKEN_TRIPLE = re.compile(r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}")


def _assign(text: str) -> Iterator[tuple[int, int]]:
    lower = text.lower()
    if any(word in lower for word in ("passw", "secret", "token", "api")):
        yield from (m.span() for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6)


def _access(text: str) -> Iterator[tuple[int, int]]:
    if "AKIA" in text:
        yield from (m.span() for m in ACCESS.finditer(text) if m.end() - m.start() >= 20)


def _hex(text: str) -> Iterator[tuple[int, int]]:
    yield from (m.span() for m in HEX.finditer(text))


def _pem(text: str) -> Iterator[tuple[int, int]]:
    if "-----BEGIN " in text:
        yield from (m.span() for m in PEM.finditer(text))


def _triple(text: str) -> Iterator[tuple[int, int]]:
    if "eyJ" in text:
        yield from (m.span() for m in TOKEN_TRIPLE.finditer(text))


class Rule(NamedTuple):
    kind: str
    version: int
    spans: Callable[[str], Iterator[tuple[int, int]]]

    @property
    def id(self) -> str:
        return f"{self.kind}@{self.version}"


BASE_KINDS = ("assign", "access", "hex")
RULES = (Rule("assign", 1, _assign), Rule("access", 1, _access), Rule("hex", 1, _hex), Rule("pem", 2, _pem), Rule("web_token", 2, _triple))


def blob_id(text: str = "text") -> Column:
    return F.sha2(F.coalesce(F.col(text), F.lit("")), 256)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """One row per blob: the rule versions that have read it and their findings, empty before the first scan."""
    if not any(name.endswith(".parquet") for name in names_in(spark, path)):
        return spark.createDataFrame([], LEDGER)
    rows = spark.read.schema(LEDGER).parquet(path)
    # A blob has one row per scan that read it, so never more than there are rule versions.
    return rows.groupBy("blob").agg(
        F.array_distinct(F.flatten(F.collect_list("rules"))).alias("rules"),
        F.array_distinct(F.flatten(F.collect_list("findings"))).alias("findings"),
    )


def unseen_pairs(texts: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The blobs that some current rule version has not read: ``blob, text, to_run``.

    Names are compared first, so that of a scan with little that is new only those texts move, and with nothing new none.
    """
    current = F.array(*[F.lit(r.id) for r in rules])
    seen = ledger.select("blob", F.col("rules").alias("_seen"))
    to_run = F.array_except(current, F.coalesce("_seen", F.array().cast("array<string>")))
    names = texts.select("blob").distinct()
    unseen = pin(names.join(seen, "blob", "left").select("blob", to_run.alias("to_run")).where(F.size("to_run") > 0))
    # Copies go before the shuffle, so a text of many paths is no hot key.
    if unseen.count() <= BROADCAST_MAX_ROWS:
        return texts.join(F.broadcast(unseen), "blob").dropDuplicates(["blob"])
    return texts.dropDuplicates(["blob"]).join(unseen, "blob")


def scan(docs: DataFrame, ledger_path: str, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Bring the ledger up to date and return ``key, blob, findings`` of every row of ``docs``.

    Findings are those of the current rule versions, by start, then rule as listed.
    """
    spark = docs.sparkSession
    by_id = {r.id: r for r in rules}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            found = [
                [{"rule": i, "start_at": s, "end_at": e} for i in ids for s, e in by_id[i].spans(t)]
                for t, ids in zip(text_array(batch.column("text")).to_pylist(), batch.column("to_run").to_pylist(), strict=True)
            ]
            kind = pa.list_(pa.struct([("rule", pa.string()), ("start_at", pa.int64()), ("end_at", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("blob"), batch.column("to_run").cast(pa.list_(pa.string())), pa.array(found, kind)], ["blob", "rules", "findings"]
            )

    texts = docs.select(blob_id(text).alias("blob"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    unseen = unseen_pairs(texts, read_ledger(spark, ledger_path), rules).select("blob", "text", "to_run")
    unseen.mapInArrow(read, LEDGER).write.mode("append").parquet(ledger_path)

    order = F.create_map(*[x for n, r in enumerate(rules) for x in (F.lit(r.id), F.lit(n))])
    placed = F.transform(
        F.filter("findings", lambda f: f["rule"].isin(list(by_id))),
        lambda f: F.struct(f["start_at"].alias("start_at"), order[f["rule"]].alias("at"), f["end_at"].alias("end_at"), f["rule"].alias("rule")),
    )
    ordered = F.transform(
        F.array_sort(placed), lambda f: F.struct(F.substring_index(f["rule"], "@", 1).alias("kind"), f["start_at"], f["end_at"])
    )
    known = read_ledger(spark, ledger_path).where(F.size("findings") > 0).select("blob", ordered.alias("findings"))
    paths = lookup(docs.select(key, blob_id(text).alias("blob")), known, ["blob"])
    nothing = F.array().cast("array<struct<kind:string,start_at:bigint,end_at:bigint>>")
    return paths.select(key, "blob", F.coalesce("findings", nothing).alias("findings"))
