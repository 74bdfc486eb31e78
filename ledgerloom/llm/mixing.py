"""Mixing sources to target weights by Pfair scheduling, in DataFrame operations only.

A source with ``k`` of every ``Q`` slots gives its block number i the release time
floor(i Q / k) and the deadline ceil((i + 1) Q / k).  Earliest deadline first fills slot after
slot with a released block; as the shares add up to Q, every block meets its deadline, so
after any number of slots each source is less than one block away from its target.

Shares are the weights in parts of 2**36, so fine that rounding moves no source by a block below 2**36 slots, however
many sources there are.  The blocks that the table holds are put into slots one by one - a row a block, 64 rows of the
table.  The driver goes through the slots once and keeps each source's next block, no more: every ``FRAME`` blocks
it hands their slots on to a table in the shared folder, which the rows join.  (A table of one frame needs none.)
With a ``period`` the shares are whole blocks of so many slots instead: one period is worked out and
repeats, and the targets are those rounded shares.

All rows are kept: when a source has no blocks left its later slots stay empty, and the
others go on in the same proportions.

Defined cases: null is a source of its own; rows are numbered within their source by the MD5 of
their key, a null key first; rows repeated under one key keep a place each.
"""

from __future__ import annotations

import heapq
import json
import uuid
from collections.abc import Iterator
from itertools import islice

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.operators.positions import row_numbers
from ledgerloom.session import BROADCAST_MAX_ROWS, checkpoint_dir, pin

BLOCK_ROWS = 64
PERIOD = 1000  # slots of a rounded schedule, where one is asked for
PARTS = 1 << 36  # of the whole, in which shares are counted without a period
EXPONENT = 0.7  # target weight of a source: its rows to this power, so that small ones count for more
FRAME = 1 << 17  # blocks, or sources, that the driver hands on at once


def whole_shares(weights: list[float], period: int = PERIOD) -> list[int]:
    """Weights as blocks of a period, one at least; the period is their sum."""
    total = sum(weights)
    return [max(1, int(period * w / total + 0.5)) for w in weights]


def one_period(shares: list[int]) -> list[tuple[int, int]]:
    """The source and its block number in every slot of a period, earliest deadline first."""
    period = sum(shares)
    waiting = [(0, s, 0) for s in range(len(shares))]  # release, source, block
    ready: list[tuple[int, int, int]] = []  # deadline, source, block
    slots = []
    for now in range(period):
        while waiting and waiting[0][0] <= now:
            _, s, i = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(i + 1) * period // shares[s]), s, i))
        _, s, i = heapq.heappop(ready)
        slots.append((s, i))
        if i + 1 < shares[s]:
            heapq.heappush(waiting, ((i + 1) * period // shares[s], s, i + 1))
    return slots


def in_slots(shares: list[int], blocks: list[int]) -> Iterator[tuple[int, int, int]]:
    """Slot, source and block number of every block that the sources have, earliest deadline first."""
    period = sum(shares)
    waiting = [(0, s, 0) for s in range(len(shares)) if blocks[s]]  # release, source, block
    ready: list[tuple[int, int, int]] = []  # deadline, source, block
    now = 0
    while waiting or ready:
        if not ready:
            now = max(now, waiting[0][0])
        while waiting and waiting[0][0] <= now:
            _, s, i = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(i + 1) * period // shares[s]), s, i))
        _, s, i = heapq.heappop(ready)
        yield now, s, i
        now += 1
        if i + 1 < blocks[s]:
            heapq.heappush(waiting, ((i + 1) * period // shares[s], s, i + 1))


def frames(shares: list[int], blocks: list[int], size: int | None = None) -> Iterator[list[dict]]:
    """The blocks in pieces of ``FRAME``: per source of a piece its first block there and the slots from that on."""
    placed = in_slots(shares, blocks)
    while some := list(islice(placed, size or FRAME)):
        of_source: dict[int, dict] = {}
        for slot, s, i in some:
            of_source.setdefault(s, {"number": s, "from": i, "at": []})["at"].append(slot)
        yield list(of_source.values())


def every_block(shares: list[int], blocks: list[int]) -> list[list[int]]:
    """Per source the slots of its blocks."""
    slots: list[list[int]] = [[] for _ in shares]
    for now, s, _ in in_slots(shares, blocks):
        slots[s].append(now)
    return slots


def _table(spark: SparkSession, pieces: Iterator[list[dict]], schema: str) -> tuple[DataFrame, bool]:
    """Rows that come in pieces, and whether they are small: one piece is a literal, more are written one by one."""
    first = next(pieces, [])
    second = next(pieces, None)
    if second is None:
        return _rows(spark, first, schema), True
    path = f"{checkpoint_dir(spark)}/mixing-{uuid.uuid4().hex}"
    for rows in (first, second):
        _rows(spark, rows, schema).write.mode("append").parquet(path)
    for rows in pieces:
        _rows(spark, rows, schema).write.mode("append").parquet(path)
    return spark.read.parquet(path), False


def _pieces_of(rows: list[dict]) -> Iterator[list[dict]]:
    return (rows[i : i + FRAME] for i in range(0, len(rows), FRAME))


def schedule(
    docs: DataFrame,
    source: str = "source",
    key: str = "doc_id",
    targets: dict[str | None, float] | None = None,
    block_rows: int = BLOCK_ROWS,
    period: int | None = None,
) -> DataFrame:
    """``key, source, block, place, release, deadline, slot`` of every row: its block of the source, its place in that,
    and when the block is due.  The mixed order is by slot, then place.

    ``targets`` maps sources to weights (those it leaves out weigh as rows to the power ``EXPONENT`` do among all).
    ``period`` rounds the weights to whole blocks of so many slots; without one they are kept.  The driver sees a few
    numbers per source.
    """
    spark = docs.sparkSession
    keyed = docs.select(F.col(key).alias("key"), F.col(source).alias("source"))
    counts = keyed.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    sources = pin(row_numbers(counts, [F.col("source").asc_nulls_first()], "number").withColumn("number", (F.col("number") - 1).cast("int")))
    found = sources.orderBy("number").select("source", "n").collect()
    by_size = [r.n**EXPONENT for r in found]
    whole_weight = sum(by_size)
    weights = [(targets or {}).get(r.source, w / whole_weight) for r, w in zip(found, by_size, strict=True)]
    shares = whole_shares(weights, PARTS if period is None else period) if found else []
    slots = sum(shares)

    if period is None:
        pieces = frames(shares, [-(-r.n // block_rows) for r in found])
    else:
        placed: list[dict] = [{"number": s, "from": 0, "at": []} for s in range(len(shares))]
        for t, (s, _) in enumerate(one_period(shares)):
            placed[s]["at"].append(t)
        pieces = iter([placed])
    lists, small = _table(spark, pieces, "number int, from bigint, at array<bigint>")
    pattern = lists.select("number", "from", F.posexplode("at").alias("_pos", "at"))
    pattern = pattern.select("number", (F.col("from") + F.col("_pos")).alias("in_period"), "at")
    begins, rows = 0, []
    for s, (r, k) in enumerate(zip(found, shares, strict=True)):
        rows.append({"number": s, "share": k, "begins": begins})
        begins += r.n
    of_number, _ = _table(spark, _pieces_of(rows), "number int, share bigint, begins bigint")
    known = of_number.join(sources.withColumnRenamed("source", "_source").drop("n"), "number")
    if len(found) <= BROADCAST_MAX_ROWS:
        known = F.broadcast(known)

    in_order = [F.col("source").asc_nulls_first(), F.md5(F.col("key").cast("string")).asc_nulls_first(), F.col("key")]
    numbered = row_numbers(keyed, in_order, "_row")
    of_source = numbered.join(known, F.expr("source <=> _source"))
    repeats = F.expr("block % share") if period is not None else F.col("block")
    blocks = of_source.withColumn("_row", F.col("_row") - 1 - F.col("begins")).select(
        "key", "source", "number", "share",
        F.expr(f"_row div {block_rows}").alias("block"),
        (F.col("_row") % block_rows).alias("place"),
    ).withColumn("in_period", repeats)
    due = blocks.join(F.broadcast(pattern) if small and period is None else pattern, ["number", "in_period"])
    before = F.expr("block div share") * F.lit(slots).cast("bigint") if period is not None else F.lit(0)
    # In decimals, so that no block number is too large to multiply.
    at = f"cast(block AS decimal(20,0)) * cast({slots} AS decimal(18,0))"
    next_at = f"cast(block + 1 AS decimal(20,0)) * cast({slots} AS decimal(18,0)) + share - 1"
    return due.select(
        F.col("key").alias(key), F.col("source").alias(source), "block", "place",
        F.expr(f"({at}) div share").alias("release"),
        F.expr(f"({next_at}) div share").alias("deadline"),
        (before + F.col("at")).alias("slot"),
    )


def _rows(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small table as one literal, so that no Python takes part in reading it."""
    parsed = F.from_json(F.lit(json.dumps(rows)), f"array<struct<{_fields(schema)}>>")
    return spark.range(1).select(F.explode(parsed).alias("r")).select("r.*")


def _fields(schema: str) -> str:
    return ",".join("`{}`:{}".format(*field.strip().split(" ", 1)) for field in schema.split(","))


def places(docs: DataFrame, source: str = "source", key: str = "doc_id", **options) -> DataFrame:
    """``key, _slot, _place``: the first place of each key in the mixed order; null is no key."""
    planned = schedule(docs, source, key, **options)
    first = planned.groupBy(key).agg(F.min(F.struct("slot", "place")).alias("_first")).where(F.col(key).isNotNull())
    return first.select(key, F.col("_first.slot").alias("_slot"), F.col("_first.place").alias("_place"))


def mixed_order(key: str = "doc_id") -> list[Column]:
    return [F.col("_slot").asc_nulls_last(), F.col("_place").asc_nulls_last(), F.col(key)]


def mixed(docs: DataFrame, source: str = "source", key: str = "doc_id", **options) -> DataFrame:
    """All rows of ``docs``, in the mixed order; rows of one key stand together, those without one last."""
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])  # whatever the columns are called
    key, source = f"c{names.index(key)}", f"c{names.index(source)}"
    placed = plain.join(places(plain, source, key, **options), key, "left")
    return placed.orderBy(*mixed_order(key)).select(*plain.columns).toDF(*names)


def running_shares(planned: DataFrame, source: str = "source") -> DataFrame:
    """``slot, source, got``: blocks of each source in the slots up to each slot that holds one of its blocks."""
    slots = planned.select("slot", source).distinct()
    return slots.withColumn("got", F.row_number().over(Window.partitionBy(source).orderBy("slot")))
