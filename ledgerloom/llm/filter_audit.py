"""How filters interact, from sorted posting lists.

Every row has a number.  Per part, filter and block of numbers a sorted list holds the numbers of the rows that fail the
filter; rows that carry a mark (a label) have lists alike.  Blocks are merged by themselves: the union of the lists
of any set of filters grows list by list, and what one more filter removes is the difference between its list
and that union, each found by galloping - a number looks for its place from where the one before it was found.
Only sizes leave a block.  They are summed over the blocks, and every order of the filters is read off the sizes,
since what a filter removes depends on which filters came before it, not on their order.

A block has ``BLOCK`` numbers at most, so a part with a third of all rows is as many small groups as it needs.

Defined cases: a null part and a null text read as empty; rows with null or repeated keys count one by one; a row
without a key has no smaller key; without rows there are no parts and the result is empty.  Labels repeated
for a key count if one of them does.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.words import pieces, text_array
from ledgerloom.operators.lookups import lookup
from ledgerloom.session import pin

BLOCK_BITS = 16
BLOCK = 1 << BLOCK_BITS  # row numbers of a posting list, at most
MAX_FILTERS = 6  # all orders of more are over 5,000 rows a part

# The asked-for filters.
LEAST_WORDS, LEAST_DISTINCT_PERCENT, MOST_CAPITAL_PERCENT = 100, 80, 10
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
SYMBOLS = b"#$%&*|"


def text_failures(raw: bytes, code_points: int) -> tuple[bool, bool, bool, bool]:
    """Too few words, too few distinct words, too many capitals, any symbol."""
    words = raw.split()  # at 0x20 and 0x09-0x0D
    capitals = len(raw) - len(raw.translate(None, CAPITALS))
    return (
        len(words) < LEAST_WORDS,
        100 * len(set(words)) < LEAST_DISTINCT_PERCENT * len(words),
        100 * capitals > MOST_CAPITAL_PERCENT * code_points,
        len(raw.translate(None, SYMBOLS)) < len(raw),
    )


def five_filters(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """``part, row, A, B, C, D, E, good, toxic`` of every row: which filters it fails and which labels it has.

    E is a text equal (by SHA-256) to that of a smaller key, in any part.
    """

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            texts = text_array(batch.column("text"))
            raw = texts.cast(pa.binary())
            fails = [text_failures(b.as_py(), n) for b, n in zip(raw, pc.utf8_length(texts).to_pylist(), strict=True)]
            digests = [hashlib.sha256(b.as_buffer()).digest() for b in raw]
            yield pa.RecordBatch.from_arrays(
                [batch.column("part"), batch.column("key"), pa.array(digests, pa.binary()), *(pa.array(f, pa.bool_()) for f in zip(*fails, strict=True))],
                ["part", "key", "digest", *"ABCD"],
            )

    read = docs.select(F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col(key).alias("key"), F.col(text).alias("text"))
    kind = docs.schema[key].dataType.simpleString()
    judged = read.mapInArrow(judge, f"part string, key {kind}, digest binary, A boolean, B boolean, C boolean, D boolean")
    rows = pin(judged.withColumn("row", F.monotonically_increasing_id()))
    copied = rows.groupBy("digest").agg(F.min("key").alias("_first"), F.max("key").alias("_last")).where("_first < _last")
    marks = labels.groupBy(F.col(key).alias("key")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic")
    )
    joined = lookup(lookup(rows, copied.select("digest", "_first"), ["digest"]), marks, ["key"])
    return joined.select(
        "part", "row", *"ABCD",
        F.coalesce(F.col("key") > F.col("_first"), F.lit(False)).alias("E"),
        *(F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")),
    )


def posting_lists(rows: DataFrame, names: list[str]) -> DataFrame:
    """``part, block, list, ids``: the sorted row numbers of each block for which the column ``list`` is true."""
    held = F.filter(F.array(*[F.when(F.col(c), F.lit(c)) for c in names]), lambda c: c.isNotNull())
    listed = rows.select("part", "row", F.shiftright("row", BLOCK_BITS).alias("block"), F.explode(held).alias("list"))
    return listed.groupBy("part", "block", "list").agg(F.sort_array(F.collect_list("row")).alias("ids"))


def among(ids: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Which of the sorted ``ids`` the sorted list ``others`` holds; the shorter list gallops through the longer."""
    if len(ids) > len(others):
        found = np.zeros(len(ids), bool)
        at = np.searchsorted(ids, others)
        at = at[at < len(ids)] if len(others) else at
        inside = at[ids[at] == others[: len(at)]]
        found[inside] = True
        return found
    at = np.searchsorted(others, ids)
    found = at < len(others)
    found[found] = others[at[found]] == ids[found]
    return found


def union(merged: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """A sorted list and one more; whole stretches between two new numbers are copied at once."""
    new = ids[~among(ids, merged)]
    return np.insert(merged, np.searchsorted(merged, new), new)


def block_sizes(lists: dict[str, np.ndarray], filters: list[str], marks: list[str]) -> list[list[int]]:
    """Per filter and set of other filters (a bit each), where not all is zero: rows in the union of the set, rows
    that the filter removes after it, and how many of these have each mark."""
    none = np.zeros(0, np.int64)
    unions = [none]
    for s in range(1, 1 << len(filters)):
        top = s.bit_length() - 1
        unions.append(union(unions[s ^ (1 << top)], lists.get(filters[top], none)))
    out = []
    for f, name in enumerate(filters):
        ids = lists.get(name, none)
        for s, before in enumerate(unions):
            if not s >> f & 1 and (len(before) or len(ids)):
                gone = ids[~among(ids, before)]
                out.append([f, s, len(before), len(gone), *(int(among(gone, lists.get(m, none)).sum()) for m in marks)])
    return out


def merge_sizes(lists: DataFrame, filters: list[str], marks: list[str]) -> DataFrame:
    """``part, filter, before, in_union, removed`` and a count a mark, summed over all blocks."""
    counts = ["in_union", "removed", *(f"lost_{m}" for m in marks)]

    def merge(block: pa.Table) -> pa.Table:
        held = {n: i.values.to_numpy() for n, i in zip(block.column("list").to_pylist(), block.column("ids"), strict=True)}
        sizes = np.array(block_sizes(held, filters, marks), np.int64).reshape(-1, 2 + len(counts))
        part = pa.array([block.column("part")[0].as_py()] * len(sizes), pa.string())
        columns = [part, *(pa.array(sizes[:, i].astype(np.int32)) for i in (0, 1)), *(pa.array(sizes[:, 2 + i]) for i in range(len(counts)))]
        return pa.Table.from_arrays(columns, ["part", "filter", "before", *counts])

    schema = "part string, filter int, before int, " + ", ".join(f"`{c}` long" for c in counts)
    merged = lists.groupBy("part", "block").applyInArrow(merge, schema)
    return merged.groupBy("part", "filter", "before").agg(*[F.sum(c).alias(c) for c in counts])


def _steps(filters: list[str]) -> Column:
    """All steps of all orders, as one literal."""
    rows = []
    for order in permutations(range(len(filters))):
        before = 0
        for step, f in enumerate(order):
            rows.append({"filter_order": "".join(filters[i] for i in order), "step": step + 1, "filter": f, "before": before})
            before |= 1 << f
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<filter_order:string,step:int,filter:int,before:int>>")


def interactions(rows: DataFrame, filters: list[str], marks: list[str]) -> DataFrame:
    """A row per part, order of the filters and step: ``kept, removed, redundant, unique_fails, lost_<mark>.., shapley``.

    ``rows`` has ``part``, a unique number ``row`` and a boolean column per filter (failed) and per mark.
    ``shapley`` is what the step's filter removes, summed over all orders.
    """
    if not 0 < len(filters) <= MAX_FILTERS:
        raise ValueError(f"1 to {MAX_FILTERS} filters")
    parts = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    sizes = pin(merge_sizes(posting_lists(rows, [*filters, *marks]), filters, marks))
    every = (1 << len(filters)) - 1

    def orders_with(s: int) -> int:
        """Orders in which exactly the filters of the set ``s`` stand before a given other one."""
        return math.factorial(s.bit_count()) * math.factorial(len(filters) - 1 - s.bit_count())

    times = F.element_at(F.array(*[F.lit(orders_with(s) if s != every else 0) for s in range(every + 1)]), F.col("before") + 1)
    alone = F.element_at(F.array(*[F.lit(every ^ (1 << f)) for f in range(len(filters))]), F.col("filter") + 1)
    of_filter = sizes.groupBy("part", "filter").agg(
        F.sum(F.when(F.col("before") == 0, F.col("removed"))).alias("_fails"),
        F.sum(F.when(F.col("before") == alone, F.col("removed"))).alias("unique_fails"),
        F.sum(F.col("removed") * times).alias("shapley"),
    )
    steps = parts.select("part", "n", F.explode(_steps(filters)).alias("s")).select("part", "n", "s.*")
    found = steps.join(sizes, ["part", "filter", "before"], "left").join(of_filter, ["part", "filter"], "left")

    def count(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0).cast("bigint"))

    return found.select(
        "part", "filter_order", "step",
        (F.col("n") - count("in_union") - count("removed")).alias("kept"),
        count("removed").alias("removed"),
        (count("_fails") - count("removed")).alias("redundant"),
        count("unique_fails").alias("unique_fails"),
        *(count(f"lost_{m}").alias(f"{m}_lost") for m in marks),
        count("shapley").alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """The interactions of the five filters over all rows of ``docs``."""
    return interactions(five_filters(docs, labels, key, text, part), list("ABCDE"), ["good", "toxic"])
