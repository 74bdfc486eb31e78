"""Joins to a table that holds one row per key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CROWD = 10_000  # rows of one key that a task may read on the left of a join that cannot be split
MARK_BITS = 27  # key marks are 2 ** 27 bits, 16 MB, however many keys there are
SLOT_WORDS = 64  # in rows of 64 numbers of 64 bits
PLAIN = {"string", "tinyint", "smallint", "int", "bigint", "date", "boolean"}  # types whose equal values have equal hashes


def unused(name: str, *frames: DataFrame) -> str:
    """A column name like ``name`` that none of the frames has."""
    taken = {c.lower() for frame in frames for c in frame.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def lookup(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join to ``right``, which has at most one row per key; null keys match nothing.

    The left side may have a key that holds a third of its rows.  Adaptive execution
    splits such a partition, but only when both join inputs come straight from a
    shuffle.  A right side that was just grouped by the same keys would be joined
    without one, so the join is on one composite key, for which the - already
    reduced - right side is shuffled again.
    """
    extra = [c for c in right.columns if c not in keys]
    key = unused("_key", left, right)
    known = right.dropna(subset=keys).select(F.struct(*keys).alias(key), *extra)
    return left.withColumn(key, F.struct(*keys)).join(known, key, how).drop(key)


def matching(left: DataFrame, right: DataFrame, keys: list[str], keep: bool = True) -> DataFrame:
    """The rows of ``left`` that have (or, with ``keep=False``, have not) a key in ``right``."""
    known = right.select(*keys).dropna().distinct()
    return lookup(left, known, keys, "left_semi" if keep else "left_anti")


def lookup_rows(left: DataFrame, right: DataFrame, keys: list[str], row: Column, out: str, made: Callable[[Column], Column]) -> DataFrame:
    """Add ``out``, what ``made`` makes of the list of a key's rows of ``right``, which must be few; null without any.

    The lists are joined where they were gathered, so ``right`` is shuffled once and what is made of it not at all.  If
    a key has more than ``CROWD`` rows on the left they are shuffled again, as in ``lookup``, so that its rows can be split.
    """
    left_sizes = left.select(*keys).dropna().groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    if not left_sizes.where(F.col("_n") > CROWD).isEmpty():
        return lookup(left, right.groupBy(*keys).agg(F.collect_list(row).alias(out)).withColumn(out, made(F.col(out))), keys)
    key = unused("_key", left, right)
    lists = right.dropna(subset=keys).groupBy(F.struct(*keys).alias(key)).agg(F.collect_list(row).alias(out))
    return left.withColumn(key, F.struct(*keys)).join(lists.withColumn(out, made(F.col(out))), key, "left").drop(key)


def _mark(keys: list[str]) -> tuple[Column, Column, Column]:
    """The slot of a key's mark, the number in the slot and the bit in the number."""
    mark = F.pmod(F.xxhash64(*keys), F.lit(1 << MARK_BITS))
    in_slot = mark % (SLOT_WORDS * 64)
    return F.floor(mark / (SLOT_WORDS * 64)), F.floor(in_slot / 64).cast("int"), (in_slot % 64).cast("int")


def key_marks(df: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` of ``df`` as a table of bits for ``may_match``: small enough to be broadcast whatever the number of keys."""
    slot, word, bit = _mark(keys)
    marked = df.select(*keys).dropna().select(slot.alias("slot"), word.alias("word"), bit.alias("bit"))
    words = marked.groupBy("slot", "word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits"))
    slots = words.groupBy("slot").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("bits"))
    every = F.sequence(F.lit(0), F.lit(SLOT_WORDS - 1))
    return slots.select("slot", F.transform(every, lambda w: F.coalesce(F.try_element_at("bits", w), F.lit(0).cast("bigint"))).alias("bits"))


def may_match(df: DataFrame, asked: DataFrame, marks: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``df`` that have a key of ``asked``, and some more, found without a shuffle of ``df``.

    ``marks`` are the ``key_marks`` of ``asked``.  A key is let through whose mark is another's too, so a join must follow.
    """
    here, there = ([f.dataType.simpleString() for f in side.select(*keys).schema] for side in (df, asked))
    if here != there or not PLAIN.issuperset(here):
        return df
    slot, bits = (unused(c, df) for c in ("_slot", "_bits"))
    known = F.broadcast(marks.select(F.col("slot").alias(slot), F.col("bits").alias(bits)))
    of_key, word, bit = _mark(keys)
    probed = df.dropna(subset=keys).withColumn(slot, of_key).join(known, slot)
    return probed.where(F.getbit(F.get(bits, word), bit) == 1).drop(slot, bits)
