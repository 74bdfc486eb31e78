"""Order statistics without sorting: distributed selection by counting over narrowing ranges.

A wanted place in the sorted order lies between two values that a mergeable quantile sketch (Greenwald-Khanna,
``percentile_approx``) names from partial sketches of every task.  One pass counts how many values lie below and
between them, which tells exactly where in that range the place is; a range that missed it is widened.  Rounds go on
with the values inside until few rows are left.  Rows are never shuffled: tasks send sketches and counts, and
in the end at most ``FEW`` distinct values with their numbers.

Nulls may take part as the lowest values, as NTILE over all rows has them.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.positions import running_total

ACCURACY = 10_000  # a sketch is off by a share of 1 / ACCURACY of its values at most
FEW = 10_000  # rows that are told to the driver, as values with counts
MAX_ROUNDS = 12


class _Range(NamedTuple):
    """Values from ``low`` to ``high`` (None: no bound), of which there are ``inside``, ``below`` others before them."""

    low: object
    high: object
    below: int
    inside: int


def _within(value: Column, r: _Range) -> Column:
    inside = value.isNotNull()
    inside = inside if r.low is None else inside & (value >= F.lit(r.low))
    return inside if r.high is None else inside & (value <= F.lit(r.high))


def _narrowed(df: DataFrame, value: Column, ranges: dict[int, _Range], margin: float) -> dict[int, _Range]:
    """Each place's range made narrower by a sketch of it; one that the place turns out not to be in stays as it was."""
    kind = df.select(value.alias("v")).schema["v"].dataType
    asked = []
    for place, r in ranges.items():
        share = (place - r.below + 0.5) / r.inside
        near = [max(0.0, share - margin), min(1.0, share + margin)]
        asked.append(F.percentile_approx(F.when(_within(value, r), value), near, ACCURACY).alias(f"p{place}"))
    ends = {p: (e[0], e[1]) for p, e in zip(ranges, df.agg(*asked).first(), strict=True)}
    counts = []
    for place, (low, high) in ends.items():
        low_at, high_at = F.lit(low).cast(kind), F.lit(high).cast(kind)
        counts += [F.count_if(value < low_at).alias(f"b{place}"), F.count_if(value <= high_at).alias(f"u{place}")]
    counted = df.agg(*counts).first()
    out = {}
    for place, r in ranges.items():
        below, upto = counted[f"b{place}"], counted[f"u{place}"]
        out[place] = _Range(*ends[place], below, upto - below) if below <= place < upto and upto - below < r.inside else r
    return out


def _value_at(df: DataFrame, value: Column, place: int, r: _Range) -> object:
    """The value at the place, its range being small or all that sketches can tell apart."""
    counts = df.where(_within(value, r)).groupBy(value.alias("v")).agg(F.count(F.lit(1)).alias("n"))
    if r.inside > FEW:
        counts = running_total(counts, [F.col("v")], F.col("n"), before="before", total="total")
        here = (F.col("before") <= place - r.below) & (F.col("before") + F.col("n") > place - r.below)
        return counts.where(here).first().v
    before = r.below
    for row in sorted(counts.collect(), key=lambda row: (row.v != row.v, row.v)):
        before += row.n
        if place < before:
            return row.v
    raise RuntimeError("the values changed between two passes")


def values_at(df: DataFrame, value: str, places: list[int], nulls: int = 0) -> dict[int, object]:
    """The values at the given places, from 0, of the column in ascending order; the first ``nulls`` places are null.

    The column's type is kept.  Places must lie within the rows.
    """
    column, wanted = F.col(value), sorted({p - nulls for p in places if p >= nulls})
    found: dict[int, object] = {p: None for p in places if p < nulls}
    if not wanted:
        return found
    known = df.select(column.alias("v")).where("v IS NOT NULL")
    v, n = F.col("v"), df.agg(F.count(column)).first()[0]
    ranges = {p: _Range(None, None, 0, n) for p in wanted}
    done: dict[int, _Range] = {}
    for turn in range(MAX_ROUNDS):
        done |= {p: r for p, r in ranges.items() if r.inside <= FEW or (r.low is not None and r.low == r.high)}
        ranges = {p: r for p, r in ranges.items() if p not in done}
        if not ranges:
            break
        ranges = _narrowed(known, v, ranges, margin=2.0 / ACCURACY * (1 + turn % 4))
    for place, r in (done | ranges).items():
        found[place + nulls] = r.low if r.low is not None and r.low == r.high else _value_at(known, v, place, r)
    return found


def quantiles(df: DataFrame, value: str, shares: dict[str, float]) -> DataFrame:
    """Quantiles with linear interpolation, one row of doubles; null for a column without values."""
    n = df.agg(F.count(value)).first()[0]
    at = {name: (n - 1) * share for name, share in shares.items()}
    places = {p for place in at.values() for p in (int(place), min(int(place) + 1, n - 1))} if n else set()
    values = {p: float(v) for p, v in values_at(df, value, sorted(places)).items()} if places else {}

    def between(place: float) -> float:
        low = int(place)
        high = low if place == low else low + 1
        return values[low] + (values[high] - values[low]) * (place - low)

    row = [between(p) if n else None for p in at.values()]
    return df.sparkSession.createDataFrame([tuple(row)], ", ".join(f"`{name}` double" for name in at))


def ntile_highest(df: DataFrame, value: str, buckets: int, names: dict[int, str]) -> DataFrame:
    """The highest value of the named NTILE buckets of all rows, nulls first, as one row in the column's type.

    Bucket j ends at row ``j * (n div k) + min(j, n mod k)``; a bucket without rows gives null.
    """
    n, known = df.agg(F.count(F.lit(1)), F.count(value)).first()
    ends = {name: j * (n // buckets) + min(j, n % buckets) - 1 for j, name in names.items() if n // buckets > 0 or j <= n % buckets}
    values = values_at(df, value, sorted(set(ends.values())), nulls=n - known) if ends else {}
    kind = df.schema[value].dataType.simpleString()
    row = tuple(values[ends[name]] if name in ends else None for name in names.values())
    return df.sparkSession.createDataFrame([row], ", ".join(f"`{name}` {kind}" for name in names.values()))


def approximate_quantiles(df: DataFrame, value: str, shares: dict[str, float], accuracy: int = ACCURACY) -> DataFrame:
    """Quantiles by the sketch alone, in one pass: values of the column, each off its rank by ``n / accuracy`` at most."""
    found = F.percentile_approx(value, list(shares.values()), accuracy)
    return df.agg(found.alias("_q")).select(*[F.get("_q", F.lit(i)).cast("double").alias(name) for i, name in enumerate(shares)])
