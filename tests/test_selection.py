"""Selection by counting rounds against a sorted list."""

from __future__ import annotations

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import positions, selection
from ledgerloom.operators.selection import approximate_quantiles, ntile_highest, quantiles, values_at

rng = random.Random(7)
COLUMNS = {
    "spread": ("double", [rng.choice([-1, 1]) * 10 ** rng.uniform(-200, 200) for _ in range(3000)]),
    "ties": ("double", [float(rng.choice([1, 1, 1, 2, 3])) for _ in range(3000)]),
    "one value": ("bigint", [5] * 500),
    "close decimals": ("decimal(38,18)", [Decimal("12345678901234567890") + Decimal(rng.randint(0, 50)) / 10**18 for _ in range(400)]),
    "with nulls": ("int", [rng.choice([None, rng.randint(-50, 50)]) for _ in range(900)]),
    "few": ("int", [3, 1, None, 2]),
}


@pytest.mark.parametrize("name", COLUMNS)
@pytest.mark.parametrize("few", [10_000, 20])
def test_against_a_sorted_list(spark, monkeypatch, name, few):
    monkeypatch.setattr(selection, "FEW", few)
    monkeypatch.setattr(selection, "ACCURACY", 50 if few == 20 else 10_000)
    kind, values = COLUMNS[name]
    df = spark.createDataFrame([(v,) for v in values], f"x {kind}").repartition(3)
    nulls = sum(v is None for v in values)
    in_order = [None] * nulls + sorted(v for v in values if v is not None)
    places = sorted({0, nulls, len(values) // 2, len(values) - 1, *rng.sample(range(len(values)), min(4, len(values)))})
    assert values_at(df, "x", places, nulls) == {p: in_order[p] for p in places}


@pytest.mark.parametrize("name", ["ties", "with nulls", "few"])
def test_ntiles_and_quantiles_agree_with_the_sorted_form(spark, name):
    kind, values = COLUMNS[name]
    df = spark.createDataFrame([(v,) for v in values], f"x {kind}")
    places = positions.value_positions(df, "x", keep_nulls=True)
    names = {j: f"t{j}" for j in range(1, 8)}
    assert ntile_highest(df, "x", 7, names).collect() == positions.ntile_maxima(places, "x", 7, names).collect()
    known = positions.value_positions(df, "x")
    shares = {"a": 0.0, "b": 0.25, "c": 0.61, "d": 1.0}
    expected = known.agg(*[positions.interpolated("x", s).alias(n) for n, s in shares.items()]).first()
    assert tuple(quantiles(df, "x", shares).first()) == pytest.approx(tuple(expected))


def test_empty_columns(spark):
    nothing = spark.createDataFrame([], "x double")
    assert tuple(quantiles(nothing, "x", {"q": 0.5}).first()) == (None,)
    assert tuple(ntile_highest(nothing, "x", 3, {1: "a", 3: "c"}).first()) == (None, None)
    nulls = spark.createDataFrame([(None,), (None,)], "x double")
    assert tuple(ntile_highest(nulls, "x", 3, {1: "a", 2: "b", 3: "c"}).first()) == (None, None, None)
    assert tuple(quantiles(nulls, "x", {"q": 0.5}).first()) == (None,)


def test_the_sketch_keeps_its_rank_error(spark):
    n, accuracy = 50_000, 200
    df = spark.range(n).select(((F.col("id") * 7919) % n).cast("double").alias("x")).repartition(7)
    found = approximate_quantiles(df, "x", {f"q{i}": i / 20 for i in range(1, 20)}, accuracy).first()
    assert all(abs(v - i / 20 * n) <= n / accuracy + 1 for i, v in enumerate(found, start=1))


def test_no_rows_are_shuffled(spark, monkeypatch):
    """Only single-row aggregates are exchanged until few rows are left."""
    ranges, plain = [], selection.running_total
    monkeypatch.setattr(selection, "running_total", lambda *a, **k: ranges.append(a) or plain(*a, **k))
    df = spark.range(200_000).select((F.col("id") * 7919 % 200_000).alias("x"))
    assert values_at(df, "x", [0, 99_999, 150_000]) == {0: 0, 99_999: 99_999, 150_000: 150_000}
    assert not ranges
