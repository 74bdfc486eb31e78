from __future__ import annotations

import hashlib
import random
import resource

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import mixing


@pytest.mark.parametrize("seed", range(12))
def test_a_period_is_within_a_block_of_every_target(seed):
    rng = random.Random(seed)
    shares = [rng.randint(1, rng.choice([3, 40, 400])) for _ in range(rng.randint(1, 25))]
    period, got = sum(shares), [0] * len(shares)
    for slot, (source, block) in enumerate(mixing.one_period(shares)):
        assert block == got[source]
        assert block * period // shares[source] <= slot < -(-(block + 1) * period // shares[source])
        got[source] += 1
        for s, k in enumerate(shares):
            assert abs(got[s] - (slot + 1) * k / period) < 1
    assert got == shares


def brute(rows, targets=None, block_rows=3, period=20):
    """Without a period the unrounded weights."""
    by_source = {}
    for doc, source in rows:
        by_source.setdefault(source, []).append(doc)
    names = sorted(by_source, key=lambda s: (s is not None, s or ""))
    sizes = [len(by_source[s]) ** mixing.EXPONENT for s in names]
    weights = [(targets or {}).get(s, w / sum(sizes)) for s, w in zip(names, sizes, strict=True)]
    shares = mixing.whole_shares(weights, period or mixing.PARTS)
    if period:
        slots = {place: t for t, place in enumerate(mixing.one_period(shares))}
    else:
        placed = mixing.every_block(shares, [-(-len(by_source[s]) // block_rows) for s in names])
        slots = {(n, i): t for n, at in enumerate(placed) for i, t in enumerate(at)}

    out = []
    for n, (name, k) in enumerate(zip(names, shares, strict=True)):
        for i, doc in enumerate(sorted(by_source[name], key=lambda d: hashlib.md5(str(d).encode()).hexdigest())):
            block = i // block_rows
            q = sum(shares)
            slot = block // k * q + slots[n, block % k] if period else slots[n, block]
            out.append((doc, name, block, i % block_rows, block * q // k, -(-(block + 1) * q // k), slot))
    return sorted(out, key=str)


@pytest.mark.parametrize("targets", [None, {"s1": 3.0, None: 1.0}])
def test_schedule(messy, targets):
    rows = [(r.doc_id, r.source) for r in messy.collect()]
    found = mixing.schedule(messy, targets=targets, block_rows=3, period=20)
    assert sorted(map(tuple, found.collect()), key=str) == brute(rows, targets)


def test_schedule_runs_no_python(messy):
    plan = mixing.schedule(messy)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))


def test_running_shares_stay_within_a_block(spark):
    rows = [(i, "hot" if i % 3 else f"s{i % 7}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string")
    planned = mixing.schedule(docs, targets={"hot": 1.0, **{f"s{i}": 1.0 for i in range(7)}}, block_rows=5, period=80)
    shares = {r.source: [] for r in planned.select("source").distinct().collect()}
    for r in mixing.running_shares(planned).collect():
        shares[r.source].append((r.slot, r.got))
    for got in shares.values():
        assert all(abs(n - (slot + 1) / 8) < 1 for slot, n in got)


def test_mixed_keeps_every_row(with_null_key, nothing):
    rows = mixing.mixed(with_null_key, block_rows=3, period=20).collect()
    assert sorted(map(str, rows)) == sorted(map(str, with_null_key.collect()))
    assert all(r.doc_id is None for r in rows[-2:])
    keys = [r.doc_id for r in rows]
    assert len([k for i, k in enumerate(keys) if i == 0 or keys[i - 1] != k]) == len(set(keys))  # one key's rows stand together
    assert mixing.schedule(nothing).collect() == [] and mixing.mixed(nothing).collect() == []


@pytest.mark.parametrize("frame", [1 << 17, 7])
def test_unrounded_schedule(messy, monkeypatch, frame):
    monkeypatch.setattr(mixing, "FRAME", frame)
    rows = [(r.doc_id, r.source) for r in messy.collect()]
    found = mixing.schedule(messy, block_rows=2, targets={"s1": 0.37})
    assert sorted(map(tuple, found.collect()), key=str) == brute(rows, {"s1": 0.37}, block_rows=2, period=None)


def test_clashing_columns(spark):
    rows = [(i, f"s{i % 3}", -i, "p", "b") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, _slot long, _place string, block string")
    assert sorted(map(tuple, mixing.mixed(docs, block_rows=4).collect())) == sorted(rows)
    assert mixing.mixed(docs, block_rows=4).columns == docs.columns


def test_more_sources_than_a_frame(spark, monkeypatch):
    monkeypatch.setattr(mixing, "FRAME", 5000)
    docs = spark.range(24_000).selectExpr("id AS doc_id", "concat('s', id % 12000) AS source")
    found = mixing.schedule(docs, block_rows=1).select("slot", "source", "block").collect()
    assert len({r.slot for r in found}) == len(found) == 24_000
    assert sorted((r.source, r.block) for r in found) == sorted((f"s{i}", b) for i in range(12_000) for b in range(2))


def test_large_block_numbers(spark, monkeypatch):
    """Release times and deadlines of blocks that a product in 64 bits would not hold."""
    numbers = mixing.row_numbers

    def far(df, order_by, out, **options):
        found = numbers(df, order_by, out, **options)
        return found.withColumn(out, F.col(out) + (1 << 40)) if out == "_row" else found

    monkeypatch.setattr(mixing, "row_numbers", far)
    docs = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "doc_id long, source string")
    planned = mixing.schedule(docs, block_rows=1, period=1 << 14, targets={"a": 3.0, "b": 1.0}).collect()
    for r in planned:
        k, q = (12288, 16384) if r.source == "a" else (4096, 16384)
        assert (r.release, r.deadline) == (r.block * q // k, -(-(r.block + 1) * q // k)) and r.block >= 1 << 40


def test_the_driver_holds_one_frame_of_ten_million_blocks():
    weights = [float(n) ** mixing.EXPONENT for n in (600_000_000, 30_000_000, 9_000_000, 1_000_000)]
    blocks = [9_375_000, 468_750, 140_625, 15_625]
    before, n = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, 0
    for frame in mixing.frames(mixing.whole_shares(weights, mixing.PARTS), blocks):
        n += sum(len(r["at"]) for r in frame)
    assert n == sum(blocks) == 10_000_000
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 150 << 10  # KB


def one_block_bound(slots, weights):
    """Every block starts less than a block from where the unrounded weights have its source."""
    total = sum(weights)
    for at, w in zip(slots, weights, strict=True):
        assert all(abs(i - t * w / total) < 1.001 and abs(i + 1 - (t + 1) * w / total) < 1.001 for i, t in enumerate(at))
    used = [t for at in slots for t in at]
    assert len(used) == len(set(used))


@pytest.mark.parametrize("rows", [[1_000_000, *[1000] * 2000], [500_000, *[100] * 9999], [93_091, *[8600 + i for i in range(19)]], [6_000_000, 7, 64, 65]])
def test_every_block_is_within_a_block_of_the_unrounded_weights(rows):
    weights, blocks = [n**mixing.EXPONENT for n in rows], [-(-n // mixing.BLOCK_ROWS) for n in rows]
    slots = mixing.every_block(mixing.whole_shares(weights, mixing.PARTS), blocks)
    assert [len(at) for at in slots] == blocks
    one_block_bound(slots, weights)


def test_schedule_keeps_small_weights_and_long_tables(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"s{i % 1500}") for i in range(18_000)]
    targets = {"hot": 0.8, "s1": 0.0001, "s2": 0.0004, "s4": 0.0003}
    docs = spark.createDataFrame(rows, "doc_id long, source string")
    planned = mixing.schedule(docs, targets=targets, block_rows=1).select("source", "block", "slot", "release", "deadline").collect()
    assert len(planned) == len(rows)
    counts = {}
    for r in planned:
        counts[r.source] = counts.get(r.source, 0) + 1
    sizes = sum(n**mixing.EXPONENT for n in counts.values())
    names = sorted(counts)
    weights = [targets.get(s, counts[s] ** mixing.EXPONENT / sizes) for s in names]
    slots = {s: [] for s in names}
    for r in sorted(planned, key=lambda r: r.block):
        assert r.release <= r.slot < r.deadline
        slots[r.source].append(r.slot)
    one_block_bound([slots[s] for s in names], weights)
