from __future__ import annotations

import random
import re
from itertools import permutations

import numpy as np
import pytest

from ledgerloom.llm import filter_audit
from ledgerloom.llm.filter_audit import among, audit, interactions, posting_lists, union


@pytest.mark.parametrize("seed", range(20))
def test_galloping_against_sets(seed):
    rng = random.Random(seed)
    a, b = (np.array(sorted(rng.sample(range(300), rng.choice([0, 1, 20, 250]))), np.int64) for _ in range(2))
    assert a[among(a, b)].tolist() == sorted(set(a.tolist()) & set(b.tolist()))
    assert union(a, b).tolist() == sorted({*a.tolist(), *b.tolist()})


def by_orders(rows, filters: str) -> list[tuple]:
    """``rows``: part, set of failed filters, good, toxic."""
    out, shapley = [], {}
    for part in {r[0] for r in rows}:
        for order in permutations(filters):
            left = [r for r in rows if r[0] == part]
            for step, f in enumerate(order, 1):
                here = [r for r in rows if r[0] == part]
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                fails = [r for r in here if f in r[1]]
                shapley[part, f] = shapley.get((part, f), 0) + len(gone)
                out.append([part, "".join(order), step, len(left), len(gone), len(fails) - len(gone), sum(r[1] == {f} for r in here), sum(r[2] for r in gone), sum(r[3] for r in gone)])
    return sorted((*r, shapley[r[0], r[1][r[2] - 1]]) for r in out)


@pytest.mark.parametrize(("filters", "bits"), [("XYZ", 2), ("ABCDE", 16), ("Q", 16)])
def test_any_filters(spark, monkeypatch, filters, bits):
    monkeypatch.setattr(filter_audit, "BLOCK_BITS", bits)
    rng = random.Random(4)
    rows = [(rng.choice("pq"), {f for f in filters if rng.random() < 0.4}, rng.random() < 0.5, rng.random() < 0.1) for _ in range(200)]
    flat = [(p, i * 3, *(f in s for f in filters), g, t) for i, (p, s, g, t) in enumerate(rows)]
    schema = "part string, row long, " + ", ".join(f"{f} boolean" for f in filters) + ", good boolean, toxic boolean"
    df = spark.createDataFrame(flat, schema).repartition(3)
    found = interactions(df, list(filters), ["good", "toxic"])
    assert found.columns[-3:] == ["good_lost", "toxic_lost", "shapley"]
    assert sorted(map(tuple, found.collect())) == by_orders(rows, filters)
    longest = max(len(r.ids) for r in posting_lists(df, list(filters)).collect())
    assert longest <= 1 << bits


def failed(rows) -> list[tuple]:
    least: dict[str, int] = {}
    for key, text, _ in rows:
        if key is not None:
            least[text or ""] = min(key, least.get(text or "", key))
    out = []
    for key, text, part in rows:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = {"A"} if len(words) < 100 else set()
        f |= {"B"} if 100 * len(set(words)) < 80 * len(words) else set()
        f |= {"C"} if 100 * len(re.findall("[A-Z]", t)) > 10 * len(t) else set()
        f |= {"D"} if re.search("[#$%&*|]", t) else set()
        f |= {"E"} if key is not None and key > least[t] else set()
        out.append((part or "", f))
    return out


def test_five_filters_on_messy_texts(spark, with_null_key):
    rng = random.Random(6)
    texts = [(200 + i, " ".join(rng.choices(["WORD", "word", "Wörd", "a#", "b", *map(str, range(99))], k=rng.choice([90, 130]))), "en") for i in range(60)]
    more = spark.createDataFrame([*texts, *texts[:9]], "doc_id long, text string, lang string")
    docs = with_null_key.withColumnsRenamed({"key": "row", "fp": "digest", "block": "A"}).unionByName(more, allowMissingColumns=True)
    pairs = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 260, 2)]
    labels = spark.createDataFrame([*pairs, (10, 1, 0), (10, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    good = {i for i, q, _ in [*pairs, (10, 1, 0)] if q}
    toxic = {i for i, _, t in pairs if t}
    rows = [(r.doc_id, r.text, r.lang) for r in docs.select("doc_id", "text", "lang").collect()]
    expected = [(p, f, r[0] in good, r[0] in toxic) for r, (p, f) in zip(rows, failed(rows), strict=True)]
    assert sorted(map(tuple, audit(docs, labels).collect())) == by_orders(expected, "ABCDE")


def test_empty_tables(spark, nothing):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit(nothing, labels).collect() == []
    one = spark.createDataFrame([(1, None, None)], "doc_id long, text string, lang string")
    rows = audit(one, labels).collect()
    assert len(rows) == 600 and sum(r.removed for r in rows) == 120
