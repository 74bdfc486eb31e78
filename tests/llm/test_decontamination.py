from __future__ import annotations

import random
import re

import pytest

from ledgerloom.llm import decontamination as dc

from .conftest import prose, texts_of


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(texts, items, k=13):
    out = {}
    for doc, text in texts.items():
        w, hit, ids = alnum(text), set(), set()
        for item, item_text in items:
            t = alnum(item_text)
            size = min(k, len(t))
            windows = {tuple(t[i : i + size]) for i in range(len(t) - size + 1)} if t else set()
            for i in range(len(w) - size + 1) if t else ():
                if tuple(w[i : i + size]) in windows:
                    hit.update(range(i, i + size))
                    ids.add("" if item is None else str(item))
        out[doc] = (len(w), len(hit), sorted(ids), len(hit) > 0 and 20 * len(hit) >= len(w))
    return out


@pytest.fixture(scope="module")
def items():
    rng = random.Random(12)
    rows = [(i, prose(rng, rng.randint(14, 60))) for i in range(12)] + [(20, "Short item"), (21, None), (22, "..."), (None, prose(rng, 20)), (3, "single")]
    return [*rows, (0, rows[0][1])]


@pytest.fixture(scope="module")
def texts(messy, items):
    rng = random.Random(13)
    out = texts_of(messy)
    for i, (_, t) in enumerate(items[:12]):
        w = re.split(r"\s+", t)
        out[200 + i] = prose(rng, 5 * i) + " " + re.sub("[a-z]", lambda m: m[0].upper(), " ".join(w[: rng.randint(10, len(w))])) + " - " + prose(rng, 200 * (i % 3))
    out[300] = "a short, ITEM and a single one " + items[15][1]
    out[301] = " ".join(["short item"] * 400)
    out[302] = prose(rng, 700) + " " + items[4][1]
    return out


@pytest.mark.parametrize("slice_bytes", [dc.SLICE_BYTES, 400])
def test_hits(spark, monkeypatch, texts, items, slice_bytes):
    monkeypatch.setattr(dc.benchmark_slices, "__defaults__", ("item_id", "text", slice_bytes))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = {r.doc_id: (r.n_words, r.n_hit, list(r.item_ids), r.contaminated) for r in dc.contamination(docs, benchmark).collect()}
    expected = brute(texts, items)
    assert found == expected
    assert sum(e[3] for e in expected.values()) > 8
    clean = dc.decontaminate(docs.selectExpr("doc_id", "text", "doc_id AS _words"), benchmark)
    assert clean.columns == ["doc_id", "text", "_words"]
    assert {r.doc_id for r in clean.collect()} == {d for d, e in expected.items() if not e[3]}


def test_rows_without_a_key_and_repeated_rows(spark, with_null_key, items):
    benchmark = spark.createDataFrame([*items, (77, "same " * 13)], "item_id long, text string")
    rows = [(r.doc_id, r.text) for r in with_null_key.collect()]
    by_text = brute({t: t or "" for _, t in rows}, [*items, (77, "same " * 13)])
    found = sorted(str((r.doc_id, r.n_words, r.n_hit, list(r.item_ids), r.contaminated)) for r in dc.contamination(with_null_key, benchmark).collect())
    assert found == sorted(str((k, *by_text[t])) for k, t in rows)
    kept = sorted(str((r.doc_id, r.text)) for r in dc.decontaminate(with_null_key, benchmark).select("doc_id", "text").collect())
    assert kept == sorted(str((k, t)) for k, t in rows if not by_text[t][3]) and len(kept) < len(rows)


def test_equal_items_are_searched_as_one():
    words = dc.Words(dc.pa.array(["the cat and the dog and the end " * 500]), dc.NOT_ALPHANUMERIC, dc.LOWER)
    one, many = (dc.Benchmark.of([(f"i{i}", "the") for i in range(n)]) for n in (1, 300))
    assert len(dc.find_windows(words, many)[0]) == len(dc.find_windows(words, one)[0]) == 1500
    assert len(many.distinct) == 1 and len(many.owners) == 300


@pytest.mark.parametrize("seed", range(8))
def test_window_groups_against_tuples(seed):
    rng = random.Random(seed)
    hashes = dc.np.array([rng.randint(0, 2) for _ in range(120)], dc.np.uint64)
    length = dc.np.array([rng.choice([1, 2, 3, 5, 8, 13]) for _ in range(60)])
    at = dc.np.array([rng.randint(0, 120 - n) for n in length])
    group, firsts = dc.window_groups(hashes, at, length)
    said = [tuple(hashes[a : a + n].tolist()) for a, n in zip(at, length, strict=True)]
    assert len(firsts) == len(set(said)) and len({(g, w) for g, w in zip(group.tolist(), said, strict=True)}) == len(set(said))
    assert [said[f] for f in firsts[group]] == said


def test_longest_matches_and_places(spark, items):
    long_item = items[4][1]
    words = alnum(long_item)
    docs = spark.createDataFrame([(1, "x y " + " ".join(words) + " z"), (2, " ".join(words[3:20]) + " q " + " ".join(words[:14]))], "doc_id long, text string")
    benchmark = spark.createDataFrame([(4, long_item)], "item_id long, text string")
    found = sorted((r.doc_id, r.word_at, r.item_id, r.item_word_at, r.n_words) for r in dc.matches(docs, benchmark).collect())
    assert found == [(1, 2, "4", 0, len(words)), (2, 0, "4", 3, 17), (2, 18, "4", 0, 14)]


def test_nothing(spark, messy, nothing):
    benchmark = spark.createDataFrame([(1, "short item")], "item_id long, text string")
    empty = benchmark.limit(0)
    assert dc.contamination(nothing, benchmark).collect() == []
    assert not any(r.contaminated or r.n_hit for r in dc.contamination(messy, empty).collect())
    assert dc.decontaminate(messy, empty).count() == messy.count()
