from __future__ import annotations

import hashlib
import random
import re

import pytest
import zstandard
from pyspark.sql import functions as F

from ledgerloom.llm import substrings


def brute(rows, k=20):
    """(key, n_words, n_removed, sha) of (key, text) rows with distinct keys."""
    words = {key: re.findall(r"[^\x20\x09-\x0D]+", text or "") for key, text in rows}
    seen, gone = set(), {}
    for key in sorted(words, key=lambda x: (x is not None, x or 0)):
        w, gone[key] = words[key], set()
        for i in range(len(w) - k + 1):
            window = tuple(w[i : i + k])
            if window in seen:
                gone[key].update(range(i, i + k))
            seen.add(window)
    out = []
    for key, w in words.items():
        kept = " ".join(x for i, x in enumerate(w) if i not in gone[key])
        out.append((key, len(w), len(gone[key]), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def cut(docs, **options):
    return sorted(map(tuple, substrings.remove_repeats(docs, **options).drop("kept").collect()), key=str)


def test_removed_words(messy):
    found = cut(messy)
    assert found == brute([(r.doc_id, r.text) for r in messy.collect()])
    assert sum(r[2] > 0 for r in found) > 10


@pytest.mark.parametrize("bound", [64 << 20, 300])
def test_few_words_many_repeats(spark, monkeypatch, bound):
    """Small vocabularies, so that windows overlap and minimisers recur; with the small bound buckets overflow."""
    monkeypatch.setattr(substrings, "BUCKET_BYTES", bound)
    monkeypatch.setattr(substrings, "PIECE", 500)
    rng = random.Random(9)
    parts = [" ".join(rng.choices("ab", k=rng.randint(3, 30))) for _ in range(6)]
    rows = [(i, " ".join(rng.choices([*parts, "ab", "b a", "é"], k=rng.randint(0, 9)))) for i in range(60)] + [(None, parts[0] + " " + parts[1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for k in (5, 20):
        expected = brute(rows, k)
        assert cut(docs, window=k) == expected
        assert any(r[2] for r in expected)


def test_a_frequent_minimiser_is_spread(spark, monkeypatch):
    """One three-word sequence has the least hash of all, in a third of the texts and in contexts of its own each time."""
    monkeypatch.setattr(substrings, "BUCKET_BYTES", 4000)
    monkeypatch.setattr(substrings, "AIM_BYTES", 1000)
    rng = random.Random(4)
    passage = [f"p{i}" for i in range(24)]
    rows = [(i, " ".join([*(f"w{rng.randrange(10**9)}" for _ in range(12)), *(passage[2:8] if i % 3 else passage), *(f"w{rng.randrange(10**9)}" for _ in range(12))])) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(12)
    dealt = substrings._dealt(docs.selectExpr("doc_id AS key", "0L AS tie", "text"), 20, 3, 64).repartition(16, "bucket", "apart")
    dealt = dealt.withColumn("task", F.spark_partition_id())
    hot = dealt.where("apart IS NOT NULL").groupBy("bucket").agg(F.count_distinct("task").alias("tasks"), F.count(F.lit(1)).alias("n"))
    assert any(r.tasks > 3 for r in hot.collect())
    whole = dealt.where("apart IS NULL AND packed IS NOT NULL").groupBy("bucket").agg(F.count_distinct("task").alias("tasks"))
    assert all(r.tasks == 1 for r in whole.collect())
    assert cut(docs) == brute(rows)


def test_bytes_are_counted_as_they_are_packed(messy):
    docs = messy.selectExpr("doc_id AS key", "0L AS tie", "text").coalesce(1)
    packed = docs.mapInArrow(lambda b: substrings._packed(b, 20, 3, 16), substrings.PACKED).where("packed IS NOT NULL").collect()
    sent = {}
    for r in packed:
        sent[r.bucket] = sent.get(r.bucket, 0) + len(zstandard.decompress(r.packed)) + 1
    counted = {}
    for r in docs.select("text").mapInArrow(lambda b: substrings._bucket_bytes(b, 20, 3, 16), "bucket long, bytes long").collect():
        counted[r.bucket] = counted.get(r.bucket, 0) + r.bytes
    assert counted.keys() == sent.keys() and all(0.9 * sent[b] <= counted[b] <= 1.2 * sent[b] for b in sent)


def test_repeated_rows_are_one_document(spark):
    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, text), (1, text), (2, text)], "doc_id long, text string")
    assert [r[:3] for r in cut(docs)] == [(1, 30, 0), (1, 30, 0), (2, 30, 30)]


@pytest.mark.parametrize("key", [None, 7])
@pytest.mark.parametrize("bound", [16 << 20, 300])
def test_texts_that_share_a_key_keep_their_own_words(spark, monkeypatch, key, bound):
    monkeypatch.setattr(substrings, "BUCKET_BYTES", bound)
    passage = " ".join(f"w{i}" for i in range(25))
    clean = [" ".join(f"{c}{i}" for i in range(60)) for c in "abcdef"]
    texts = [clean[0] + " " + passage, passage + " " + clean[1], *clean[2:], clean[2]]
    docs = spark.createDataFrame([(key, t) for t in texts] + [(9, "x " + passage)], "doc_id long, text string").repartition(3)
    kept = sorted(r.kept for r in substrings.remove_repeats(docs).collect())
    whole = [*clean[2:], clean[2], "x"]
    assert kept in (sorted([*whole, texts[0], clean[1]]), sorted([*whole, clean[0], texts[1]]))


def test_kept_text(spark):
    passage = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(1, f"a\n{passage}  b"), (2, f"c {passage} d")], "doc_id long, text string")
    assert {r.doc_id: r.kept for r in substrings.remove_repeats(docs).collect()} == {1: f"a {passage} b", 2: "c d"}


def test_nothing(nothing):
    assert cut(nothing) == []
