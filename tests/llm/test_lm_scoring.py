from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import lm_scoring as lm


def tokens(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower), None]


def brute(rows):
    """Scores of (key, text) rows, by counting and by EM over single tokens."""
    split = [("" if k is None else str(k), tokens(t)) for k, t in rows]
    role = [zlib.crc32(k.encode()) % 7 for k, _ in split]
    word, pair, dev_word, dev_pair = Counter(), Counter(), Counter(), Counter()
    for r, (_, t) in zip(role, split, strict=True):
        pairs = list(zip([None, *t[:-1]], t, strict=True))
        if r != 2:
            word.update(t)
            pair.update(pairs)
        if r == 3:
            dev_word.update(t)
            dev_pair.update(pairs)
    n, v = sum(word.values()), len(word)
    rest = max(n - sum(dev_word.values()), 1)
    rest_types = sum(word[w] > dev_word[w] for w in word)
    held = []
    for (a, b), times in dev_pair.items():
        c = word[a] - dev_word[a]
        held.append((c.bit_length(), (pair[a, b] - dev_pair[a, b]) / c if c else 0, (word[b] - dev_word[b]) / rest, 1 / (rest_types + 1), times))
    weights = {b: [1 / 3] * 3 for b in range(lm.BUCKETS)}
    for _ in range(lm.ROUNDS):
        sums = {b: [1e-3] * 3 for b, *_ in held}
        for b, *p, times in held:
            q = [x * y for x, y in zip(weights[b], p, strict=True)]
            for j in range(3):
                sums[b][j] += times * q[j] / sum(q)
        new = weights | {b: [x / sum(s) for x in s] for b, s in sums.items()}
        change = max(abs(x - y) for b in new for x, y in zip(new[b], weights[b], strict=True))
        weights = new
        if change < lm.SETTLED:
            break
    out = []
    for r, (key, _), (_, t) in zip(role, rows, split, strict=True):
        base = sum(math.log10((word[w] + 1) / (n + v + 1)) for w in t)
        total = 0.0
        for a, b in zip([None, *t[:-1]], t, strict=True):
            x = weights[word[a].bit_length()]
            total += math.log10(x[0] * pair[a, b] / max(word[a], 1) + x[1] * word[b] / max(n, 1) + x[2] / (v + 1))
        out.append((key, r == 2, len(t), sum(word[w] > 0 for w in t), n, base, total))
    return out


def by_key(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[2], r[5]))


def test_scores(with_null_key, monkeypatch):
    monkeypatch.setattr(lm, "KEY_BYTES", 2_000)  # many key groups
    found = lm.score_texts(with_null_key).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()
    expected = by_key(brute([(r.doc_id, r.text) for r in with_null_key.collect()]))
    for got, want in zip(by_key(map(tuple, found)), expected, strict=True):
        assert got[:5] == want[:5]
        assert got[5:] == pytest.approx(want[5:], rel=1e-9)
    assert any(w[1] for w in expected) and not all(w[1] for w in expected)


def test_context_helps_on_held_out_texts(spark):
    docs = spark.createDataFrame([(i, "to be or not to be that is the question " * (i % 5 + 1)) for i in range(80)], "doc_id long, text string")
    sums = lm.score_texts(docs).where("held_out").agg(F.sum("score").alias("model"), F.sum("base_score").alias("base")).first()
    assert sums.model > 0.5 * sums.base


def test_nothing_learned(spark, nothing):
    key = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 7 == 2)
    found = lm.score_texts(spark.createDataFrame([(key, "a b")], "doc_id long, text string")).first()
    assert (found.held_out, found.n_tokens, found.n_known, found.train_tokens, found.base_score) == (True, 3, 0, 0, 0.0)
    assert math.isfinite(found.score)
    assert lm.score_texts(nothing).collect() == []


def test_byte_planes_round_trip():
    import numpy as np

    values = np.array([0, 5, 1 << 40, 7], np.uint64)
    assert lm._unzip(lm._zip(values), np.uint64).tolist() == values.tolist()
    assert lm._unzip(lm._zip(values[:0]), np.uint64).tolist() == []


def test_a_bucket_that_is_not_met_takes_the_nearest_weights(spark):
    """The most frequent context moves up a power of two with the counts of the part the weights are learned on."""
    kind = {r: [k for k in range(2000) if zlib.crc32(str(k).encode()) % 7 == r] for r in range(7)}
    keys = [*kind[0][:60], *kind[3][:8], kind[2][0]]  # 60 ends elsewhere, 68 with the dev part: buckets 6 and 7
    docs = spark.createDataFrame([(k, "a b c") for k in keys], "doc_id long, text string")
    rest = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7
    model = lm.learn(docs, rest == 2, rest == 3, nearest=True)
    assert model.weights[7].tolist() == model.weights[6].tolist() != [1 / 3] * 3
    assert model.weights[0].tolist() == [1 / 3] * 3
    held = lm.score_texts(docs, nearest=True).where("held_out").first()
    assert held.score > -0.1  # every word follows from the one before
