"""The similarity join with a falling threshold against comparing all pairs, and how many pairs it joins."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import matching, set_matching
from ledgerloom.operators.set_matching import clear_winners

NEEDLES = "g string, tokens array<string>"
SETS = NEEDLES + ", copies int, item int"


def all_pairs(needles, sets):
    out = {}
    for g, words in needles:
        w = set(words)
        scores = sorted(((len(w & set(t)) / len(w | set(t)) if w and t else 0.0, c, i) for h, t, c, i in sets if h == g), reverse=True)
        second = scores[1][0] if len(scores) > 1 else 0.0
        if scores and scores[0][0] >= 0.45 and scores[0][0] - second >= 0.15 and scores[0][1] == 1:
            out[g, tuple(words)] = (scores[0][2], scores[0][0])
    return out


def distinct(rows):
    return list({(g, *words): (g, sorted(words)) for g, words in rows}.values())


def found_by(spark, needles, sets):
    left, right = spark.createDataFrame(needles, NEEDLES).repartition(3), spark.createDataFrame(sets, SETS).repartition(3)
    return {(r.g, tuple(r.tokens)): (r.item, r.score) for r in clear_winners(left, right, ["g"]).collect()}


@pytest.mark.parametrize(("seed", "vocabulary", "longest"), [(1, 9, 5), (2, 14, 9), (3, 60, 7), (4, 25, 14)])
def test_against_comparing_all_pairs(spark, seed, vocabulary, longest):
    rng = random.Random(seed)
    words = [f"w{n}" for n in range(vocabulary)]

    def draw(n):
        return [(rng.choice("ab"), rng.sample(words, rng.randint(0, min(longest, vocabulary)))) for _ in range(n)]

    sets = [(g, w, rng.choice([1, 1, 1, 2]), n) for n, (g, w) in enumerate(distinct(draw(90)))]
    # Needles near the sets, so that all scores between 0.3 and 1 occur.
    near = [(g, [w for w in t if rng.random() < 0.8] + rng.sample(words, rng.randint(0, 2))) for g, t, *_ in sets]
    needles = distinct([(g, sorted(set(w))) for g, w in near] + draw(40) + [("a", ["unheard"]), ("c", ["w1"])])
    expected = all_pairs(needles, sets)
    assert found_by(spark, needles, sets) == expected and expected


def joined_rows(monkeypatch):
    """Counts of the pairs that each round joins."""
    counts, plain = [], set_matching.candidates

    def counted(*args):
        pairs = plain(*args)
        counts.append(pairs.count())
        return pairs

    monkeypatch.setattr(set_matching, "candidates", counted)
    return counts


SHARED = ["cotton", "mens", "printed", "shirt"]


@pytest.mark.parametrize("case", ["own words", "one word too many", "words of other titles"])
def test_titles_that_share_four_words_do_not_all_meet(spark, monkeypatch, case):
    counts, n = joined_rows(monkeypatch), 2000
    sets = [("g", sorted([*SHARED, f"u{i}", f"v{i}"]), 1, i) for i in range(n)]
    if case == "own words":
        needles, winners = [(g, t) for g, t, *_ in sets], n
    elif case == "one word too many":
        needles, winners = [("g", sorted([*SHARED, f"u{i}", f"x{i}"])) for i in range(n)], n
    else:  # every title overlaps alike with every needle, in words that all are asked for
        sets += [("g", [f"p{i}", f"q{i}", f"r{i}"], 1, n + i) for i in range(n)]
        needles, winners = [("g", sorted([*SHARED, f"p{i}", f"q{(i + 1) % n}"])) for i in range(n)], 0
    found = found_by(spark, needles, sets)
    assert len(found) == winners and all(f"u{item}" in words for (_, words), (item, _) in found.items())
    assert sum(counts) <= 20 * n


def test_large_orders_follow_the_same_rules(spark, monkeypatch):
    rng = random.Random(8)
    words = ["amber", "brass", "candle", "dish", "easel", "frame", "globe"]
    items = [("P", o, n, " ".join(rng.sample(words, rng.randint(1, 4))), rng.choice([None, "", "K1", "k2", f"m{n}"])) for o in "abc" for n in range(rng.randint(2, 9))]
    asked = [(n, "P", rng.choice("abcd"), rng.choice([None, "k1", "M3"]), " ".join(rng.sample(words, 3)), "", "keep") for n in range(120)]
    item_df = spark.createDataFrame(items, "platform string, order_id string, item_index int, title string, product_id string")
    task_df = spark.createDataFrame(asked, "row_no long, platform string, order_id string, sku string, product_name string, _sku string, _key string")
    task_df = task_df.withColumn("product_link", F.lit(""))
    small = sorted(map(str, matching.match_line_items(task_df, item_df).collect()))
    monkeypatch.setattr(matching, "FEW", 1)
    large = matching.match_line_items(task_df, item_df)
    assert sorted(map(str, large.collect())) == small
    assert {r["_key"] for r in large.collect()} == {"keep"} and "_sku" in large.columns
