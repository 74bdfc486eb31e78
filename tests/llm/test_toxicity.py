from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import toxicity

from .conftest import prose


@pytest.fixture(scope="module")
def corpus():
    rng, rows = random.Random(6), []
    for i in range(900):
        text = prose(rng, rng.randint(5, 80))
        toxic = i % 5 == 0
        if toxic:
            words = text.split()
            for _ in range(3):
                words.insert(rng.randint(0, len(words)), rng.choice(["vilewort", "grimling", "vilish"]))
            text = " ".join(words)
        rows.append((i, text, int(i % 2), int(toxic)))
    return rows


@pytest.fixture(scope="module")
def frames(spark, corpus):
    docs = spark.createDataFrame([(i, t, None) for i, t, _, _ in corpus], "doc_id long, text string, quality string")
    labels = spark.createDataFrame([(i, q, t) for i, _, q, t in corpus if i % 3] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_held_out_texts(corpus, frames):
    docs, labels = frames
    chain = toxicity.train(docs, labels)
    found = {r.doc_id: r for r in toxicity.score(docs, chain).collect()}
    held_out = [(i, t) for i, _, _, t in corpus if i % 3 == 0]
    assert sum(found[i].rejected == bool(t) for i, t in held_out) >= 0.98 * len(held_out)
    kept = toxicity.without_toxic(docs, chain)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in found.items() if not r.rejected}


def test_later_models_read_the_earlier_probabilities(corpus, frames):
    chain = toxicity.train(*frames)
    assert chain.categories == list(toxicity.CATEGORIES)
    assert [len(w) for w in chain.weights] == [1 + len(chain.features) + i for i in range(3)]
    assert np.abs(chain.weights[2][1 + len(chain.features) :]).min() > 0


def test_out_of_fold_probabilities_come_from_other_rows():
    """A feature that marks single rows: a model that has seen them is sure, one that has not knows nothing."""
    n = 60
    y = np.arange(n) % 2
    rows = [[i] for i in range(n)]
    chain = toxicity.fit_chain(["a", "b"], np.arange(n, dtype=np.uint64), rows, np.stack([y, y], axis=1), np.arange(n) // 2 % 3)
    assert abs(chain.weights[1][1 + n]) < 1  # the first category's probability told nothing out of fold


def test_fit_finds_the_minimum():
    rng = np.random.default_rng(3)
    features = [list(np.flatnonzero(rng.random(6) < 0.4)) for _ in range(300)]
    y = np.array([float(0 in f or (1 in f and rng.random() < 0.5)) for f in features])
    rows = toxicity.Rows(features, 6)
    w = toxicity.fit(rows, y, np.ones(300, bool), penalty=0.01)
    p = toxicity.sigmoid(rows.scores(w))
    slope = rows.gradient(p - y) / 300
    slope[1:] += 0.01 * w[1:]
    assert np.abs(slope).max() < 1e-4


def test_defined_cases(spark, messy, with_null_key, nothing, frames):
    labels = frames[1]
    none = toxicity.train(messy, labels.limit(0))
    assert not any(r.rejected for r in toxicity.score(with_null_key, none).collect())
    assert toxicity.without_toxic(with_null_key, none).count() == with_null_key.count()
    assert toxicity.score(nothing, toxicity.train(nothing, labels)).collect() == []
    one_class = labels.selectExpr("doc_id", "1 AS quality", "0 AS toxic")
    assert not any(r.rejected for r in toxicity.score(messy, toxicity.train(messy, one_class)).collect())


def test_the_sample_is_bounded_and_repeatable(frames):
    docs, labels = frames
    a, b = (toxicity.train(docs.repartition(n), labels, labelled_rows=120) for n in (2, 5))
    assert a.features.tolist() == b.features.tolist()
    assert all(np.allclose(x, y, atol=1e-3) for x, y in zip(a.weights, b.weights, strict=True))


def newton(x, y, use, penalty=toxicity.PENALTY):
    """Logistic regression by Newton steps on all columns; the first is the intercept and is not penalised."""
    x, y = x[use], y[use]
    w, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], penalty)
    ridge[0] = 0
    for _ in range(100):
        p = 1 / (1 + np.exp(-(x @ w)))
        slope = x.T @ (p - y) / len(y) + ridge * w
        curve = (x * (p * (1 - p))[:, None]).T @ x / len(y) + np.diag(ridge + 1e-12)
        w -= np.linalg.solve(curve, slope)
    return w


def parts_of(text):
    """The words of a text and the beginnings of its longer words."""
    words = re.findall("[0-9a-z]+", text.lower())
    return {("word", w) for w in words} | {(n, w[:n]) for w in words for n in toxicity.BEGINNINGS if len(w) > n}


def test_chain_against_plain_loops(spark):
    """Counts, evidence, folds, fits and probabilities worked out one by one."""
    rng = random.Random(31)
    vocabulary = ["alpha", "brick", "cloud", "drift", "ember", "flint", "grove", "hazelnut", "hazelwood", "ivory"]
    rows = []
    for i in range(400):
        words = rng.sample(vocabulary, rng.randint(2, 6))
        toxic = rng.random() < (0.75 if "brick" in words else 0.2)
        quality = rng.random() < (0.8 if "hazelnut" in words or "hazelwood" in words else 0.35)
        rows.append((i, " ".join(words), int(quality), int(toxic)))
    table = spark.createDataFrame(rows, "doc_id long, text string, quality int, toxic int")
    found = {r.doc_id: r for r in toxicity.score(table, toxicity.train(table, table.drop("text"))).collect()}

    texts = [parts_of(t) for _, t, _, _ in rows]
    labels = [np.array([t and not q for _, _, q, t in rows], float), np.array([t and q for _, _, q, t in rows], float), np.array([t for *_, t in rows], float)]
    n, features = len(rows), []
    for f in sorted({f for t in texts for f in t}, key=str):
        has = np.array([f in t for t in texts])
        most = 0.0
        for y in labels:
            table2 = [[(has & (y == v)).sum() for v in (1, 0)], [(~has & (y == v)).sum() for v in (1, 0)]]
            (a, b), (c, d) = table2
            spread = (a + b) * (c + d) * (a + c) * (b + d)
            most = max(most, n * (a * d - b * c) ** 2 / spread if spread else 0.0)
        if has.sum() >= toxicity.LEAST_TEXTS and most >= toxicity.LEAST_EVIDENCE:
            features.append(has.astype(float))
    assert 2 <= len(features) < 20
    fold_of = F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(toxicity.FOLDS))
    fold = np.array([r.f for r in table.select("doc_id", fold_of.alias("f")).orderBy("doc_id").collect()])
    words = np.column_stack([np.ones(n), *features])
    learned, judged = words, words
    for name, y in zip(toxicity.CATEGORIES, labels, strict=True):
        p = 1 / (1 + np.exp(-(judged @ newton(learned, y, np.ones(n, bool)))))
        assert [found[i][f"p_{name}"] for i in range(n)] == pytest.approx(p.tolist(), abs=1e-3)
        out_of_fold = np.zeros(n)
        for k in range(toxicity.FOLDS):
            w = newton(learned, y, fold != k)
            out_of_fold[fold == k] = 1 / (1 + np.exp(-(learned @ w)))[fold == k]
        learned, judged = np.column_stack([learned, out_of_fold]), np.column_stack([judged, p])
    assert all(r.rejected == (r.p_toxic >= toxicity.THRESHOLD) for r in found.values())
