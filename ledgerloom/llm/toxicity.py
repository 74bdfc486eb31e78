"""Toxicity by a classifier chain.

One linear model per category, in a fixed order; each reads the words of a text, the
beginnings of its longer words and the probabilities that the models before it gave.  So that a later model learns from
probabilities as it will meet them, those of its training rows come out of fold: from models
that have not seen the row.

Models are fitted on the driver on at most ``LABELLED_ROWS`` labelled texts (those whose key has the smallest
hash), over the words - ``FEATURES`` at most - that tell most about a category there; the features are counted and found on
the executors.  Every text is then judged where it lies, whole.

Categories come from the labels: toxic texts of low quality, toxic texts of good quality, and toxic at all, which
decides.  Defined cases: a null label is no label; labels repeated for one key count as toxic (of good quality) if
one of them does; without labelled rows nothing is rejected; a null or empty text has the probability of no evidence.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.words import LOWER, NOT_ALPHANUMERIC, Words, mix, pieces
from ledgerloom.session import pin

LABELLED_ROWS = 10_000
FEATURES = 1_024
LEAST_TEXTS = 5  # labelled texts that a feature must occur in
LEAST_EVIDENCE = 30.0  # chi-square of a feature; chance reaches it for about one word in 20 million
BEGINNINGS = (4, 6)  # bytes of a word's beginning that are features too
FOLDS = 3
PENALTY = 1e-4
THRESHOLD = 0.5
CATEGORIES = {"toxic_poor": "toxic = 1 AND quality = 0", "toxic_good": "toxic = 1 AND quality = 1", "toxic": "toxic = 1"}


def features_of(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words and of the beginnings of longer words, and the text of each."""
    doc, lengths = words.doc_of_word(), words.ends - words.starts
    found, texts = [words.hashes()], [doc]
    for size in BEGINNINGS:
        longer = lengths > size
        found.append(mix(words.hashes(size)[longer] + np.uint64(size)))
        texts.append(doc[longer])
    return np.concatenate(found), np.concatenate(texts)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


class Rows:
    """Training rows: which features each has, and dense columns beside them."""

    def __init__(self, features: list[list[int]], width: int, dense: np.ndarray | None = None) -> None:
        self.n, self.width = len(features), width
        self.at = np.array([f for row in features for f in row], np.int64)
        self.row = np.repeat(np.arange(self.n), [len(row) for row in features])
        self.dense = np.zeros((self.n, 0)) if dense is None else dense

    def beside(self, column: np.ndarray) -> Rows:
        out = Rows([], self.width)
        out.n, out.at, out.row = self.n, self.at, self.row
        out.dense = np.column_stack([self.dense, column])
        return out

    def scores(self, w: np.ndarray) -> np.ndarray:
        words = np.bincount(self.row, weights=w[1 + self.at], minlength=self.n)
        return w[0] + words + self.dense @ w[1 + self.width :]

    def gradient(self, residual: np.ndarray) -> np.ndarray:
        words = np.bincount(self.at, weights=residual[self.row], minlength=self.width)
        return np.concatenate([[residual.sum()], words, residual @ self.dense])


def fit(rows: Rows, y: np.ndarray, use: np.ndarray, penalty: float = PENALTY, steps: int = 60) -> np.ndarray:
    """Weights (intercept, words, dense columns) of a logistic regression, by limited-memory BFGS."""
    n = max(int(use.sum()), 1)

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = rows.scores(w)
        p = sigmoid(z)
        value = np.where(use, np.logaddexp(0, z) - y * z, 0).sum() / n + penalty / 2 * (w[1:] @ w[1:])
        slope = rows.gradient(np.where(use, p - y, 0)) / n
        slope[1:] += penalty * w[1:]
        return value, slope

    w = np.zeros(1 + rows.width + rows.dense.shape[1])
    value, slope = loss(w)
    memory: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        direction, used = -slope, []
        for s, d in reversed(memory):
            share = (s @ direction) / (s @ d)
            direction = direction - share * d
            used.append(share)
        if memory:
            s, d = memory[-1]
            direction = direction * (s @ d) / (d @ d)
        for (s, d), share in zip(memory, reversed(used), strict=True):
            direction = direction + (share - (d @ direction) / (s @ d)) * s
        step, descent = 1.0, slope @ direction
        while (new := loss(w + step * direction))[0] > value + 1e-4 * step * descent and step > 1e-8:
            step /= 2
        move, turn = step * direction, new[1] - slope
        w, (value, slope) = w + move, new
        if move @ turn > 1e-12:
            memory = [*memory[-7:], (move, turn)]
        if np.abs(slope).max() < 1e-6:
            break
    return w


class Chain(NamedTuple):
    categories: list[str]
    features: np.ndarray  # sorted word hashes
    weights: list[np.ndarray]  # of category i: intercept, words, probabilities of the categories before it

    def probabilities(self, words: Words) -> np.ndarray:
        """One row per text, one column per category."""
        n, width = len(words.counts), len(self.features)
        found, doc = features_of(words)
        if width and len(found):
            at = np.minimum(np.searchsorted(self.features, found), width - 1)
            known = self.features[at] == found
            pairs = np.unique(doc[known] * width + at[known])  # a word counts once a text
        else:
            pairs = np.zeros(0, np.int64)
        doc, at = (pairs // width, pairs % width) if width else (pairs, pairs)
        out = np.zeros((n, len(self.weights)))
        for i, w in enumerate(self.weights):
            score = w[0] + np.bincount(doc, weights=w[1 + at], minlength=n) + out[:, :i] @ w[1 + width :]
            out[:, i] = sigmoid(score)
        return out


def fit_chain(categories: list[str], features: np.ndarray, rows: list[list[int]], labels: np.ndarray, fold: np.ndarray) -> Chain:
    """``rows``: feature numbers of each training row; ``labels``: a column per category; ``fold``: 0..FOLDS-1 per row."""
    known, weights = Rows(rows, len(features)), []
    for i in range(len(categories)):
        y = labels[:, i].astype(float)
        everything = np.ones(known.n, bool)
        weights.append(fit(known, y, everything))
        if i + 1 < len(categories):
            out_of_fold = np.zeros(known.n)
            for k in range(FOLDS):
                w = fit(known, y, fold != k)
                out_of_fold[fold == k] = sigmoid(known.scores(w))[fold == k]
            known = known.beside(out_of_fold)
    return Chain(categories, features, weights)


def train(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    categories: dict[str, str] | None = None,
    labelled_rows: int = LABELLED_ROWS,
    n_features: int = FEATURES,
) -> Chain:
    """Fit the chain; ``categories`` maps names, in chain order, to SQL conditions on the label columns."""
    categories = categories or CATEGORIES
    names = [f"_{i}" for i in range(len(categories))]
    given = labels.select(F.col(key).alias("key"), *[F.expr(sql).cast("int").alias(n) for n, sql in zip(names, categories.values(), strict=True)])
    one = given.dropna(subset=["key", names[-1]]).groupBy("key").agg(*[F.coalesce(F.max(n), F.lit(0)).alias(n) for n in names])
    chosen = one.orderBy(F.xxhash64("key"), "key").limit(labelled_rows)  # the documented bound of the sample

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            words = Words(batch.column("text"), NOT_ALPHANUMERIC, LOWER)
            hashes, doc = features_of(words)
            order = np.argsort(doc, kind="stable")
            first = np.searchsorted(doc[order], np.arange(batch.num_rows + 1))
            hashes = hashes[order].view(np.int64)
            found = [np.unique(hashes[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), *[batch.column(n) for n in names], pa.array(found, pa.list_(pa.int64()))], ["key", *names, "words"]
            )

    kind = docs.schema[key].dataType.simpleString()
    texts = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(chosen), "key")
    schema = f"key {kind}, {', '.join(f'{n} int' for n in names)}, words array<long>"
    rows = texts.select("key", "text", *names).mapInArrow(extracted, schema)
    sample = pin(rows.groupBy("key").agg(*[F.max(n).alias(n) for n in names], F.max("words").alias("words")))

    total = sample.agg(F.count(F.lit(1)).alias("n"), *[F.sum(n).alias(n) for n in names]).first()
    if not total.n:
        return Chain(list(categories), np.zeros(0, np.uint64), [np.array([-50.0, *[0.0] * i]) for i in range(len(categories))])
    by_word = sample.select("key", *names, F.explode("words").alias("word"))
    counts = by_word.groupBy("word").agg(F.count(F.lit(1)).alias("n"), *[F.sum(n).alias(n) for n in names]).where(F.col("n") >= LEAST_TEXTS)

    def told(name: str):
        """Chi-square of the word's occurrence and the category."""
        n, yes = F.lit(float(total.n)), F.lit(float(total[name]))
        surplus = F.col(name) * n - F.col("n") * yes
        spread = F.col("n") * (n - F.col("n")) * yes * (n - yes)
        return F.coalesce(n * surplus * surplus / F.nullif(spread, F.lit(0.0)), F.lit(0.0))

    most = F.array_max(F.array(*map(told, names))).alias("most")
    best = counts.select("word", most).where(F.col("most") >= LEAST_EVIDENCE).orderBy(F.desc("most"), "word").limit(n_features)
    features = np.sort(np.array([r.word for r in best.select("word").collect()], np.int64).view(np.uint64))
    table = docs.sparkSession.sparkContext.broadcast(features)

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = table.value
        for batch in batches:
            lists = batch.column("words")
            found = []
            for i in range(batch.num_rows):
                words = lists[i].values.to_numpy().view(np.uint64)
                at = np.minimum(np.searchsorted(known, words), max(len(known) - 1, 0))
                found.append(at[known[at] == words] if len(known) else at[:0])
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(n) for n in names], batch.column("fold"), pa.array(found, pa.list_(pa.int64()))], [*names, "fold", "at"]
            )

    folded = sample.select("words", *names, F.pmod(F.xxhash64(F.lit(3), "key"), F.lit(FOLDS)).cast("int").alias("fold"))
    learned = folded.mapInArrow(numbered, f"{', '.join(f'{n} int' for n in names)}, fold int, at array<long>").collect()
    y = np.array([[r[n] for n in names] for r in learned])
    return fit_chain(list(categories), features, [r["at"] for r in learned], y, np.array([r.fold for r in learned]))


def score(docs: DataFrame, chain: Chain, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``key, p_<category>..., rejected`` of every text; the last category decides."""
    model = docs.sparkSession.sparkContext.broadcast(chain)
    columns = [f"p_{c}" for c in chain.categories]

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text):
            p = model.value.probabilities(Words(batch.column(text), NOT_ALPHANUMERIC, LOWER))
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), *[pa.array(p[:, i]) for i in range(len(columns))], pa.array(p[:, -1] >= threshold)], [key, *columns, "rejected"]
            )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(judged, f"`{key}` {kind}, {', '.join(f'{c} double' for c in columns)}, rejected boolean")


def without_toxic(docs: DataFrame, chain: Chain, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the chain does not reject, with all their columns; texts do not move."""
    model = docs.sparkSession.sparkContext.broadcast(chain)
    number = docs.columns.index(text)
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, f"c{number}"):
            p = model.value.probabilities(Words(batch.column(number), NOT_ALPHANUMERIC, LOWER))
            yield batch.filter(pa.array(p[:, -1] < threshold))

    return plain.mapInArrow(kept, plain.schema).toDF(*docs.columns)
