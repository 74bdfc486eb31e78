"""Quality rules as a short-circuit cascade.

Each rule is tried on a sample of the texts, which gives its cost (seconds a text)
and its rejection rate; rules then run in order of rejections per second, and a text
that one rule rejects reaches no later rule.  The verdict is the same for any order -
a text is kept when no rule rejects it - so the sample decides speed alone.

Defined cases: a null or empty text has no words.  A rule judges a text by itself, so
repeated rows get the same verdict and an empty table gives no rows.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.words import Words, covered, mix, pieces, sum_by_text, text_array, window_hashes, windows_in

SAMPLE_TEXTS = 512  # texts on which costs and rejections are estimated; no result depends on it
SYMBOLS = np.zeros(256, np.int64)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = 1
HAS_WORD = re.compile(r"[^\x20\x09-\x0D]")
REPEAT_WINDOW = 5


class Texts:
    """Some texts, with their words found when a rule first asks for them."""

    def __init__(self, column: pa.Array) -> None:
        self.column = text_array(column)
        self._words: Words | None = None

    def __len__(self) -> int:
        return len(self.column)

    @property
    def words(self) -> Words:
        if self._words is None:
            self._words = Words(self.column)
        return self._words

    def take(self, chosen: np.ndarray) -> Texts:
        return self if chosen.all() else Texts(self.column.take(pa.array(np.flatnonzero(chosen))))


def word_chars(texts: Texts) -> np.ndarray:
    """Code points inside words."""
    words = texts.words
    begins = np.zeros(len(words.data) + 1, np.int64)
    np.cumsum((words.data & 0xC0) != 0x80, out=begins[1:])
    return sum_by_text(begins[words.ends] - begins[words.starts], words.first)


def symbol_counts(texts: Texts) -> np.ndarray:
    return sum_by_text(SYMBOLS[texts.words.raw], texts.words.at)


def lines_and_duplicates(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word, and how many of them equal an earlier line of the text."""
    n, duplicates = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts.column.to_pylist()):
        lines = [line for line in text.split("\n") if HAS_WORD.search(line)]
        n[i], duplicates[i] = len(lines), len(lines) - len(set(lines))
    return n, duplicates


def _duplicate_lines(texts: Texts) -> np.ndarray:
    n, duplicates = lines_and_duplicates(texts)
    return 10 * duplicates > 3 * n


def repeated_words(texts: Texts, k: int = REPEAT_WINDOW) -> np.ndarray:
    """Words inside windows of ``k`` words that occur twice or more in the text, the first included."""
    words = texts.words
    starts, owner = windows_in(words.counts, k)
    if not len(starts):
        return np.zeros(len(texts), np.int64)
    keys = mix(window_hashes(words.hashes(), k)[starts] + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    again = np.zeros(len(keys), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    return sum_by_text(covered(starts[again], k, len(words)).astype(np.int64), words.first)


def _capitals(texts: Texts) -> np.ndarray:
    """Whether over six in ten of the ASCII letters are capitals."""
    raw, at = texts.words.raw, texts.words.at
    upper = (raw >= ord("A")) & (raw <= ord("Z"))
    letters = upper | ((raw >= ord("a")) & (raw <= ord("z")))
    return 10 * sum_by_text(upper.astype(np.int64), at) > 6 * sum_by_text(letters.astype(np.int64), at)


class Rule(NamedTuple):
    name: str
    rejects: Callable[[Texts], np.ndarray]


def _mean_word_length(texts: Texts) -> np.ndarray:
    n, chars = texts.words.counts, word_chars(texts)
    return (n > 0) & ((chars < 2 * n) | (chars > 20 * n))


RULES = (
    Rule("few_words", lambda t: t.words.counts < 10),
    Rule("repeats", lambda t: 100 * repeated_words(t) > 20 * t.words.counts),
    Rule("symbols", lambda t: 5 * symbol_counts(t) > 2 * t.words.counts),
    Rule("duplicate_lines", _duplicate_lines),
    Rule("word_length", _mean_word_length),
    Rule("capitals", _capitals),
)


def run_cascade(texts: Texts, rules: list[Rule], alive: np.ndarray | None = None) -> np.ndarray:
    """Per text, the number of the rule that rejects it, or -1."""
    rejected_by = np.full(len(texts), -1)
    left = np.arange(len(texts)) if alive is None else np.flatnonzero(alive)
    rest = texts if alive is None else texts.take(alive)
    for number, rule in enumerate(rules):
        if not len(left):
            break
        out = rule.rejects(rest)
        rejected_by[left[out]] = number
        left, rest = left[~out], rest.take(~out)
    return rejected_by


def estimate(docs: DataFrame, rules: tuple[Rule, ...], text: str = "text", sample_texts: int = SAMPLE_TEXTS) -> dict[str, tuple[float, float]]:
    """Rule -> (rejection rate, seconds a text), from about ``sample_texts`` random texts."""

    def tried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text):
            rows = []
            for rule in rules:
                texts = Texts(batch.column(text))
                began = time.perf_counter()
                out = int(rule.rejects(texts).sum())
                rows.append((rule.name, len(texts), out, time.perf_counter() - began))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], ["rule", "n", "n_out", "seconds"])

    total = docs.count()
    sample = docs.select(text).sample(min(1.0, 1.5 * sample_texts / max(total, 1)), seed=7).limit(2 * sample_texts)
    found = sample.mapInArrow(tried, "rule string, n long, n_out long, seconds double").groupBy("rule").agg(
        F.sum("n").alias("n"), F.sum("n_out").alias("n_out"), F.sum("seconds").alias("seconds")
    )
    return {r.rule: (r.n_out / r.n, r.seconds / r.n) for r in found.collect()}  # a row for each rule


def cascade_order(estimates: dict[str, tuple[float, float]], rules: tuple[Rule, ...]) -> list[Rule]:
    """Most rejections per second first; rules without an estimate last, ties in the given order."""

    def gain(rule: Rule) -> float:
        rate, seconds = estimates.get(rule.name, (0.0, 1.0))
        return rate / max(seconds, 1e-9)

    return sorted(rules, key=gain, reverse=True)


def quality_verdicts(
    docs: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text: str = "text", sample_texts: int = SAMPLE_TEXTS
) -> DataFrame:
    """``key, kept, rejected_by``: the verdict and the rule that rejected the text first (null if kept)."""
    ordered = cascade_order(estimate(docs, rules, text, sample_texts), rules)
    names = np.array([r.name for r in ordered], dtype=object)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text):
            by = run_cascade(Texts(batch.column(text)), ordered)
            who = pa.array(np.where(by >= 0, names[by], None), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(by < 0), who], [key, "kept", "rejected_by"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(judge, f"`{key}` {kind}, kept boolean, rejected_by string")


def quality_measures(
    docs: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text: str = "text", sample_texts: int = SAMPLE_TEXTS
) -> DataFrame:
    """The verdict with the measures of every text, rejected or not.

    Returns ``key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept``.  The measures
    are asked for on every text, so the two base rules come from them and the cascade runs on what these leave.
    """
    further = tuple(r for r in rules if r.name not in ("few_words", "repeats"))
    ordered = cascade_order(estimate(docs, further, text, sample_texts), further)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text):
            texts = Texts(batch.column(text))
            n, repeats = texts.words.counts, repeated_words(texts)
            failed = (n < 10) | (100 * repeats > 20 * n)
            kept = ~failed & (run_cascade(texts, ordered, ~failed) < 0)
            measures = [n.astype(np.int64), word_chars(texts), symbol_counts(texts), lines_and_duplicates(texts)[1], repeats]
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), *map(pa.array, measures), pa.array(failed), pa.array(kept)],
                [key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
            )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(
        judge,
        f"`{key}` {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "base_failed boolean, kept boolean",
    )
