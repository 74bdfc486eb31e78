"""Benchmark decontamination by suffix arrays over the training texts.

Every task sorts the word suffixes of its shard of texts (about 4 MB) by prefix doubling
and looks every benchmark suffix up in it by binary search.  That gives, per benchmark
suffix, its longest verbatim match and every place of it.  Texts never move: the
benchmark goes to them, in slices of bounded size that a chain of narrow steps works off,
so a benchmark of any size costs further steps and no further shuffle.

A document word is *hit* inside an occurrence of a window of 13 consecutive item words (the
whole item if it is shorter); a document is contaminated with at least one hit word and one
hit in 20 words.

Equal windows of any number of items are searched as one.

Defined cases: null texts have no words; items without words match nothing; repeated items
count once by their id; a null item id reads as the empty string; rows with null or repeated keys are
judged one by one and kept or dropped by their own texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.words import LOWER, NOT_ALPHANUMERIC, Words, covered, pieces, sum_by_text

WINDOW = 13
SLICE_BYTES = 16 << 20  # benchmark text broadcast at once; its arrays take about three times that


def window_groups(hashes: np.ndarray, at: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the windows ``hashes[at:at + length]`` are equal: the group of each, and the first window of each group.

    A window is told by its first and its last words, as many as a power of two has, whose ranks come from doubling.
    """
    group, firsts, known = np.zeros(len(at), np.int64), [np.zeros(0, np.int64)], 0
    rank, width = np.unique(hashes, return_inverse=True)[1].astype(np.int64), 1
    for n in np.unique(length).tolist():
        while 2 * width <= n:
            after = np.zeros_like(rank)
            after[: max(0, len(rank) - width)] = rank[width:] + 1
            rank, width = np.unique(rank * (len(rank) + 2) + after, return_inverse=True)[1].astype(np.int64), 2 * width
        rows = np.flatnonzero(length == n)
        ends = rank[at[rows]] * (len(rank) + 2) + rank[at[rows] + n - width]
        _, first, which = np.unique(ends, return_index=True, return_inverse=True)
        group[rows] = known + which
        firsts.append(rows[first])
        known += len(first)
    return group, np.concatenate(firsts)


class Benchmark(NamedTuple):
    """Word suffixes of a slice of the benchmark."""

    words: np.ndarray  # word hashes, items one after another
    left: np.ndarray  # per suffix, the words to the end of its item
    item: np.ndarray  # per suffix, the number of its item
    window: np.ndarray  # per suffix, the words of the window that starts there; 0 if none does
    ids: list[str]
    distinct: np.ndarray  # a suffix for each window that differs from the others
    owner_at: np.ndarray  # where the items of each distinct window begin in ``owners``
    owners: np.ndarray  # numbers of items, each once a window

    @classmethod
    def of(cls, items: list[tuple[str, str]], window: int = WINDOW) -> Benchmark:
        words = Words(pa.array([text for _, text in items], pa.string()), NOT_ALPHANUMERIC, LOWER)
        item = words.doc_of_word()
        left = words.first[item + 1] - np.arange(len(item))
        n = words.counts[item]
        starts = np.where(n >= window, left >= window, left == n)
        sizes = np.where(starts, np.minimum(n, window), 0)
        at, hashes = np.flatnonzero(sizes), words.hashes()
        group, firsts = window_groups(hashes, at, sizes[at])
        owned = np.unique(group * (len(items) + 1) + item[at])
        owner_at = np.searchsorted(owned // (len(items) + 1), np.arange(len(firsts) + 1))
        return cls(hashes, left, item, sizes, [i for i, _ in items], at[firsts], owner_at, owned % (len(items) + 1))


class SuffixArray:
    """The suffixes of a shard's words, in the order of their first ``depth`` word hashes."""

    def __init__(self, words: Words, depth: int) -> None:
        self.n = len(words)
        self.depth = 1
        self.hashes = words.hashes()
        self.left = words.first[words.doc_of_word() + 1] - np.arange(self.n)
        rank = np.unique(self.hashes, return_inverse=True)[1].astype(np.int64) + 1 if self.n else np.zeros(0, np.int64)
        while self.depth < depth:
            following = np.zeros(self.n, np.int64)  # 0: the text ends before
            inside = np.flatnonzero(self.left > self.depth)
            following[inside] = rank[inside + self.depth]
            pair = rank * (self.n + 2) + following
            rank = np.unique(pair, return_inverse=True)[1].astype(np.int64) + 1 if self.n else rank
            self.depth *= 2
        self.order = np.argsort(rank, kind="stable")

    def _less(self, at: np.ndarray, bench: Benchmark, suffix: np.ndarray, length: np.ndarray, or_equal: bool) -> np.ndarray:
        """Whether the shard suffix, as far as ``length`` words, sorts before the benchmark suffix."""
        out, equal = np.zeros(len(at), bool), np.ones(len(at), bool)
        for k in range(int(length.max(initial=0))):
            rows = np.flatnonzero(equal & (length > k))
            if not len(rows):
                break
            ended = self.left[at[rows]] <= k
            mine = self.hashes[np.minimum(at[rows] + k, self.n - 1)]
            theirs = bench.words[suffix[rows] + k]
            below = ended | (mine < theirs)
            differs = ended | (mine != theirs)
            out[rows[differs]] = below[differs]
            equal[rows[differs]] = False
        out[equal] = or_equal
        return out

    def search(self, bench: Benchmark, suffix: np.ndarray, length: np.ndarray, or_equal: bool) -> np.ndarray:
        """Per benchmark suffix, how many shard suffixes sort before it (or begin with it, ``or_equal``)."""
        low, high = np.zeros(len(suffix), np.int64), np.full(len(suffix), self.n)
        while (busy := np.flatnonzero(low < high)).size:
            middle = (low[busy] + high[busy]) // 2
            before = self._less(self.order[middle], bench, suffix[busy], length[busy], or_equal)
            low[busy[before]] = middle[before] + 1
            high[busy[~before]] = middle[~before]
        return low

    def common(self, at: np.ndarray, bench: Benchmark, suffix: np.ndarray) -> np.ndarray:
        """Words that the shard suffix and the benchmark suffix have in common from their starts."""
        n = np.zeros(len(at), np.int64)
        most = np.minimum(self.left[at], bench.left[suffix])
        rows = np.flatnonzero(most > 0)
        while rows.size:
            rows = rows[self.hashes[at[rows] + n[rows]] == bench.words[suffix[rows] + n[rows]]]
            n[rows] += 1
            rows = rows[n[rows] < most[rows]]
        return n


def _spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges low[i]:high[i], and the i of each."""
    n = high - low
    which = np.repeat(np.arange(len(n)), n)
    return low[which] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n), which


def find(words: Words, bench: Benchmark, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Every match of at least a window: word number in the shard, benchmark suffix, window length, longest match."""
    array = SuffixArray(words, window)
    suffix = np.flatnonzero(bench.window)
    if not array.n or not suffix.size:
        return (np.zeros(0, np.int64),) * 4
    length = bench.window[suffix]
    low = array.search(bench, suffix, length, or_equal=False)
    high = array.search(bench, suffix, length, or_equal=True)
    places, which = _spread(low, high)
    at = array.order[places]
    return at, suffix[which], length[which], array.common(at, bench, suffix[which])


def find_windows(words: Words, bench: Benchmark, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every occurrence of a distinct window: word number in the shard, number of the window, its length."""
    array = SuffixArray(words, window)
    if not array.n or not bench.distinct.size:
        return (np.zeros(0, np.int64),) * 3
    length = bench.window[bench.distinct]
    low = array.search(bench, bench.distinct, length, or_equal=False)
    high = array.search(bench, bench.distinct, length, or_equal=True)
    places, which = _spread(low, high)
    return array.order[places], which, length[which]


def benchmark_slices(benchmark: DataFrame, item: str = "item_id", text: str = "text", slice_bytes: int = SLICE_BYTES) -> Iterator[list[tuple[str, str]]]:
    """The benchmark in parts whose expected size is at most ``slice_bytes``."""
    rows = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-size // slice_bytes) or 1
    for part in range(parts):
        yield [(r.id, r.text) for r in rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(parts)) == part).toLocalIterator()]


def matches(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """``key, word_at, item_id, item_word_at, n_words``: each longest verbatim match of a window or more, one row per
    place where it begins (a match is reported at its first word, not again at those inside it)."""
    out = None
    kind = docs.schema[key].dataType.simpleString()
    for items in benchmark_slices(benchmark):
        bench = docs.sparkSession.sparkContext.broadcast(Benchmark.of(items, window))

        def located(batches: Iterator[pa.RecordBatch], bench=bench) -> Iterator[pa.RecordBatch]:
            b = bench.value
            first_of_item = np.flatnonzero(np.diff(b.item, prepend=-1))
            for batch in pieces(batches, text):
                words = Words(batch.column(text), NOT_ALPHANUMERIC, LOWER)
                at, suffix, _, longest = find(words, b, window)
                doc = words.doc_of_word()[at]
                # Inside a match that began a word earlier in both: already reported.
                pairs = set(zip(at.tolist(), suffix.tolist(), strict=True))
                fresh = np.array([(a - 1, s - 1) not in pairs or words.first[d] == a or b.item[s - 1] != b.item[s] for a, s, d in zip(at, suffix, doc, strict=True)], bool)
                at, suffix, longest, doc = at[fresh], suffix[fresh], longest[fresh], doc[fresh]
                item = b.item[suffix]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(key).take(pa.array(doc)),
                        pa.array(at - words.first[doc]),
                        pa.array([b.ids[i] for i in item], pa.string()),
                        pa.array(suffix - first_of_item[np.searchsorted(b.item[first_of_item], item)]),
                        pa.array(longest),
                    ],
                    [key, "word_at", "item_id", "item_word_at", "n_words"],
                )

        some = docs.select(key, text).mapInArrow(located, f"`{key}` {kind}, word_at long, item_id string, item_word_at long, n_words long")
        out = some if out is None else out.unionByName(some)
    return out


_FOUND = T.StructType(
    [
        T.StructField("_words", T.LongType()),
        T.StructField("_hits", T.ArrayType(T.LongType())),
        T.StructField("_items", T.ArrayType(T.StringType())),
    ]
)


def with_hits(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with ``_words`` (how many), ``_hits`` (numbers of the hit words) and ``_items`` (ids found), by narrow steps."""
    out, columns = docs, docs.columns
    for number, items in enumerate(benchmark_slices(benchmark)):
        bench = docs.sparkSession.sparkContext.broadcast(Benchmark.of(items, window))

        def searched(batches: Iterator[pa.RecordBatch], bench=bench, number=number) -> Iterator[pa.RecordBatch]:
            b = bench.value
            for batch in pieces(batches, text):
                words = Words(batch.column(text), NOT_ALPHANUMERIC, LOWER)
                at, found_window, length = find_windows(words, b, window)
                doc = words.doc_of_word()
                marked = np.zeros(len(words), bool)
                for size in np.unique(length):
                    marked |= covered(at[length == size], int(size), len(words))
                inside = np.concatenate([[0], np.cumsum(sum_by_text(marked.astype(np.int64), words.first))])
                place = np.flatnonzero(marked)
                hits = pa.ListArray.from_arrays(pa.array(inside, pa.int32()), pa.array(place - words.first[doc[place]], pa.int64()))
                # A window is looked up once a text, whichever items have it; their ids come last.
                n_windows = len(b.distinct) + 1
                pair = np.unique(doc[at] * n_windows + found_window)
                owner, which = _spread(b.owner_at[pair % n_windows], b.owner_at[pair % n_windows + 1])
                owned = np.unique(pair[which] // n_windows * (len(b.ids) + 1) + b.owners[owner])
                items_at = np.searchsorted(owned // (len(b.ids) + 1), np.arange(batch.num_rows + 1))
                ids = pa.array([b.ids[i] for i in (owned % (len(b.ids) + 1)).tolist()], pa.string())
                found = pa.ListArray.from_arrays(pa.array(items_at, pa.int32()), ids)
                if number:
                    hits = pa.array([a + c for a, c in zip(batch.column("_hits").to_pylist(), hits.to_pylist(), strict=True)], hits.type)
                    found = pa.array([a + c for a, c in zip(batch.column("_items").to_pylist(), found.to_pylist(), strict=True)], found.type)
                kept = [batch.column(c) for c in columns]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(words.counts.astype(np.int64)), hits, found], [*columns, *_FOUND.names])

        out = out.mapInArrow(searched, T.StructType([*docs.schema.fields, *_FOUND.fields]))
    return out


def _contaminated(n_hit, n_words):
    return (n_hit > 0) & (20 * n_hit >= n_words)


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """``key, n_words, n_hit, item_ids`` (distinct, sorted as strings) ``, contaminated`` of every document."""
    found = with_hits(docs.select(key, text), benchmark, text, window)
    slim = found.select(
        key,
        F.col("_words").alias("n_words"),
        F.size(F.array_distinct("_hits")).cast("long").alias("n_hit"),
        F.array_sort(F.array_distinct("_items")).alias("item_ids"),
    )
    return slim.withColumn("contaminated", _contaminated(F.col("n_hit"), F.col("n_words")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns."""
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # names of its own, whatever the table's are
    found = with_hits(plain, benchmark, f"c{docs.columns.index(text)}", window)
    clean = found.where(~_contaminated(F.size(F.array_distinct("_hits")), F.col("_words")))
    return clean.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
