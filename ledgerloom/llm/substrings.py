"""Substring dedup by super-k-mer partitioning.

A window is 20 consecutive words of a text.  Its minimiser is the smallest hash among its
3-word sequences, so equal windows have equal minimisers.  Consecutive windows with one
minimiser travel as one packed string to the bucket of that minimiser, which costs about three
times the text instead of twenty.  There the windows are sorted and compared, word for word, and
all but the earliest of equal ones are marked.

Before the shuffle a task drops strings it has sent already: of equal strings only its earliest
can be the earliest of all, so the others are marked at once.  A passage that a third of all
documents hold thus arrives once a task.  Bytes of each bucket are counted before: one that will outgrow
``BUCKET_BYTES`` (one minimiser in very many contexts) is not brought together, its rows are spread over
all tasks and each hands its windows on singly, as two 64-bit hashes, to be grouped by those.  So does a
bucket that outgrows the bound uncounted.

Defined cases: keys are whole numbers; a null text has no words; a null key counts as smaller than any other; equal texts
under one key, or under none, are one document, whose equal starts are not earlier than each other.  Different
texts under one key, or under none, are documents of their own, in the order of a hash of the text (``tie``, 0 where
the key alone tells the document).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.words import Words, mix, pieces, window_hashes, windows_in
from ledgerloom.operators.lookups import lookup
from ledgerloom.session import broadcast_if_small, pin, shuffle_partitions

WINDOW = 20
MINIMISER = 3  # words
BUCKET_BYTES = 16 << 20  # packed text that a task holds at once; its arrays take about twenty times that
AIM_BYTES = 6 << 20  # packed text a bucket is planned for
PIECE = 6 << 20  # text handled at once before the shuffle
TASK_BYTES = 512 << 20  # packed text a task is planned for; it comes sorted by bucket and is held a bucket at a time
NULL_KEY = -(1 << 63)

PACKED = "bucket long, keys array<long>, ties array<long>, starts array<int>, counts array<int>, packed binary"
MARKS = "key long, tie long, start int, n int, w1 long, w2 long"  # w1 and w2 only of windows that travel on singly


def _sliding_least(values: np.ndarray, size: int) -> np.ndarray:
    """The least of every ``size`` consecutive values."""
    least, width = values, 1
    while 2 * width <= size:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = size - width
    return np.minimum(least[:-rest], least[rest:]) if rest else least


def super_kmers(words: Words, window: int, minimiser: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First word, number of windows, text and minimiser of every run of windows that share their minimiser."""
    starts, texts = windows_in(words.counts, window)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64)
    least = _sliding_least(window_hashes(words.hashes(), minimiser), window - minimiser + 1)[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (least[1:] != least[:-1]) | (texts[1:] != texts[:-1])
    first = np.flatnonzero(new)
    return starts[first], np.diff(np.append(first, len(starts))), texts[first], least[first]


def _runs(keys: np.ndarray, ties: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Single starts as key, tie, first start and length of runs without a gap."""
    order = np.lexsort((starts, ties, keys))
    keys, ties, starts = keys[order], ties[order], starts[order]
    if not len(keys):
        return keys, ties, starts.astype(np.int32), np.zeros(0, np.int32)
    follows = (keys[1:] == keys[:-1]) & (ties[1:] == ties[:-1]) & (starts[1:] - starts[:-1] <= 1)
    first = np.concatenate([[0], np.flatnonzero(~follows) + 1])
    last = np.append(first[1:], len(keys)) - 1
    return keys[first], ties[first], starts[first].astype(np.int32), (starts[last] - starts[first] + 1).astype(np.int32)


def _string_hashes(hashes: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A 64-bit number of each run of ``n`` words; equal runs have equal ones."""
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes, out=total[1:])
    # A sum knows no order; the first, middle and last word stand for it.
    order = hashes[first] ^ mix(hashes[first + n // 2] + np.uint64(1)) ^ mix(hashes[first + n - 1] + np.uint64(2))
    return mix(total[first + n] - total[first] + mix(order))


def _bucket_bytes(batches: Iterator[pa.RecordBatch], window: int, minimiser: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """``bucket, bytes``: about what ``_packed`` will send, equal strings of a piece once; it only decides where windows meet."""
    for batch in pieces(batches, "text", PIECE):
        words = Words(batch.column("text"))
        first, n, _, least = super_kmers(words, window, minimiser)
        if not len(first):
            continue
        _, once = np.unique(_string_hashes(words.hashes(), first, n + window - 1), return_index=True)
        first, n, bucket = first[once], n[once], (least[once] % np.uint64(buckets)).astype(np.int64)
        size = words.ends[first + n + window - 2] - words.starts[first] + 1
        met, where = np.unique(bucket, return_inverse=True)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(np.bincount(where, size).astype(np.int64))], ["bucket", "bytes"])


def _packed(batches: Iterator[pa.RecordBatch], window: int, minimiser: int, buckets: int) -> Iterator[pa.RecordBatch]:
    compress = zstandard.ZstdCompressor(level=1).compress
    schema = pa.schema(
        [("bucket", pa.int64()), ("keys", pa.list_(pa.int64())), ("ties", pa.list_(pa.int64())), ("starts", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32())), ("packed", pa.binary())]
    )
    for batch in pieces(batches, "text", PIECE):
        key, tie = batch.column("key").to_numpy(), batch.column("tie").to_numpy()
        order = np.lexsort((tie, key))  # so that what is met first is the earliest
        key, tie = key[order], tie[order]
        words = Words(batch.column("text").take(pa.array(order)))
        first, n, text, least = super_kmers(words, window, minimiser)
        joined, at, end = words.joined()
        begin, finish = at[first].tolist(), end[first + n + window - 2].tolist() if len(first) else []
        inside = first - words.first[text]
        seen: dict[bytes, int] = {}
        again = []
        for i, (s, e) in enumerate(zip(begin, finish, strict=True)):
            j = seen.setdefault(joined[s:e], i)
            if j != i and not (inside[i] == inside[j] and key[text[i]] == key[text[j]] and tie[text[i]] == tie[text[j]]):
                again.append(i)
        strings = list(seen)
        kept = np.fromiter(seen.values(), np.int64, len(seen))
        del seen
        bucket = (least[kept] % np.uint64(buckets)).astype(np.int64)
        by_bucket = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.diff(bucket[by_bucket], prepend=-1))
        rows: list[list] = [[], [], [], [], [], []]
        for a, b in zip(cuts, [*cuts[1:], len(kept)], strict=True):
            some = by_bucket[a:b]
            chosen = kept[some]
            for column, value in zip(
                rows,
                (bucket[some[0]], key[text[chosen]], tie[text[chosen]], inside[chosen].astype(np.int32), n[chosen].astype(np.int32), compress(b"\n".join([strings[j] for j in some]))),
                strict=True,
            ):
                column.append(value)
        again = np.array(again, np.int64)
        if len(again):
            # Marks need no bucket of their own.
            spread = np.repeat(again, n[again])
            step = np.arange(len(spread)) - np.repeat(np.cumsum(n[again]) - n[again], n[again])
            marks = _runs(key[text[spread]], tie[text[spread]], inside[spread] + step)
            for column, value in zip(rows, (int(mix(key[:1].view(np.uint64))[0] % np.uint64(buckets)), *marks, None), strict=True):
                column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(rows, schema, strict=True)], schema=schema)


class _Bucket:
    """The strings of one bucket, and which of their windows are not the earliest of their kind."""

    def __init__(self, window: int) -> None:
        self.window, self.rows, self.size, self.spilled = window, [], 0, False
        self.expand = zstandard.ZstdDecompressor().decompress

    def add(self, row: dict) -> Iterator[pa.RecordBatch]:
        raw = self.expand(row["packed"])
        self.rows.append((raw, row["keys"], row["ties"], row["starts"]))
        self.size += len(raw)
        if self.size > BUCKET_BYTES:
            yield from self.singly()

    def _windows(self):
        """All words, and per window its first word, key, tie and start."""
        raw = b"\n".join(r[0] for r in self.rows)
        data = np.frombuffer(raw, np.uint8)
        breaks = np.flatnonzero(data == 0x0A)
        offsets = np.concatenate([[0], breaks + 1, [len(raw)]])  # a break ends its string, as white space
        strings = pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(raw))
        words = Words(strings)
        begins, string = windows_in(words.counts, self.window)
        keys = np.concatenate([r[1] for r in self.rows])
        ties = np.concatenate([r[2] for r in self.rows])
        starts = np.concatenate([r[3] for r in self.rows]).astype(np.int64)
        return raw, words, begins, keys[string], ties[string], starts[string] + begins - words.first[string]

    def singly(self) -> Iterator[pa.RecordBatch]:
        """The windows held so far, each as hashes of its words; nothing is held after."""
        _, words, begins, keys, ties, starts = self._windows()
        hashes = words.hashes()
        w1 = window_hashes(hashes, self.window)[begins].view(np.int64)
        w2 = window_hashes(mix(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5)), self.window)[begins].view(np.int64)
        self.rows, self.size, self.spilled = [], 0, True
        for i in range(0, len(begins), 100_000):
            s = slice(i, i + 100_000)
            yield _marks(keys[s], ties[s], starts[s].astype(np.int32), np.ones(len(keys[s]), np.int32), w1[s], w2[s])

    def finish(self) -> Iterator[pa.RecordBatch]:
        if not self.rows:
            return
        if self.spilled:
            yield from self.singly()
            return
        raw, words, begins, keys, ties, starts = self._windows()
        hashes = window_hashes(words.hashes(), self.window)[begins]
        order = np.argsort(hashes)
        same = hashes[order][1:] == hashes[order][:-1]
        twice = np.zeros(len(order), bool)
        twice[1:] |= same
        twice[:-1] |= same
        chosen = order[twice]
        chosen = chosen[np.lexsort((starts[chosen], ties[chosen], keys[chosen]))]
        earliest: dict[bytes, tuple[int, int, int]] = {}
        later = np.zeros(len(chosen), bool)
        at, end = words.starts[begins[chosen]].tolist(), words.ends[begins[chosen] + self.window - 1].tolist()
        for i, (s, e, place) in enumerate(zip(at, end, zip(*(x[chosen].tolist() for x in (keys, ties, starts)), strict=True), strict=True)):
            later[i] = earliest.setdefault(raw[s:e], place) != place
        yield _marks(*_runs(*(x[chosen[later]] for x in (keys, ties, starts))))


def _marks(keys, ties, starts, n, w1=None, w2=None) -> pa.RecordBatch:
    none = pa.nulls(len(keys), pa.int64())
    return pa.RecordBatch.from_arrays(
        [pa.array(keys, pa.int64()), pa.array(ties, pa.int64()), pa.array(starts, pa.int32()), pa.array(n, pa.int32()), none if w1 is None else pa.array(w1), none if w2 is None else pa.array(w2)],
        ["key", "tie", "start", "n", "w1", "w2"],
    )


def _compared(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by bucket; those of a bucket that is not brought together say so in ``apart``."""
    number, held = None, _Bucket(window)
    for batch in batches:
        for i in range(batch.num_rows):
            row = {
                "keys": batch.column("keys")[i].values.to_numpy(),
                "ties": batch.column("ties")[i].values.to_numpy(),
                "starts": batch.column("starts")[i].values.to_numpy(),
                "counts": batch.column("counts")[i].values.to_numpy(),
                "packed": batch.column("packed")[i].as_py(),
            }
            if row["packed"] is None:
                yield _marks(row["keys"], row["ties"], row["starts"], row["counts"])
                continue
            if batch.column("apart")[i].as_py() is not None:
                alone = _Bucket(window)
                yield from alone.add(row)
                if alone.rows:
                    yield from alone.singly()
                continue
            if (bucket := batch.column("bucket")[i].as_py()) != number:
                yield from held.finish()
                number, held = bucket, _Bucket(window)
            yield from held.add(row)
    yield from held.finish()


def documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc, text, key, tie``: the key as a whole number, null as ``NULL_KEY``, and what tells apart texts under one key."""
    rows = docs.select(F.col(key).alias("doc"), F.col(text).alias("text"), F.coalesce(F.col(key).cast("long"), F.lit(NULL_KEY)).alias("key"))
    shared = pin(rows.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1))
    found = lookup(rows, broadcast_if_small(shared), ["key"])
    return found.select("doc", "text", "key", F.when(F.col("_n").isNull(), F.lit(0)).otherwise(F.xxhash64("text")).cast("long").alias("tie"))


def repeated_windows(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, minimiser: int = MINIMISER) -> DataFrame:
    """``key, tie, runs``: per document the starts (and lengths) of runs of windows whose words also start earlier."""
    return _repeated(documents(docs, key, text), window, minimiser)


def _dealt(docs: DataFrame, window: int, minimiser: int, buckets: int) -> DataFrame:
    """Packed strings by bucket; those of an overfull bucket have a number of their own in ``apart``."""
    counted = docs.select("text").mapInArrow(lambda b: _bucket_bytes(b, window, minimiser, buckets), "bucket long, bytes long")
    overfull = pin(counted.groupBy("bucket").agg(F.sum("bytes").alias("bytes")).where(F.col("bytes") > BUCKET_BYTES))
    packed = docs.mapInArrow(lambda b: _packed(b, window, minimiser, buckets), PACKED)
    row = F.xxhash64(F.col("keys")[0], F.col("ties")[0], F.col("starts")[0])
    return lookup(packed, broadcast_if_small(overfull), ["bucket"]).withColumn("apart", F.when(F.col("bytes").isNotNull(), row)).drop("bytes")


def _repeated(docs: DataFrame, window: int, minimiser: int = MINIMISER) -> DataFrame:
    spark = docs.sparkSession
    plain = docs.select("key", "tie", "text")
    size = plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(shuffle_partitions(spark), -(-3 * size // TASK_BYTES))
    buckets = max(parts, -(-3 * size // AIM_BYTES))

    dealt = _dealt(plain, window, minimiser, buckets).repartition(parts, "bucket", "apart").sortWithinPartitions("bucket")
    found = pin(dealt.mapInArrow(lambda b: _compared(b, window), MARKS))

    single = found.where(F.col("w1").isNotNull())
    earliest = single.groupBy("w1", "w2").agg(F.min(F.struct("key", "tie", "start")).alias("_first"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
    later = lookup(single, earliest.drop("_n"), ["w1", "w2"], "inner").where(F.struct("key", "tie", "start") != F.col("_first"))
    marks = found.where(F.col("w1").isNull()).select("key", "tie", "start", "n").unionByName(later.select("key", "tie", "start", "n"))
    return marks.groupBy("key", "tie").agg(F.collect_set(F.struct("start", "n")).alias("runs"))  # no longer than the text


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """``key, n_words, n_removed, kept, kept_sha256``: every text without the words that a later equal window covers.

    ``kept`` are the words left, joined by one space.
    """
    kind = docs.schema[key].dataType.simpleString()
    named = documents(docs, key, text)
    marked = lookup(named, _repeated(named, window), ["key", "tie"]).select("doc", "text", "runs")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            words = Words(batch.column("text"))
            joined, at, end = words.joined()
            lists = batch.column("runs")
            removed, kept = np.zeros(batch.num_rows, np.int64), []
            valid = pc.is_valid(lists).to_numpy(zero_copy_only=False)
            for i in range(batch.num_rows):
                a, b = int(words.first[i]), int(words.first[i + 1])
                if not valid[i]:
                    kept.append(joined[at[a] : end[b - 1]] if b > a else b"")
                    continue
                run = lists[i].values
                first, n = run.field("start").to_numpy().astype(np.int64), run.field("n").to_numpy().astype(np.int64)
                edge = np.zeros(b - a + 1, np.int64)
                np.add.at(edge, np.minimum(first, b - a), 1)
                np.add.at(edge, np.minimum(first + n + window - 1, b - a), -1)
                gone = np.cumsum(edge[:-1]) > 0
                removed[i] = gone.sum()
                stays = np.diff(np.concatenate([[True], gone, [True]]).astype(np.int8))
                spans = zip(np.flatnonzero(stays == -1) + a, np.flatnonzero(stays == 1) + a, strict=True)
                kept.append(b" ".join(joined[at[s] : end[e - 1]] for s, e in spans))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc"),
                    pa.array(words.counts.astype(np.int64)),
                    pa.array(removed),
                    pa.array([k.decode() for k in kept], pa.string()),
                    pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
                ],
                ["doc", "n_words", "n_removed", "kept", "kept_sha256"],
            )

    out = marked.mapInArrow(cut, f"doc {kind}, n_words long, n_removed long, kept string, kept_sha256 string")
    return out.withColumnRenamed("doc", key)
