"""Text scores from a bigram model with deleted interpolation.

    p(w | v) = a2(b) c(v w) / c(v) + a1(b) c(w) / N + a0(b) / (V + 1),    b = bucket of c(v)

mixes maximum-likelihood estimates; the weights of each bucket of context frequencies (powers of
two) are learned by expectation-maximisation on counts that were held out of the estimates: part of
the training texts is counted apart, and for the weights its counts are taken off again.

Work goes by blocks of about 4 MB of text.  A block counts its own distinct words and bigrams
and sends each once, so a word that is everywhere is one entry a block; keys are grouped by range of
their 64-bit hash, summed, and the sums go back to the blocks that asked, in the order in which they
asked.  Nothing is broadcast but the weights.  All tables in between are written to the shared folder.
Words and bigrams are told apart by their 64-bit hashes alone, so two of billions could be counted as one.

Defined cases: a null text is empty and has the end token alone; a null key counts as the empty string
in the split; without training texts every word is unknown and c(w) / N is 0; a bucket that the
held-out part never meets keeps equal weights or, with ``nearest``, takes those of the nearest one it
meets (contexts never seen, or where it meets none: equal weights).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.words import LOWER, SPACES, Words, mix, pieces, sum_by_text
from ledgerloom.session import checkpoint_dir

BLOCK = 4 << 20
KEY_BYTES = 4 << 20  # text whose keys one group is planned for
END = np.uint64(0x5BD1E9955BD1E995)
BUCKETS = 40  # of context frequency: 0, 1, 2-3, 4-7, ...
ROUNDS = 20
SETTLED = 1e-3

SENT = "part long, block long, keys binary, n binary, dev binary"
REPLY = "block long, part long, n binary, dev binary, tokens long, dev_tokens long, types long, rest_types long"


def _zip(values: np.ndarray) -> bytes:
    """Numbers as compressed byte planes."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unzip(raw: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _steps(keys: np.ndarray) -> np.ndarray:
    return np.diff(keys, prepend=np.uint64(0))


class Tokens:
    """The tokens of a block: words and one end a text, each with the token before it (an end, before the first)."""

    def __init__(self, raw: bytes, offsets: bytes) -> None:
        at = np.frombuffer(offsets, np.int32)
        data = zstandard.ZstdDecompressor().decompress(raw)
        words = Words(pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(offsets), pa.py_buffer(data)), SPACES, LOWER)
        self.token = np.insert(words.hashes(), words.first[1:], END)
        self.counts = words.counts + 1
        self.first = np.concatenate([[0], np.cumsum(self.counts)])
        before = np.concatenate([[END], self.token[:-1]]).astype(np.uint64)
        self.words, self.word = np.unique(self.token, return_inverse=True)
        self.bigrams, self.bigram = np.unique(mix(before * np.uint64(0x9E3779B97F4A7C15) + self.token), return_inverse=True)
        # Every token but an end is the context of the next one, and an end that of the first.
        self.context = np.concatenate([[np.searchsorted(self.words, END)], self.word[:-1]])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    compress = zstandard.ZstdCompressor(level=1).compress
    task, number = TaskContext.get().partitionId(), 0
    for batch in pieces(batches, "text", BLOCK):
        dev = batch.column("dev").to_numpy(zero_copy_only=False)
        for wanted in (False, True):
            some = batch.filter(pa.array(dev == wanted))
            if not some.num_rows:
                continue
            texts = pa.array(some.column("text").fill_null("").to_pylist(), pa.string())
            _, offsets, data = texts.buffers()
            at = np.frombuffer(offsets, np.int32)[: len(texts) + 1]
            raw = data.to_pybytes()[: at[-1]] if data is not None else b""
            whole = pa.array([0, len(texts)], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([(task << 32) + number], pa.int64()),
                    pa.array([wanted]),
                    pa.ListArray.from_arrays(whole, some.column("key")),
                    pa.ListArray.from_arrays(whole, some.column("held_out")),
                    pa.array([at.tobytes()], pa.binary()),
                    pa.array([compress(raw)], pa.binary()),
                ],
                ["block", "dev", "keys", "held_out", "offsets", "texts"],
            )
            number += 1


def _asked(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """The distinct words (parts below 2**bits) and bigrams (from there on) of each block, with their counts."""
    for batch in batches:
        for i in range(batch.num_rows):  # one block's bytes in Python at a time
            row = batch.slice(i, 1).to_pylist()[0]
            tokens = Tokens(row["texts"], row["offsets"])
            learned = np.repeat(~np.array(row["held_out"], bool), tokens.counts)
            columns: list[list] = [[], [], [], [], []]
            for base, keys, which in ((0, tokens.words, tokens.word), (1 << bits, tokens.bigrams, tokens.bigram)):
                n = np.bincount(which, weights=learned, minlength=len(keys)).astype(np.uint32)
                dev = n if row["dev"] else np.zeros_like(n)
                part = (keys >> np.uint64(64 - bits)).astype(np.int64)
                cuts = np.flatnonzero(np.diff(part, prepend=-1))
                for a, b in zip(cuts, [*cuts[1:], len(keys)], strict=True):
                    value = (base + int(part[a]), row["block"], _zip(_steps(keys[a:b])), _zip(n[a:b]), _zip(dev[a:b]))
                    for column, v in zip(columns, value, strict=True):
                        column.append(v)
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["part", "block", "keys", "n", "dev"])


def _summed(sent: pa.Table, bits: int) -> pa.Table:
    """Counts over all blocks, sent back to each block in the order of its keys; one more row has the part's totals."""
    part = sent["part"][0].as_py()
    keys = [np.cumsum(_unzip(k, np.uint64), dtype=np.uint64) for k in sent["keys"].to_pylist()]
    every, which = np.unique(np.concatenate(keys), return_inverse=True)
    n, dev = (
        np.bincount(which, weights=np.concatenate([_unzip(x, np.uint32) for x in sent[c].to_pylist()]), minlength=len(every)).astype(np.uint64)
        for c in ("n", "dev")
    )
    cuts = np.cumsum([len(k) for k in keys])[:-1]
    rows = [
        {"block": block, "part": part, "n": _zip(n[w]), "dev": _zip(dev[w]), "tokens": None, "dev_tokens": None, "types": None, "rest_types": None}
        for block, w in zip(sent["block"].to_pylist(), np.split(which, cuts), strict=True)
    ]
    if part < 1 << bits:
        totals = {"tokens": int(n.sum()), "dev_tokens": int(dev.sum()), "types": int((n > 0).sum()), "rest_types": int((n > dev).sum())}
        rows.append({"block": None, "part": part, "n": None, "dev": None, **totals})
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), *[pa.int64()] * 4]
    names = ["block", "part", "n", "dev", "tokens", "dev_tokens", "types", "rest_types"]
    return pa.table([pa.array([r[c] for r in rows], k) for c, k in zip(names, kinds, strict=True)], names=names)


def _answered(tokens: Tokens, replies: pa.Table, bits: int, column: str) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the block's words and of its bigrams."""
    replies = replies.sort_by("part")
    of_words = replies["part"].to_numpy() < 1 << bits
    raw = [_unzip(x, np.uint64) for x in replies[column].to_pylist()]
    words = np.concatenate([r for r, w in zip(raw, of_words, strict=True) if w])
    bigrams = np.concatenate([r for r, w in zip(raw, of_words, strict=True) if not w])
    return words.astype(np.float64), bigrams.astype(np.float64)


def frequency_bucket(counts: np.ndarray) -> np.ndarray:
    """0 for 0, then one bucket for each power of two."""
    return np.minimum(np.frexp(counts)[1], BUCKETS - 1)


class Model(NamedTuple):
    path: str
    bits: int
    tokens: int  # N
    types: int  # V
    weights: np.ndarray  # a row per bucket: bigram, word, uniform


def learn(docs: DataFrame, held_out: Column, dev: Column, key: str = "doc_id", text: str = "text", nearest: bool = False) -> Model:
    """Count the texts that ``held_out`` does not name, and learn the weights on those of them that ``dev`` names."""
    spark = docs.sparkSession
    path = f"{checkpoint_dir(spark)}/language-model-{uuid.uuid4().hex}"
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), held_out.alias("held_out"), (dev & ~held_out).alias("dev"))
    schema = f"block long, dev boolean, keys array<{kind}>, held_out array<boolean>, offsets binary, texts binary"
    rows.mapInArrow(_blocks, schema).write.parquet(f"{path}/blocks")
    blocks = spark.read.parquet(f"{path}/blocks")

    size = blocks.agg(F.sum(F.octet_length("texts"))).first()[0] or 0
    bits = max(4, int(-(-2 * size // KEY_BYTES)).bit_length())
    sent = blocks.mapInArrow(lambda b: _asked(b, bits), SENT)
    sent.groupBy("part").applyInArrow(lambda t: _summed(t, bits), REPLY).write.parquet(f"{path}/replies")
    replies = spark.read.schema(REPLY).parquet(f"{path}/replies")

    sums = replies.where(F.col("block").isNull()).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens", "dev_tokens", "types", "rest_types")])
    total = sums.first()
    weights, met = _weights(blocks, replies, bits, path, total)
    weights = nearest_weights(weights, met) if nearest else weights
    return Model(path, bits, total.tokens, total.types, weights)


def _weights(blocks: DataFrame, replies: DataFrame, bits: int, path: str, total) -> tuple[np.ndarray, list[int]]:
    """Expectation-maximisation over the held-out tokens, in buckets of their context's frequency elsewhere; the buckets met."""

    def estimated(block: pa.Table, answers: pa.Table) -> pa.Table:
        row = block.to_pylist()[0]
        tokens = Tokens(row["texts"], row["offsets"])
        words, bigrams = (a - b for a, b in zip(_answered(tokens, answers, bits, "n"), _answered(tokens, answers, bits, "dev"), strict=True))
        counts = np.stack([bigrams[tokens.bigram], words[tokens.context], words[tokens.word]]).astype(np.int64)
        order = np.lexsort(counts)
        counts = counts[:, order]
        first = np.flatnonzero(np.any(np.diff(counts, axis=1, prepend=-1) != 0, axis=0))
        n = np.diff(np.append(first, counts.shape[1]))
        return pa.table([*counts[:, first], n], names=["both", "context", "word", "n"])

    dev = blocks.where("dev")
    asked = replies.join(dev.select("block"), "block", "left_semi")
    found = dev.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(estimated, "both long, context long, word long, n long")
    rest = max(total.tokens - total.dev_tokens, 1)
    bucket = F.when(F.col("context") == 0, 0).otherwise(F.floor(F.log2("context")) + 1).cast("int")
    estimates = found.groupBy(
        F.least(bucket, F.lit(BUCKETS - 1)).alias("bucket"),
        F.coalesce(F.try_divide("both", "context"), F.lit(0.0)).alias("p2"),
        (F.col("word") / F.lit(rest)).alias("p1"),
    ).agg(F.sum("n").alias("n"))
    estimates.write.parquet(f"{path}/held-out")
    estimates = blocks.sparkSession.read.parquet(f"{path}/held-out")

    weights, met = np.full((BUCKETS, 3), 1 / 3), []
    p0 = 1 / (total.rest_types + 1)
    for _ in range(ROUNDS):
        a2, a1, a0 = (F.element_at(F.array(*[F.lit(float(x)) for x in weights[:, j]]), F.col("bucket") + 1) for j in range(3))
        shares = estimates.select("bucket", "n", (a2 * F.col("p2")).alias("q2"), (a1 * F.col("p1")).alias("q1"), (a0 * p0).alias("q0"))
        p = F.col("q2") + F.col("q1") + F.col("q0")
        sums = shares.groupBy("bucket").agg(*[F.sum(F.col("n") * F.col(q) / p).alias(q) for q in ("q2", "q1", "q0")]).collect()
        new = weights.copy()
        for r in sums:
            got = np.array([r.q2, r.q1, r.q0]) + 1e-3  # so that no weight becomes 0
            new[r.bucket] = got / got.sum()
        met = [r.bucket for r in sums]
        change = np.abs(new - weights).max()
        weights = new
        if change < SETTLED:
            break
    return weights, met


def nearest_weights(weights: np.ndarray, met: list[int]) -> np.ndarray:
    """The weights, those of a bucket that is not ``met`` from the nearest that is, the lower of two.

    Full counts are higher than those the weights were learned on, so the most frequent contexts
    can reach a bucket above all that were met.
    """
    learned = sorted(b for b in met if b)  # contexts never seen have no bigrams, so they are like no other bucket
    out = weights.copy()
    for b in range(1, len(weights)):
        if learned and b not in learned:
            out[b] = weights[min(learned, key=lambda m: (abs(m - b), m))]
    return out


def score(spark, model: Model, key: str = "doc_id", kind: str = "bigint") -> DataFrame:
    """``key, held_out, n_tokens, n_known, base_score, score`` of every text the model was given, learned from or not.

    ``score`` is the model's log10 probability; ``base_score`` that of single words with one added to each count.
    """
    blocks, replies = spark.read.parquet(f"{model.path}/blocks"), spark.read.schema(REPLY).parquet(f"{model.path}/replies")

    def scored(block: pa.Table, answers: pa.Table) -> pa.Table:
        row = block.to_pylist()[0]
        tokens = Tokens(row["texts"], row["offsets"])
        words, bigrams = _answered(tokens, answers, model.bits, "n")
        context, word, both = words[tokens.context], words[tokens.word], bigrams[tokens.bigram]
        a = model.weights[frequency_bucket(context)]
        p = a[:, 0] * both / np.maximum(context, 1) + a[:, 1] * word / max(model.tokens, 1) + a[:, 2] / (model.types + 1)
        base = np.log10((word + 1) / (model.tokens + model.types + 1))
        texts = np.repeat(np.arange(len(tokens.counts)), tokens.counts)
        return pa.table(
            [
                pa.array(row["keys"], block.schema.field("keys").type.value_type),
                pa.array(row["held_out"], pa.bool_()),
                pa.array(tokens.counts.astype(np.int64)),
                pa.array(sum_by_text((word > 0).astype(np.int64), tokens.first)),
                pa.array(np.bincount(texts, weights=base, minlength=len(tokens.counts))),
                pa.array(np.bincount(texts, weights=np.log10(p), minlength=len(tokens.counts))),
            ],
            names=["key", "held_out", "n_tokens", "n_known", "base_score", "score"],
        )

    schema = f"key {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    asked = replies.where(F.col("block").isNotNull())
    return blocks.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(scored, schema).withColumnRenamed("key", key)


def score_texts(
    docs: DataFrame, key: str = "doc_id", text: str = "text", split: int = 7, held_out: int = 2, dev: int = 3, nearest: bool = False
) -> DataFrame:
    """Scores of all texts, learning from those whose CRC-32 of the key modulo ``split`` is not ``held_out``.

    The weights are learned on those whose remainder is ``dev``; ``nearest`` says which a bucket takes that they never meet.
    """
    rest = F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % split
    model = learn(docs, rest == held_out, rest == dev, key, text, nearest)
    found = score(docs.sparkSession, model, key, docs.schema[key].dataType.simpleString())
    return found.withColumn("train_tokens", F.lit(model.tokens).cast("long"))
