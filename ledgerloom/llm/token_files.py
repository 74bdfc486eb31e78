"""Token ids as binary shards with a minimal perfect hash index.

``shards`` is a Parquet table of one row per shard (about 4 MB of text): the raw
little-endian ids of its documents one after another, their keys and their lengths.  Shards follow
each other in the asked-for order, so a document's first id has a place in one long sequence.

``index`` maps a key to its shard and offset.  Keys are dealt to buckets by hash; a bucket is a
minimal perfect hash function - levels of bit arrays, in each of which a key that shares its
place with no other is settled - over dense arrays of fingerprints, shards and offsets.  A
lookup opens the folders of the buckets that its keys fall in (at most 64 buckets to a folder, whatever the number of
documents) and reads one place of each array; the stored fingerprint tells keys that were never written.
Ids are then read from the shards of those places.  A lookup of keys in very many folders reads all of them
instead, with the same result.  ``about`` holds the number of buckets.

Rows of one key must be neighbours in the order (they are, if it begins with the key); they
are told apart by their number among them, counted from 0.

Defined cases: a null text is empty and has the end id alone; null is a key; an empty table
gives empty tables.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm.words import LOWER, NOT_ALPHANUMERIC, SPACES, Words, mix, pieces, text_array
from ledgerloom.operators.lookups import lookup
from ledgerloom.session import pin

KEYS_PER_BUCKET = 4096
SLICE_BUCKETS = 64  # buckets in a folder of the index, at most
MOST_NAMED = 1000  # folders or parts that a lookup names to the scan; one that needs more reads all
GAMMA = 2  # places of a level for each key that is left
CACHE_WORDS = 400_000
CACHE_PARTS = 100_000

# The pre-tokens of the tokenizer's published pattern, in words of ASCII and lower-case Latin-1 letters.
LETTER = r"a-z\u00DF-\u00F6\u00F8-\u00FF"
PRE_TOKEN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[0-9]|[^0-9{LETTER}]+")
PLAIN = re.compile(rf"[\x21-\x7e{LETTER}]+")
# Bytes that byte-level tokenizers show as they are; the others follow from code point 256 on.
SHOWN = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTE_SIGNS = {b: chr(b) for b in SHOWN} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in SHOWN)}

# Marks that may close a word, where they are a pre-token of their own; not those that special tokens are written with.
CLOSING = np.zeros(256, bool)
CLOSING[[ord(c) for c in ".,;:!?&$%*#@+=~^/()[]{}-_"]] = True
ASCII_ALNUM = ~NOT_ALPHANUMERIC & (np.arange(256) < 0x80)
ASCII_LOWER = (np.arange(256) >= ord("a")) & (np.arange(256) <= ord("z"))
SIGNS = np.array([ord(BYTE_SIGNS.get(b, chr(b))) for b in range(256)], "<u2")  # what shows each byte, all below 2**16
SPACE_SIGN = BYTE_SIGNS[0x20]


def apart_from_closing_marks(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words with closing marks split off, and how many parts the words before each have.

    Only after an ASCII letter or digit or a Latin-1 letter, where the library splits too.
    """
    data, starts, ends = words.data, words.starts, words.ends
    core = ends.copy()
    for _ in range(8):
        more = (core > starts + 1) & CLOSING[data[core - 1]]
        if not more.any():
            break
        core -= more
    last, before = data[core - 1], data[np.maximum(core - 2, 0)]
    letter = (before == 0xC3) & (core - 2 >= starts) & (last != 0x97) & (last != 0xB7)
    split = (core < ends) & (ASCII_ALNUM[last] | letter)
    core = np.where(split, core, ends)
    at = np.flatnonzero(split) + 1
    upto = np.concatenate([[0], np.cumsum(1 + split)])
    return np.insert(starts, at, core[split]), np.insert(core, at, ends[split]), upto


def only_letters(words: Words, chosen: np.ndarray) -> np.ndarray:
    """Which of the chosen words hold letters of ``LETTER`` alone, and so are one pre-token."""
    data = words.data
    second = np.zeros(len(data), bool)  # second bytes of lower-case Latin-1 letters
    second[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x9F) & (data[1:] <= 0xBF) & (data[1:] != 0xB7)
    fine = ASCII_LOWER[data] | second
    fine[:-1] |= second[1:]
    upto = np.zeros(len(data) + 1, np.int64)
    np.cumsum(fine, out=upto[1:])
    starts, ends = words.starts[chosen], words.ends[chosen]
    return upto[ends] - upto[starts] == ends - starts


class WordEncoder:
    """A white-space-dropping tokenizer in one worker; ids of parts it has met stay in a bounded cache.

    The library drops white space and looks at nothing beyond it, so a text's ids are those of
    its words one after another.  A batch looks up each distinct word once, by its 64-bit hash.
    """

    _loaded: dict[str, WordEncoder] = {}

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self._forget()

    def _forget(self) -> None:
        self.number: dict[int, int] = {}
        self.parts: dict[str, list[int]] = {}
        self.starts, self.lengths = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, self.kind)

    @classmethod
    def of(cls, path: str) -> WordEncoder:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def _plain(self, word: str) -> list[int]:
        """Ids of a word of plain characters, by its pre-tokens."""
        out: list[int] = []
        for part in PRE_TOKEN.findall(word):
            ids = self.parts.get(part)
            if ids is None:
                shown = part if part.isascii() else part.encode().decode("latin-1").translate(BYTE_SIGNS)
                ids = self.parts[part] = [t.id for t in self.tokenizer.model.tokenize(shown)]
            out += ids
        return out

    def _letters(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[list[int]]:
        """Ids of words that are one pre-token each, of lower-case letters."""
        lengths = ends - starts + 1  # with a space after each
        upto = np.cumsum(lengths)
        at = np.arange(upto[-1]) - np.repeat(upto - lengths - starts, lengths)
        at[upto - 1] = 0
        shown = SIGNS[data[at]]
        shown[upto - 1] = ord(SPACE_SIGN)
        tokenize = self.tokenizer.model.tokenize
        return [[t.id for t in tokenize(word)] for word in shown[:-1].tobytes().decode("utf-16-le").split(SPACE_SIGN)]

    def _others(self, words: list[str]) -> list[list[int]]:
        """Ids of any words: by pre-tokens where all characters are plain, by the library where not."""
        if len(self.parts) > CACHE_PARTS:
            self.parts.clear()
        plain = [PLAIN.fullmatch(w) and not any(s in w for s in self.special) for w in words]
        rest = [w for w, p in zip(words, plain, strict=True) if not p]
        encoded = iter(self.tokenizer.encode_batch_fast(rest, add_special_tokens=False) if rest else ())
        return [self._plain(w.lower()) if p else next(encoded).ids for w, p in zip(words, plain, strict=True)]

    def _learn(self, hashes: np.ndarray, words: Words, chosen: np.ndarray) -> None:
        """Keep the ids of the chosen words, by their hashes."""
        starts, ends = words.starts[chosen], words.ends[chosen]
        simple = only_letters(words, chosen)
        order = np.concatenate([np.flatnonzero(simple), np.flatnonzero(~simple)])
        found = self._letters(words.data, starts[simple], ends[simple]) if simple.any() else []
        data = words.data.tobytes()
        found += self._others([data[a:b].decode() for a, b in zip(starts[~simple].tolist(), ends[~simple].tolist(), strict=True)])
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        self.number.update(zip(hashes[order].tolist(), range(len(self.number), len(self.number) + len(found)), strict=True))
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(found), self.kind, int(lengths.sum()))])

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each followed by the end id, and how many each text has."""
        column = text_array(texts)
        words = Words(column, SPACES, LOWER)
        if b"<|" in words.raw.tobytes():  # the library ignores case but for special tokens, and so may the cache where there are none
            words = Words(column)
        first = words.first
        words.starts, words.ends, upto = apart_from_closing_marks(words)
        hashes, at, which = np.unique(words.hashes(), return_index=True, return_inverse=True)
        if len(self.number) > CACHE_WORDS:
            self._forget()
        known = hashes.tolist()
        new = np.flatnonzero(np.fromiter((h not in self.number for h in known), bool, len(known)))
        if len(new):
            self._learn(hashes[new], words, at[new])
        numbers = np.fromiter(map(self.number.__getitem__, known), np.int64, len(known))[which]
        lengths = self.lengths[numbers]
        upto_ids = np.zeros(len(numbers) + 1, np.int64)
        np.cumsum(lengths, out=upto_ids[1:])
        ids = self.ids[np.repeat(self.starts[numbers] - upto_ids[:-1], lengths) + np.arange(upto_ids[-1])]
        ends = upto_ids[upto[first[1:]]]  # before the end ids are put in
        return np.insert(ids, ends, end_id), np.diff(ends, prepend=0) + 1


class PerfectHash:
    """Numbers 0..n-1 for n keys of two 64-bit hashes each."""

    def __init__(self, levels: list[np.ndarray]) -> None:
        self.levels = levels  # bits of each level
        self.before = np.cumsum([0, *(int(bits.sum()) for bits in levels)])
        self.ranks = [np.cumsum(bits) - bits for bits in levels]

    @staticmethod
    def _place(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(a + b * np.uint64(2 * level + 1)) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, a: np.ndarray, b: np.ndarray) -> PerfectHash:
        levels: list[np.ndarray] = []
        while len(a):
            if len(levels) > 200:
                raise ValueError("two keys have the same hashes")
            size = -(-GAMMA * len(a) // 8) * 8
            at = cls._place(a, b, len(levels), size)
            bits = np.bincount(at, minlength=size) == 1
            levels.append(bits)
            left = ~bits[at]
            a, b = a[left], b[left]
        return cls(levels)

    def numbers(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The number of each key; a key that was not built in gets any, or -1."""
        out = np.full(len(a), -1, np.int64)
        left = np.arange(len(a))
        for level, bits in enumerate(self.levels):
            at = self._place(a[left], b[left], level, len(bits))
            here = bits[at]
            out[left[here]] = self.before[level] + self.ranks[level][at[here]]
            left = left[~here]
        return out

    def to_rows(self) -> list[bytes]:
        return [np.packbits(bits).tobytes() for bits in self.levels]

    @classmethod
    def of_rows(cls, rows: list[bytes]) -> PerfectHash:
        return cls([np.unpackbits(np.frombuffer(r, np.uint8)).astype(bool) for r in rows])


def _stored(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Fingerprints of keys."""
    return (mix(b ^ (a >> np.uint64(7))) >> np.uint64(32)).astype(np.uint32)


def key_hashes(key: str, nth: str) -> list[Column]:
    return [F.xxhash64(F.col(key), F.col(nth)).alias("_a"), F.xxhash64(F.lit(7), F.col(nth), F.col(key)).alias("_b")]


def write_tokens(
    docs: DataFrame, path: str, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = 1, order_by: list[Column] | None = None
) -> None:
    """Encode every whole text with the tokenizer file and write ``path/shards`` and ``path/index``.

    The order is ascending by key, null first, unless ``order_by`` names another; rows of equal key by text.
    """
    spark = docs.sparkSession
    order = [*(order_by or [F.col(key)]), F.col(text)]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = docs.repartitionByRange(parts, *order[:-1]).sortWithinPartitions(*order).select(F.col(key).alias("key"), F.col(text).alias("text"))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = WordEncoder.of(tokenizer), TaskContext.get().partitionId()
        last, nth = object(), 0
        for chunk, batch in enumerate(pieces(batches, "text")):
            ids, n = encoder.encode(batch.column("text"), end_id)
            keys, numbers = batch.column("key").to_pylist(), []
            for k in keys:
                nth = nth + 1 if k == last else 0
                last = k
                numbers.append(nth)
            whole = pa.array([0, len(keys)], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()),
                    pa.array([chunk], pa.int32()),
                    pa.array([len(ids)], pa.int64()),
                    pa.ListArray.from_arrays(whole, batch.column("key")),
                    pa.ListArray.from_arrays(whole, pa.array(numbers, pa.int32())),
                    pa.ListArray.from_arrays(whole, pa.array(n, pa.int32())),
                    pa.array([encoder.kind.itemsize], pa.int32()),
                    pa.array([ids.tobytes()], pa.binary()),
                ],
                ["part", "chunk", "n_ids", "keys", "nth", "lengths", "id_bytes", "payload"],
            )

    kind = docs.schema[key].dataType.simpleString()
    schema = f"part int, chunk int, n_ids long, keys array<{kind}>, nth array<int>, lengths array<int>, id_bytes int, payload binary"
    dealt.mapInArrow(encoded, schema).write.option("compression", "zstd").parquet(f"{path}/shards")
    _write_index(spark, path)


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """``key, nth, part, chunk, offset, n``: the documents as the shards list them, ids not read."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                n = batch.column("lengths")[i].values
                lengths = n.to_numpy().astype(np.int64)
                same = np.ones(len(lengths), np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("keys")[i].values,
                        batch.column("nth")[i].values,
                        pa.array(same * batch.column("part")[i].as_py()),
                        pa.array(same * batch.column("chunk")[i].as_py()),
                        pa.array(np.cumsum(lengths) - lengths),
                        n,
                    ],
                    ["key", "nth", "part", "chunk", "offset", "n"],
                )

    shards = spark.read.parquet(f"{path}/shards").select("part", "chunk", "keys", "nth", "lengths")
    kind = shards.schema["keys"].dataType.elementType.simpleString()
    return shards.mapInArrow(spread, f"key {kind}, nth int, part int, chunk int, offset long, n int")


ENTRY = "levels array<binary>, stored binary, part binary, chunk binary, offset binary, n binary"
PLACES = {"part": "<i4", "chunk": "<i4", "offset": "<i8", "n": "<i4"}


def _dealt(rows: DataFrame, buckets: int) -> DataFrame:
    """The rows with their bucket, and the folder of it: a bucket each while there are few."""
    slices = max(min(buckets, SLICE_BUCKETS), -(-buckets // SLICE_BUCKETS))
    return rows.withColumn("bucket", F.pmod("_a", F.lit(buckets).cast("bigint"))).withColumn("slice", F.expr(f"bucket * {slices} div {buckets}"))


def _write_index(spark: SparkSession, path: str) -> None:
    listed = catalogue(spark, path).select(*key_hashes("key", "nth"), "part", "chunk", "offset", "n")
    buckets = max(1, -(-listed.count() // KEYS_PER_BUCKET))

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        a, b = rows["_a"].to_numpy().view(np.uint64), rows["_b"].to_numpy().view(np.uint64)
        function = PerfectHash.build(a, b)
        at = np.argsort(function.numbers(a, b))
        arrays = [rows[c].to_numpy()[at].astype(t).tobytes() for c, t in PLACES.items()]
        return pd.DataFrame(
            [[rows["slice"].iloc[0], rows["bucket"].iloc[0], function.to_rows(), _stored(a, b)[at].tobytes(), *arrays]],
            columns=["slice", "bucket", "levels", "stored", *PLACES],
        )

    # Dealt by folder, so that a folder is one file; buckets hold about as many keys each.
    built = _dealt(listed, buckets).repartition("slice").groupBy("slice", "bucket").applyInPandas(build, f"slice long, bucket long, {ENTRY}")
    built.write.partitionBy("slice").parquet(f"{path}/index")
    spark.range(1).select(F.lit(buckets).cast("bigint").alias("buckets")).write.parquet(f"{path}/about")


def _named(rows: DataFrame, column: str) -> list | None:
    """The values of the column, unless there are more than ``MOST_NAMED``."""
    found = [r[0] for r in rows.select(column).distinct().limit(MOST_NAMED + 1).collect()]
    return found if len(found) <= MOST_NAMED else None


def index_rows(spark: SparkSession, path: str, slices: list | None = None) -> DataFrame:
    """``bucket`` and its arrays, from the named folders or from all; other folders are not opened."""
    index = spark.read.schema(f"bucket long, {ENTRY}, slice long").parquet(f"{path}/index")
    return (index if slices is None else index.where(F.col("slice").isin(slices))).drop("slice")


def find(keys: DataFrame, path: str, key: str = "key", nth: str = "nth", prune: bool = True) -> DataFrame:
    """``key, nth, part, chunk, offset, n`` of the asked-for keys that were written, through the index.

    Without ``prune`` the whole index is read at once, which saves a look at the keys where most of it is wanted.
    """
    spark = keys.sparkSession
    buckets = spark.read.parquet(f"{path}/about").first()[0]
    kind = keys.schema[key].dataType.simpleString()
    schema = f"key {kind}, nth int, part int, chunk int, offset long, n int"

    def probe(asked: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(rows):
            return asked.iloc[:0][["key", "nth"]].assign(part=0, chunk=0, offset=0, n=0)
        row = rows.iloc[0]
        a, b = asked["_a"].to_numpy().view(np.uint64), asked["_b"].to_numpy().view(np.uint64)
        at = PerfectHash.of_rows(list(row["levels"])).numbers(a, b)
        known = (at >= 0) & (np.frombuffer(row["stored"], np.uint32)[at] == _stored(a, b))
        out = asked.loc[known, ["key", "nth"]].copy()
        for c, t in PLACES.items():
            out[c] = np.frombuffer(row[c], t)[at[known]]
        return out

    asked = keys.select(F.col(key).alias("key"), F.col(nth).cast("int").alias("nth")).distinct()
    dealt = _dealt(asked.select("key", "nth", *key_hashes("key", "nth")), buckets)
    index = index_rows(spark, path, _named(dealt, "slice") if prune else None)
    return dealt.drop("slice").groupBy("bucket").cogroup(index.groupBy("bucket")).applyInPandas(probe, schema)


def shard_starts(spark: SparkSession, path: str) -> DataFrame:
    """``part, chunk, first``: the ids of all shards before each shard."""
    sizes = spark.read.parquet(f"{path}/shards").select("part", "chunk", "n_ids")
    before = Window.unboundedPreceding, -1
    # One row per range partition of the writer, however many documents.
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("_n"))
    offsets = parts.select("part", F.coalesce(F.sum("_n").over(Window.orderBy("part").rowsBetween(*before)), F.lit(0)).alias("_before"))
    inside = F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("chunk").rowsBetween(*before)), F.lit(0))
    return sizes.withColumn("_inside", inside).join(offsets, "part").select("part", "chunk", (F.col("_before") + F.col("_inside")).alias("first"))


def digests(spark: SparkSession, path: str) -> DataFrame:
    """``part, chunk, offset, n_tokens, ids_crc32``: every document's ids in the raw payloads, as unsigned 32-bit numbers."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids = np.frombuffer(batch.column("payload")[i].as_buffer(), f"<u{batch.column('id_bytes')[i].as_py()}")
                lengths = batch.column("lengths")[i].values.to_numpy().astype(np.int64)
                raw = memoryview(ids.astype("<u4").tobytes())
                offsets = np.cumsum(lengths) - lengths
                sums = [zlib.crc32(raw[4 * o : 4 * (o + n)]) for o, n in zip(offsets.tolist(), lengths.tolist(), strict=True)]
                same = np.ones(len(lengths), np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(same * batch.column(c)[i].as_py()) for c in ("part", "chunk")]
                    + [pa.array(offsets), pa.array(lengths), pa.array(sums, pa.int64())],
                    ["part", "chunk", "offset", "n_tokens", "ids_crc32"],
                )

    shards = spark.read.parquet(f"{path}/shards").select("part", "chunk", "lengths", "id_bytes", "payload")
    return shards.mapInArrow(read, "part int, chunk int, offset long, n_tokens long, ids_crc32 long")


def read_documents(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """``key, start, n_tokens, ids_crc32`` of every document: found through the index, read from its payload."""
    found = find(catalogue(spark, path).select("key", "nth"), path, prune=False)
    placed = found.join(shard_starts(spark, path), ["part", "chunk"])
    read = lookup(placed, digests(spark, path), ["part", "chunk", "offset"], "inner")
    return read.select(F.col("key").alias(key), (F.col("first") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def read_ids(keys: DataFrame, path: str, key: str = "key", nth: str = "nth") -> DataFrame:
    """``key, nth, ids`` of the asked-for documents; the scan is told which shards are wanted."""
    spark = keys.sparkSession
    asked = find(keys, path, key, nth).groupBy("part", "chunk").agg(F.collect_list(F.struct("key", "nth", "offset", "n")).alias("asked"))
    asked = pin(asked)  # read for its parts, then joined
    shards = spark.read.parquet(f"{path}/shards").select("part", "chunk", "id_bytes", "payload")
    for column in ("part", "chunk"):
        if (wanted := _named(asked, column)) is not None:
            shards = shards.where(F.col(column).isin(wanted))
    kind = keys.schema[key].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids = np.frombuffer(batch.column("payload")[i].as_buffer(), f"<u{batch.column('id_bytes')[i].as_py()}")
                wanted = batch.column("asked")[i].values
                o, n = wanted.field("offset").to_pylist(), wanted.field("n").to_pylist()
                found = [ids[s : s + m].astype(np.int64) for s, m in zip(o, n, strict=True)]
                yield pa.RecordBatch.from_arrays([wanted.field("key"), wanted.field("nth"), pa.array(found, pa.list_(pa.int64()))], ["key", "nth", "ids"])

    return shards.join(asked, ["part", "chunk"]).select("id_bytes", "payload", "asked").mapInArrow(read, f"key {kind}, nth int, ids array<long>")
