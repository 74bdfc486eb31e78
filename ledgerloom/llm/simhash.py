"""SimHash near-duplicates by anchor-point covering.

Two fingerprints that differ in at most ``distance`` of 64 bits differ in at most a third of
that in one of three bands.  In each band the code words of a covering code are anchors:
15 of its bits carry the perfect Hamming code, the others are taken as they are, so every value
has one nearest anchor, its home, at most one bit away.  A fingerprint is replicated to every
anchor within the covering radius plus the band's threshold.  Whatever lies within the
threshold of a fingerprint then meets it at its home, where the whole fingerprints are
compared.

Only distinct fingerprints are replicated, so exact copies cost one.  An anchor with many
homes is dealt out in slices of its homes; a task holds the homes of one slice and lets the members pass by.  What an anchor hands on are not its pairs but
a spanning tree of them: links for the components, no more than it has members.

Defined cases: null and empty texts have the fingerprint zero, linked like any other; a null
key keeps its row, and its component is the smallest key it reaches (null if it reaches none).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.components import connected_components
from ledgerloom.llm.words import LOWER, SPACES, Words, pieces
from ledgerloom.operators.lookups import lookup
from ledgerloom.session import pin

SHINGLE = 4
DISTANCE = 4
SEED = 42
BANDS = ((0, 22), (22, 21), (43, 21))  # first bit and width
CODED = 15  # bits of a band under the Hamming code: 2**4 - 1
RADIUS = 1  # its covering radius
HOMES_PER_SLICE = 4096
PAIRS_AT_ONCE = 1 << 21
SHINGLES_AT_ONCE = 1 << 18


def fingerprint(hashes: np.ndarray) -> int:
    """The bits set in over half of the 64-bit hashes."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), SHINGLES_AT_ONCE):
        some = hashes[i : i + SHINGLES_AT_ONCE].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(some, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``key, fp``: the SimHash of every text over its word shingles, as a signed 64-bit number."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        for batch in pieces(batches, text):
            words = Words(batch.column(text), SPACES, LOWER)
            joined, starts, ends = words.joined()
            out = np.zeros(batch.num_rows, np.uint64)
            for i in np.flatnonzero(words.counts):
                a, b = words.first[i], words.first[i + 1]
                last = min(shingle, b - a) - 1
                spans = zip(starts[a : b - last].tolist(), ends[a + last : b].tolist(), strict=True)
                out[i] = fingerprint(np.fromiter((digest(joined[s:e], SEED) for s, e in spans), np.uint64, b - a - last))
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(out.view(np.int64))], [key, "fp"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(hashed, f"`{key}` {kind}, fp long")


def _syndromes() -> np.ndarray:
    """Of every value of the coded bits: the exclusive-or of the places (from 1) of its ones."""
    out = np.zeros(1 << CODED, np.int64)
    for place in range(CODED):
        out ^= np.where(np.arange(1 << CODED) >> place & 1, place + 1, 0)
    return out


def _masks(width: int, radius: int) -> list[np.ndarray]:
    """Per syndrome, the bit patterns of at most ``radius`` ones that lead from such a value to an anchor."""
    values = [0]
    for _ in range(radius):
        values = sorted({v ^ bit for v in values for bit in [0, *(1 << i for i in range(width))]})
    every = np.array(values, np.int64)
    of = _syndromes()[every & ((1 << CODED) - 1)]
    return [every[of == s] for s in range(CODED + 1)]


def anchors(fps: np.ndarray, distance: int, homes_only: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor numbers, the fingerprint number at each, and whether it is the fingerprint's home."""
    syndromes, radius = _syndromes(), RADIUS + distance // len(BANDS)
    at, who, home = [], [], []
    for band, (first, width) in enumerate(BANDS):
        value = (fps.view(np.uint64) >> np.uint64(first)).astype(np.int64) & ((1 << width) - 1)
        syndrome = syndromes[value & ((1 << CODED) - 1)]
        nearest = value ^ np.where(syndrome > 0, 1 << np.maximum(syndrome - 1, 0), 0)
        if homes_only:
            at.append(nearest | band << 32)
            who.append(np.arange(len(fps)))
            home.append(np.ones(len(fps), bool))
            continue
        for s, masks in enumerate(_masks(width, radius)):
            rows = np.flatnonzero(syndrome == s)
            places = (value[rows][:, None] ^ masks[None, :]).ravel()
            at.append(places | band << 32)
            who.append(np.repeat(rows, len(masks)))
            home.append(places == np.repeat(nearest[rows], len(masks)))
    return np.concatenate(at), np.concatenate(who), np.concatenate(home)


def spanning_tree(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what the pairs (a, b) connect: each node to the smallest of its component."""
    nodes, both = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = both[: len(a)], both[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        while not np.array_equal(shorter := new[new], new):
            new = shorter
        new = np.minimum(new, new[label])
        if np.array_equal(new, label):
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def _close_pairs(fps: np.ndarray, home: np.ndarray, group: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a home and a member of the same group (rows sorted by group) that differ in few bits."""
    begins = np.flatnonzero(np.diff(group, prepend=group[0] - 1))
    sizes = np.diff([*begins, len(group)])
    number = np.cumsum(np.diff(group, prepend=group[0]) != 0)
    homes = np.flatnonzero(home)
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    each = sizes[number[homes]]
    part = (np.cumsum(each) - each) // PAIRS_AT_ONCE
    for p in np.unique(part):
        some = homes[part == p]
        n = sizes[number[some]]
        left = np.repeat(some, n)
        right = np.repeat(begins[number[some]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        near = (np.bitwise_count(fps[left] ^ fps[right]) <= distance) & (fps[left] != fps[right])
        a.append(fps[left[near]].view(np.int64))
        b.append(fps[right[near]].view(np.int64))
        if sum(map(len, a)) > PAIRS_AT_ONCE:
            a, b = ([x] for x in spanning_tree(np.concatenate(a), np.concatenate(b)))
    return np.concatenate(a), np.concatenate(b)


def links(distinct: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """``a, b``: links between the distinct fingerprints ``fp`` that join all within ``distance``."""
    spark = distinct.sparkSession

    def home_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, _, _ = anchors(batch.column("fp").to_numpy(), distance, homes_only=True)
            yield pa.RecordBatch.from_arrays([pa.array(at)], ["anchor"])

    def replicas(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column("fp").to_numpy()
            for i in range(0, len(fps), 20_000):
                some = fps[i : i + 20_000]
                at, who, home = anchors(some, distance)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(some[who]), pa.array(home)], ["anchor", "fp", "home"])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Homes come before the other members of their group, so of a group that goes on only these are held.
        open_key, held = -1, np.zeros(0, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            key, fp = batch.column("key").to_numpy(), batch.column("fp").to_numpy()
            home = batch.column("home").to_numpy(zero_copy_only=False)
            if key[0] == open_key:
                key, fp = np.concatenate([np.full(len(held), open_key), key]), np.concatenate([held, fp])
                home = np.concatenate([np.ones(len(held), bool), home])
            a, b = _close_pairs(fp.view(np.uint64), home, key, distance)
            tree = spanning_tree(a, b) if len(a) else (a, b)
            yield pa.RecordBatch.from_arrays(list(map(pa.array, tree)), ["a", "b"])
            last = int(np.searchsorted(key, key[-1]))
            open_key, held = key[-1], fp[last:][home[last:]]

    homes = distinct.mapInArrow(home_anchors, "anchor long").groupBy("anchor").count().where(F.col("count") > HOMES_PER_SLICE)
    slices = homes.select("anchor", F.ceil(F.col("count") / HOMES_PER_SLICE).cast("int").alias("slices"))
    dealt = (
        distinct.mapInArrow(replicas, "anchor long, fp long, home boolean")
        .join(slices, "anchor", "left")
        .withColumn("slice", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("slices"), F.lit(1)) - 1)))
        .withColumn("home", F.col("home") & (F.pmod(F.xxhash64("fp"), F.coalesce("slices", F.lit(1))) == F.col("slice")))
    )
    # One number per anchor and slice; at the bound of 2**24 slices an anchor would have 2**36 homes.
    keyed = dealt.select((F.col("anchor") + F.col("slice").cast("long") * (1 << 36)).alias("key"), "fp", "home")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return keyed.repartition(parts, "key").sortWithinPartitions("key", F.desc("home")).mapInArrow(compared, "a long, b long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """``key, fingerprint, component_id`` of every row of ``docs``.

    ``fingerprint`` is in 16 hex digits; ``component_id`` the smallest key reachable over links, the row's own included.
    """
    marked = pin(fingerprints(docs, key, text, shingle))
    by_fp = pin(marked.groupBy("fp").agg(F.min(key).alias("least")))
    member = connected_components(links(by_fp.select("fp"), distance)).select(F.col("node").alias("fp"), "label")
    # The smallest fingerprint of a component labels it and is none of its nodes.
    linked = member.unionByName(member.select(F.col("label").alias("fp"), "label").distinct())
    with_least = linked.join(by_fp, "fp")
    least = with_least.groupBy("label").agg(F.min("least").alias("component_id"))
    of_linked = lookup(with_least.select("fp", "label"), least, ["label"]).select("fp", "component_id")
    of_fp = by_fp.join(of_linked, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    fingerprint_hex = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return lookup(marked, of_fp, ["fp"]).select(key, fingerprint_hex.alias("fingerprint"), "component_id")


def one_per_group(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """The rows of ``docs`` without those whose group has a smaller key.

    Rows without a key stay: nothing can name them.  Rows repeated under one key are one document and stay together.
    """
    found = near_duplicates(docs, key, text, shingle, distance)
    gone = found.groupBy(key).agg(F.max(F.col(key) == F.col("component_id")).alias("_stays")).where("not _stays").select(key)
    return docs.join(gone, key, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
