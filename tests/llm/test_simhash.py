from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash

from ledgerloom.llm import simhash
from ledgerloom.llm.components import connected_components


def grouped(nodes, pairs):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {n: root(n) for n in nodes}


def brute_fingerprint(text: str) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(len(words) - 3, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def brute(rows):
    marked = [(key, brute_fingerprint(text or "")) for key, text in rows]
    fps = sorted({fp for _, fp in marked})
    group = grouped(fps, [(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if (a ^ b).bit_count() <= 4])
    least = {}
    for key, fp in marked:
        if key is not None:
            least[group[fp]] = min(least.get(group[fp], key), key)
    return sorted((key is None, key or 0, format(fp, "016x"), least.get(group[fp])) for key, fp in marked)


def test_components_of_whole_texts(with_null_key):
    rows = [(r.doc_id, r.text) for r in with_null_key.collect()]
    found = simhash.near_duplicates(with_null_key).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.fingerprint, r.component_id) for r in found) == brute(rows)
    assert len({r.component_id for r in found}) < len({r.doc_id for r in found}) - 5


def test_every_pair_within_the_distance_meets_at_an_anchor():
    rng = np.random.default_rng(2)
    fps = rng.integers(0, 1 << 63, 2000, dtype=np.uint64) * np.uint64(2)
    near = fps.copy()
    for i in range(len(near)):
        for bit in rng.choice(64, size=i % 5, replace=False):
            near[i] ^= np.uint64(1) << np.uint64(bit)
    at, who, home = simhash.anchors(fps, 4)
    other_at, other_who, _ = simhash.anchors(near, 4)
    homes = {(int(w), int(a)) for a, w, h in zip(at, who, home, strict=True) if h}
    assert len(homes) == 3 * len(fps)
    everywhere = set(zip(other_who.tolist(), other_at.tolist(), strict=True))
    met = {w for w, a in homes if (w, a) in everywhere}
    assert met == set(range(len(fps)))


@pytest.fixture
def small_batches(spark):
    """Groups of an anchor that go on over many batches."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "13")
    yield
    spark.conf.set(name, before)


def test_groups_over_many_batches(spark, monkeypatch, small_batches):
    monkeypatch.setattr(simhash, "HOMES_PER_SLICE", 7)
    links_and_pairs(spark)


@pytest.mark.parametrize("homes_per_slice", [4096, 7])
def test_links_join_a_large_group_of_near_copies(spark, monkeypatch, homes_per_slice):
    """Anchors dealt out in slices."""
    monkeypatch.setattr(simhash, "HOMES_PER_SLICE", homes_per_slice)
    links, pairs = links_and_pairs(spark)
    assert len(links) < len(pairs)


def links_and_pairs(spark):
    """Fingerprints a few bits around one another, some only reachable through others: links and pairs connect the same."""
    rng = random.Random(4)
    centre = rng.getrandbits(64)
    fps = {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for _ in range(250)} | {rng.getrandbits(64) for _ in range(150)}
    fps = sorted(fps)
    pairs = [(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if (a ^ b).bit_count() <= 4]
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    found = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long").repartition(3)).collect()
    links = [(r.a & (1 << 64) - 1, r.b & (1 << 64) - 1) for r in found]
    assert all((a ^ b).bit_count() >= 1 for a, b in links)
    assert grouped(fps, links) == grouped(fps, pairs)
    return links, pairs


def test_components_of_long_chains_and_a_hot_node(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 260)] + [(9, 9), (300, 301), (301, 300)]
    found = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted(map(tuple, found)) == [(i, 100) for i in range(101, 161)] + [(i, 7) for i in range(200, 260)] + [(301, 300)]


def test_one_document_of_each_group_stays(messy, with_null_key, nothing):
    stays = simhash.one_per_group(messy)
    assert stays.columns == messy.columns
    component = {r.doc_id: r.component_id for r in simhash.near_duplicates(messy).collect()}
    assert sorted(r.doc_id for r in stays.collect()) == sorted(set(component.values()))
    rows = simhash.one_per_group(with_null_key).collect()
    assert sum(r.doc_id is None for r in rows) == 2
    assert simhash.near_duplicates(nothing).collect() == []
    assert simhash.one_per_group(nothing).collect() == []
