from __future__ import annotations

import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import spelling
from ledgerloom.llm.spelling import counted_words, number_trie, spelling_groups


def near(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) - len(a) == 1 and any(a == b[:i] + b[i + 1 :] for i in range(len(b)))


def brute(counts: dict[str, int], ratio: int = 10) -> list[tuple]:
    form, rows = {}, []
    for w, n in counts.items():
        around = [v for v in counts if near(w, v)]
        best = min(around, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * n else None
        rows.append([w, n, len(around), form[w], counts.get(form[w])])
    for row in rows:
        root = row[0]
        while form[root]:
            root = form[root]
        row.append(root)
    return sorted(map(tuple, rows), key=str)


def groups(spark, counts, **options):
    df = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    return sorted(map(tuple, spelling_groups(df, **options).collect()), key=str)


@pytest.mark.parametrize("seed", range(6))
def test_against_comparing_all_words(spark, seed):
    rng = random.Random(seed)
    alphabet = ["ab", "abcé", "aàÿz"][seed % 3]
    counts = {"".join(rng.choices(alphabet, k=rng.randint(1, 7))): int(10 ** rng.uniform(0, 5)) for _ in range(250)}
    assert groups(spark, counts) == brute(counts)


def test_runs_of_a_letter_and_long_words(spark):
    counts = {"a" * k: 10 ** (k % 4) for k in range(1, 9)} | {"b" * 4000: 5, "b" * 3999: 500, "b" * 2000 + "c" + "b" * 1999: 6}
    assert groups(spark, counts) == brute(counts)


def test_chains_of_forms_end_at_the_last(spark):
    counts = {"abcdefg" + "h" * k: 10**k for k in range(9)}
    rows = groups(spark, counts)
    assert rows == brute(counts) and {r[5] for r in rows} == {"abcdefg" + "h" * 8}


def test_a_common_beginning_and_a_common_end(spark):
    """All words in one branch of either trie, over many ranges."""
    rng = random.Random(1)
    counts = {"counter" + "".join(rng.choices("xyz", k=4)) + "revolution": rng.randint(1, 300) for _ in range(70)}
    assert groups(spark, counts) == brute(counts)


def test_trie_nodes_are_numbered_once(spark):
    rng = random.Random(2)
    words = {"".join(rng.choices("abc", k=rng.randint(1, 6))) for _ in range(300)}
    df = spark.createDataFrame([(w,) for w in words], "word string")
    nodes, places = {}, {}
    for r in number_trie(df, "word", "path", "place").collect():
        places[r.word] = r.place
        assert len(r.path) == len(r.word) + 1
        for i, node in enumerate(r.path):
            assert nodes.setdefault(r.word[:i], node) == node
    assert sorted(nodes.values()) == list(range(len(nodes)))
    assert [w for w, _ in sorted(places.items(), key=lambda p: p[1])] == sorted(words)


def test_repeated_null_and_empty_words(spark, nothing):
    rows = [("abcdefg", 1, "x"), ("abcdefg", 2, "y"), ("abcdefgh", 40, None), (None, 5, None), ("", 9, None)]
    df = spark.createDataFrame(rows, "word string, n long, path string")
    assert sorted(map(tuple, spelling_groups(df).collect()), key=str) == brute({"abcdefg": 3, "abcdefgh": 40})
    assert spelling_groups(df.limit(0)).collect() == []
    assert counted_words(nothing).collect() == []


def expected_counts(rows) -> dict[str, int]:
    out: dict[str, int] = {}
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                out[run] = out.get(run, 0) + 1
    return out


def test_counts_of_messy_texts(spark, with_null_key):
    rng = random.Random(3)
    texts = [(i, " ".join(rng.choices(["Straßenbahn", "ÉCOLEécoleX", "internationality", "seventy7seventy", "ab×cd÷efg"], k=80))) for i in range(40)]
    more = spark.createDataFrame(texts, "doc_id long, text string")
    docs = with_null_key.select("doc_id", "text", F.lit(1).alias("word"), F.lit(2).alias("n")).unionByName(more, allowMissingColumns=True)
    found = {r.word: r.n for r in counted_words(docs, alter=spelling.one_in_31).collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert found == expected_counts(rows)
    plain = {r.word: r.n for r in counted_words(docs).collect()}
    assert plain != found and plain["internationality"] > 0
