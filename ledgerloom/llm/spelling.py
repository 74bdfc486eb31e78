"""Spelling variants by a dictionary of trie-node pairs.

The words stand in two tries, one read forwards and one read backwards, whose nodes are numbered.  A word
cut at any place is then a pair of whole numbers, the node of its beginning and the node of its end:

* two words of one length that differ in one letter share the pair that skips that letter in both;
* a word without a letter that another has shares, as it is, the pair that skips the letter in the other.

So equal pairs give exactly the words one inserted, deleted or replaced letter apart, without comparing letters.
A pair names one string at most and is skipped into by one word per letter of the alphabet at most, which
bounds every group, however many words there are.  A letter inside a run of equal letters is skipped at the
run's start only when a whole word is met, so no two words meet twice.

A trie is numbered where its words lie: in sorted order a word adds the nodes below what it shares with the word before.
Words are dealt out by ranges of that order, each range is numbered by itself, and a row per range - its first and last
word and the nodes of the last - tells where the next one goes on.

Defined cases: a null text has no words, a null key reads as empty; a null or empty word is none; a word
listed twice counts as one with the sum of its counts; other columns are not looked at.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.words import LOWER, pieces, text_array
from ledgerloom.operators.lookups import lookup
from ledgerloom.session import pin, shuffle_partitions

# The asked-for letters, lengths and ratio.
LETTERS = "a-zÀ-ÿ"  # after lower-casing A-Z
LEAST_LETTERS = 7
LEAST_COUNT = 2
RATIO = 10
DIVISOR = 31

WHOLE, SKIPPED, SKIPPED_INSIDE = 0, 1, 2  # how a word came to a pair


def one_in_31(key: str) -> Callable[[str], str]:
    """Delete one letter of every run whose CRC-32 together with the key is divisible by 31."""
    begun = zlib.crc32(f"{key}:".encode())

    def alter(run: str) -> str:
        h = zlib.crc32(run.encode(), begun)
        if h % DIVISOR:
            return run
        at = h % len(run)
        return run[:at] + run[at + 1 :]

    return alter


def counted_words(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    least_letters: int = LEAST_LETTERS,
    alter: Callable[[str], Callable[[str], str]] | None = None,
) -> DataFrame:
    """``word, n``: the runs of letters of all whole texts, A-Z lower-cased, and how often each occurs.

    ``alter(key)`` gives what a run of that row becomes; it may keep or shorten runs.  Words of fewer than
    ``least_letters`` are left out.
    """
    runs = re.compile(f"[{LETTERS}]{{{least_letters},}}")
    folded = LOWER.tobytes()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            total: Counter[str] = Counter()
            texts = text_array(batch.column("text")).cast(pa.binary())
            for name, raw in zip(batch.column("key").to_pylist(), texts, strict=True):
                found = Counter(runs.findall(raw.as_py().translate(folded).decode()))
                if alter is None:
                    total.update(found)
                    continue
                change = alter(name)
                for run, n in found.items():
                    total[change(run)] += n
            kept = [(w, n) for w, n in total.items() if len(w) >= least_letters]
            yield pa.RecordBatch.from_arrays(
                [pa.array([w for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], ["word", "n"]
            )

    read = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.col(text).alias("text"))
    return read.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def shared(a: str, b: str) -> int:
    """How many letters both begin with."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return next(i for i in range(n) if a[i] != b[i])


def _goes_on(ranges: list) -> list[tuple[int, int, int, int, list[int]]]:
    """Per range: letters its first word shares with the word before the range, what is added to its own node
    numbers and to its places, and the nodes of the shared letters.  The root is node 0."""
    out, last, path, nodes, words = [], "", [], 1, 0
    for r in sorted(ranges, key=lambda r: r._range):
        same = shared(last, r.first)
        known = path[:same]
        out.append((r._range, same, nodes - same, words, known))
        path = [known[x] if x < same else x + nodes - same for x in r.path]
        last, nodes, words = r.last, nodes + r.made - same, words + r.n_words
    return out


def number_trie(words: DataFrame, word: str, path: str, place: str) -> DataFrame:
    """Add the numbers of the trie nodes from the root to each word, ``path``, and its place in sorted order.

    ``words`` has distinct words.  Node 0 is the root.
    """
    spark, names = words.sparkSession, words.columns

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, nodes, made, at = "", [], 0, 0
        for batch in batches:
            ends, flat, added, places = [0], [], [], []
            for w in batch.column(word).to_pylist():
                same = shared(last, w)
                new = len(w) - same
                nodes = [*nodes[:same], *range(made, made + new)]
                flat += nodes
                ends.append(len(flat))
                added.append(new)
                places.append(at)
                last, made, at = w, made + new, at + 1
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, lists, pa.array(added, pa.int64()), pa.array(places, pa.int64())], [*batch.schema.names, path, "_made", place]
            )

    dealt = words.repartitionByRange(shuffle_partitions(spark), word).sortWithinPartitions(word)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in words.schema)
    numbered = dealt.mapInArrow(walk, f"{schema}, `{path}` array<long>, _made long, `{place}` long")
    inside = pin(numbered.withColumn("_range", F.spark_partition_id()))
    end = F.max_by(F.struct(F.col(word).alias("last"), F.col(path).alias("path")), place)
    ranges = (
        inside.groupBy("_range")
        .agg(F.min_by(word, place).alias("first"), end.alias("end"), F.sum("_made").alias("made"), F.count(F.lit(1)).alias("n_words"))
        .select("_range", "first", "end.*", "made", "n_words")
    )
    # A row per range of the writer, not per word.
    begun = spark.createDataFrame(_goes_on(ranges.collect()), "_range int, _same long, _shift long, _before long, _known array<long>")
    whole = F.transform(path, lambda x: F.when(x < F.col("_same"), F.get("_known", x.cast("int"))).otherwise(x + F.col("_shift")))
    return inside.join(F.broadcast(begun), "_range").select(
        *names, F.concat(F.array(F.lit(0).cast("bigint")), whole).alias(path), (F.col(place) + F.col("_before")).alias(place)
    )


def _pairs() -> Column:
    """All pairs of a word with its nodes ``path`` and ``back``: whole at every place, and with every letter skipped."""
    length = F.size("letters")

    def cut(i: Column, skip: int, how: Column) -> Column:
        return F.struct(F.get("path", i).alias("p"), F.get("back", length - skip - i).alias("s"), how.alias("how"))

    repeated = F.lit(SKIPPED_INSIDE)
    whole = F.transform(F.sequence(F.lit(0), length), lambda i: cut(i, 0, F.lit(WHOLE)))
    skipped = F.transform(
        "letters", lambda letter, i: cut(i, 1, F.when(letter == F.get("letters", i - 1), repeated).otherwise(F.lit(SKIPPED)))
    )
    return F.concat(whole, skipped)


def near_words(numbered: DataFrame) -> DataFrame:
    """``place, n_near, best``: how many words are near, and the place and count of the most frequent of them.

    ``numbered`` has ``word, n, path, back, place``; words without a near one are not in the result.
    """
    lettered = numbered.select("place", "n", "path", "back", F.split("word", "").alias("letters"))
    pairs = lettered.select("place", "n", F.explode(_pairs()).alias("e")).select("e.p", "e.s", "place", "n", "e.how")
    # Nearly all pairs have one word; they go before anything is gathered.
    meet = pairs.withColumn("_here", F.count(F.lit(1)).over(Window.partitionBy("p", "s"))).where("_here > 1")
    # The most frequent first, then the first in order.
    member = F.struct("n", (-F.col("place")).alias("back_place"), "how")
    groups = meet.groupBy("p", "s").agg(F.sort_array(F.collect_list(member), asc=False).alias("all"))
    parts = groups.select(
        F.filter("all", lambda m: m["how"] == WHOLE).alias("whole"),
        F.filter("all", lambda m: m["how"] != WHOLE).alias("skipped"),
        F.filter("all", lambda m: m["how"] == SKIPPED).alias("met"),
    )

    def first(members: Column, n: int = 0) -> Column:
        return F.get(members, F.lit(n))

    def answer(m: Column, near: Column, best: Column) -> Column:
        chosen = F.struct(best["n"].alias("n"), best["back_place"].alias("back_place"))
        return F.struct((-m["back_place"]).alias("place"), near.cast("long").alias("near"), F.when(best.isNotNull(), chosen).alias("best"))

    def of_skipped(m: Column, i: Column) -> Column:
        other = F.when(i == 0, first(F.col("skipped"), 1)).otherwise(first(F.col("skipped")))
        inside = m["how"] == SKIPPED_INSIDE
        # The word that is whole here is near, and shorter by the letter; array_max passes over nulls.
        best = F.array_max(F.array(other, F.when(~inside, first(F.col("whole")))))
        return answer(m, F.size("skipped") - 1 + F.when(inside, 0).otherwise(F.size("whole")), best)

    answers = F.concat(
        F.transform("skipped", of_skipped), F.transform("whole", lambda m: answer(m, F.size("met"), first(F.col("met"))))
    )
    return (
        parts.select(F.explode(answers).alias("a"))
        .select("a.*")
        .where("near > 0")
        .groupBy("place")
        .agg(F.sum("near").alias("n_near"), F.max("best").alias("best"))
        .select("place", "n_near", F.struct((-F.col("best.back_place")).alias("place"), F.col("best.n").alias("n")).alias("best"))
    )


def _to_the_last(links: DataFrame, ratio: int) -> DataFrame:
    """Add ``last`` to links ``place, form``: where following the links from each form ends.

    Counts grow by the ratio at every link, so the greatest count bounds how many follow each other; each round
    doubles how far a row sees.
    """
    greatest = links.agg(F.max("form_n")).first()[0] or 1
    most = max(1, math.ceil(math.log(greatest, ratio)) + 1) if ratio > 1 else greatest
    rows = links.withColumn("last", F.col("form"))
    for _ in range(math.ceil(math.log2(most))):
        following = rows.select(F.col("place").alias("last"), F.col("last").alias("_next"))
        rows = pin(lookup(rows, following, ["last"]).withColumn("last", F.coalesce("_next", "last")).drop("_next"))
    return rows


def spelling_groups(words: DataFrame, word: str = "word", n: str = "n", ratio: int = RATIO) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` of every word: the words one letter apart are its near words.

    The form is the near word of greatest count (ties: the first in code-point order) if its count is at least
    ``ratio`` times the word's, else null; the root is where the forms of forms end, the word itself if it has none.
    ``ratio`` is above 1.
    """
    if ratio <= 1:
        raise ValueError("forms must be more frequent than their words")
    listed = words.select(F.col(word).alias("word"), F.col(n).alias("n")).where("word <> ''").groupBy("word").agg(F.sum("n").alias("n"))
    forward = number_trie(pin(listed), "word", "path", "place").withColumn("reversed", F.reverse("word"))
    numbered = number_trie(forward, "reversed", "back", "_back_place").drop("reversed", "_back_place")
    near = pin(near_words(numbered))

    known = numbered.select("place", "word", "n")
    links = pin(
        lookup(known, near.where(F.col("best").isNotNull()), ["place"], "inner")
        .where(F.col("best.n") >= F.col("n") * ratio)
        .select("place", F.col("best.place").alias("form"), F.col("best.n").alias("form_n"))
    )
    spelled = known.select(F.col("place").alias("form"), F.col("word").alias("form_word"))
    named = lookup(_to_the_last(links, ratio), spelled, ["form"])
    named = lookup(named, spelled.select(F.col("form").alias("last"), F.col("form_word").alias("last_word")), ["last"])
    found = lookup(known, near.select("place", "n_near"), ["place"])
    found = lookup(found, named.select("place", "form_n", "form_word", "last_word"), ["place"])
    return found.select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
        F.col("form_word").alias("form"),
        "form_n",
        F.coalesce("last_word", "word").alias("root"),
    )
