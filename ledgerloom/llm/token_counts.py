"""Token counts by a two-tier lookup, without a shuffle of pre-tokens.

A text's pre-tokens are looked up in a broadcast table of frequent pre-tokens and their
lengths; the others go through a cache in each worker, and only what that has not seen
is encoded.  Both tiers hold what the tokenizer library itself gave for the pre-token, so
neither the sample behind the table nor the size of a cache can change a count.

Cutting a text is exact because the library's pattern never lets a pre-token run from a
non-space into a space.  Which characters are letters or spaces is only assumed where that
is beyond doubt: texts with other characters are cut at ASCII spaces alone, and texts
with unusual spaces or special-token strings go to the library whole.

Defined cases: a null text counts as empty (0 tokens); repeated rows are counted each.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.words import pieces, text_array

FREQUENT = 50_000  # entries of the broadcast table; with MAX_CHARS its bound is about 8 MB
MAX_CHARS = 64  # longer pre-tokens are not put into the table or a cache
SAMPLE_TEXTS = 2_000  # texts whose pre-tokens fill the table
CACHE_ENTRIES = 200_000  # of one worker; emptied when full

# The published byte-level pattern over characters of certain kind.
_LETTER = r"A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F"
_SPACE = r"\x20\x09-\x0D"
PRE_TOKEN = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[0-9]+| ?[^{_SPACE}{_LETTER}0-9]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
)
CHUNK = re.compile(rf"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")
UNCERTAIN = re.compile(r"[^\x00-\x7f\u00C0-\u024F]|[\x1c-\x1f]")
ODD_SPACE = re.compile(r"[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u2064\u3000\ufeff]")


class Cutter:
    """Texts to independent parts whose token counts add up."""

    def __init__(self, special: list[str]) -> None:
        self.special = [s for s in special if s]

    def cut(self, text: str) -> list[str]:
        if any(s in text for s in self.special) or ODD_SPACE.search(text):
            return [text]
        return (CHUNK if UNCERTAIN.search(text) else PRE_TOKEN).findall(text)


class Encoder:
    """The library's tokenizer in one worker."""

    _loaded: dict[str, Encoder] = {}

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.cutter = Cutter([t.content for t in self.tokenizer.get_added_tokens_decoder().values()])
        self.cache: dict[str, int] = {}

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def lengths(self, parts: list[str]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]

    def learn(self, parts: set[str]) -> dict[str, int]:
        """Lengths of the parts, from the cache where it has them."""
        if len(self.cache) > CACHE_ENTRIES:
            self.cache.clear()
        known = {p: self.cache[p] for p in parts if p in self.cache}
        new = [p for p in parts if p not in known]
        found = dict(zip(new, self.lengths(new), strict=True)) if new else {}
        self.cache.update((p, n) for p, n in found.items() if len(p) <= MAX_CHARS)
        return known | found


def frequent_lengths(docs: DataFrame, path: str, text: str = "text", entries: int = FREQUENT, sample_texts: int = SAMPLE_TEXTS) -> dict[str, int]:
    """The most frequent pre-tokens of about ``sample_texts`` random texts and their lengths."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Encoder.of(path).cutter
        for batch in pieces(batches, text):
            seen = Counter(p for t in text_array(batch.column(text)).to_pylist() for p in cutter.cut(t) if len(p) <= MAX_CHARS)
            yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["part", "n"])

    total = docs.count()
    sample = docs.select(text).sample(min(1.0, 1.5 * sample_texts / max(total, 1)), seed=7).limit(2 * sample_texts)
    top = sample.mapInArrow(counted, "part string, n long").groupBy("part").agg(F.sum("n").alias("n"))
    parts = [r.part for r in top.orderBy(F.desc("n"), "part").limit(entries).collect()]
    return dict(zip(parts, Encoder.of(path).lengths(parts), strict=True))


def count_tokens(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", frequent: dict[str, int] | None = None) -> DataFrame:
    """``key, n_bytes, n_tokens`` of every whole text under the tokenizer file ``path``.

    ``frequent`` is a table of pre-token lengths to broadcast; by default that of a sample.
    """
    if frequent is None:
        frequent = frequent_lengths(docs, path, text)
    table: Broadcast = docs.sparkSession.sparkContext.broadcast(frequent)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, encoder = table.value.get, Encoder.of(path)
        for batch in pieces(batches, text):
            texts = text_array(batch.column(text))
            totals, missed = [], []
            for t in texts.to_pylist():
                parts = encoder.cutter.cut(t)
                found = list(map(first, parts))
                totals.append(sum(filter(None, found)))
                missed.append([p for p, n in zip(parts, found, strict=True) if n is None])
            second = encoder.learn({p for parts in missed for p in parts})
            n_tokens = [n + sum(map(second.__getitem__, parts)) for n, parts in zip(totals, missed, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), pc.binary_length(texts).cast(pa.int64()), pa.array(n_tokens, pa.int64())], [key, "n_bytes", "n_tokens"]
            )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(counted, f"`{key}` {kind}, n_bytes long, n_tokens long")
