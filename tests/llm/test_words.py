from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm import words as w

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aAbZé \n\t\x1f9|", max_size=30)), max_size=6)


def lower_az(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_words_are_those_of_the_pattern(texts):
    expected = [re.findall(r"[^\x20\x09-\x0D]+", lower_az(t or "")) for t in texts]
    found = w.Words(pa.array(texts, pa.string()), w.SPACES, w.LOWER)
    data = found.data.tobytes()
    assert [data[a:b].decode() for a, b in zip(found.starts, found.ends, strict=True)] == [x for e in expected for x in e]
    assert found.counts.tolist() == [len(e) for e in expected]
    joined, starts, ends = found.joined()
    flat = [x for e in expected for x in e]
    assert joined.decode() == " ".join(flat)
    assert [joined[a:b].decode() for a, b in zip(starts, ends, strict=True)] == flat
    by_word = dict(zip(flat, found.hashes().tolist(), strict=True))
    assert found.hashes().tolist() == [by_word[x] for x in flat]
    assert len(set(by_word.values())) == len(by_word)


@settings(max_examples=100, deadline=None)
@given(TEXTS)
def test_alphanumeric_words(texts):
    expected = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower_az(t or "")) for t in texts]
    found = w.Words(pa.array(texts, pa.string()), w.NOT_ALPHANUMERIC, w.LOWER)
    assert found.counts.tolist() == [len(e) for e in expected]


def test_a_slice_of_an_array_and_a_word_longer_than_a_hashing_step():
    column = pa.array(["skip me", "a" * 3_000_000 + " b", "b"], pa.string()).slice(1)
    found = w.Words(column)
    assert found.counts.tolist() == [2, 1]
    hashes = found.hashes()
    assert hashes[1] == hashes[2] != hashes[0]


def test_windows_and_coverage():
    starts, texts = w.windows_in(np.array([3, 0, 1, 4]), 3)
    assert starts.tolist() == [0, 4, 5] and texts.tolist() == [0, 3, 3]
    assert w.covered(np.array([1]), 2, 4).tolist() == [False, True, True, False]
    hashes = np.array([5, 6, 7, 5, 6, 7], np.uint64)
    windows = w.window_hashes(hashes, 3)
    assert windows[0] == windows[3] and len(set(windows.tolist())) == 3
    assert w.sum_by_text(np.array([1, 2, 3]), np.array([0, 0, 2, 3])).tolist() == [0, 3, 3]


def test_pieces_hold_every_row_once():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * n for n in (5, 0, 50, 3, 3)]), pa.array(range(5))], ["t", "i"])
    cut = list(w.pieces(iter([batch, batch.slice(0, 0)]), "t", 10))
    assert [i for p in cut for i in p.column("i").to_pylist()] == [0, 1, 2, 3, 4]
    assert len(cut) > 1
