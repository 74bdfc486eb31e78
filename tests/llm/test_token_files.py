from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerloom.llm import token_files

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def expected(rows):
    tokenizer, start, out = Tokenizer.from_file(WORD_BPE), 0, []
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@pytest.fixture(scope="module")
def written(spark, with_null_key, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tokens") / "files")
    token_files.write_tokens(with_null_key, path, WORD_BPE)
    return path


def test_documents_read_back(spark, with_null_key, written):
    found = token_files.read_documents(spark, written).collect()
    assert sorted(map(tuple, found), key=str) == sorted(expected([(r.doc_id, r.text) for r in with_null_key.collect()]), key=str)


def test_words_are_encoded_as_the_library_encodes_texts():
    rng = random.Random(8)
    alphabet = [*"abXYZ019 .,'!\n\t\r|<>-_éßñÉ×÷", "ſ", "K", "İ", "Σ", "ς", "中", "́", " ", " ", "　", "\x1c", "\x85", "​", "🙂"]
    alphabet += ["<|endoftext|>", "<|startoftext|>", "'s", "'RE", " 'll", "  ", "<|ENDOFTEXT|>", "é.", "a,", "é", "É!", "…", "×,"]
    alphabet += [*"&$%*#@+=~^/()[]{}\"`\\", "&&&", "a$$$", "÷)", "=\u0338", "zß(", "ab", "ÿ", "µ", "ª"]
    encoder = token_files.WordEncoder.of(WORD_BPE)
    for _ in range(3000):
        texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 12))) for _ in range(3)]
        ids, n = encoder.encode(pa.array(texts), 1)
        whole = [[*encoder.tokenizer.encode(t, add_special_tokens=False).ids, 1] for t in texts]
        assert ids.tolist() == sum(whole, []) and n.tolist() == [len(w) for w in whole], texts


def test_full_cache_changes_nothing(monkeypatch):
    texts = pa.array(["one two three", "four five one", "two six"])
    whole = token_files.WordEncoder(WORD_BPE).encode(texts, 1)[0].tolist()
    monkeypatch.setattr(token_files, "CACHE_WORDS", 1)
    small = token_files.WordEncoder(WORD_BPE)
    assert [small.encode(texts, 1)[0].tolist() for _ in range(3)] == [whole] * 3


def test_perfect_hash_is_minimal_and_knows_its_keys():
    rng = np.random.default_rng(1)
    a, b = (rng.integers(0, 1 << 63, 5000, dtype=np.uint64) for _ in range(2))
    built = token_files.PerfectHash.of_rows(token_files.PerfectHash.build(a, b).to_rows())
    assert sorted(built.numbers(a, b).tolist()) == list(range(5000))
    assert len(built.numbers(b, a)) == 5000
    with pytest.raises(ValueError, match="same hashes"):
        token_files.PerfectHash.build(a[[0, 0]], b[[0, 0]])


def test_ids_by_key(spark, messy, written):
    tokenizer = Tokenizer.from_file(WORD_BPE)
    texts = {r.doc_id: r.text or "" for r in messy.collect()}
    asked = spark.createDataFrame([(0, 0), (41, 0), (72, 0), (72, 1), (999_999, 0), (12, 0)], "key long, nth int")
    found = {r.key: r.ids for r in token_files.read_ids(asked, written).collect()}
    assert found == {k: [*tokenizer.encode(texts[k], add_special_tokens=False).ids, 1] for k in (0, 41, 72, 12)}


def test_unknown_keys_are_told_by_their_fingerprint(spark, written):
    strangers = spark.range(10_000, 30_000).select(F.col("id").alias("key"), F.lit(0).alias("nth"))
    assert token_files.find(strangers, written).count() == 0


def test_lookup_opens_the_folders_of_its_keys(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "KEYS_PER_BUCKET", 8)
    path = str(tmp_path / "files")
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.concat(F.lit("word "), F.col("id")).alias("text")).repartition(8)
    token_files.write_tokens(docs, path, WORD_BPE)
    assert len(list((tmp_path / "files" / "index").glob("slice=*/*.parquet"))) == 64  # of 250 buckets; a file each
    asked = spark.createDataFrame([(i, 0) for i in range(0, 2000, 400)], "key long, nth int")
    pruned = token_files.index_rows(spark, path, [3, 40])
    assert {r[0].split("slice=")[1].split("/")[0] for r in pruned.select(F.input_file_name()).distinct().collect()} == {"3", "40"}
    plan = token_files.find(asked, path)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [slice" in plan and "PartitionFilters: [slice" not in token_files.find(asked, path, prune=False)._jdf.queryExecution().executedPlan().toString()
    tokenizer = Tokenizer.from_file(WORD_BPE)
    ids = {k: [*tokenizer.encode(f"word {k}", add_special_tokens=False).ids, 1] for k in range(2000)}
    assert {r.key: r.ids for r in token_files.read_ids(asked, path).collect()} == {k: ids[k] for k in range(0, 2000, 400)}
    monkeypatch.setattr(token_files, "MOST_NAMED", 2)  # more folders than are named: all are read
    everything = spark.range(2000).select(F.col("id").alias("key"), F.lit(0).alias("nth"))
    assert {r.key: r.ids for r in token_files.read_ids(everything, path).collect()} == ids


def test_another_order(spark, messy, tmp_path):
    path = str(tmp_path / "files")
    token_files.write_tokens(messy, path, WORD_BPE, order_by=[F.col("doc_id").desc()])
    found = {r.doc_id: r.start for r in token_files.read_documents(spark, path).collect()}
    assert sorted(found, key=found.get) == sorted(found, reverse=True)


def test_nothing_written(spark, nothing, tmp_path):
    path = str(tmp_path / "files")
    token_files.write_tokens(nothing, path, WORD_BPE)
    assert token_files.read_documents(spark, path).collect() == []
