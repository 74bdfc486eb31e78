"""The registered queries on the smallest tables: against SQL, and the pipeline against its stages by brute force."""

from __future__ import annotations

import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from ledgerloom.llm import mixing, toxicity
from ledgerloom.llm.queries import QUERIES
from ledgerloom.session import pin

from .test_decontamination import brute as contaminated
from .test_mixing import brute as mixed
from .test_simhash import brute as components
from .test_spelling import expected_counts as word_counts
from .test_spelling import near as is_near

SF_DIR = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF_DIR.exists(), reason="the given tables are not here")


@pytest.mark.parametrize("query", [q for q in QUERIES if q.sql], ids=lambda q: q.name)
def test_query_and_sql(spark, query):
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for name in ("documents", "benchmark", "labels", "pages"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    found = query.build(spark, str(SF_DIR))
    expected = connection.execute(query.sql)
    columns = [c[0] for c in expected.description]
    assert sorted(columns) == sorted(found.columns)
    assert sorted(map(str, (tuple(r) for r in found.select(columns).collect()))) == sorted(map(str, expected.fetchall()))


def test_mixing_of_unequal_sources_and_sql(spark):
    """Eight sources of very different sizes, row by row."""
    duckdb = pytest.importorskip("duckdb")
    documents = spark.range(30_000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 29 > 0 THEN concat('s', id % 29 % 7) END AS source")
    connection = duckdb.connect()
    connection.register("documents", documents.toArrow())
    query = next(q for q in QUERIES if q.name == "op4_source_mixing")
    expected = connection.execute(query.sql)
    columns = [c[0] for c in expected.description]
    assert sorted(map(tuple, mixing.schedule(documents).select(columns).collect()), key=str) == sorted(expected.fetchall(), key=str)


def test_names():
    assert [q.name.split("_")[0] for q in QUERIES] == [f"op{i}" for i in range(1, 14)]
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "benchmark_decontamination", "source_mixing", "token_output"]


def test_spelling_variants_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    counts = {w: n for w, n in word_counts(rows).items() if n >= 2}
    found = next(q for q in QUERIES if q.name == "op12_spelling_variants").build(spark, str(SF_DIR))
    by_length: dict[int, list[str]] = {}
    for w in counts:
        by_length.setdefault(len(w), []).append(w)
    expected = {}
    for w, n in counts.items():
        around = [v for k in (-1, 0, 1) for v in by_length.get(len(w) + k, []) if is_near(w, v)]
        best = min(around, key=lambda v: (-counts[v], v), default=None)
        form = best if best and counts[best] >= 10 * n else None
        expected[w] = (form, n, len(around), counts.get(form))
    roots = {}
    for w in expected:
        roots[w] = w
        while expected[roots[w]][0]:
            roots[w] = expected[roots[w]][0]
    assert sorted(map(str, (tuple(r) for r in found.collect()))) == sorted(str((w, f, roots[w], n, k, m)) for w, (f, n, k, m) in expected.items())
    assert any(f for f, *_ in expected.values())


def test_pipeline_against_brute_force(spark):
    sf_dir = str(SF_DIR)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    chain = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rejected = {r.doc_id for r in toxicity.score(docs, chain).collect() if r.rejected}
    rows = {r.doc_id: r for r in docs.collect()}

    left = {i: r.text or "" for i, r in rows.items() if i not in rejected}
    left = {i: left[i] for _, i, _, least in components(left.items()) if least == i}
    bad = contaminated(left, items)
    left = {i: t for i, t in left.items() if not bad[i][3]}
    order = mixed([(i, rows[i].source) for i in left], block_rows=mixing.BLOCK_ROWS, period=None)
    tokenizer, start, expected = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0, []
    for _, _, doc in sorted((slot, place, doc) for doc, _, _, place, _, _, slot in order):
        ids = [*tokenizer.encode(left[doc], add_special_tokens=False).ids, 1]
        expected.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)

    found = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted(map(tuple, found)) == sorted(expected)
    assert 0 < len(found) < len(rows)


def test_stages_with_null_and_repeated_keys(spark, with_null_key):
    docs = with_null_key.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = pin(stage(spark, docs, str(SF_DIR)))
        assert docs.where("doc_id IS NULL").count() == 2, name  # nothing names them as copies, and they are clean
    last = corpus_pipeline.STAGES[-1][1](spark, docs, str(SF_DIR))
    assert last.count() == docs.count() and last.where("doc_id IS NULL").count() == 2


def test_stages_keep_the_columns(spark, messy):
    docs = messy.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(SF_DIR))
        assert out.columns == docs.columns, name
        assert out.count() > 0
        assert stage(spark, docs.limit(0), str(SF_DIR)).count() == 0
