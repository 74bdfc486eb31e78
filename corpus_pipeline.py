"""The training-data pipeline: five stages over documents, each on all that the one before kept.

Toxic texts go, one document of each near-duplicate group stays, contaminated documents go, the rest is put
into the order of the source mixture, and written in that order as token shards.  The first four stages return
the columns of documents; the last one a row per document: where its ids start in the mixed sequence, how many
there are, and their CRC-32, as read back from the files.

The mixture drops no document.  A Parquet table has no order to rely on, so the last stage works out the
same schedule again from what it is given - which is all that the fourth kept - and lays the shards out by it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm.decontamination import decontaminate
from ledgerloom.llm.mixing import mixed, mixed_order, places
from ledgerloom.llm.simhash import one_per_group
from ledgerloom.llm.token_files import read_documents, write_tokens
from ledgerloom.llm.toxicity import train, without_toxic
from ledgerloom.session import checkpoint_dir

SHINGLE, DISTANCE = 4, 4
TOKENIZER = "word_bpe_49k.json"


def _path(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_toxic(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_per_group(docs, shingle=SHINGLE, distance=DISTANCE)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = _path(spark, "tokens")
    in_order = docs.select("doc_id", "text").join(places(docs), "doc_id", "left")
    write_tokens(in_order, path, public_tokenizers.path(TOKENIZER), order_by=mixed_order())
    return read_documents(spark, path)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mixing),
    ("token_output", token_output),
]

ORACLE_SQL = None  # a trained chain, fingerprints and a tokenizer: tests hold it against brute force instead


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stage's rows written and read again as the next one's."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = _path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
