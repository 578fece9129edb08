"""The corpus pipeline: language ID, line de-duplication, near-duplicate removal, benchmark
decontamination, SentencePiece encoding.

Each stage takes (spark, docs, sf_dir) and works on all documents that the stage before
kept; all but the last return the columns of ``documents``.

Defined results. Null texts have no language, so the first stage drops them with the other
documents that it rejects. Columns besides doc_id and text pass through untouched. A
null doc_id passes through every stage that keeps rows; it takes part in no decision by id. Empty
tables give empty results.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.llm import decontamination, jaccard, language, lines, pieces
from chronoweave.llm.queries import vocabulary
from chronoweave.runtime import shared_dir


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language is undetermined or whose margin is too narrow."""
    model = language.fit(docs, ~language.held_out(docs))
    columns = tuple(c for c in docs.columns if c != "doc_id")
    found = language.identify(docs, model, passing=columns)
    return found.where("accepted").select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop lines that larger doc_ids hold too; n_chars follows the text."""
    maps = lines.drop_bitmaps(docs)
    out = lines.apply_bitmaps(docs, maps)
    return out.select(*(F.length("text").cast(dict(docs.dtypes)[c]).alias(c) if c == "n_chars" else c for c in docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest doc_id of each group of near duplicates."""
    return jaccard.drop_near_duplicates(docs).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that overlap a benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontamination.decontaminate(docs, benchmark).select(*docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode what stays; the digest columns stand for ids and decoded text."""
    return pieces.encode(docs, vocabulary("piece_bpe_32k.model"), ("n_tokens", "ids_sha256", "decoded_sha256", "n_bytes_covered"))


STAGES = [
    ("language ID", identify_language),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("SentencePiece encoding and decoding", encode_pieces),
]

#: SQL can't express these stages; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
