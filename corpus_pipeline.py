"""From raw documents to packed training sequences.

Each stage takes what the one before kept, written as Parquet and read again:
quality rules reject documents, exact copies go, of near copies one stays, sources
are mixed to their target weights (documents repeated by their copies), and the
mix is packed into sequences.

Defined results: a null, empty or short text has too few words and is rejected;
long texts go through whole.  Of equal texts the largest doc_id stays (null
lowest), of near copies the smallest (null last); repeated rows are one copy,
and the mix may take a document up to three times.  An empty table gives no
pieces.  All columns of ``documents``, whatever their names and however many,
are carried to the last stage, which returns pieces.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tablecraft.llm.exact import exact_dedup
from tablecraft.llm.jaccard import drop_near_copies
from tablecraft.llm.mixing import mix_documents
from tablecraft.llm.packing import pack_documents
from tablecraft.llm.quality import filter_quality
from tablecraft.session import ensure_checkpoint_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule of the policy rejects."""
    return filter_quality(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id."""
    return exact_dedup(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 75 % of their five-word shingles the one with the smallest doc_id."""
    return drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mix_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mix with their places in sequences of 1024 tokens."""
    return pack_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_copies),
    ("n-gram Jaccard join", near_copies),
    ("mixing sources", mix_sources),
    ("packing", pack_sequences),
]

# the mix and the packing are not expressible in SQL; tests hold run() against a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what a stage returns is stored in the shared checkpoint folder."""
    base = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4()}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
    return docs
