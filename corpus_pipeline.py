"""From raw documents to packed training sequences, in five stages.

Each stage works on all that the one before kept. Toxic documents go; lines
that are boilerplate of their source go, the document stays (linked copies
count as one page there); of documents
linked as near-duplicates one stays; secrets are masked in place; the rest is
packed. All but the last return the columns of ``documents``, with ``n_chars``
that of the new text.

Every stage takes nulls in any column, empty and very long texts, repeated rows
and empty tables; what becomes of them is said with each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.core.shared import written
from quarrystone.llm.jaccard_join import copy_classes, one_of_each
from quarrystone.llm.line_dedup import drop_boilerplate
from quarrystone.llm.packing import pack
from quarrystone.llm.registry import tokenizer_path
from quarrystone.llm.secret_scan import redact
from quarrystone.llm.toxicity import drop_toxic


def _measured(docs: DataFrame, columns: list[str]) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("bigint")).select(*columns)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` without toxic ones. Null and empty texts stay; repeated rows go
    or stay together; without labels all stay; an empty table stays empty."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` without boilerplate lines of their source; no row goes. A null
    text stays null, an empty one empty; a null source is a source of its own;
    repeated rows count as one page; an empty table stays empty."""
    # Copies and near copies are one page: else a large group of them makes all its own lines boilerplate.
    return _measured(drop_boilerplate(docs, classes=written(copy_classes(docs), "copy_classes")), docs.columns)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of linked documents: the one of the smallest id. Null,
    empty and blank texts all stay; a repeated row of one id and text stays
    once; an empty table stays empty."""
    return one_of_each(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` with secrets masked; no row goes. Null and empty texts stay as
    they are, repeated rows are each masked; an empty table stays empty."""
    return _measured(redact(docs), docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1024 tokens. A null or empty
    text is its end token alone; repeated rows are each packed; an empty table
    gives no piece."""
    return pack(docs, tokenizer=tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("jaccard_join", jaccard_join),
    ("secret_scan", secret_scan),
    ("packing", packing),
]

#: The toxicity model and the signatures are beyond SQL; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
