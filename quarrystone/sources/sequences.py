"""Sequence files: FASTA by a native reader, and members of ZIP archives."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _records(spark: SparkSession, path: str) -> DataFrame:
    """(path, id, head, text) of each record of FASTA files, its sequence still in lines.

    The reader parts files where a line begins with >, at any byte range, so one
    large file is many tasks. Text before the first record fails when it is
    read: of a file's records the first alone keeps its >, or is blank, and must
    be there in the file's first range; one row for all files says whether it is.
    """
    rows = spark.read.option("lineSep", "\n>").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), "value")
    blank = F.trim(F.regexp_replace("value", r"\s", "")) == ""
    begins = rows.where("start = 0").groupBy("path").agg(F.bool_or(blank | F.col("value").startswith(">")).alias("good"))
    good = begins.agg(F.coalesce(F.bool_and("good"), F.lit(True)).alias("good"))
    text = F.regexp_replace("value", "\r", "")
    head = F.regexp_replace(F.split_part(text, F.lit("\n"), F.lit(1)), "^>", "")
    ident = F.regexp_extract("head", r"^(\S+)", 1)
    named = F.when(~F.col("good"), F.raise_error(F.lit("text before the first record"))).when(ident == "", F.raise_error(F.lit("sequence without an identifier"))).otherwise(ident)
    records = rows.where(~blank).select("path", head.alias("head"), text.alias("text")).crossJoin(F.broadcast(good))  # one row
    return records.select("path", named.alias("id"), "head", "text")


def _built(records: DataFrame, mode: str) -> DataFrame:
    body = F.regexp_replace(F.regexp_replace("text", r"^[^\n]*\n?", ""), r"\s", "")
    body = {"raw": body, "upper": F.upper(body), "protein": F.replace(F.upper(body), F.lit("*"), F.lit(""))}[mode]
    return records.select("path", "id", F.regexp_extract("head", r"^\S+\s+(.*)$", 1).alias("description"), body.alias("seq"))


def fasta(spark: SparkSession, path: str, mode: str = "raw") -> DataFrame:
    """(path, id, description, seq) of FASTA files; ``mode`` raw, upper, or protein (upper without stops)."""
    return _built(_records(spark, path), mode)


def fasta_of(spark: SparkSession, path: str, wanted: DataFrame, mode: str = "raw") -> DataFrame:
    """The records whose id is in ``wanted`` (id). Ids meet before sequences are built: what is not wanted goes as it was read."""
    ids = wanted.select("id").where("id is not null").distinct()
    return _built(_records(spark, path).join(ids, "id", "left_semi"), mode)


def fasta_ids(spark: SparkSession, path: str) -> DataFrame:
    """Just the ids: sequences are not built."""
    lines = spark.read.text(path).where(F.col("value").startswith(">"))
    return lines.select(F.regexp_extract("value", r"^>(\S+)", 1).alias("id"))


def conflicts(df: DataFrame) -> DataFrame:
    """Ids that stand for more than one sequence."""
    return df.groupBy("id").agg(F.countDistinct("seq").alias("n")).where("n > 1")


def zipped_cds(spark: SparkSession, path: str, member: str = "cds_from_genomic.fna") -> DataFrame:
    """(path, id, seq) of the one member of each ZIP archive whose name ends with ``member``; the id is its [protein_id=…]."""
    return zipped_records(spark.read.format("binaryFile").load(path), member)


def zipped_records(archives: DataFrame, member: str = "cds_from_genomic.fna") -> DataFrame:
    """``zipped_cds`` of archives given as (path, content)."""
    schema = pa.schema([("path", pa.string()), ("id", pa.string()), ("seq", pa.string())])
    tag = re.compile(r"\[protein_id=([^\]]+)\]")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    found = [n for n in z.namelist() if n == member or n.endswith("/" + member)]
                    if len(found) != 1:
                        raise ValueError(f"{name} has {len(found)} members {member}")
                    records = z.read(found[0]).decode("utf-8", "replace").split("\n>")
                rows = []
                for r in records:
                    head, _, seq = r.lstrip(">").partition("\n")
                    if m := tag.search(head):
                        rows.append({"path": name, "id": m[1], "seq": "".join(seq.split())})
                yield from pa.Table.from_pylist(rows, schema).to_batches()

    return archives.select("path", "content").mapInArrow(run, "path string, id string, seq string")
