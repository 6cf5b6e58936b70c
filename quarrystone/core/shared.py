"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}
#: Folders made inside each open ``scratch``, the innermost last.
_MADE: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``, or else the one set as the context's checkpoint folder.

    Only a session on one machine (a local master) may have neither: a folder
    of our own is made and set there. Anywhere else that is an error, as
    executors would each write to their own disk.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if "dir" not in _OWN:
        if known := context.getCheckpointDir():
            return known.rstrip("/")
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        _OWN["dir"] = tempfile.mkdtemp(prefix="quarrystone-")
        context.setCheckpointDir(_OWN["dir"])
    return _OWN["dir"]


def place(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing lies at yet."""
    path = f"{shared_folder(spark)}/quarrystone/{name}-{uuid.uuid4().hex}"
    if _MADE:
        _MADE[-1].append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is written to the shared folder inside goes at the end, by Spark's
    own file systems. DataFrames made inside must be read or written out before
    the end, as they are lazy and need their tables until then."""
    _MADE.append([])
    try:
        yield
    finally:
        conf, hadoop = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs
        for path in _MADE.pop():
            p = hadoop.Path(path)
            p.getFileSystem(conf).delete(p, True)


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again.

    Cuts the lineage: what the table holds survives a lost executor and is the
    same at every later read, even if ``df`` numbers rows by partition.
    """
    spark = df.sparkSession
    path = place(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written_bytes(df: DataFrame) -> int:
    """Bytes on disk of the files that ``df`` (see ``written``) reads."""
    files = df.inputFiles()
    if not files:
        return 0
    # The listing alone: the column with the files' contents is not read.
    sizes = df.sparkSession.read.format("binaryFile").load(files).select("length")
    return int(sizes.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0])
