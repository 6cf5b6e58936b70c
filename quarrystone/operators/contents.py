"""Digests of files of any size: that of a large file goes on from task to task, each of which reads a leg of it."""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.core.shared import place, written

#: Bytes from which a file is read in ranges, and bytes of a file that are digested before its state is handed on.
LARGE, LEG = 128 << 20, 256 << 20
#: Bytes of a row that holds a part of a file.
_PIECE = 1 << 20
#: Names of OpenSSL's functions and bytes of a digest. A state takes less than ``_STATE`` bytes (112 and 92).
_KINDS, _STATE = {"sha256": ("SHA256", 32), "md5": ("MD5", 16)}, 256
#: Files that Spark's reader of lines would decompress: they are read whole at any size.
_PACKED = r"\.(gz|bz2|deflate|lz4|snappy|zst)$"
_BOM = b"\xef\xbb\xbf"


class Digest:
    """A SHA-256 or MD5 whose state can be stored and taken up elsewhere, which ``hashlib`` does not offer: by the functions
    of the OpenSSL that ``hashlib`` is linked with."""

    def __init__(self, kind: str, state: bytes | None = None):
        import _hashlib

        name, self.size = _KINDS[kind]
        library = ctypes.CDLL(_hashlib.__file__)
        self._init, self._update, self._final = (getattr(library, f"{name}_{step}") for step in ("Init", "Update", "Final"))
        self._update.argtypes = [ctypes.c_void_p, ctypes.c_char_p, ctypes.c_size_t]
        self._state = ctypes.create_string_buffer(state or b"", _STATE)
        if state is None:
            self._init(self._state)

    def update(self, content: bytes) -> Digest:
        self._update(self._state, content, len(content))
        return self

    def state(self) -> bytes:
        return self._state.raw

    def hex(self) -> str:
        """The digest of what came so far; more may follow."""
        out = ctypes.create_string_buffer(self.size)
        self._final(out, ctypes.create_string_buffer(self.state(), _STATE))
        return out.raw.hex()


def resumable(kind: str) -> bool:
    """Whether states can be stored here: the functions are there, and a digest in two steps is that of ``hashlib``."""
    try:
        return Digest(kind, Digest(kind).update(b"a" * 100).state()).update(b"b" * 100).hex() == hashlib.new(kind, b"a" * 100 + b"b" * 100).hexdigest()
    except (ImportError, OSError, AttributeError):
        return False


def _parts(lines: DataFrame) -> DataFrame:
    """(file, start, nth, leg, n, content) of (file, start, leg, line): the lines of a range of a file in few rows, ``nth`` in order."""
    schema = pa.schema([("file", pa.string()), ("start", pa.int64()), ("nth", pa.int64()), ("leg", pa.int64()), ("n", pa.int64()), ("content", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nth = 0
        for batch in batches:
            files, starts, legs, body = batch.columns
            new = pc.or_(pc.not_equal(files[1:], files[:-1]), pc.not_equal(starts[1:], starts[:-1]))
            bounds = [0, *(i + 1 for i in pc.indices_nonzero(new).to_pylist()), batch.num_rows]
            for a, b in zip(bounds, bounds[1:]):
                content = b"".join(body.slice(a, b - a).to_pylist())
                for at in range(0, len(content), _PIECE):
                    piece = content[at : at + _PIECE]
                    row = (files[a].as_py(), starts[a].as_py(), nth, legs[a].as_py(), len(piece), piece)
                    yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema)], schema=schema)
                    nth += 1

    return lines.mapInArrow(run, "file string, start bigint, nth bigint, leg bigint, n bigint, content binary")


def _gone_on(rows: DataFrame, kind: str) -> DataFrame:
    """(file, size, done, state, digest) of sorted rows (file, size, done, start, nth, content): of each file first the row
    of its state, with its ``size`` and the bytes ``done``, and then parts of it."""
    schema = pa.schema([("file", pa.string()), ("size", pa.int64()), ("done", pa.int64()), ("state", pa.binary()), ("digest", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, size, done, digest = None, 0, 0, None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((file, size, done, digest.state(), digest.hex()), schema)], schema=schema)

        for batch in batches:
            files, sizes, dones, starts, _, contents = batch.columns
            for i in range(batch.num_rows):
                content = contents[i].as_py()
                if starts[i].as_py() < 0:
                    if digest:
                        yield row()
                    file, size, done, digest = files[i].as_py(), sizes[i].as_py(), dones[i].as_py(), Digest(kind, content)
                    continue
                if files[i].as_py() != file:
                    raise ValueError(f"{files[i]} has no state")
                if done + len(content) == size + 1:  # the last line has no end of its own
                    content = content[:-1]
                digest.update(content)
                done += len(content)
        if digest:
            yield row()

    return rows.mapInArrow(run, "file string, size bigint, done bigint, state binary, digest string")


def _handed_on(spark: SparkSession, path: str, listed: DataFrame, large, kind: str, leg: int) -> DataFrame:
    """(file, digest) of the large files ``listed`` (file, size).

    The reader of lines takes files by ranges and leaves bytes as they are: between line ends, which are put back, and
    without a byte order mark, whose lack the length shows. The parts are written, and then digested leg by leg: a task
    gets a leg of a file and the state that the leg before left.
    """
    lines = spark.read.option("lineSep", "\n").option("recursiveFileLookup", True).text(path).where(large)
    start = F.col("_metadata.file_block_start")
    lines = lines.select(F.col("_metadata.file_path").alias("file"), start.alias("start"), F.floor(start / leg).alias("leg"), F.concat(F.col("value").cast("binary"), F.lit(b"\n")).alias("line"))
    parts = _parts(lines)
    parts.write.partitionBy("leg").parquet(folder := place(spark, "file-parts"))
    parts = spark.read.schema(parts.schema).parquet(folder)
    totals = written(parts.groupBy("file").agg(F.sum("n").alias("total"), F.max("leg").alias("legs")), "file-totals")
    legs, files = totals.agg(F.coalesce(F.max("legs"), F.lit(-1))).first()[0] + 1, listed.count()
    lacks = F.col("size") - F.coalesce("total", F.lit(0)) >= 2  # a last line end may be too many, a mark is three bytes
    fresh, marked = (F.lit(Digest(kind).update(x).state()) for x in (b"", _BOM))
    state = listed.join(totals, "file", "left").select("file", "size", F.when(lacks, 3).otherwise(0).cast("bigint").alias("done"), F.when(lacks, marked).otherwise(fresh).alias("state"))
    for k in range(legs):
        before = state.select("file", "size", "done", F.lit(-1).cast("bigint").alias("start"), F.lit(0).cast("bigint").alias("nth"), F.col("state").alias("content"))
        none = F.lit(None).cast("bigint")
        now = parts.where(F.col("leg") == k).select("file", none.alias("size"), none.alias("done"), "start", "nth", "content")
        rows = before.unionByName(now).repartition(2 * files, "file").sortWithinPartitions("file", "start", "nth")
        state = written(_gone_on(rows, kind), "file-states")
    wrong = F.raise_error(F.concat(F.lit("not read as it is: "), "file"))
    return state.select("file", F.when(F.col("done") == F.col("size"), F.col("digest")).otherwise(wrong).alias("digest"))


def digested(spark: SparkSession, path: str, kind: str, large: int = LARGE, leg: int = LEG) -> DataFrame:
    """(path, length, digest) of all files below a folder, ``kind`` sha256 or md5.

    Files below ``large`` bytes are read as they are. Larger ones are dealt out by ranges and digested leg by leg, so that
    no task reads more of a file than a leg and no row holds a file; only compressed ones, and all where states cannot be
    stored (see ``resumable``), are read whole.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    whole = files.select("path", "length", {"sha256": F.sha2("content", 256), "md5": F.md5("content")}[kind].alias("digest"))
    if not resumable(kind):
        return whole
    # By the listing alone, so that the contents of other files are not read.
    size, name = F.col("_metadata.file_size"), F.col("_metadata.file_name")
    long = (size >= large) & ~F.rlike(name, F.lit(_PACKED))
    listed = written(files.where(long).select("path", "length", F.col("_metadata.file_path").alias("file"), F.col("length").alias("size")), "large-files")
    if listed.isEmpty():
        return whole
    small = files.where(~long).select("path", "length", {"sha256": F.sha2("content", 256), "md5": F.md5("content")}[kind].alias("digest"))
    rest = listed.join(_handed_on(spark, path, listed.select("file", "size"), long, kind, leg), "file").select("path", "length", "digest")
    return small.unionByName(rest)
