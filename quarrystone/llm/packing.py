"""Packing of tokenised documents into sequences by best-fit decreasing.

A document is cut into full windows and one remainder. Best-fit decreasing
needs only the number of pieces of each length, a table of at most ``window``
rows however large the corpus is, so the packing is planned on the driver with
exactly the bins that placing piece after piece would give. Which piece takes
which place follows from its rank among the pieces of its length; ranks come
from counts by (length, task), so no group of pieces meets in one task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.core.shared import written
from quarrystone.llm.arrow import Rows, values

WINDOW = 1024
#: Most slots that are broadcast, of six numbers each.
BROADCAST_SLOTS = 50_000


class Slot(NamedTuple):
    """Pieces of ``length`` ranked from ``low`` up to ``high``: ``each`` to a
    sequence, from ``sequence`` on, the first of each at ``offset``."""

    length: int
    low: int
    high: int
    sequence: int
    each: int
    offset: int


class OpenWindows:
    """Open sequences by remaining capacity, over a segment tree of counts."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.tree = [0] * (2 * self.leaves)
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(self.leaves)]

    def push(self, capacity: int, first: int, n: int) -> None:
        if capacity and n:
            self.runs[capacity].append((first, n))
            self._count(capacity, 1)

    def pop(self, capacity: int) -> tuple[int, int]:
        self._count(capacity, -1)
        return self.runs[capacity].pop()

    def _count(self, capacity: int, by: int) -> None:
        node = capacity + self.leaves
        while node:
            self.tree[node] += by
            node >>= 1

    def tightest(self, length: int) -> int | None:
        """The smallest capacity that is at least ``length`` and open."""
        node = length + self.leaves
        if self.tree[node]:
            return length
        while node > 1:
            if not node & 1 and self.tree[node + 1]:  # the right neighbour holds larger capacities
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.tree[2 * node] else 2 * node + 1
                return node - self.leaves
            node >>= 1
        return None


def best_fit_decreasing(counts: dict[int, int], window: int = WINDOW) -> list[Slot]:
    """Slots for ``counts[length]`` pieces of each length, the longest first.

    A piece goes where the least room is left that holds it; that sequence then
    stays the tightest as long as another piece of the length fits. So a run of
    equal sequences takes ``capacity // length`` pieces each, one run at a time.
    """
    open_windows, slots, new = OpenWindows(window), [], 0
    for length in sorted((k for k, n in counts.items() if n), reverse=True):
        if not 0 < length <= window:
            raise ValueError(f"a piece of {length} tokens does not fit a window of {window}")
        left, rank = counts[length], 0
        while left:
            capacity = open_windows.tightest(length)
            if capacity is None:
                capacity, n = window, -(-left // (window // length))
                first, new = new, new + n
            else:
                first, n = open_windows.pop(capacity)
            each = capacity // length
            whole = min(n, left // each)
            taken = whole * each
            if taken:
                slots.append(Slot(length, rank, rank + taken, first, each, window - capacity))
                open_windows.push(capacity - each * length, first, whole)
            rank, left = rank + taken, left - taken
            if left and n > whole:  # fewer than ``each`` are left: one more sequence takes them
                slots.append(Slot(length, rank, rank + left, first + whole, each, window - capacity))
                open_windows.push(capacity - left * length, first + whole, 1)
                whole, rank, left = whole + 1, rank + left, 0
            open_windows.push(capacity, first + whole, n - whole)
    return slots


class Encoder:
    """Ids of a byte-level BPE given as a ``tokenizers`` file.

    The file's vocabulary and split pattern run in tiktoken, which gives the
    same ids several times faster; texts with a special token's string go to
    ``tokenizers`` itself, and so do those whose split gives up (a run of about
    a million spaces). Files with another split or a normalizer are refused.
    """

    def __init__(self, path: str):
        import json

        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split = {k: (spec.get("pre_tokenizer") or {}).get(k) for k in ("type", "add_prefix_space", "use_regex")}
        if split != {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True} or spec.get("normalizer"):
            raise ValueError(f"not a plain byte-level vocabulary: {path}")
        back = {c: b for b, c in _byte_letters().items()}
        self.path = path
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        ranks = {bytes(back[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece not in self.special}
        self.fast = tiktoken.Encoding("vocabulary", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.full = None

    def ids(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        if not any(s in text for s in self.special):
            try:
                return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()
            except ValueError:  # the split ran out of room for going back
                pass
        if self.full is None:
            from tokenizers import Tokenizer

            self.full = Tokenizer.from_file(self.path)
        import numpy as np

        return np.array(self.full.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


# Fixed value: the split pattern of the public byte-level BPE vocabulary.
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


_ENCODERS: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


_PIECES = pa.schema(
    [("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("task", pa.int64()), ("nth", pa.int64())]
)


def token_pieces(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, tokenizer: str, window: int = WINDOW, end_id: int = 0, with_ids: bool = False
) -> DataFrame:
    """A row per piece: id, start, length, ids_crc32, doc_tokens, task, nth (and
    ids, packed little-endian, if ``with_ids``).

    A null text counts as empty, and an empty one is the end id alone. ``nth``
    numbers the task's pieces of one length; write the table before use.
    """
    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), *_PIECES, *([("ids", pa.binary())] if with_ids else [])])
    ddl = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, task bigint, nth bigint" + ", ids binary" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, rows, task, seen = _encoder(tokenizer), Rows(schema), TaskContext.get().partitionId(), [0] * (window + 1)
        end, step = end_id.to_bytes(4, "little"), 4 * window
        for doc, text in values(batches, "doc_id", "text"):
            ids = encoder.ids(text or "") + end
            for at in range(0, len(ids), step):
                piece = ids[at : at + step]
                n = len(piece) // 4
                row = (doc, at // 4, n, zlib.crc32(piece), len(ids) // 4, task, seen[n])
                rows.add(*row, *([piece] if with_ids else []), weight=len(piece) * with_ids)
                seen[n] += 1
            if rows.full():
                yield rows.batch()
        yield rows.batch()

    return source.mapInArrow(run, ddl)


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, tokenizer: str, window: int = WINDOW, end_id: int = 0, with_ids: bool = False
) -> DataFrame:
    """Pieces of all documents with their ``sequence_id`` and ``offset``.

    Defined results: null and empty texts are one end id; repeated rows and
    repeated or null ids are packed row by row; very long texts become many
    windows; an empty table gives no rows; other columns are not read.
    """
    pieces = written(token_pieces(docs, id_col, text_col, tokenizer=tokenizer, window=window, end_id=end_id, with_ids=with_ids), "pieces")
    spark = docs.sparkSession
    counts = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    total = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``window`` rows
    found = best_fit_decreasing(total, window)
    slots = spark.createDataFrame(
        found, "slot_length bigint, low bigint, high bigint, sequence bigint, each bigint, place bigint"
    )
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    ahead = counts.select("length", "task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("ahead"))
    ranked = pieces.join(ahead, ["length", "task"]).withColumn("rank", F.col("ahead") + F.col("nth"))
    # The slots depend on the window alone, not on the corpus: some thousand rows; were there more, a join by length would do.
    placed = ranked.join(
        F.broadcast(slots) if len(found) <= BROADCAST_SLOTS else slots, (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
    )
    inside = F.col("rank") - F.col("low")
    return placed.select(
        "doc_id",
        "start",
        "length",
        "ids_crc32",
        "doc_tokens",
        (F.col("sequence") + F.floor(inside / F.col("each")).cast("bigint")).alias("sequence_id"),
        (F.col("place") + F.pmod(inside, F.col("each")) * F.col("length")).alias("offset"),
        *(["ids"] if with_ids else []),
    )
