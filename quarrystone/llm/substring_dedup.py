"""Substring dedup by difference-cover anchors.

A window of ``window`` words is repeated if its word sequence starts anywhere
else too; every word that a repeated window covers is removed. For a period p
and a difference cover D of it, any two equal windows have a place, the same in
both, that lies at a position of D modulo p in both documents. So it suffices to hash
shorter anchors of ``window - p + 1`` words at cover positions only: an equal
pair of windows shares an anchor. Anchors that occur once are done with; around
the others the windows that hold them are hashed whole, and those that occur
again are the repeated ones. No pairs are formed, so a passage that many
documents share costs its occurrences and no more.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.llm.arrow import Rows, values

WINDOW, PERIOD = 35, 21


def difference_cover(period: int) -> list[int]:
    """The smallest set whose differences modulo ``period`` are all residues, first in order of its numbers."""

    def extend(chosen: list[int], size: int) -> list[int] | None:
        if len(chosen) == size:
            return chosen if len({(a - b) % period for a in chosen for b in chosen}) == period else None
        for nxt in range(chosen[-1] + 1, period - (size - len(chosen)) + 1):
            if found := extend([*chosen, nxt], size):
                return found
        return None

    size = 1
    while size * (size - 1) + 1 < period:
        size += 1
    while True:
        if found := extend([0], size):
            return found
        size += 1


class Hasher:
    """Hashes of runs of words: polynomials modulo 2^64 over 64-bit word hashes."""

    BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)  # fixed values: odd multipliers

    def __init__(self, words: list[bytes], seeds: int = 1):
        n = len(words)
        self.n = n
        self.sums, self.back = [], []
        for seed in range(seeds):
            x = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), "u8", n)
            base = self.BASES[seed]
            power = _powers(base, n + 1)
            total = np.zeros(n + 1, "u8")
            np.cumsum(x * power[:n], out=total[1:])
            self.sums.append(total)
            self.back.append(_powers(pow(base, -1, 1 << 64), n + 1))

    def at(self, starts: np.ndarray, length: int, seed: int = 0) -> np.ndarray:
        """Hashes of the ``length`` words from each start, as signed 64-bit numbers."""
        total = self.sums[seed]
        h = (total[starts + length] - total[starts]) * self.back[seed][starts]
        h ^= h >> np.uint64(31)
        return (h * np.uint64(0xBF58476D1CE4E5B9)).view("i8")


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base^0 to base^(n-1) modulo 2^64; long runs are remembered up to a million."""
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        known = np.full(max(n, 4096), base, "u8")
        known[0] = 1
        known = np.multiply.accumulate(known)
        if n <= 1_000_000:
            _POWERS[base] = known
    return known[:n]


def words_of(text: str | None) -> list[bytes]:
    """The words [^\\x20\\x09-\\x0D]+ in UTF-8; bytes split at just these six characters."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def _anchor_starts(n: int, window: int, period: int, cover: np.ndarray) -> np.ndarray:
    """Cover positions whose anchor lies inside some window of a text of n words."""
    if n < window:
        return np.empty(0, "i8")
    length = window - period + 1
    at = np.arange(0, n - length + 1)
    return at[np.isin(at % period, cover)]


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text, and what stands for the text: a 64-bit hash and another of
    31 bits. Equal texts have the same windows, whoever holds them."""
    body = F.coalesce(F.col("text"), F.lit(""))
    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return source.withColumns({"key": F.xxhash64(body), "size": F.hash(body).bitwiseAND(0x7FFFFFFF)})


def _travelling(source: DataFrame) -> DataFrame:
    """doc_id, key, size and the text as ``packed`` (zstd), the form in which it is shuffled; null stays null."""
    schema = pa.schema([("doc_id", pa.int64()), pa.field("key", pa.int64(), False), pa.field("size", pa.int32(), False), ("packed", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, packer = Rows(schema), zstandard.ZstdCompressor(level=3, write_checksum=False, write_content_size=True)
        for doc, key, size, text in values(batches, "doc_id", "key", "size", "text"):
            packed = None if text is None else packer.compress(text.encode("utf-8", "surrogatepass"))
            rows.add(doc, key, size, packed, weight=len(packed or b""))
            if rows.full():
                yield rows.batch()
        yield rows.batch()

    # The keys are never null; else only one of the two joins would drop nulls first, and they would not share an exchange.
    return source.mapInArrow(run, "doc_id bigint, key bigint NOT NULL, size int NOT NULL, packed binary")


def _words_in(packed: bytes | None) -> list[bytes]:
    return [] if packed is None else zstandard.decompress(packed).split()


def _combined(hashes: list[np.ndarray], own: list[np.ndarray]) -> np.ndarray:
    """For each row 0 if its hash (one or two columns) occurs once here, 1 if it
    is the first of several, 2 if it is one of the others.

    The first speaks for all of them where hashes meet, so however often a
    passage occurs, that place gets a row for each batch and no more. ``own``
    breaks ties, for the same choice in any order of the rows.
    """
    order = np.lexsort((*own[::-1], *hashes[::-1]))
    same = np.ones(len(order) - 1, bool)
    for h in hashes:
        same &= h[order][1:] == h[order][:-1]
    kind = np.zeros(len(order), "i8")
    kind[1:][same] = 2
    kind[:-1][same & (kind[:-1] == 0)] = 1
    out = np.empty_like(kind)
    out[order] = kind
    return out


def _apart(key: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A value of its own for each (text, place), to spread rows that are settled."""
    x = key.view("u8") ^ (at.astype("u8") * np.uint64(Hasher.BASES[0]))
    x ^= x >> np.uint64(29)
    return (x * np.uint64(0x94D049BB133111EB)).view("i8")


def _anchors(source: DataFrame, window: int, period: int) -> DataFrame:
    """(h, key, place): anchors at cover positions (see ``_place``)."""
    cover, length = np.array(difference_cover(period)), window - period + 1
    schema = pa.schema([("h", pa.int64()), ("key", pa.int64()), ("place", pa.int64())])

    def made(row: tuple) -> tuple | None:
        key, size, text = row
        words = words_of(text)
        starts = _anchor_starts(len(words), window, period, cover)
        whole = lambda x: np.full(len(starts), x, "i8")
        return (Hasher(words).at(starts, length), whole(key), whole(size), starts) if len(starts) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, key, size, at in _chunks(values(batches, "key", "size", "text"), made, 400_000):
            kind = _combined([h], [key, size, at])
            h = np.where(kind == 2, _apart(key, at), h)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h, key, _place(size, at, kind > 0))], schema=schema)

    return source.select("key", "size", "text").mapInArrow(run, "h bigint, key bigint, place bigint")


def _place(size: np.ndarray, at: np.ndarray, again: np.ndarray) -> np.ndarray:
    """A text's second hash, a position from -1 on and whether what is there is known to occur again, in one number."""
    return size << 32 | (at + 1) << 1 | again


def _unpacked(found: DataFrame) -> DataFrame:
    """Columns size, at and settled of a column ``place``."""
    place = F.col("place")
    return found.withColumns(
        {
            "size": F.shiftright(place, 32).cast("int"),
            "at": (F.shiftright(place, 1).bitwiseAND(0x7FFFFFFF) - 1).cast("int"),
            "settled": place.bitwiseAND(1) == 1,
        }
    )


def _chunks(rows: Iterator[tuple], made, most: int) -> Iterator[tuple[np.ndarray, ...]]:
    """What ``made`` gives for the rows, joined to columns of little more than ``most`` values."""
    kept, total = [], 0
    for row in rows:
        got = made(row)
        if got is not None:
            kept.append(got)
            total += len(got[0])
        if total >= most:
            yield tuple(map(np.concatenate, zip(*kept)))
            kept, total = [], 0
    if kept:
        yield tuple(map(np.concatenate, zip(*kept)))


ALL = -1


def _windows(joined: DataFrame, window: int, period: int) -> DataFrame:
    """(h1, h2, key, place): the windows that hold a repeated anchor of their
    text, told apart by 128 bits. A text that the row before held too speaks for both: a row with no
    start (ALL) says that all its windows occur again, and its windows, of
    size -1, wait for no answer."""
    anchor = window - period + 1
    schema = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("key", pa.int64()), ("place", pa.int64())])

    def one_of_copies(rows: Iterator[tuple]) -> Iterator[tuple]:
        last, copies = None, 0
        for row in rows:
            if last is not None and row[:3] == last[:3]:
                copies = 1
                continue
            if last is not None:
                yield (*last, copies)
            last, copies = row, 0
        if last is not None:
            yield (*last, copies)

    def made(row: tuple) -> tuple | None:
        key, size, packed, anchors, copies = row
        words = _words_in(packed)
        n = len(words)
        if n < window:
            return None
        mark = np.zeros(n + 1, "i8")
        at = np.array(anchors, "i8")
        at = at[at <= n - anchor]  # another text of the same hash may have added some
        np.add.at(mark, np.maximum(at - period + 1, 0), 1)
        np.add.at(mark, at + 1, -1)
        starts = np.flatnonzero(np.cumsum(mark)[: n - window + 1] > 0)
        h = Hasher(words, 2)
        h1, h2 = h.at(starts, window, 0), h.at(starts, window, 1)
        if copies:
            starts, h1, h2 = np.append(starts, ALL), np.append(h1, 0), np.append(h2, 0)
        whole = lambda x: np.full(len(starts), x, "i8")
        return h1, h2, whole(key), starts, whole(size), whole(copies)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = one_of_copies(values(batches, "key", "size", "packed", "anchors"))
        for h1, h2, key, at, size, copies in _chunks(rows, made, 200_000):
            kind = _combined([h1, h2], [key, size, at])
            alone = (kind == 2) | (at == ALL)
            back = (copies == 0) | (at == ALL)  # the windows of a text with copies need no answer
            h1, h2 = np.where(alone, _apart(key, at), h1), np.where(alone, size, h2)
            key = np.where(back, key, 0)
            place = _place(np.where(back, size, -1), at, (kind > 0) | (copies > 0))
            keep = back | (kind != 2)
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (h1, h2, key, place)], schema=schema)

    return joined.mapInArrow(run, "h1 bigint, h2 bigint, key bigint, place bigint")


def repeated_windows(source: DataFrame, packed: DataFrame, *, window: int = WINDOW, period: int = PERIOD) -> DataFrame:
    """(key, size, starts): for each text of ``source`` with repeated windows the
    places where these start, or ALL. A row per text, bounded by its length.
    ``packed`` has the same texts in the form that is shuffled."""
    # Python has merged equal hashes of each batch, so a partition gets few rows of any one.
    often = lambda rows, *by: _unpacked(rows.withColumn("n", F.count("*").over(Window.partitionBy(*by)))).where("n > 1 or settled")
    anchors = often(_anchors(source, window, period), "h").groupBy("key", "size").agg(F.collect_set("at").alias("anchors"))
    # All columns, so that this join and the last one share one exchange of the texts.
    joined = packed.join(anchors, ["key", "size"]).select("key", "size", "packed", "anchors", "doc_id")
    windows = often(_windows(joined, window, period), "h1", "h2").where("size >= 0")
    return windows.groupBy("key", "size").agg(F.collect_set("at").alias("starts"))


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, window: int = WINDOW, period: int = PERIOD, with_text: bool = False
) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of each document (and the
    kept words joined by one space as ``kept``, if ``with_text``).

    Windows are judged on the input, not on what is left. A null text has no
    words, and a text of fewer words than a window loses none; each repeated
    row is judged like any other copy; other columns are not read; an empty
    table gives no rows.
    """
    if not 0 < period <= window:
        raise ValueError("the period must be from 1 to the window")
    source = _keyed(docs, id_col, text_col)
    packed = _travelling(source)
    starts = repeated_windows(source, packed, window=window, period=period)
    joined = packed.join(starts, ["key", "size"], "left").select("doc_id", "packed", "starts")
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), *([("kept", pa.string())] if with_text else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = Rows(schema)
        for doc, body, repeated in values(batches, "doc_id", "packed", "starts"):
            words = _words_in(body)
            n = len(words)
            if repeated and n >= window:
                mark = np.zeros(n + 1, "i8")
                at = np.arange(n - window + 1) if ALL in repeated else np.array(repeated, "i8")
                at = at[at <= n - window]  # a text that collides in all 95 bits may have brought others
                mark[at] += 1
                mark[at + window] -= 1
                words = [w for w, covered in zip(words, np.cumsum(mark).tolist()) if not covered]
            kept = b" ".join(words)
            row = (doc, n, n - len(words), hashlib.sha256(kept).hexdigest())
            rows.add(*row, *([kept.decode("utf-8", "replace")] if with_text else []), weight=len(kept) * with_text)
            if rows.full():
                yield rows.batch()
        yield rows.batch()

    return joined.mapInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string" + ", kept string" * with_text)
