"""Vector codes: each part of a vector as the number of its nearest codebook entry, by Elkan's Lloyd rounds.

Components are integers (``scale`` times the component, rounded down), so that
nearness and ties are exact. Each round is one pass over a table that carries,
with every vector, the entry of each part, an upper bound of the distance to
it, and a lower bound of the distance to every entry, all from the round
before. Bounds are shifted by how far the entries have moved since; an entry
whose lower bound, or half of whose distance to the part's own entry, lies
strictly above the upper bound is left out by the triangle inequality. The
distances of the rest are compared as integers, and ties go to the lower
index. Lower bounds are kept in half a byte each, rounded down, upper ones as
floats, rounded up: they may prune less, never wrongly.

New entries come from sums by (part, entry) that each task adds up, so what is
shuffled and what the driver holds depends on the codebooks' size alone.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystone.core.shared import written

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Vectors handled at a time, entries compared at a time, and the slack of rounding in bounds.
ROWS, BLOCK, SLACK = 2048, 8, 1e-9
#: Labels up to which their sums are broadcast, two numbers each.
BROADCAST_LABELS = 10_000
_FAR = np.iinfo("i8").max


class Codebooks:
    """``entries`` (parts, entries, components) and what pruning needs: half of
    the distances among a part's entries, how far each has moved since the last
    round, and the unit of the lower bounds."""

    def __init__(self, entries: np.ndarray, before: np.ndarray | None = None, unit: np.ndarray | None = None):
        self.entries = entries
        gaps = ((entries[:, :, None] - entries[:, None]) ** 2).sum(3)
        self.half = 0.5 * np.sqrt(gaps) * (1 - SLACK)
        others = self.half.copy()
        others[:, range(others.shape[1]), range(others.shape[1])] = np.inf
        self.nearest_other = others.min(2)
        self.moved = np.zeros(entries.shape[:2]) if before is None else np.sqrt(((entries - before) ** 2).sum(2)) * (1 + SLACK)
        self.unit = np.maximum(2 * self.half.max((1, 2)) / 14, 1e-3) if unit is None else unit
        self.compared = 0

    def assign(self, x: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """Moves the codes (rows, parts) of ``x`` (rows, parts, components) to
        their nearest entries, and both bounds with them; the squared distances
        (rows, parts)."""
        squares = np.empty(code.shape, "i8")
        for p in range(x.shape[1]):
            squares[:, p] = self._assign(p, x[:, p], code[:, p], upper[:, p], lower[:, p])
        return squares

    def _assign(self, p: int, x: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> np.ndarray:
        entries, half, other = self.entries[p], self.half[p], self.nearest_other[p]
        lower -= self.moved[p]
        upper += self.moved[p][code]
        doubtful = upper >= other[code]
        own = ((x - entries[code]) ** 2).sum(1)
        rows = np.flatnonzero(doubtful)
        upper[rows] = np.sqrt(own[rows]) * (1 + SLACK)
        rows = rows[upper[rows] >= other[code[rows]]]
        every = np.arange(len(rows))
        for at in range(0, len(entries), BLOCK):
            block = np.arange(at, min(at + BLOCK, len(entries)))
            here, most = code[rows], upper[rows][:, None]
            near = (lower[rows][:, block] <= most) & (half[here][:, block] <= most) & (block != here[:, None])
            r, j = np.nonzero(near)
            if not len(r):
                continue
            self.compared += len(r)
            found = ((x[rows[r]] - entries[block[j]]) ** 2).sum(1)
            lower[rows[r], block[j]] = np.sqrt(found) * (1 - SLACK)
            square = np.full(near.shape, _FAR)
            square[r, j] = found
            best = square.argmin(1)  # of equal ones the lower index
            least = square[every, best]
            wins = (least < own[rows]) | (least == own[rows]) & (block[best] < here)
            took = rows[wins]
            lower[took, code[took]] = np.sqrt(own[took]) * (1 - SLACK)
            code[took], own[took] = block[best[wins]], least[wins]
            upper[took] = np.sqrt(own[took]) * (1 + SLACK)
        return own


def _numbers(column: pa.Array, rows: int, dtype: str) -> np.ndarray:
    """A binary or list column whose rows are equally long, as an array (rows, length)."""
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(rows, -1).copy()
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(rows, -1)


def _packed(levels: np.ndarray) -> np.ndarray:
    """Numbers from 0 to 15, two to a byte."""
    even = np.pad(levels, [(0, 0)] * (levels.ndim - 1) + [(0, levels.shape[-1] % 2)])
    return even[..., ::2] | even[..., 1::2] << 4


def _unpacked(packed: np.ndarray, count: int) -> np.ndarray:
    return np.stack([packed & 15, packed >> 4], axis=-1).reshape(*packed.shape[:-1], -1)[..., :count]


def _vectors(column: pa.Array, rows: int, dim: int, parts: int) -> np.ndarray:
    lengths = np.diff(column.offsets.to_numpy())
    if (lengths != dim).any():
        raise ValueError(f"vectors must all have {dim} components, one has {int(lengths[lengths != dim][0])}")
    x = _numbers(column, rows, "i8")
    most = math.isqrt((1 << 62) // max(1, dim // parts)) // 2
    if (x > most).any() or (x < -most).any():
        raise ValueError(f"a component is beyond {most} after scaling: squared distances would not be exact")
    return x.reshape(rows, parts, -1)


_STATE = "vec_id bigint, label string, x array<int>, code binary, upper binary, lower binary, error bigint"


def _pass(source: DataFrame, books: Codebooks, dim: int, parts: int, last: bool) -> DataFrame:
    """One round's assignment of every vector: a table with codes and bounds; without the vectors and bounds if it is the last."""
    fresh = "code" not in source.columns
    count = books.entries.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                get = lambda name: part.column(part.schema.get_field_index(name))
                n = part.num_rows
                x = _vectors(get("x"), n, dim, parts)
                if fresh:
                    code, upper, lower = np.zeros((n, parts), "i8"), np.full((n, parts), np.inf), np.zeros((n, parts, count))
                else:
                    code, upper = _numbers(get("code"), n, "u1").astype("i8"), _numbers(get("upper"), n, "<f4").astype("f8")
                    lower = _unpacked(_numbers(get("lower"), n, "u1").reshape(n, parts, -1), count) * (books.unit[:, None] * (1 - SLACK))
                error = books.assign(x, code, upper, lower).sum(1)
                columns = [get("vec_id"), get("label")]
                codes = pa.array([c.tobytes() for c in code.astype("u1")], pa.binary())
                if last:
                    yield pa.RecordBatch.from_arrays([*columns, codes, pa.array(error)], names=["vec_id", "label", "code", "error"])
                    continue
                up = np.nextafter(upper.astype("<f4"), np.float32(np.inf), dtype="<f4")
                down = _packed(np.clip(np.floor(lower * (1 - SLACK) / books.unit[:, None]), 0, 15).astype("u1"))
                vectors = pa.ListArray.from_arrays(np.arange(0, n * dim + 1, dim, dtype="i4"), pa.array(x.ravel().astype("i4")))
                bounds = [pa.array([v.tobytes() for v in b], pa.binary()) for b in (up, down)]
                yield pa.RecordBatch.from_arrays([*columns, vectors, codes, *bounds, pa.array(error)], names=["vec_id", "label", "x", "code", "upper", "lower", "error"])

    ddl = "vec_id bigint, label string, code binary, error bigint" if last else _STATE
    return written(source.mapInArrow(run, ddl), "vector_codes")


def _moved(state: DataFrame, entries: np.ndarray, dim: int) -> np.ndarray:
    """The entries, each replaced by its parts' mean rounded down; one without parts stays."""
    parts, count, size = entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((parts * count, size), "i8"), np.zeros(parts * count, "i8")
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                x = _vectors(part.column(0), part.num_rows, dim, parts)
                cell = (_numbers(part.column(1), part.num_rows, "u1") + np.arange(parts) * count).ravel()
                np.add.at(total, cell, x.reshape(-1, size))
                n += np.bincount(cell, minlength=len(n))
        used = np.flatnonzero(n)
        cells = pa.array(np.repeat(used, size).astype("i4"))
        places = pa.array(np.tile(np.arange(size, dtype="i4"), len(used)))
        yield pa.RecordBatch.from_arrays([cells, places, pa.array(total[used].ravel()), pa.array(np.repeat(n[used], size))], names=["cell", "place", "total", "n"])

    sums = state.select("x", "code").mapInArrow(run, "cell int, place int, total bigint, n bigint")
    sums = sums.groupBy("cell", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
    out = entries.reshape(-1, size).copy()
    for r in sums.collect():  # a row per component of an entry
        out[r.cell, r.place] = int(r.total) // r.n
    return out.reshape(entries.shape)


def vector_codes(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", *,
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
) -> DataFrame:
    """vec_id, code (two hex digits a part), error (squared distances summed
    over the parts), label_error (error summed over equal labels) and
    codebooks_sha256 (of all final components, comma-joined).

    A codebook starts as that part of the ``entries`` smallest ids' vectors; of
    repeated ids the smaller vector is first, null ids are last. ``rounds``
    times every part goes to its nearest entry and every used entry to the
    mean of its parts, rounded down; then all are assigned again.

    Defined results: vectors that are null, empty or hold null or non-finite
    components are left out; repeated rows are each a vector; fewer vectors
    than ``entries`` make shorter codebooks; null labels are one label; an
    empty table gives no rows; other columns are not read. Vectors of unequal
    length, of a length that ``parts`` does not divide, or with components so
    large that squared distances are not exact in 64 bits are an error.
    """
    if not 0 < entries <= 256:
        raise ValueError("two hex digits hold 256 entries at most")
    spark = vectors.sparkSession
    v = F.col(vector_col)
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    whole = F.transform(v, lambda c: F.floor(c.cast("double") * F.lit(float(scale))))
    source = vectors.where(v.isNotNull() & (F.size(v) > 0) & ~bad)
    source = source.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(label_col).cast("string").alias("label"), whole.alias("x"))
    first = [r.x for r in source.select("vec_id", "x").orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).collect()]
    out = "vec_id bigint, code string, error bigint, label_error bigint, codebooks_sha256 string"
    if not first:
        return spark.createDataFrame([], out)
    dim = len(first[0])
    if dim % parts:
        raise ValueError(f"{dim} components do not make {parts} equal parts")
    start = _vectors(pa.array(first, pa.list_(pa.int64())), len(first), dim, parts)
    books = Codebooks(start.transpose(1, 0, 2).copy())
    state = source
    for _ in range(rounds):
        state = _pass(state, books, dim, parts, last=False)
        books = Codebooks(_moved(state, books.entries, dim), books.entries, books.unit)
    final = _pass(state, books, dim, parts, last=True)
    digest = hashlib.sha256(",".join(map(str, books.entries.ravel().tolist())).encode()).hexdigest()
    sums = written(final.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of_label"), "label_errors")
    few = sums.count() <= BROADCAST_LABELS
    joined = final.join(F.broadcast(sums) if few else sums, F.col("label").eqNullSafe(F.col("of_label")))
    return joined.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def oracle_sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """The same rows for a table without repeated ids, every part against every entry."""
    sql = f"""WITH kept AS (
    SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) - 1 AS nth, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {scale}) AS BIGINT)) AS x
    FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
part AS MATERIALIZED (SELECT vec_id, nth, p, x[p * len(x) // {parts} + 1 : (p + 1) * len(x) // {parts}] AS v FROM kept, range({parts}) AS r(p)),
book0 AS MATERIALIZED (SELECT p, nth AS entry, v AS e FROM part WHERE nth < {entries})"""
    distance = "list_sum(list_transform(range(1, len(v) + 1), lambda i: (v[i] - e[i]) * (v[i] - e[i])))"
    for k in range(rounds + 1):
        sql += f""",
near{k} AS MATERIALIZED (SELECT vec_id, p, min({{'d': CAST({distance} AS BIGINT), 'entry': entry}}) AS best FROM part JOIN book{k} USING (p) GROUP BY vec_id, p)"""
        if k < rounds:
            sql += f""",
cell{k} AS (SELECT p, best.entry AS entry, i, sum(v[i]) AS s, count(*) AS n FROM part JOIN near{k} USING (vec_id, p), range(1, (SELECT max(len(v)) + 1 FROM part)) AS r(i) GROUP BY ALL),
mean{k} AS (SELECT p, entry, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS e FROM cell{k} GROUP BY p, entry),
book{k + 1} AS MATERIALIZED (SELECT b.p, b.entry, coalesce(m.e, b.e) AS e FROM book{k} b LEFT JOIN mean{k} m ON m.p = b.p AND m.entry = b.entry)"""
    return f"""{sql},
coded AS (SELECT vec_id, string_agg(lower(printf('%02x', best.entry)), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM near{rounds} GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
    (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY p, entry)) FROM book{rounds}) AS codebooks_sha256
FROM coded JOIN kept USING (vec_id)"""
