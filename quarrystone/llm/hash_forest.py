"""Approximate nearest neighbours by a hash-prefix forest.

Each tree hashes vectors to strings of 32 bits, the sides of random hyperplanes,
and keeps them sorted. A query descends in every tree to its longest matching
prefix and then ascends in all trees at once, a bit at a time, until the
vectors below its nodes are as many as asked for; these are scored exactly.
For the inner product a vector gets one component more, which makes all equally
long; a query gets 0 there. Vectors, each with its hash strings, lie in blocks,
and queries in chunks; a task searches one chunk in one block.

How many candidates a query needs, a share of each block, is fitted on a
bounded sample of vectors to a few queries of it, whose true neighbours among
all vectors are found by one exact pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.core.shared import written

TREES, BITS, BLOCK, CHUNK = 96, 32, 32_768, 16_384
#: Vectors and queries of the sample on which the share of candidates is fitted, and the recall that it has to reach there.
SAMPLE, SAMPLE_QUERIES, TARGET = 4096, 128, 0.95
SHARES = (0.001, 0.002, 0.005, 0.01, 0.02, 0.05, *(round(0.01 * i, 2) for i in range(8, 100, 2)), 1.0)


def planes(dim: int, trees: int = TREES, seed: int = 11) -> np.ndarray:
    """(trees, BITS, dim + 1): the hyperplanes of each tree; the last component is the one added."""
    return np.random.default_rng(seed).standard_normal((trees, BITS, dim + 1))


def hash_strings(x: np.ndarray, extra: np.ndarray, normals: np.ndarray) -> np.ndarray:
    """(trees, rows): the strings of rows of ``x`` with the component ``extra``, as 32-bit numbers whose order is that of the strings."""
    wide = np.column_stack([x, extra])
    out = np.empty((len(normals), len(x)), "u4")
    for t, normal in enumerate(normals):
        out[t] = np.ascontiguousarray(np.packbits(wide @ normal.T > 0, axis=1)).view(">u4").ravel()
    return out


class Forest:
    """A forest over the rows of ``x`` with hash strings ``codes`` (trees, rows); ``ids`` break ties."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, codes: np.ndarray):
        self.x, self.ids, self.trees = x, ids, len(codes)
        self.order = np.argsort(codes, axis=1, kind="stable")
        self.sorted = np.take_along_axis(codes, self.order, axis=1)

    def node(self, codes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Where each query's prefix of a length begins and ends in each tree: (trees, queries)."""
        rest = np.uint64(BITS - length)
        begin = codes.astype("u8") >> rest << rest
        end = begin + (np.uint64(1) << rest)
        low, high = np.empty(codes.shape, "i4"), np.empty(codes.shape, "i4")
        for t in range(self.trees):
            low[t] = np.searchsorted(self.sorted[t], begin[t].astype("u4"), "left")
            # The end of the last node of a length is past the largest number.
            high[t] = np.where(end[t] > 0xFFFFFFFF, len(self.ids), np.searchsorted(self.sorted[t], np.minimum(end[t], 0xFFFFFFFF).astype("u4"), "left"))
        return low, high

    def candidates(self, codes: np.ndarray, share: float, k: int) -> Iterator[tuple[int, np.ndarray]]:
        """For each query, a column of ``codes``, the prefix length it came to and a mask of the rows below its nodes.

        The descent is to the longest length at which the nodes hold enough
        rows, those under several nodes counted at each; the ascent shortens it
        in all trees at once until the distinct ones are enough.
        """
        n = len(self.ids)
        wanted, known = min(n, max(4 * k, int(np.ceil(share * n)))), {}

        def node(length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            if length not in known:
                low, high = self.node(codes, length)
                known[length] = low, high, (high - low).sum(axis=0)
            return known[length]

        for i in range(codes.shape[1]):
            low, high = 0, BITS
            while low < high:  # longer prefixes never hold more
                middle = (low + high + 1) // 2
                low, high = (middle, high) if node(middle)[2][i] >= wanted else (low, middle - 1)
            length, below = low, np.zeros(n, bool)
            while True:
                begin, end, _ = node(length)
                for t, (a, b) in enumerate(zip(begin[:, i].tolist(), end[:, i].tolist())):
                    below[self.order[t, a:b]] = True
                if length == 0 or np.count_nonzero(below) >= wanted:
                    break
                length -= 1
            yield length, below

    def search(self, queries: np.ndarray, own: np.ndarray, codes: np.ndarray, k: int, share: float) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids and scores of the ``k`` best candidates of each query, other than those of its own id."""
        out = []
        for at in range(0, len(queries), 256):
            for i, (_, below) in enumerate(self.candidates(codes[:, at : at + 256], share, k), at):
                below &= self.ids != own[i]
                out.append(best_of(self.x, self.ids, np.flatnonzero(below), queries[i], k))
        return out


def best_of(x: np.ndarray, ids: np.ndarray, rows: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the ``k`` of ``rows`` nearest to ``q``, ties to the smaller id."""
    near = x[rows] @ q
    if len(rows) > k:
        floor = np.partition(near, len(rows) - k)[len(rows) - k]
        rows = rows[near >= floor - 1e-9 * max(1.0, abs(floor))]
    # Products summed row by row in one order, so that equal vectors have equal scores.
    score = (x[rows] * q).sum(axis=1)
    first = np.lexsort((ids[rows], -score))[:k]
    return ids[rows][first], score[first]


def fitted_share(x: np.ndarray, extra: np.ndarray, ids: np.ndarray, true: list[tuple[np.ndarray, np.ndarray]], k: int, target: float, normals: np.ndarray) -> float:
    """The smallest of SHARES at which the first rows of a sample, as queries,
    meet ``target`` of their true neighbours: ``true`` has the vectors and
    extra components of these, one entry a query."""
    codes = hash_strings(x, extra, normals)
    forest = Forest(x, ids, codes)
    rows = len(true)
    asked = hash_strings(x[:rows], np.zeros(rows), normals)
    # The longest prefix that a query shares with each neighbour in any tree.
    match = []
    for i, (near, more) in enumerate(true):
        differ = (hash_strings(near, more, normals) ^ asked[:, i : i + 1]).min(axis=0)
        match.append(BITS - np.ceil(np.log2(differ.astype("f8") + 1)).astype(int))
    total = sum(map(len, match))
    for share in SHARES:
        met = sum(int((m >= length).sum()) for m, (length, _) in zip(match, forest.candidates(asked, share, k)))
        if met >= target * total:
            return share
    return 1.0


def valid_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, x): rows with an id and a vector of finite components, not all zero; repeated rows once."""
    own = df.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"))
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return own.where(F.col("vec_id").isNotNull() & F.coalesce(finite & F.exists("x", lambda v: v != 0), F.lit(False))).distinct()


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def true_neighbours(vectors: DataFrame, asked: dict[int, tuple[np.ndarray, np.ndarray]], k: int) -> dict[int, list[np.ndarray]]:
    """For each length of vector the ``k`` nearest vectors of each query of
    ``asked`` (ids, vectors), by an exact pass over all. Batches keep their
    best, so the pass returns about ``k`` rows a query and batch to one
    aggregation, and ``k`` a query to the driver."""
    schema = pa.schema([("dim", pa.int32()), ("q", pa.int32()), ("score", pa.float64()), ("vec_id", pa.int64()), ("x", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[int, int], list[tuple]] = {}
        for batch in batches:
            dims, ids = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("dim", "vec_id"))
            lists = batch.column(batch.schema.get_field_index("x"))
            for dim, (own, queries) in asked.items():
                rows = np.flatnonzero(dims == dim)
                if len(rows):
                    x = _matrix(lists.take(pa.array(rows)))
                    for q in range(len(own)):
                        some = best_of(x, ids[rows], np.flatnonzero(ids[rows] != own[q]), queries[q], k)
                        at = dict(zip(ids[rows].tolist(), range(len(rows))))
                        kept = best.setdefault((dim, q), [])
                        kept.extend((-s, v, x[at[v]]) for v, s in zip(some[0].tolist(), some[1].tolist()))
                        best[dim, q] = sorted(kept, key=lambda r: r[:2])[:k]
        flat = [(dim, q, -s, v, x) for (dim, q), kept in best.items() for s, v, x in kept]
        columns = list(zip(*flat)) if flat else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)

    found = vectors.select("dim", "vec_id", "x").mapInArrow(run, "dim int, q int, score double, vec_id bigint, x array<double>")
    rank = F.row_number().over(Window.partitionBy("dim", "q").orderBy(F.desc("score"), "vec_id"))
    out: dict[int, list[np.ndarray]] = {dim: [np.empty((0, dim))] * len(own) for dim, (own, _) in asked.items()}
    for (dim, q), part in found.withColumn("rank", rank).where(F.col("rank") <= k).select("dim", "q", "x").toPandas().groupby(["dim", "q"]):
        out[dim][q] = np.array(part["x"].tolist(), "f8").reshape(-1, dim)
    return out


def nearest(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", *, every: int = 20, k: int = 20, trees: int = TREES, target: float = TARGET
) -> DataFrame:
    """query_id, rank, vec_id and score: the ``k`` nearest found of every
    vector whose id is divisible by ``every``, by inner product.

    Vectors that are null, zero, or hold null or non-finite components take no
    part, nor do rows without an id. Vectors of different lengths are never
    compared. A repeated row counts once; of several vectors with one id each
    is a candidate and a query, and none is a candidate of its own id. A tie
    goes to the smaller id. With fewer than ``k`` others, all are returned. An
    empty table, or one without a query, gives no rows; other columns are not read.
    """
    spark = df.sparkSession
    square = F.aggregate("x", F.lit(0.0), lambda acc, v: acc + v * v)
    vectors = written(valid_vectors(df, id_col, vector_col).withColumns({"dim": F.size("x"), "square": square}), "vectors")
    asked = F.col("vec_id") % every == 0
    sizes = {r.dim: r for r in vectors.groupBy("dim").agg(F.count("*").alias("n"), F.sum(asked.cast("bigint")).alias("q"), F.max("square").alias("most")).collect()}  # a row per length
    sizes = {d: r for d, r in sizes.items() if r.q}
    if not sizes:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")

    def by_dim(known: dict[int, float | int]) -> Column:
        return F.element_at(F.create_map(*[F.lit(v) for pair in known.items() for v in pair]), F.col("dim"))

    samples = sampled(vectors, {d: r.n for d, r in sizes.items()})
    lengthen = lambda x, most: np.sqrt(np.maximum(0.0, most - (x * x).sum(axis=1)))
    queries = {d: (ids[:SAMPLE_QUERIES], x[:SAMPLE_QUERIES]) for d, (ids, x) in samples.items() if sizes[d].n > 4 * k}
    true = true_neighbours(vectors, queries, k)
    shares = dict.fromkeys(sizes, 1.0)
    for d in queries:
        ids, x = samples[d]
        shares[d] = fitted_share(x, lengthen(x, sizes[d].most), ids, [(t, lengthen(t, sizes[d].most)) for t in true[d]], k, target, planes(d, trees))
    longest = {d: r.most for d, r in sizes.items()}
    schema = pa.schema([("dim", pa.int32()), ("own", pa.int64()), ("vec_id", pa.int64()), ("x", pa.list_(pa.float64())), ("codes", pa.binary()), ("asked", pa.binary())])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each vector with its strings as a candidate, and as a query if it is one."""
        normals = {d: planes(d, trees) for d in longest}
        for batch in batches:
            dims, own, ids = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("dim", "own", "vec_id"))
            for dim in np.unique(dims):
                rows = np.flatnonzero(dims == dim)
                lists = batch.column(batch.schema.get_field_index("x")).take(pa.array(rows))
                x = _matrix(lists)
                codes = np.ascontiguousarray(hash_strings(x, lengthen(x, longest[dim]), normals[dim]).T)
                queries = np.ascontiguousarray(hash_strings(x, np.zeros(len(x)), normals[dim]).T)
                asks = [q.tobytes() if i % every == 0 else None for i, q in zip(ids[rows].tolist(), queries)]
                yield pa.RecordBatch.from_arrays([pa.array(dims[rows]), pa.array(own[rows]), pa.array(ids[rows]), lists, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(asks, pa.binary())], schema=schema)

    source = vectors.where(F.col("dim").isin(*sizes)).select("dim", F.pmod(F.xxhash64("vec_id", "x"), F.lit(1 << 40)).alias("own"), "vec_id", "x")
    strings = written(source.mapInArrow(hashed, "dim int, own bigint, vec_id bigint, x array<double>, codes binary, asked binary"), "strings")
    blocks, chunks = by_dim({d: -(-r.n // BLOCK) for d, r in sizes.items()}).cast("int"), by_dim({d: -(-r.q // CHUNK) for d, r in sizes.items()}).cast("int")
    block, chunk = F.pmod("own", blocks).cast("int"), F.pmod(F.floor(F.col("own") / 4096), chunks).cast("int")
    rows = strings.select("dim", block.alias("block"), F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk"), F.lit(False).alias("asks"), "own", "vec_id", "x", "codes")
    asks = strings.where("asked is not null").select("dim", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), chunk.alias("chunk"), F.lit(True).alias("asks"), "own", "vec_id", "x", F.col("asked").alias("codes"))

    def search(table: pa.Table) -> pa.Table:
        asking = np.array(table.column("asks").to_pylist())
        ids, own, x = table.column("vec_id").to_numpy(), table.column("own").to_numpy(), _matrix(table.column("x"))
        codes = np.frombuffer(b"".join(table.column("codes").to_pylist()), "u4").reshape(len(ids), -1).T
        out: list[tuple[np.ndarray, ...]] = []
        if asking.any() and not asking.all():
            forest = Forest(x[~asking], ids[~asking], np.ascontiguousarray(codes[:, ~asking]))
            found = forest.search(x[asking], ids[asking], np.ascontiguousarray(codes[:, asking]), k, shares[table.column("dim")[0].as_py()])
            for q, copy, (near, score) in zip(ids[asking], own[asking], found):
                out.append((np.full(len(near), q), np.full(len(near), copy), near, score))
        columns = map(np.concatenate, zip(*out)) if out else [np.empty(0, d) for d in ("i8", "i8", "i8", "f8")]
        return pa.table(dict(zip(("query_id", "copy", "vec_id", "score"), map(pa.array, columns))))

    found = rows.unionByName(asks).groupBy("dim", "block", "chunk").applyInArrow(search, "query_id bigint, copy bigint, vec_id bigint, score double")
    best = Window.partitionBy("query_id", "copy").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def sampled(vectors: DataFrame, sizes: dict[int, int]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of about ``SAMPLE`` vectors of each length, the first by a
    hash of the id; a length of no more vectors is taken whole."""
    whole = 1 << 62
    most = F.element_at(F.create_map(*[F.lit(v) for d, n in sizes.items() for v in (d, min(whole, whole * SAMPLE // n))]), F.col("dim"))
    rows = vectors.where(F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(whole)) < most).select("dim", "vec_id", "x").toPandas()
    out = {}
    for dim, part in rows.groupby("dim"):
        x = np.array(part["x"].tolist(), "f8").reshape(len(part), dim)
        order = np.lexsort((*x.T, part["vec_id"].to_numpy(), pd.util.hash_array(part["vec_id"].to_numpy("u8"))))[:SAMPLE]
        out[int(dim)] = part["vec_id"].to_numpy("i8")[order], x[order]
    return out
