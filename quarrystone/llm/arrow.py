"""Small helpers for operators that run as ``mapInArrow``."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa


class Rows:
    """Gathers output rows and hands them on in batches of bounded size."""

    def __init__(self, schema: pa.Schema, rows: int = 20_000, weight: int = 8_000_000):
        self.schema, self.rows, self.most, self.kept, self.weight = schema, rows, weight, [], 0

    def add(self, *row, weight: int = 0) -> None:
        self.kept.append(row)
        self.weight += weight

    def full(self) -> bool:
        return len(self.kept) >= self.rows or self.weight >= self.most

    def batch(self) -> pa.RecordBatch:
        columns = zip(*self.kept) if self.kept else [[] for _ in self.schema]
        out = pa.RecordBatch.from_arrays(
            [pa.array(list(c), type=f.type) for c, f in zip(columns, self.schema)], schema=self.schema
        )
        self.kept, self.weight = [], 0
        return out


def values(batches: Iterable[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """Rows of the named columns as Python values, a slice of rows at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            yield from zip(*(part.column(part.schema.get_field_index(n)).to_pylist() for n in names))


def grouped(rows: Iterable[tuple], weight: Callable[[tuple], int], most: int = 2_000_000, at_most: int = 1_000) -> Iterator[list[tuple]]:
    """Lists of rows whose weights add up to little more than ``most``."""
    kept, total = [], 0
    for row in rows:
        kept.append(row)
        total += weight(row)
        if total >= most or len(kept) >= at_most:
            yield kept
            kept, total = [], 0
    if kept:
        yield kept
