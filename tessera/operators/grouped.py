"""Small kernels over many rows or groups: a task streams through them in order, so that each costs what its rows cost."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows that a task hands back at once.
ROWS = 10_000


def packed(rows: list[tuple], kind: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in kind]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind, strict=True)], schema=kind)


def by_row(df: DataFrame, make: Callable[..., Iterable[tuple]], schema: T.StructType) -> DataFrame:
    """What ``make`` makes of the values of each row, tuples in the order of ``schema``. A task holds one row of ``df`` and ROWS of what is made."""
    kind = to_arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                for made in make(*[x.as_py() for x in row]):
                    out.append(made)
                    if len(out) >= ROWS:
                        yield packed(out, kind)
                        out = []
        yield packed(out, kind)

    return df.mapInArrow(run, schema)


def by_key(df: DataFrame, key: list[str], choose: Callable[[list[tuple]], Iterable[tuple]], schema: str) -> DataFrame:
    """What ``choose`` makes of the rows of each group, tuples in the order of ``df``'s columns. A task holds one group at a time."""
    at, kind = [df.columns.index(k) for k in key], to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, last, out = [], None, []
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                group = [row[k] for k in at]
                if own and group != last:
                    out += choose(own)
                    own = []
                    if len(out) >= ROWS:
                        yield packed(out, kind)
                        out = []
                own.append(row)
                last = group
        if own:
            out += choose(own)
        yield packed(out, kind)

    return df.repartition(*key).sortWithinPartitions(*key).mapInArrow(run, schema)
