"""Vectors compressed to codes: weighted Lloyd rounds over the distinct integer parts of each position.

1. Components become integers, floor(1024 x); vectors are cut into equal parts.
2. Equal parts of a position are one row with a weight: repeated vectors, and a part that a third of all vectors share, cost one row.
3. Each round assigns the distinct parts to their nearest entry; weighted sums by entry, a few numbers whatever the input's size, move the entries.
4. The last assignment gives each distinct part its code and error, which are joined back to the vectors that hold it. Parts of which a
   thousandth of all vectors or more hold one are at most a thousand in each position and joined by broadcast; the others shuffle.

All arithmetic is on integers, so the order of rows and tasks changes nothing.

Defined results: vectors that are null or hold null or non-finite components are left out; vectors of other lengths than the longest, or of one that the
parts do not divide, are filled up with zeros; integers beyond 2^27 count as 2^27, so that errors fit a long; with fewer vectors than entries
there are as many entries as vectors; of vectors with one id the smaller in order of components comes first, and null ids come last; rows may repeat; null
labels are one label; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import _stage

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Integers stay within this, so squared distances of up to 64 components fit 62 bits.
MOST = 1 << 27
#: Distances computed at once.
TABLE = 1 << 20


def integers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """``row, vec_id, label, whole``: the vectors that are kept, as integers, each row with a number of its own."""
    x = _stage.columns_of(vectors, vec_id="long", embedding="array<double>", label="string")
    odd = F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    whole = F.transform("embedding", lambda c: F.floor(F.greatest(F.least(c * scale, F.lit(float(MOST))), F.lit(float(-MOST)))).cast("int"))
    kept = x.where(F.col("embedding").isNotNull() & ~F.coalesce(odd, F.lit(False)))
    return kept.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", whole.alias("whole"))


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of the nearest entries for every row, and its squared distance. In doubles where these hold every sum exactly, else in integers."""
    code, error = np.empty(len(x), dtype=np.int64), np.empty(len(x), dtype=np.int64)
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(book).max(initial=0)))
    kind = np.float64 if 8 * most * most * max(1, x.shape[1]) < 1 << 53 else np.int64
    book = book.astype(kind)
    own, step = (book * book).sum(axis=1), max(1, TABLE // max(1, len(book)))
    for a in range(0, len(x), step):
        part = x[a : a + step].astype(kind)
        far = own - 2 * (part @ book.T)  # without the row's own square, which is the same for all entries
        best = far.argmin(axis=1)
        code[a : a + step] = best
        error[a : a + step] = far[np.arange(len(part)), best] + (part * part).sum(axis=1)
    return code, error


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _by_position(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Position, rows of the batch that are of it, their parts."""
    pos, parts = batch.column("pos").to_numpy(), _matrix(batch.column("part"), width)
    for k in np.unique(pos).tolist():
        rows = np.flatnonzero(pos == k)
        yield k, rows, parts[rows]


def _sums(books, width: int, entries: int):
    """A task's weighted sums and counts by position and entry: a bounded number of rows."""

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: dict[int, np.ndarray] = {}
        for batch in batches:
            weights = batch.column("n").to_numpy()
            for k, rows, parts in _by_position(batch, width):
                code, _ = nearest(parts, books.value[k])
                n = weights[rows][:, None]
                own = np.hstack([n, parts.astype(np.int64) * n])
                order = np.argsort(code, kind="stable")
                first = np.flatnonzero(np.diff(code[order], prepend=-1))
                sums = have.setdefault(k, np.zeros((entries, width + 1), dtype=np.int64))
                sums[code[order][first]] += np.add.reduceat(own[order], first, axis=0)
        for k, sums in have.items():
            used = np.flatnonzero(sums[:, 0])
            columns = [pa.array(np.full(len(used), k, dtype=np.int32)), pa.array(used.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(np.ascontiguousarray(c)) for c in sums[used].T)], ["pos", "entry", "n", *(f"s{i}" for i in range(width))])

    return add


def _coded(books, width: int):
    def code(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, errors = np.empty(batch.num_rows, dtype=np.int32), np.empty(batch.num_rows, dtype=np.int64)
            for k, rows, parts in _by_position(batch, width):
                codes[rows], errors[rows] = nearest(parts, books.value[k])
            yield pa.RecordBatch.from_arrays([batch.column("pos"), batch.column("part"), batch.column("n"), pa.array(codes), pa.array(errors)], ["pos", "part", "n", "code", "error"])

    return code


class VectorCodes:
    """``codes``: vec_id, label, codes array<int>, error. ``codebooks``: for each part an array of entries by components. ``parts``: pos, part, n, code, error of
    every distinct part."""

    def __init__(self, codes: DataFrame, codebooks: np.ndarray, parts: DataFrame | None):
        self.codes, self.codebooks, self.parts = codes, codebooks, parts

    def digest(self) -> str:
        """SHA-256 of all entries' components in decimal, by part, entry and place, comma-joined."""
        return sha256(",".join(map(str, self.codebooks.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> VectorCodes:
    spark = vectors.sparkSession
    rows = _stage.written(integers(vectors, scale), "vectors")
    total, longest = rows.agg(F.count("*"), F.coalesce(F.max(F.size("whole")), F.lit(0))).first()
    width = -(-longest // parts)
    filled = F.concat("whole", F.array_repeat(F.lit(0), F.lit(width * parts) - F.size("whole")))
    cut = F.array(*[F.slice(filled, k * width + 1, width) if width else F.array().cast("array<int>") for k in range(parts)])
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), filled).select(filled.alias("whole")).limit(entries).collect()  # TakeOrdered: `entries` rows
    books = np.array([r["whole"] for r in first], dtype=np.int64).reshape(len(first), parts, width).transpose(1, 0, 2).copy()
    spread = rows.select("row", "vec_id", "label", F.posexplode(cut).alias("pos", "part"))
    distinct = _stage.written(spread.groupBy("pos", "part").agg(F.count("*").alias("n")), "parts")
    schema = "pos int, entry int, n long" + "".join(f", s{i} long" for i in range(width))
    for _ in range(rounds if total else 0):
        sums = distinct.mapInArrow(_sums(spark.sparkContext.broadcast(books), width, len(first)), schema)
        by_entry = sums.groupBy("pos", "entry").agg(F.sum("n"), *[F.sum(f"s{i}") for i in range(width)])
        books = books.copy()
        for pos, entry, n, *own in by_entry.collect():  # at most parts x entries rows
            books[pos, entry] = [s // n for s in own]
    coded = _stage.written(distinct.mapInArrow(_coded(spark.sparkContext.broadcast(books), width), "pos int, part array<int>, n long, code int, error long"), "coded")
    back = _stage.spread_join(spread, coded.select("pos", "part", "n", "code", "error"), ["pos", "part"], total)
    codes = F.array(*[F.max(F.when(F.col("pos") == k, F.col("code"))) for k in range(parts)])
    whole = back.groupBy("row").agg(F.first("vec_id").alias("vec_id"), F.first("label").alias("label"), codes.alias("codes"), F.sum("error").alias("error"))
    return VectorCodes(_stage.written(whole.drop("row"), "codes"), books, coded)


def with_label_errors(codes: DataFrame) -> DataFrame:
    """``codes`` with ``label_error``: the errors of all rows of its label; nulls are one label."""
    sums = _stage.written(codes.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "labels")
    return codes.join(sums, codes["label"].eqNullSafe(sums["of"])).drop("of")
