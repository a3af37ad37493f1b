"""Benchmark decontamination by a prefix-filtered set join.

Items are cut into windows of ``window`` consecutive words (an item of fewer words is one window), windows into shingles of
``shingle`` words. A document that contains a window contains every one of its shingles, so one is enough as the prefix: the
rarest over all documents. Documents and windows are joined on that shingle, its place bounds where the window would have to
begin and end, and each candidate is verified word by word over the window.

Defined results: a null item_id is the empty one, and counts as one item with it; a null or empty text has no words; a null or empty item has no windows; repeated rows are treated each on its
own; an empty benchmark hits nothing; other columns are ignored, ``carry`` columns come back untouched.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import _stage, _text

WINDOW = 13
SHINGLE = 4
#: Windows that are broadcast at once (about 200 bytes each); a larger benchmark is taken in as many blocks as it needs.
BLOCK_WINDOWS = 200_000

_WINDOWS = "item_id string, n int, words binary, hashes binary, shingle_n int, shingles array<long>"


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """The distinct windows of each item: ``item_id, n, words`` (joined by a space), hashes of words and of shingles."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = batch.column("item_id").to_pylist(), []
            for block in _text.blocks(batch.column("text"), _text.ALNUM):
                hashes = block.hashes()
                for r in range(len(block)):
                    a, b = int(block.first[r]), int(block.first[r + 1])
                    n = min(window, b - a)
                    k = min(shingle, n)
                    for s in range(a, b - n + 1 if n else a):
                        text = b" ".join(block.data[i:j].tobytes() for i, j in zip(block.starts[s : s + n], block.ends[s : s + n], strict=True))
                        rows.append((ids[block.offset + r], n, text, hashes[s : s + n].tobytes(), k, _text.runs(hashes[s : s + n], k).view(np.int64).tolist()))
            columns = zip(*rows, strict=True) if rows else [[]] * 6
            kinds = (pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(columns, kinds, strict=True)], ["item_id", "n", "words", "hashes", "shingle_n", "shingles"])

    items = _stage.columns_of(benchmark, item_id="string", text="string")
    return items.mapInArrow(cut, _WINDOWS).dropDuplicates(["item_id", "n", "words"])


def shingle_counts(docs: DataFrame, wanted: dict[int, np.ndarray]) -> DataFrame:
    """How often each wanted shingle (by its number of words) occurs over all documents: ``shingle_n, shingle, n``."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = {k: np.zeros(len(v), dtype=np.int64) for k, v in wanted.items()}
        for batch in batches:
            for block in _text.blocks(batch.column("text"), _text.ALNUM):
                hashes, row = block.hashes(), block.row_of_word()
                for k, sought in wanted.items():
                    g = _text.runs(hashes, k)
                    g = g[row[: len(g)] == row[k - 1 :][: len(g)]]
                    at = np.searchsorted(sought, g)
                    at[at == len(sought)] = 0
                    totals[k] += np.bincount(at[sought[at] == g], minlength=len(sought))
        for k, v in wanted.items():
            some = np.flatnonzero(totals[k])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), k, dtype=np.int32)), pa.array(v[some].view(np.int64)), pa.array(totals[k][some])], ["shingle_n", "shingle", "n"])

    return docs.mapInArrow(count, "shingle_n int, shingle long, n long").groupBy("shingle_n", "shingle").agg(F.sum("n").alias("n"))


class PrefixIndex:
    """Windows under their prefix shingle: by number of words the sorted shingles, and for each its windows and their offsets."""

    def __init__(self, windows: list, counts: dict[tuple[int, int], int]):
        self.items = [w["item_id"] for w in windows]
        self.words = [bytes(w["words"]) for w in windows]
        self.n = np.array([w["n"] for w in windows], dtype=np.int64)
        self.hashes = np.zeros((len(windows), max([1, *self.n.tolist()])), dtype=np.uint64)
        by: dict[int, list[tuple[int, int, int]]] = {}
        for i, w in enumerate(windows):
            self.hashes[i, : w["n"]] = np.frombuffer(w["hashes"], dtype=np.uint64)
            ranked = min((counts.get((w["shingle_n"], s), 0), s, at) for at, s in enumerate(w["shingles"]))
            by.setdefault(w["shingle_n"], []).append((ranked[1] % (1 << 64), i, ranked[2]))
        self.prefixes = {}
        for k, entries in by.items():
            entries.sort()
            keys, first = np.unique(np.array([e[0] for e in entries], dtype=np.uint64), return_index=True)
            self.prefixes[k] = (keys, np.append(first, len(entries)), np.array([e[1] for e in entries]), np.array([e[2] for e in entries]))

    def occurrences(self, block: _text.Block, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First words (numbered in the block) and windows of every verified occurrence."""
        row = block.row_of_word()
        found_at, found = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for k, (keys, first, windows, offsets) in self.prefixes.items():
            g = _text.runs(hashes, k)
            at = np.searchsorted(keys, g)
            at[at == len(keys)] = 0
            places = np.flatnonzero(keys[at] == g)
            lists = at[places]
            sizes = first[lists + 1] - first[lists]
            places = np.repeat(places, sizes)
            entry = np.repeat(first[lists], sizes) + np.arange(len(places)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            window = windows[entry]
            begin = places - offsets[entry]
            end = begin + self.n[window]  # the bounds of place and length: all of the window within one document
            fits = (begin >= 0) & (end <= len(hashes))
            begin, end, window = begin[fits], end[fits], window[fits]
            same = row[begin] == row[end - 1] if len(begin) else np.zeros(0, dtype=bool)
            for j in range(self.hashes.shape[1]):
                inside = j < self.n[window]
                same &= ~inside | (hashes[np.minimum(begin + j, len(hashes) - 1)] == self.hashes[window, j])
            for b, w in zip(begin[same].tolist(), window[same].tolist(), strict=True):
                spans = zip(block.starts[b : b + self.n[w]], block.ends[b : b + self.n[w]], strict=True)
                if b" ".join(block.data[i:j].tobytes() for i, j in spans) == self.words[w]:
                    found_at.append(np.array([b]))
                    found.append(np.array([w]))
        return np.concatenate(found_at), np.concatenate(found)


_RESULT = "doc_id long, n_words long, n_hit long, item_ids array<string>, spans array<struct<start:int,end:int>>"


def _scan(index, carry: str | None, more: bool):
    """mapInArrow body: adds a block's hits to those of earlier blocks; the texts go on if more blocks follow."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = [set(x or ()) for x in batch.column("item_ids").to_pylist()]
            spans = [[(s["start"], s["end"]) for s in x or ()] for x in batch.column("spans").to_pylist()]
            n_words = np.zeros(batch.num_rows, dtype=np.int64)
            for block in _text.blocks(batch.column("text"), _text.ALNUM):
                n_words[block.offset : block.offset + len(block)] = np.diff(block.first)
                begins, windows = index.value.occurrences(block, block.hashes())
                rows = np.searchsorted(block.first, begins, side="right") - 1
                for r, b, w in zip(rows.tolist(), begins.tolist(), windows.tolist(), strict=True):
                    items[block.offset + r].add(index.value.items[w] or "")
                    start = b - int(block.first[r])
                    spans[block.offset + r].append((start, start + int(index.value.n[w])))
            merged = [_merged(s) for s in spans]
            out = {
                "doc_id": batch.column("doc_id"),
                "n_words": pa.array(n_words),
                "n_hit": pa.array([sum(e - s for s, e in x) for x in merged], pa.int64()),
                "item_ids": pa.array([sorted(x) for x in items], pa.list_(pa.string())),
                "spans": pa.array([[{"start": s, "end": e} for s, e in x] for x in merged], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
            }
            out |= {c: batch.column(c) for c in ([carry] if carry else []) + (["text"] if more else [])}
            yield pa.RecordBatch.from_pydict(out)
        _text.give_back()

    return scan


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, block_windows: int = BLOCK_WINDOWS, carry: str | None = None) -> DataFrame:
    """Per document ``doc_id, n_words, n_hit, item_ids, spans, contaminated``: spans of words inside any occurrence of a window.

    ``contaminated``: at least one word is hit and hit words are a twentieth of all words or more.
    """
    spark = docs.sparkSession
    kept = [carry] if carry else []
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *kept)
    windows = _stage.written(benchmark_windows(benchmark, window, shingle), "windows")
    blocks = max(1, -(-windows.count() // block_windows))
    now = texts.withColumns({"item_ids": F.lit(None).cast("array<string>"), "spans": F.lit(None).cast("array<struct<start:int,end:int>>")})
    for b in range(blocks):
        own = windows.where(F.pmod(F.xxhash64("item_id", "words"), F.lit(blocks)) == b).collect()
        sought: dict[int, set[int]] = {}
        for w in own:
            sought.setdefault(w["shingle_n"], set()).update(w["shingles"])
        wanted = {k: np.unique(np.array(list(v), dtype=np.int64).view(np.uint64)) for k, v in sought.items()}
        counts = {(r[0], r[1]): r[2] for r in shingle_counts(texts.select("text"), wanted).collect()} if wanted else {}
        index = spark.sparkContext.broadcast(PrefixIndex(own, counts))
        more = b < blocks - 1
        fields = [texts.schema[c] for c in [*kept, *["text"] * more]]  # as they are: a DDL text would need its names quoted
        now = now.mapInArrow(_scan(index, carry, more), T.StructType([*T.DataType.fromDDL(_RESULT).fields, *fields]))
        if more:
            now = _stage.written(now, "scanned")
    return now.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).withColumn("item_ids", F.coalesce("item_ids", F.array().cast(T.ArrayType(T.StringType()))))
