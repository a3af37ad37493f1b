"""N-gram Jaccard join by T-occurrence search (DivideSkip).

A document's set holds the hashes of its distinct 5-word shingles. Documents with equal sets form a class, and classes are joined:

1. One pass counts shingles in slots and digests each set. Shingles are ordered by how frequent their slot is, then by hash, so
   shared passages come last.
2. In that order two sets that are similar enough share a shingle among the first |x| - ceil(t|x|) + 1, and more than one if their
   sizes are alike. Only these prefixes are dealt out, by shingle; where a shingle has two classes or more it gives an inverted list.
   Classes that share so many short lists (up to SHORT classes) as a link of their sizes must are neighbours; in a long list every class is a
   neighbour of the list's smallest. Classes that neighbours connect form a family: every link lies within one.
3. Families are searched for links, each by DivideSkip over the whole sets of its members: a query's short lists are heap-merged,
   its longest are probed by binary search, and members that reach the overlap the threshold asks for are kept. A family up to TILE shingles is
   one tile, all against all. A larger one is first asked for the links of its most connected class; only the members that do not link with it
   are then queries, in tiles of a block of queries and a block of members.
4. A tile returns a spanning forest of the links it found, so never more rows than members; pairs that links already connect need
   no check. Components of these links are those of all links. At no time is there a row for each pair of a group.

Defined results: a null or empty text has an empty set and links with nothing; texts of fewer words than a shingle are one shingle;
repeated rows have equal sets and so one component; a null id takes part, but is no component's name (a component of null ids
only has null); other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from hashlib import blake2b
from math import log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import _bits, _stage, _text

SHINGLE = 5
THRESHOLD = (75, 100)
#: Slots for shingle counts: SLOTS_A_DOCUMENT for each, within these bounds (only the order of shingles depends on them, never the result).
SLOTS_A_DOCUMENT = 64
SLOTS = (1 << 16, 1 << 22)
SLOT_BLOCK = 1 << 14
#: Prefix entries of a bucket on average; a shingle whose slot may hold more than LIST_ENTRIES is dealt over several buckets.
BUCKET_ENTRIES = 400_000
LIST_ENTRIES = 10_000
#: Classes of a list whose pairs are counted in place; longer lists make families.
SHORT = 64
#: Pairs of a bucket that are looked at at once.
PAIRS = 1 << 20
#: Shingles of one side of a tile.
TILE = 1 << 18
#: Bits of the filter that keeps the sets of classes with a partner; a fuller filter lets through more sets, nothing else.
FILTER_BITS = 1 << 26


def shingle_sets(column: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row number and sorted distinct shingle hashes of every row."""
    for block in _text.blocks(column, _text.SPACED):
        hashes = block.hashes()
        every = _text.runs(hashes, n)
        for r in range(len(block)):
            a, b = int(block.first[r]), int(block.first[r + 1])
            own = every[a : b - n + 1] if b - a >= n else _text.runs(hashes[a:b], b - a) if b > a else hashes[:0]
            yield block.offset + r, np.unique(own)


def digest(own: np.ndarray) -> bytes | None:
    return blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None


def key_of(cls: bytes) -> int:
    """The 64-bit key under which a class is dealt out; tables keep the whole digest."""
    return int.from_bytes(cls[:8], "little", signed=True)


_SURVEY = "doc_id long, row_key long, n_shingles long, cls binary, k long, block int, counts binary"


def slots_for(rows: int) -> int:
    return min(max(SLOTS[0], 1 << (SLOTS_A_DOCUMENT * max(1, rows) - 1).bit_length()), SLOTS[1])


def _survey(n: int, n_slots: int):
    def survey(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = np.zeros(n_slots, dtype=np.uint32)

        def out(ids, row_keys, sizes, classes, blocks, counts):
            keys = [key_of(c) if c else None for c in classes]
            arrays = [pa.array(ids, pa.int64()), pa.array(row_keys, pa.int64()), pa.array(sizes, pa.int64()), pa.array(classes, pa.binary()), pa.array(keys, pa.int64()), pa.array(blocks, pa.int32()), pa.array(counts, pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, ["doc_id", "row_key", "n_shingles", "cls", "k", "block", "counts"])

        def add(pending: list[np.ndarray]) -> None:
            at, times = np.unique((np.concatenate(pending) & np.uint64(n_slots - 1)).astype(np.int32), return_counts=True)
            slots[at] += times.astype(np.uint32)

        for batch in batches:
            sizes, classes, pending, held = [], [], [], 0
            for _, own in shingle_sets(batch.column("text"), n):
                sizes.append(len(own))
                classes.append(digest(own))
                pending.append(own)
                held += len(own)
                if held > 1_000_000:
                    add(pending)
                    pending, held = [], 0
            if pending:
                add(pending)
            none = [None] * len(sizes)
            yield out(batch.column("doc_id"), batch.column("row_key"), sizes, classes, none, none)
        for b in range(0, n_slots, SLOT_BLOCK):
            part = slots[b : b + SLOT_BLOCK]
            if (most := part.max()) > 0:
                kind = "<u1" if most < 1 << 8 else "<u2" if most < 1 << 16 else "<u4"
                yield out([None], [None], [None], [None], [b // SLOT_BLOCK], [part.astype(kind).tobytes()])
        _text.give_back()

    return survey


def _slot_sums(surveyed: DataFrame, n_slots: int, tasks: int) -> np.ndarray:
    """Counts by slot over all documents: as many numbers as slots, whatever the input's size."""

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, counts in zip(batch.column("block").to_pylist(), batch.column("counts"), strict=True):
                body = counts.as_buffer()
                new = np.frombuffer(body, dtype=f"<u{body.size // SLOT_BLOCK}").astype(np.int64)
                have[b] = have[b] + new if b in have else new
        for b, counts in have.items():
            yield pa.RecordBatch.from_pydict({"block": pa.array([b], pa.int32()), "counts": pa.array([np.minimum(counts, 0xFFFFFFFF).astype("<u4").tobytes()], pa.binary())})

    out = np.zeros(n_slots, dtype=np.uint32)
    parts = surveyed.where("block is not null").select("block", "counts").repartition(tasks, "block").mapInArrow(add, "block int, counts binary")
    for row in parts.toLocalIterator():
        out[row["block"] * SLOT_BLOCK :][:SLOT_BLOCK] = np.frombuffer(bytes(row["counts"]), dtype="<u4")
    return out


def frequency_levels(slots: np.ndarray) -> np.ndarray:
    """0 for slots within four standard deviations of the mean count, then one level for each doubling of what is over the mean."""
    mean = max(1.0, float(slots.mean()))
    return np.minimum(np.log2(np.maximum(1.0, (slots - mean) / (2 * mean**0.5))), 63).astype(np.uint8)


def buckets_by_level(slots: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Over how many buckets, as a power of two, a shingle of each level is dealt: one unless a slot of that level counts more than LIST_ENTRIES."""
    most = np.ones(64)
    np.maximum.at(most, levels, slots)
    return np.uint64(1) << np.ceil(np.log2(np.maximum(1.0, most / LIST_ENTRIES))).astype(np.uint64)


def levels_of(hashes: np.ndarray, levels: np.ndarray) -> np.ndarray:
    return levels[(hashes & np.uint64(len(levels) - 1)).astype(np.int64)].astype(np.uint64)


def prefix(own: np.ndarray, levels: np.ndarray, num: int, den: int) -> np.ndarray:
    """The first |x| - ceil(t|x|) + 1 shingles in the order of frequency level, then hash."""
    p = len(own) - -(-num * len(own) // den) + 1
    order = (levels_of(own, levels) << np.uint64(58)) | (own >> np.uint64(6))
    return own[np.argsort(order, kind="stable")[:p]]


_POSTING = np.dtype([("h", "<u8"), ("k", "<i8"), ("n", "<u4"), ("at", "<u4")])


def _postings(order, n: int, num: int, den: int, buckets: int):
    """Prefix shingles by bucket. A shingle of a very frequent slot is dealt over several buckets, by class."""

    def post(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, spreads = order.value
        seen: set[int] = set()
        hold: list[np.ndarray] = []
        held = 0

        def flush():
            rows = np.concatenate(hold)
            spread = np.minimum(spreads[levels_of(rows["h"], levels).astype(np.int64)], np.uint64(buckets))
            part = (rows["h"] + (rows["k"].view(np.uint64) % spread)) % np.uint64(buckets)
            by_part = np.argsort(part, kind="stable")
            rows, part = rows[by_part], part[by_part]
            cuts = np.append(np.flatnonzero(np.diff(part, prepend=part[0] + np.uint64(1))), len(rows))
            yield pa.RecordBatch.from_pydict({"bucket": pa.array(part[cuts[:-1]].astype(np.int64)), "body": pa.array([rows[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())})

        for batch in batches:
            for _, own in shingle_sets(batch.column("text"), n):
                if not len(own) or (k := key_of(digest(own))) in seen:
                    continue
                seen.add(k)
                first = prefix(own, levels, num, den)
                rows = np.empty(len(first), dtype=_POSTING)
                rows["h"], rows["k"], rows["n"], rows["at"] = first, k, len(own), np.arange(len(first))
                hold.append(rows)
                held += len(rows)
                if held > 1_000_000:
                    yield from flush()
                    hold, held = [], 0
        if hold:
            yield from flush()
        hold = []
        _text.give_back()

    return post


_LISTS = "h long, a long, an long, b long, bn long, shared long"


def _may_link(rows: np.ndarray, a: np.ndarray, b: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether the sizes of two entries' sets and their places in them leave room for a link."""
    an, bn, at, bt = (rows[c][x].astype(np.int64) for c in ("n", "at") for x in (a, b))
    room = np.minimum(at, bt) + np.minimum(an - at, bn - bt)
    return (np.minimum(an, bn) * den >= np.maximum(an, bn) * num) & (room * (num + den) >= num * (an + bn))


def _lists(order, num: int, den: int, short: int):
    """What a bucket's inverted lists say: pairs of classes with the number of short lists they share, and the entries ``h, a, an`` of long lists.

    Lists that may go on in another bucket count as long. Pairs are left out whose sizes, or whose places in a list, rule a link out.
    """

    def lists(table: pa.Table) -> pa.Table:
        levels, spreads = order.value
        rows = np.frombuffer(b"".join(table.column("body").to_pylist()), dtype=_POSTING)
        rows = rows[np.lexsort((rows["k"], rows["h"]))]
        rows = rows[np.append(True, (rows["h"][1:] != rows["h"][:-1]) | (rows["k"][1:] != rows["k"][:-1]))]
        first = np.flatnonzero(np.append(True, rows["h"][1:] != rows["h"][:-1]))
        sizes = np.diff(np.append(first, len(rows)))
        long = (sizes > short) | (spreads[levels_of(rows["h"][first], levels).astype(np.int64)] > 1)
        left, right = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for m in np.unique(sizes[~long & (sizes > 1)]).tolist():
            begins = first[~long & (sizes == m)][:, None]
            x, y = np.triu_indices(m, 1)
            step = max(1, PAIRS // len(x))
            for s in range(0, len(begins), step):
                a, b = (begins[s : s + step] + x).ravel(), (begins[s : s + step] + y).ravel()
                fits = _may_link(rows, a, b, num, den)
                left.append(a[fits])
                right.append(b[fits])
        a, b = rows[np.concatenate(left)], rows[np.concatenate(right)]
        by_pair = np.lexsort((b["k"], a["k"]))
        a, b = a[by_pair], b[by_pair]
        begins = np.flatnonzero(np.append(len(a) > 0, (a["k"][1:] != a["k"][:-1]) | (b["k"][1:] != b["k"][:-1])))
        shared = np.diff(np.append(begins, len(a)))
        a, b = a[begins], b[begins]
        entries = rows[np.repeat(long, sizes)]
        none = pa.nulls(len(entries), pa.int64())
        of = lambda pairs, more: pa.chunked_array([pa.array(np.ascontiguousarray(pairs).astype(np.int64)), more])
        columns = [of(np.zeros(0), pa.nulls(0, pa.int64()))] * 6
        columns[0] = pa.chunked_array([pa.nulls(len(a), pa.int64()), pa.array(np.ascontiguousarray(entries["h"]).view(np.int64))])
        columns[1], columns[2] = of(a["k"], pa.array(np.ascontiguousarray(entries["k"]))), of(a["n"], pa.array(entries["n"].astype(np.int64)))
        columns[3], columns[4], columns[5] = of(b["k"], none), of(b["n"], none), of(shared, none)
        _text.give_back()
        return pa.Table.from_arrays(columns, names=["h", "a", "an", "b", "bn", "shared"])

    return lists


def _least_shared(n1, n2, num: int, den: int):
    """Prefix shingles that two sets of these sizes share at least if they link.

    Of the two, take the set whose prefix ends first in the order: what it shares within its prefix is in the other's prefix too,
    and beyond its prefix it has ceil(t|x|) - 1 shingles.
    """
    return F.ceil(num * (n1 + n2) / (num + den)) - F.ceil(num * F.greatest(n1, n2) / den) + 1


def _required(a, b, num: int, den: int):
    return -(-num * (a + b) // (num + den))


class InvertedIndex:
    """Inverted lists over some sets, numbered by ascending size: for every shingle the numbers of the sets that hold it, ascending."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(x) for x in sets])
        tokens = np.concatenate(sets)
        whose = np.repeat(np.arange(len(sets)), self.sizes)
        by_token = np.argsort(tokens, kind="stable")
        tokens, self.whose = tokens[by_token], whose[by_token]
        self.first = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1]))
        self.tokens, self.last = tokens[self.first], np.append(self.first[1:], len(tokens))

    def most_connected(self) -> int:
        """The set whose lists are the longest in sum."""
        lengths = self.last - self.first
        return int(np.argmax(np.bincount(self.whose, weights=np.repeat(lengths, lengths))))

    def lists(self, query: np.ndarray, low: int, high: int) -> list[np.ndarray]:
        """The lists of the query's shingles, cut to sets ``low`` to ``high`` (exclusive) and without empty ones, short ones first."""
        at = np.searchsorted(self.tokens, query)
        at[at == len(self.tokens)] = 0
        at = at[self.tokens[at] == query]
        every = [self.whose[a:b] for a, b in zip(self.first[at], self.last[at], strict=True)]
        if low > 0 or high < len(self.sizes):
            every = [x[np.searchsorted(x, low) : np.searchsorted(x, high)] for x in every]
        return sorted((x for x in every if len(x)), key=len)


def divide_skip(query: np.ndarray, index: InvertedIndex, num: int, den: int) -> list[tuple[int, int]]:
    """Which indexed sets reach the overlap with ``query`` that the threshold asks for, and their overlaps.

    Only sets whose size allows it are looked at. With T the least overlap asked of any, the L longest lists are set aside: a set that is on T
    lists is on T - L of the others. These are heap-merged; what reaches T - L there is looked up in the long lists by binary search,
    for as long as it can still reach its own overlap.
    """
    n = len(query)
    low, high = np.searchsorted(index.sizes, -(-num * n // den)), np.searchsorted(index.sizes, den * n // num, side="right")
    if low >= high:
        return []
    least = int(_required(n, int(index.sizes[low]), num, den))
    inverted = index.lists(query, low, high)
    if len(inverted) < least:
        return []
    aside = min(least - 1, int(least / (0.01 * log(max(2, len(inverted[-1]))) + 1)))
    short, long_lists = inverted[: len(inverted) - aside], inverted[len(inverted) - aside :]
    merged = np.fromiter(heapq.merge(*(x.tolist() for x in short)), dtype=np.int64)
    found, count = np.unique(merged, return_counts=True)
    need = _required(n, index.sizes[found], num, den)
    for left, one in zip(range(aside, 0, -1), long_lists, strict=True):
        alive = count + left >= need
        found, count, need = found[alive], count[alive], need[alive]
        if not len(found):
            return []
        at = np.searchsorted(one, found)
        count = count + (one[np.minimum(at, len(one) - 1)] == found)
    return [(j, c) for j, c, t in zip(found.tolist(), count.tolist(), need.tolist(), strict=True) if c >= t]


class _Forest:
    """Which keys links connect so far."""

    def __init__(self):
        self.above: dict[int, int] = {}

    def root(self, k: int) -> int:
        while (up := self.above.get(k, k)) != k:
            self.above[k] = self.above.get(up, up)
            k = up
        return k

    def join(self, a: int, b: int) -> bool:
        """Whether the link connects what was apart; the smaller root stays."""
        a, b = sorted((self.root(a), self.root(b)))
        self.above[b] = a
        return a != b


#: In a tile: member that is searched, query, or both.
MEMBER, QUERY, BOTH = 0, 1, 2


def _searched(num: int, den: int):
    """A tile's links as a spanning forest. Members that share a ``label`` are known to be connected.

    Where members are queries too, the most connected one asks first; what its component holds need not ask, as all others do.
    """

    def search(table: pa.Table) -> pa.Table:
        rows = [(r, k, label, np.frombuffer(body, dtype=np.uint64)) for r, k, label, body in zip(*(table.column(c).to_pylist() for c in ("role", "k", "label", "body")), strict=True)]
        members = sorted((r for r in rows if r[0] != QUERY), key=lambda r: (len(r[3]), r[1]))
        queries = sorted((r for r in rows if r[0] != MEMBER), key=lambda r: (len(r[3]), r[1]))
        links, forest = [], _Forest()
        for _, k, label, _ in rows:
            forest.join(k, label)
        if members and queries:
            index = InvertedIndex([own for *_, own in members])
            main = members[index.most_connected()][1] if queries[0][0] == BOTH else None
            for _, q, _, own in sorted(queries, key=lambda r: r[1] != main):
                if main not in (None, q) and forest.root(q) == forest.root(main):
                    continue
                for j, _ in divide_skip(own, index, num, den):
                    if forest.join(q, members[j][1]):
                        links.append((q, members[j][1]))
        a, b = zip(*links, strict=True) if links else ((), ())
        rows = members = queries = index = None
        _text.give_back()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return search


def components(links: DataFrame) -> DataFrame:
    """``k, label``: the smallest key reachable over the links, for every key that has one.

    Smallest labels spread along links, and each round every label also takes its own label's label, so long chains take few rounds.
    """
    both = _stage.written(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    labels = _stage.written(both.groupBy(F.col("a").alias("k")).agg(F.min(F.least("a", "b")).alias("label")), "labels")
    total = None
    while True:
        near = both.join(labels, both["b"] == labels["k"]).groupBy(F.col("a").alias("k")).agg(F.min("label").alias("label"))
        spread = _stage.written(labels.union(near).groupBy("k").agg(F.min("label").alias("label")), "spread")
        up = spread.select(F.col("k").alias("at"), F.col("label").alias("up"))
        labels = _stage.written(spread.join(up, spread["label"] == up["at"]).select("k", F.least("label", "up").alias("label")), "labels")
        before, total = total, labels.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
        if total == before:  # labels only ever fall
            return labels


class JaccardJoin:
    """``documents``: doc_id, n_shingles, component_id, row_key (hash of the text). ``links``: verified links (a, b) between class keys that
    connect every component. ``members``: doc_id, row_key, n_shingles, cls, k."""

    def __init__(self, documents: DataFrame, links: DataFrame, members: DataFrame):
        self.documents, self.links, self.members = documents, links, members


def _families(lists: DataFrame, num: int, den: int) -> DataFrame:
    """``k, n, weight, family``: the classes that may have links, how many lists each is known to share, and the smallest class of its family."""
    counted = lists.where("h is null").groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.first("an").alias("an"), F.first("bn").alias("bn"))
    near = _stage.written(counted.where(F.col("shared") >= _least_shared(F.col("an"), F.col("bn"), num, den)), "near")
    entries = lists.where("h is not null").select("h", F.col("a").alias("k"), F.col("an").alias("n"))
    tops = entries.groupBy("h").agg(F.min("k").alias("top"), F.max("k").alias("last")).where("top < last").select("h", "top")
    entries = _stage.written(entries.join(tops, "h"), "long")
    edges = near.select("a", "b").unionByName(entries.where("k != top").select(F.col("top").alias("a"), F.col("k").alias("b")))
    weights = near.select(F.col("a").alias("k"), F.col("an").alias("n"), "shared").unionByName(near.select(F.col("b").alias("k"), F.col("bn").alias("n"), "shared")).unionByName(entries.select("k", "n", F.lit(1).cast("long").alias("shared")))
    weights = weights.groupBy("k").agg(F.first("n").alias("n"), F.sum("shared").alias("weight"))
    return _stage.written(weights.join(components(edges), "k").withColumnRenamed("label", "family"), "families")


def _search(families: DataFrame, sets: DataFrame, num: int, den: int, tile: int) -> DataFrame:
    """``a, b``: links that connect every component of every family."""
    by_family = families.groupBy("family").agg(F.ceil(F.sum("n") / tile).cast("int").alias("blocks"), F.max(F.struct("weight", (-F.col("k")).alias("neg"))).alias("m"))
    by_family = _stage.written(by_family.select("family", "blocks", (-F.col("m.neg")).alias("main")), "sizes")

    def found(tiles: DataFrame, *by: str) -> DataFrame:
        rows = tiles.join(sets, "k").select(*by, "role", "k", "label", "body")
        return _stage.written(rows.groupBy(*by).applyInArrow(_searched(num, den), "a long, b long"), "links")

    small = families.join(by_family.where("blocks = 1"), "family").select("family", F.lit(BOTH).alias("role"), "k", F.col("k").alias("label"))
    links = found(small, "family")
    large = by_family.where("blocks > 1")
    if not large.take(1):
        return links
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = lambda salt, n: F.pmod(F.xxhash64("k", F.lit(salt)), F.col(n)).cast("int")
    members = _stage.written(families.join(large, "family").select("family", "k", "n", "blocks", "main", dealt(1, "blocks").alias("block")), "large")
    asked = large.select("family", every("blocks").alias("block"), F.lit(QUERY).alias("role"), F.col("main").alias("k"), F.col("main").alias("label"))
    star = found(members.where("k != main").select("family", "block", F.lit(MEMBER).alias("role"), "k", F.col("k").alias("label")).unionByName(asked), "family", "block")
    # a link of the main class, found from either side, puts a member into the main class's component
    linked = star.select("a").union(star.select("b")).distinct().withColumnRenamed("a", "linked")
    known = members.join(linked, members["k"] == linked["linked"], "left").withColumn("label", F.when(F.col("linked").isNotNull(), F.col("main")).otherwise(F.col("k")))
    known = _stage.written(known.drop("linked"), "known")
    rest = known.where("label != main and k != main")
    parts = _stage.written(rest.groupBy("family").agg(F.ceil(F.sum("n") / tile).cast("int").alias("parts")), "parts")
    queries = rest.join(parts, "family").select("family", dealt(2, "parts").alias("part"), every("blocks").alias("block"), F.lit(QUERY).alias("role"), "k", "label")
    searched = known.join(parts, "family").select("family", every("parts").alias("part"), "block", F.lit(MEMBER).alias("role"), "k", "label")
    return links.unionByName(star).unionByName(found(queries.unionByName(searched), "family", "part", "block"))


def jaccard_join(docs: DataFrame, shingle: int = SHINGLE, threshold: tuple[int, int] = THRESHOLD, short: int = SHORT, tile: int = TILE) -> JaccardJoin:
    """Links between documents whose shingle sets' intersection is at least ``threshold`` of their union, as classes and components.

    ``short`` and ``tile`` say how the work is cut, never what is found.
    """
    num, den = threshold
    spark = docs.sparkSession
    tasks = min(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    texts = _stage.columns_of(docs, doc_id="long", text="string").withColumn("row_key", F.xxhash64("text"))
    n_slots = slots_for(texts.count())
    surveyed = _stage.written(texts.mapInArrow(_survey(shingle, n_slots), _SURVEY), "survey")
    members = surveyed.where("block is null").select("doc_id", "row_key", "n_shingles", "cls", "k")
    slots = _slot_sums(surveyed, n_slots, tasks)
    levels = frequency_levels(slots)
    order = spark.sparkContext.broadcast((levels, buckets_by_level(slots, levels)))
    total = surveyed.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    buckets = max(256, -(-total * (den - num) // den // BUCKET_ENTRIES))
    body = texts.select("text").mapInArrow(_postings(order, shingle, num, den, buckets), "bucket long, body binary")
    lists = _stage.written(body.groupBy("bucket").applyInArrow(_lists(order, num, den, short), _LISTS), "lists")
    families = _families(lists, num, den)
    links = _search(families, _sets(texts, members, families.select("k"), shingle, tasks), num, den, tile)
    labels = components(links)
    whole = members.join(labels, "k", "left").select("doc_id", "row_key", "n_shingles", "cls", F.when(F.col("label").isNotNull(), F.col("label").cast("string").cast("binary")).otherwise(F.col("cls")).alias("group"))
    whole = _stage.written(whole, "grouped")
    names = _stage.written(whole.where("group is not null").groupBy("group").agg(F.min("doc_id").alias("name")), "names")
    alone = whole.where("group is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "row_key")
    documents = whole.where("group is not null").join(names, "group").select("doc_id", "n_shingles", F.col("name").alias("component_id"), "row_key").unionByName(alone)
    return JaccardJoin(documents, links, members)


def _key_filter(keys: DataFrame, tasks: int):
    """A broadcast filter of FILTER_BITS bits that passes every ``row_key`` of ``keys``, and few others."""

    def mark(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
        for batch in batches:
            _bits.set_bits(bits, batch.column("row_key").to_numpy().view(np.uint64) % np.uint64(FILTER_BITS))
        yield from _bits.as_blocks(bits)

    blocks = _bits.merge_blocks(keys.mapInArrow(mark, "block int, bits binary"), tasks)
    return keys.sparkSession.sparkContext.broadcast(_bits.gathered(blocks, FILTER_BITS // 8))


def _passes(bits: np.ndarray, row_keys: np.ndarray) -> np.ndarray:
    return _bits.get_bits(bits, row_keys.view(np.uint64) % np.uint64(FILTER_BITS))


def deduplicate(docs: DataFrame, shingle: int = SHINGLE, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, of one document of each component: that with the component's smallest id.

    Documents without words stay, as do components of null ids only; rows that repeat id and text stay or go together. Only rows whose
    text passes a filter of the texts that go are joined with them.
    """
    spark = docs.sparkSession
    tasks = min(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    groups = jaccard_join(docs, shingle, threshold).documents
    away = groups.where("component_id is not null and (doc_id is null or doc_id != component_id)")
    away = _stage.written(away.select(F.col("doc_id").alias("away_id"), "row_key").distinct(), "away")
    wanted = _key_filter(away.select("row_key"), tasks)

    @F.pandas_udf("boolean")
    def may_go(keys: pd.Series) -> pd.Series:
        return pd.Series(_passes(wanted.value, keys.to_numpy(np.int64)))

    rows = docs.select(F.struct("*").alias("own"), F.xxhash64(F.col("text").cast("string")).alias("row_key")).withColumn("may", may_go("row_key"))
    same = F.col("own.doc_id").cast("long").eqNullSafe(F.col("away_id"))
    checked = rows.where("may").alias("r").join(away.alias("g"), (F.col("r.row_key") == F.col("g.row_key")) & same, "left_anti")
    return rows.where("not may").select("own.*").unionByName(checked.select("own.*"))


def _sets(texts: DataFrame, members: DataFrame, keys: DataFrame, n: int, tasks: int) -> DataFrame:
    """``k, cls, body``: the sets of the classes with these keys, each once.

    Of each class one text is read again, found by its hash behind a filter of fixed size; other texts are not cut into words.
    """

    one = members.join(keys, "k").groupBy("cls").agg(F.min("row_key").alias("row_key")).select("row_key")
    wanted = _key_filter(one, tasks)

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            asked = _passes(wanted.value, batch.column("row_key").to_numpy())
            rows = []
            for _, own in shingle_sets(batch.column("text").filter(pa.array(asked)), n):
                if len(own) and (cls := digest(own)) not in seen:
                    seen.add(cls)
                    rows.append((key_of(cls), cls, own.tobytes()))
            k, cls, body = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_pydict({"k": pa.array(k, pa.int64()), "cls": pa.array(cls, pa.binary()), "body": pa.array(body, pa.binary())})
        _text.give_back()

    found = texts.select("row_key", "text").mapInArrow(emit, "k long, cls binary, body binary")
    return _stage.written(found.dropDuplicates(["cls"]), "sets")
