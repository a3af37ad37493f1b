"""SimHash near-duplicates, searched with vantage-point trees.

1. A text's fingerprint has a bit set where over half of its 3-word shingles' XXH64 values have it. Equal fingerprints are one class.
2. A vantage-point tree over a bounded sample of classes cuts the space of fingerprints into shards: at a node, what lies within a radius of the
   vantage point goes inside, the rest outside. The tree says how the work is cut, never what is found.
3. Every class is a member of one shard. A link between two sides of a node has its outer end no further than the radius and the
   bits a link may differ in, so by the triangle inequality only such outer classes visit the inside; visitors go on down every branch that the same
   bound leaves open. Members meet members and visitors, so each link is found in the shard of one of its ends.
4. In a shard the members' own vantage-point tree is walked in the same way down to buckets, which are compared bit by bit. Sets that no
   radius parts well are searched breadth first among what is not reached yet, so a ball of near copies never gives a row for each pair.
   A shard returns a spanning forest of its links, and the components of these are those of all links.

Visits multiply by about 1.4 for each level of the tree (for fingerprints that look random), so the search costs about the number of classes to the power 1.5.

Defined results: a null or empty text, or one without words, has fingerprint zero and links like any other; a text of fewer words than a
shingle is one shingle; repeated rows have equal fingerprints; a null id takes part, but names no component (one of null ids only has null);
other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tessera.llm import _stage
from tessera.llm.jaccard_join import components

SHINGLE, SEED, BITS = 3, 42, 2
#: Bytes of a text that are cut into words at once, and shingles that are hashed at once.
CHUNK, BLOCK = 1 << 20, 255 * 256
#: Classes of a shard on average; sampled classes for each shard, and at most in all: the sample and the tree it gives are what the driver holds.
SHARD, SAMPLE_A_SHARD, SAMPLE = 1 << 15, 64, 1 << 22
#: Members of a bucket, and bytes of a table of comparisons.
BUCKET, TABLE = 512, 1 << 22
#: Vantage points tried for a node, and fingerprints they are tried on.
CANDIDATES, TRIED = 6, 512

_SPACE = re.compile(rb"[\x20\x09-\x0d]")


def _word_lists(text: bytes) -> Iterator[list[bytes]]:
    """The lower-cased words of a text, about CHUNK bytes at a time."""
    at = 0
    while at < len(text):
        cut = _SPACE.search(text, at + CHUNK)
        end = cut.start() if cut else len(text)
        yield text[at:end].lower().split()
        at = end


def _bit_sums(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set, lowest bit first: 255 of them are added at a time in eight byte lanes of one number."""
    lanes = np.unpackbits(hashes.view(np.uint8), bitorder="little").view(np.uint64).reshape(-1, 8)
    lanes = np.concatenate([lanes, np.zeros((-len(lanes) % 255, 8), dtype=np.uint64)]).reshape(-1, 255, 8).sum(axis=1, dtype=np.uint64)
    return np.ascontiguousarray(lanes).view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    sums, total, tail, words = np.zeros(64, dtype=np.int64), 0, [], 0
    for more in _word_lists(text):
        words += len(more)
        own = tail + more
        if len(own) >= shingle:
            joined = b" ".join(own)
            ends = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1) - 1
            starts = np.append(0, ends[:-1] + 1)
            n = len(own) - shingle + 1
            for a in range(0, n, BLOCK):
                b = min(n, a + BLOCK)
                spans = zip(starts[a:b].tolist(), ends[a + shingle - 1 : b + shingle - 1].tolist(), strict=True)
                sums += _bit_sums(np.fromiter((xxh64_intdigest(joined[s:e], seed) for s, e in spans), np.uint64, b - a))
            total += n
        tail = own[-(shingle - 1) :] if shingle > 1 else []
    if words and not total:
        return xxh64_intdigest(b" ".join(tail), seed)
    return int(np.packbits(2 * sums > total, bitorder="little").view("<u8")[0]) if total else 0


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """``doc_id, fp``: every text's fingerprint, its 64 bits as a signed long."""

    def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.fromiter((fingerprint(t.as_py() or b"", shingle, seed) for t in batch.column("text").cast(pa.large_binary())), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "fp": pa.array(own.view(np.int64))})

    return _stage.columns_of(docs, doc_id="long", text="string").mapInArrow(hashed, "doc_id long, fp long")


def distances(fps: np.ndarray, point) -> np.ndarray:
    return np.bitwise_count(fps ^ point)


def vantage(fps: np.ndarray, bits: int) -> tuple[np.uint64, int] | None:
    """The vantage point and radius that part these fingerprints with the fewest visits, or None where none parts them well.

    Weighed by what a split saves of the comparisons of all with all: members inside meet visitors from outside too.
    """
    tried = fps[:: max(1, len(fps) // TRIED)]
    points = tried[:: max(1, len(tried) // CANDIDATES)]
    best, least = None, 0.9
    for point in points:
        below = np.cumsum(np.bincount(distances(tried, point), minlength=65)[:65]) / len(tried)
        inside, visits = below[:63], np.minimum(1.0, below[np.minimum(np.arange(63) + bits, 64)]) - below[:63]
        work = inside * (inside + 2 * visits) + (1 - inside) ** 2
        work[(inside < 0.05) | (inside > 0.95)] = 1
        radius = int(np.argmin(work))
        if work[radius] < least:
            best, least = (point, radius), work[radius]
    return best


def _sides(fps: np.ndarray, members: np.ndarray, visitors: np.ndarray, point, radius: int, bits: int):
    """Members and visitors inside and outside, as places in ``fps``."""
    own, other = distances(fps[members], point).astype(np.int16), distances(fps[visitors], point).astype(np.int16)
    crossing = members[(own > radius) & (own <= radius + bits)]
    yield members[own <= radius], np.concatenate([crossing, visitors[other <= radius + bits]])
    yield members[own > radius], visitors[other > radius - bits]


class ShardTree:
    """A vantage-point tree whose leaves are shards: ``nodes`` holds (point, radius, inside, outside), a child below 0 is shard ~child."""

    def __init__(self, sample: np.ndarray, shards: int, bits: int):
        self.bits, self.nodes, self.shards = bits, [], 0
        self.root = self._grown(sample, shards)

    def _grown(self, sample: np.ndarray, shards: int) -> int:
        cut = vantage(sample, self.bits) if shards > 1 and len(sample) > 1 else None
        if cut is None:
            self.shards += 1
            return ~(self.shards - 1)
        point, radius = cut
        near = distances(sample, point) <= radius
        inner = min(shards - 1, max(1, round(shards * near.mean())))
        at = len(self.nodes)
        self.nodes.append(None)
        self.nodes[at] = (point, radius, self._grown(sample[near], inner), self._grown(sample[~near], shards - inner))
        return at

    def routed(self, fps: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Shard, its members and its visitors among ``fps``."""
        todo = [(self.root, np.arange(len(fps)), np.zeros(0, dtype=np.int64))]
        while todo:
            node, members, visitors = todo.pop()
            if not len(members) + len(visitors):
                continue
            if node < 0:
                yield ~node, fps[members], fps[visitors]
                continue
            point, radius, inside, outside = self.nodes[node]
            todo += [(child, *side) for child, side in zip((inside, outside), _sides(fps, members, visitors, point, radius, self.bits), strict=True)]


def _reached(fps: np.ndarray, members: np.ndarray, visitors: np.ndarray, bits: int) -> Iterator[tuple[int, int]]:
    """A spanning forest of the links of members with members and visitors, breadth first; only what is not reached yet is compared."""
    while len(members):
        front, members = [(int(members[-1]), True)], members[:-1]
        while front:
            at, is_member = front.pop()
            near = distances(fps[members], fps[at]) <= bits
            found = [(int(x), True) for x in members[near]]
            members = members[~near]
            if is_member and len(visitors):
                near = distances(fps[visitors], fps[at]) <= bits
                found += [(int(x), False) for x in visitors[near]]
                visitors = visitors[~near]
            yield from ((at, x) for x, _ in found)
            front += found


def _compared(fps: np.ndarray, members: np.ndarray, visitors: np.ndarray, bits: int) -> Iterator[tuple[int, int]]:
    """As ``_reached``, after all members without a link are set aside by one table of distances."""
    every = np.concatenate([members, visitors])
    linked, met = np.zeros(len(members), dtype=bool), np.zeros(len(every), dtype=bool)
    step = max(1, TABLE // (8 * max(1, len(every))))
    for a in range(0, len(members), step):
        near = distances(fps[members[a : a + step]][:, None], fps[every][None, :]) <= bits
        linked[a : a + step] = near.sum(axis=1) > 1  # each is near itself
        met |= near[linked[a : a + step]].any(axis=0)
    if linked.any():
        yield from _reached(fps, members[linked], visitors[met[len(members) :]], bits)


def linked(fps: np.ndarray, members: np.ndarray, visitors: np.ndarray, bits: int) -> Iterator[tuple[int, int]]:
    """Links, as places in ``fps``, that connect whatever links of members with members and visitors connect."""
    todo = [(members, visitors)]
    while todo:
        members, visitors = todo.pop()
        if not len(members) or len(members) + len(visitors) < 2:
            continue
        if len(members) <= BUCKET:
            yield from _compared(fps, members, visitors, bits)
        elif (cut := vantage(fps[members], bits)) is None:
            yield from _reached(fps, members, visitors, bits)
        else:
            todo += list(_sides(fps, members, visitors, *cut, bits))


def _searched(bits: int):
    def search(table: pa.Table) -> pa.Table:
        members, visitors = (np.frombuffer(b"".join(x or b"" for x in table.column(c).to_pylist()), dtype=np.uint64) for c in ("members", "visitors"))
        fps = np.concatenate([members, visitors])
        pairs = list(linked(fps, np.arange(len(members)), np.arange(len(members), len(fps)), bits))
        a, b = fps[np.array(pairs, dtype=np.int64).reshape(-1, 2)].T.view(np.int64) if pairs else np.zeros((2, 0), dtype=np.int64)
        return pa.table({"a": pa.array(np.ascontiguousarray(a)), "b": pa.array(np.ascontiguousarray(b))})

    return search


def _routed(tree, limit: int = 1 << 20):
    """Shards' members and visitors as packed fingerprints, a row for each shard and about ``limit`` of them."""

    def route(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        held = 0

        def flush():
            packed = [[np.concatenate(x).tobytes() for x in zip(*parts, strict=True)] for parts in hold.values()]
            return pa.RecordBatch.from_pydict({"shard": pa.array(list(hold), pa.int32()), "members": pa.array([m for m, _ in packed], pa.binary()), "visitors": pa.array([v for _, v in packed], pa.binary())})

        for batch in batches:
            for shard, members, visitors in tree.value.routed(batch.column("fp").to_numpy().view(np.uint64)):
                hold.setdefault(shard, []).append((members, visitors))
                held += len(members) + len(visitors)
            if held > limit:
                yield flush()
                hold, held = {}, 0
        if hold:
            yield flush()

    return route


def links(classes: DataFrame, bits: int = BITS, shard: int = SHARD) -> DataFrame:
    """``a, b``: links between distinct fingerprints ``fp`` that differ in ``bits`` bits at most; all links are connected by these.

    ``shard`` says how the work is cut, never what is found.
    """
    spark = classes.sparkSession
    n = classes.count()
    shards = max(1, min(-(-n // shard), SAMPLE // SAMPLE_A_SHARD))
    size = shards * SAMPLE_A_SHARD
    picked = classes.where(F.pmod(F.xxhash64("fp"), F.lit(max(1, n // size))) == 0).select("fp").limit(2 * size) if shards > 1 else classes.limit(0)
    sample = np.sort(picked.toArrow().column("fp").to_numpy().view(np.uint64))
    tree = spark.sparkContext.broadcast(ShardTree(sample, shards, bits))
    dealt = classes.select("fp").mapInArrow(_routed(tree), "shard int, members binary, visitors binary")
    return _stage.written(dealt.groupBy("shard").applyInArrow(_searched(bits), "a long, b long"), "links")


def simhash_groups(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, bits: int = BITS, shard: int = SHARD) -> DataFrame:
    """``doc_id, fp, component_id``: every document's fingerprint and the smallest id reachable over fingerprints that differ in at most ``bits`` bits."""
    rows = _stage.written(fingerprints(docs, shingle, seed), "fingerprints")
    classes = _stage.written(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "classes")
    labels = components(links(classes, bits, shard)).select(F.col("k").alias("fp"), "label")
    classes = _stage.written(classes.join(labels, "fp", "left").withColumn("label", F.coalesce("label", "fp")), "labelled")
    names = classes.groupBy("label").agg(F.min("first").alias("component_id"))
    named = _stage.written(classes.join(names, "label").select("fp", "n", "component_id"), "named")
    return _stage.spread_join(rows, named, ["fp"], rows.count()).select("doc_id", "fp", "component_id")


def deduplicate(docs: DataFrame, **how) -> DataFrame:
    """``doc_id`` of one document of each group: that with the smallest id; groups without ids have none."""
    return simhash_groups(docs, **how).where("doc_id = component_id").select("doc_id").distinct()

