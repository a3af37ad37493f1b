"""Merkle manifests of a data set: one tree for each group of rows, one over the groups, and a proof for every row.

1. Rows are hashed where they are read; only digests move. They are sorted by group and key in ranges, which are cut into partitions of at most
   ROWS rows, and counts by partition and group give every row its index in its tree.
2. A partition pushes its leaves on a mountain range: a stack of peaks, where a leaf that ends a run of ``fanout`` siblings is carried like a digit, as
   often as runs end. A tree's last run may be shorter and is hashed as it is, without padding. Runs whose head lies in an earlier partition, or whose
   tail lies in a later one, stay as peaks: O(log n) of them.
3. The peaks of WIDTH neighbouring partitions meet in one range, what they leave over in the next round, until each tree has one peak: its root. The
   roots of the groups, in order of the groups, are the leaves of the tree above, which is made by the same steps.
4. On the way back every peak gets the siblings on its way to the root, from the same stacks run once more; a partition's leaves go from peak to leaf in
   the same way and are folded to the root with their siblings.

No task holds more than a partition's digests or WIDTH partitions' peaks, and nothing but single counts reaches the driver.

Defined results: a field that is null is hashed as ``-``, so it differs from an empty text; rows ascend by key, nulls first, and rows with one key by their leaf, so
repeated rows are next to each other and interchangeable; a null group is a group, before all others; a group of one row has that leaf as its root;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import reduce
from hashlib import sha256

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm import _stage

FANOUT, ROWS, WIDTH = 2, 50_000, 64
#: Ranges that rows are sorted in, at most; a range of more than ROWS rows is cut into several partitions.
RANGES = 1 << 14


def digest(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def leaf_of(*fields: Column) -> Column:
    """The leaf's digest: of each field, its UTF-8 byte count, a colon and its text; a hyphen for null."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


class MountainRange:
    """The peaks of a stretch of nodes of one tree, which are pushed from left to right.

    ``sizes[l]`` is how many nodes level l of the whole tree has. ``record`` is called for every run that is hashed, with its level, its first
    node's number and its digests.
    """

    def __init__(self, leaves: int, fanout: int, record: Callable[[int, int, list[str]], None] | None = None):
        self.fanout, self.record, self.sizes, self.peaks = fanout, record, [leaves], []
        while self.sizes[-1] > 1:
            self.sizes.append(-(-self.sizes[-1] // fanout))

    def push(self, level: int, j: int, value: str) -> None:
        while level < len(self.sizes) - 1:
            before = j % self.fanout
            if before < self.fanout - 1 and j < self.sizes[level] - 1:
                break  # its run goes on
            run = self.peaks[len(self.peaks) - before :]
            if [x[:2] for x in run] != [(level, i) for i in range(j - before, j)]:
                break  # its run began in an earlier partition
            del self.peaks[len(self.peaks) - before :]
            values = [*(x[2] for x in run), value]
            if self.record:
                self.record(level, j - before, values)
            level, j, value = level + 1, j // self.fanout, digest(*values)
        self.peaks.append((level, j, value))


class _Climb(MountainRange):
    """A mountain range that knows each node's siblings on the way to its peak."""

    def __init__(self, leaves: int, fanout: int):
        super().__init__(leaves, fanout, self._siblings)
        self.above: dict[tuple[int, int], tuple[str, str, tuple[int, int]]] = {}

    def _siblings(self, level: int, first: int, values: list[str]) -> None:
        up = (level + 1, first // self.fanout)
        for m in range(len(values)):
            self.above[level, first + m] = ("".join(values[:m]), "".join(values[m + 1 :]), up)

    def path(self, level: int, j: int) -> tuple[list[str], tuple[int, int]]:
        """Siblings to the left and to the right, level by level, and the peak that is reached."""
        at, out = (level, j), []
        while at in self.above:
            left, right, at = self.above[at]
            out += (left, right)
        return out, at


def proof(path: list[str]) -> str:
    return digest(*path)


def folded(leaf: str, path: list[str]) -> str:
    for left, right in zip(path[::2], path[1::2], strict=True):
        leaf = digest(left, leaf, right)
    return leaf


_PEAKS = "part long, tree string, n long, level int, j long, value string"
_PATHS = "part long, tree string, level int, j long, path array<string>, subroot string, root string"


def _table(schema: str, rows: list[tuple]) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<string>": pa.list_(pa.string())}
    fields = [x.split(" ") for x in schema.split(", ")]
    return pa.table({name: pa.array([r[i] for r in rows], kinds[kind]) for i, (name, kind) in enumerate(fields)})


def _rows(table: pa.Table, *names: str) -> Iterator[tuple]:
    return zip(*(table.column(c).to_pylist() for c in names), strict=True)


def _stretches(rows: pa.Table, sizes: pa.Table) -> Iterator[tuple[str | None, int, int, list[tuple]]]:
    """A partition's trees: name, leaves in all, index of the first leaf here, and the leaves in order."""
    by_tree = defaultdict(list)
    for tree, *leaf in _rows(rows, "tree", "key", "leaf", "claimed"):
        by_tree[tree].append(tuple(leaf))
    for tree, first, n in _rows(sizes, "tree", "first", "n"):
        yield tree, n, first, sorted(by_tree[tree], key=lambda x: (x[0] is not None, x[0], x[1]) if x[0] is not None else (False, x[1]))


def _leaf_peaks(fanout: int):
    def climb(rows: pa.Table, sizes: pa.Table) -> pa.Table:
        out = []
        for tree, n, first, leaves in _stretches(rows, sizes):
            stack = MountainRange(n, fanout)
            for i, (_, leaf, _) in enumerate(leaves):
                stack.push(0, first + i, leaf)
            out += [(rows.column("part")[0].as_py(), tree, n, *peak) for peak in stack.peaks]
        return _table(_PEAKS, out)

    return climb


def _peaks_in_order(peaks: pa.Table, fanout: int) -> Iterator[tuple[str | None, int, list[tuple]]]:
    by_tree = defaultdict(list)
    for part, tree, n, level, j, value in _rows(peaks, "part", "tree", "n", "level", "j", "value"):
        by_tree[tree, n].append((j * fanout**level, part, level, j, value))
    for (tree, n), own in by_tree.items():
        yield tree, n, sorted(own)


def _merged_peaks(fanout: int):
    def climb(key: tuple, peaks: pa.Table) -> pa.Table:
        out = []
        for tree, n, own in _peaks_in_order(peaks, fanout):
            stack = MountainRange(n, fanout)
            for *_, level, j, value in own:
                stack.push(level, j, value)
            out += [(key[0].as_py(), tree, n, *peak) for peak in stack.peaks]
        return _table(_PEAKS, out)

    return climb


def _peak_paths(fanout: int):
    """The paths of a round's peaks from those of the peaks they were merged to."""

    def descend(peaks: pa.Table, paths: pa.Table) -> pa.Table:
        above = {(tree, level, j): rest for tree, level, j, *rest in _rows(paths, "tree", "level", "j", "path", "subroot", "root")}
        out = []
        for tree, n, own in _peaks_in_order(peaks, fanout):
            stack = _Climb(n, fanout)
            for *_, level, j, value in own:
                stack.push(level, j, value)
            for _, part, level, j, _ in own:
                path, top = stack.path(level, j)
                rest, subroot, root = above[tree, *top]
                out.append((part, tree, level, j, path + rest, subroot, root))
        return _table(_PATHS, out)

    return descend


_PROOFS = "key {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string"
_TOPS = "tree string, path array<string>, root string"


def _leaf_proofs(fanout: int, schema: str):
    """Proofs of a partition's leaves; for the tree over the groups, the paths themselves."""

    def descend(rows: pa.Table, paths: pa.Table) -> pa.Table:
        above = {(tree, level, j): rest for tree, level, j, *rest in _rows(paths, "tree", "level", "j", "path", "subroot", "root") if level is not None}
        out = []
        sizes = paths.filter(pc.is_valid(paths.column("first")))
        for tree, n, first, leaves in _stretches(rows, sizes):
            stack = _Climb(n, fanout)
            for i, (_, leaf, _) in enumerate(leaves):
                stack.push(0, first + i, leaf)
            for i, (key, leaf, claimed) in enumerate(leaves):
                path, top = stack.path(0, first + i)
                rest, subroot, root = above[tree, *top]
                path = path + rest
                out.append((key, path, root) if schema == _TOPS else (key, leaf, subroot, root, proof(path), folded(claimed or leaf, path)))
        return _table(schema, out)

    return descend


class _Forest:
    """Trees over rows ``tree, key, leaf, claimed``, climbed to their roots."""

    def __init__(self, rows: DataFrame, total: int, fanout: int, per: int, width: int):
        self.fanout = fanout
        by = [F.col("tree").asc_nulls_first(), F.col("key").asc_nulls_first(), "leaf", "tie"]
        ranges = max(1, min(RANGES, -(-total // per)))
        placed = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(ranges, *by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id())
        # the number holds the range in its upper bits and the place in it in the lower 33
        place = F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
        cut = _stage.written(placed.select(F.shiftright("at", 33).alias("range"), F.floor(place / per).cast("long").alias("chunk"), "tree", "key", "leaf", "claimed"), "leaves")
        chunks = (cut.agg(F.max("chunk")).first()[0] or 0) + 1
        self.leaves = cut.select((F.col("range") * chunks + F.col("chunk")).alias("part"), "tree", "key", "leaf", "claimed")
        counts = _stage.written(self.leaves.groupBy("part", "tree").agg(F.count("*").alias("count")), "counts")
        of_tree = Window.partitionBy("tree")  # a row for each partition that holds some of the tree
        before = F.sum("count").over(of_tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
        self.sizes = _stage.written(counts.select("part", "tree", F.coalesce(before, F.lit(0)).alias("first"), F.sum("count").over(of_tree).alias("n")), "sizes")
        groups = (self.sizes.agg(F.max("part")).first()[0] or 0) + 1
        peaks = self.leaves.groupBy("part").cogroup(self.sizes.groupBy("part")).applyInArrow(_leaf_peaks(fanout), _PEAKS)
        self.peaks, self.rounds, self.roots, self.width = [], [], [], width
        while True:
            peaks = _stage.written(peaks, "peaks")
            is_root = (F.col("j") == 0) & (F.pow(F.lit(float(fanout)), F.col("level")) >= F.col("n"))
            self.peaks.append(peaks)
            self.roots.append(peaks.where(is_root))
            if groups == 1:
                return
            self.rounds.append(peaks.where(~is_root))
            groups = -(-groups // width)
            peaks = self.rounds[-1].groupBy(F.expr(f"part div {width}").alias("above")).applyInArrow(_merged_peaks(fanout), _PEAKS)

    def trees(self) -> DataFrame:
        """``tree, value``: the trees' roots."""
        return reduce(DataFrame.unionByName, self.roots).select("tree", "value")

    def nodes(self) -> DataFrame:
        """``part, tree, n, level, j, value``: every node that partitions handed on, the roots among them."""
        return reduce(DataFrame.unionByName, self.peaks)

    def paths(self, tops: DataFrame) -> DataFrame:
        """``tops`` holds ``tree, path, root`` of every tree; the paths of all partitions' peaks, with the partitions' sizes among them."""
        tops = tops.withColumnRenamed("tree", "of")
        of_roots = [r.join(tops, r["tree"].eqNullSafe(tops["of"])).select("part", "tree", "level", "j", "path", F.col("value").alias("subroot"), "root") for r in self.roots]
        paths = of_roots[-1]
        for peaks, roots in zip(reversed(self.rounds), reversed(of_roots[:-1]), strict=True):
            above = peaks.groupBy(F.expr(f"part div {self.width}").alias("above")).cogroup(paths.groupBy("part"))
            paths = roots.unionByName(_stage.written(above.applyInArrow(_peak_paths(self.fanout), _PATHS), "paths"))
        return paths.unionByName(self.sizes, allowMissingColumns=True)

    def proofs(self, tops: DataFrame, schema: str) -> DataFrame:
        return self.leaves.groupBy("part").cogroup(self.paths(tops).groupBy("part")).applyInArrow(_leaf_proofs(self.fanout, schema), schema)


class Manifest:
    """``proofs``: key, leaf, subroot, root, proof_sha256, folded_root of every row. ``groups``: tree, value of every group's root. ``peaks``: the node records that
    partitions exchanged: part, tree, n, level, j, value."""

    def __init__(self, proofs: DataFrame, groups: DataFrame, peaks: DataFrame):
        self.proofs, self.groups, self.peaks = proofs, groups, peaks


def manifest(rows: DataFrame, group: Column, key: Column, leaf: Column, claimed: Column | None = None, fanout: int = FANOUT, per: int = ROWS, width: int = WIDTH) -> Manifest:
    """The manifest of ``rows`` with one tree for each ``group`` in order of ``key``. ``claimed`` is the leaf to fold in place of ``leaf`` where it is not null.

    ``per`` and ``width`` say how the work is cut, never what is found.
    """
    claimed = F.lit(None) if claimed is None else claimed
    hashed = rows.select(group.cast("string").alias("tree"), key.alias("key"), leaf.alias("leaf"), claimed.cast("string").alias("claimed"))
    kind = hashed.schema["key"].dataType.simpleString().replace("bigint", "long")
    forest = _Forest(hashed, rows.count(), fanout, per, width)
    groups = _stage.written(forest.trees(), "groups")
    none = F.lit(None).cast("string")
    over = _Forest(groups.select(none.alias("tree"), F.col("tree").alias("key"), F.col("value").alias("leaf"), none.alias("claimed")), groups.count(), fanout, per, width)
    tops = over.proofs(over.trees().select("tree", F.array().cast("array<string>").alias("path"), F.col("value").alias("root")), _TOPS)
    return Manifest(forest.proofs(_stage.written(tops, "tops"), _PROOFS.format(kind=kind)), groups, forest.nodes())
