"""Linear models over hashed n-gram indicators scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import _stage, _text

_MULTIPLIERS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1, 0xD3A2646D, 0xFD7046C5, 0xB55A4F09)


class Indicators:
    """Distinct hashed runs of texts; ``sizes`` in characters (a text is taken with a line feed on either side)."""

    def __init__(self, sizes: tuple[int, ...], bits: int):
        self.sizes, self.bits = sizes, bits
        self._last = np.zeros(1 << bits, dtype=np.int32)

    def _slots(self, units: np.ndarray, n: int) -> np.ndarray:
        m = max(0, len(units) - n + 1)
        h = np.full(m, 0x2545F491 * n & 0xFFFFFFFF, dtype=np.uint32)
        for k in range(n):
            h += units[k : k + m] * np.uint32(_MULTIPLIERS[k])
            h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        h ^= h >> np.uint32(13)
        h *= np.uint32(0x297A2D39)
        return (h >> np.uint32(32 - self.bits)).astype(np.int32)

    def _distinct(self, slots: np.ndarray) -> np.ndarray:
        """Each slot once, without sorting: the place that wrote a slot last is the one that stays."""
        at = np.arange(len(slots), dtype=np.int32)
        self._last[slots] = at
        return slots[self._last[slots] == at]

    def of(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The distinct slots of every row, in order of rows (null: the empty text)."""
        for _, texts in _text.text_groups(column, 1_000_000):
            units, starts = _text.code_points(texts)
            by_size = [(n, self._slots(units, n)) for n in self.sizes]
            for r in range(len(texts)):
                a, b = int(starts[r]), int(starts[r + 1]) + 1
                yield self._distinct(np.concatenate([s[a : max(a, b - n + 1)] for n, s in by_size]))


def log_count_ratios(rows: list[np.ndarray], labels: np.ndarray, width: int, smooth: float = 1.0, least_docs: int = 3, least_ratio: float = 0.4) -> np.ndarray:
    """log of (share of a slot among label-1 indicators / among label-0 indicators), counts smoothed.

    0, that is unused, for slots of fewer than ``least_docs`` rows and for ratios nearer to 0 than ``least_ratio``.
    """
    counts = np.zeros((2, width))
    for slots, y in zip(rows, labels, strict=True):
        counts[int(y), slots] += 1
    seen = counts.sum(axis=0) >= least_docs
    counts += smooth
    shares = counts / counts.sum(axis=1, keepdims=True)
    ratios = np.log(shares[1] / shares[0])
    return np.where(seen & (np.abs(ratios) >= least_ratio), ratios, 0.0)


def fit_hinge(rows: list[np.ndarray], labels: np.ndarray, r: np.ndarray, cost: float = 1.0, epochs: int = 30, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias of an L2-regularised hinge-loss machine by dual coordinate descent, each row scaled to length 1.

    Each class weighs as much as the other in total. Feature values are the ratios ``r`` on a row's slots, and a constant 1 for the bias.
    """
    y = np.where(labels > 0, 1.0, -1.0)
    share = np.array([max(1, int((labels == k).sum())) for k in (0, 1)]) / max(1, len(labels))
    upper = cost * 0.5 / share[(labels > 0).astype(int)]
    values = [r[slots] for slots in rows]
    scale = np.array([1.0 / max(1e-9, float(np.sqrt(v @ v))) for v in values])
    w, bias, alpha = np.zeros(len(r)), 0.0, np.zeros(len(rows))
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        largest = 0.0
        for i in order.permutation(len(rows)):
            slots, v = rows[i], values[i] * scale[i]
            gradient = y[i] * (w[slots] @ v + bias) - 1.0
            new = min(max(alpha[i] - gradient / 2.0, 0.0), upper[i])  # the row's squared length is 2, with the constant
            step = (new - alpha[i]) * y[i]
            if step:
                w[slots] += step * v
                bias += step
                alpha[i] = new
                largest = max(largest, abs(step))
        if largest < 1e-3:
            break
    return w, bias


def margins(rows: list[np.ndarray], r: np.ndarray, w: np.ndarray, bias: float) -> np.ndarray:
    return np.array([(w[s] @ r[s]) / max(1e-9, float(np.sqrt(r[s] @ r[s]))) + bias for s in rows])


def fit_sigmoid(margin: np.ndarray, labels: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """a, b so that 1 / (1 + exp(-(a * margin + b))) fits the labels: logistic regression on one value, by Newton steps."""
    a, b = 1.0, 0.0
    n1, n0 = float((labels > 0).sum()), float((labels <= 0).sum())
    target = np.where(labels > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -500, 500)))
        g = np.array([((p - target) * margin).sum(), (p - target).sum()])
        q = p * (1 - p)
        hess = np.array([[(q * margin * margin).sum(), (q * margin).sum()], [(q * margin).sum(), q.sum()]]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(hess, g)
        step *= min(1.0, 5.0 / max(1e-9, float(np.abs(step).max())))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(a), float(b)


class Model:
    """What scoring needs: ratios and weights by slot, the bias, the sigmoid, and how indicators are made."""

    def __init__(self, sizes: tuple[int, ...], bits: int, slots: np.ndarray, ratios: np.ndarray, weights: np.ndarray, bias: float, a: float, b: float):
        self.sizes, self.bits, self.bias, self.a, self.b = sizes, bits, bias, a, b
        self.ratios, self.weights = np.zeros(1 << bits, dtype=np.float32), np.zeros(1 << bits, dtype=np.float32)
        self.ratios[slots], self.weights[slots] = ratios, weights

    def score(self, slots: np.ndarray) -> float:
        r = self.ratios[slots]
        norm = float(np.sqrt(r @ r))
        margin = (float(self.weights[slots] @ r) / norm if norm else 0.0) + self.bias
        return float(1 / (1 + np.exp(-np.clip(self.a * margin + self.b, -500, 500))))


def sampled_labels(labels: DataFrame, label: str, modulus: int, remainder: int, per_class: int) -> DataFrame:
    """At most ``per_class`` rows ``doc_id, label`` of either class, never held-out ones, in the order of a hash of the id."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    known = known.where(~_stage.held_out("doc_id", modulus, remainder)).groupBy("doc_id").agg(F.max("label").alias("label"))
    ranked = known.orderBy(F.xxhash64("doc_id"), "doc_id")
    return ranked.where("label = 0").limit(per_class).union(ranked.where("label = 1").limit(per_class))


def train(docs: DataFrame, sample: DataFrame, sizes: tuple[int, ...], bits: int, cost: float = 1.0, epochs: int = 15) -> Model:
    """Fit on the documents of ``sample`` (bounded by its maker): indicators by all tasks, the fit itself in one task.

    Three quarters of the sample fit the machine, a quarter the sigmoid that turns margins into probabilities. Without both labels
    every text scores the smoothed share of label 1.
    """

    def indicators(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        makes = Indicators(sizes, bits)
        for batch in batches:
            rows = [np.sort(s).tobytes() for s in makes.of(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(rows, pa.binary())], ["doc_id", "label", "slots"])

    def fit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: dict[int, tuple[int, bytes]] = {}
        for batch in batches:
            for i, y, s in zip(batch.column("doc_id").to_pylist(), batch.column("label").to_pylist(), batch.column("slots"), strict=True):
                own = (y, s.as_py())
                have[i] = min(have.get(i, own), own)  # of rows that repeat an id, the same one in whatever order they arrive
        ids = sorted(have)
        y = np.array([have[i][0] for i in ids], dtype=int)
        rows = [np.frombuffer(have[i][1], dtype=np.int32) for i in ids]
        r = w = np.zeros(1 << bits)
        bias, a, b = 0.0, 0.0, float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        if 0 < y.sum() < len(y):
            rank = np.zeros(len(y), dtype=int)
            for k in (0, 1):
                rank[y == k] = np.arange((y == k).sum())
            held = rank % 4 == 3
            if not all((y[held] == k).any() for k in (0, 1)):
                held[:] = False
            own = [rows[i] for i in np.flatnonzero(~held)]
            r = log_count_ratios(own, y[~held], 1 << bits)
            used = [s[r[s] != 0] for s in own]
            w, bias = fit_hinge(used, y[~held], r, cost, epochs)
            check = held if held.any() else ~held
            a, b = fit_sigmoid(margins([rows[i] for i in np.flatnonzero(check)], r, w, bias), y[check])
        slots = np.flatnonzero(r)
        row = {"slots": slots.astype(np.int32).tobytes(), "ratios": r[slots].astype(np.float32).tobytes(), "weights": w[slots].astype(np.float32).tobytes()}
        yield pa.RecordBatch.from_pydict({k: pa.array([v], pa.binary()) for k, v in row.items()} | {k: pa.array([v], pa.float64()) for k, v in (("bias", bias), ("a", a), ("b", b))})

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id").select("doc_id", "label", "text")
    rows = texts.mapInArrow(indicators, "doc_id long, label int, slots binary")
    found = rows.repartition(1).mapInArrow(fit, "slots binary, ratios binary, weights binary, bias double, a double, b double").first()
    return Model(sizes, bits, np.frombuffer(bytes(found["slots"]), np.int32), np.frombuffer(bytes(found["ratios"]), np.float32), np.frombuffer(bytes(found["weights"]), np.float32), found["bias"], found["a"], found["b"])


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` of every whole text (null: the empty text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        makes = Indicators(m.sizes, m.bits)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([m.score(s) for s in makes.of(batch.column("text"))], pa.float64())], ["doc_id", "score"])

    return _stage.columns_of(docs, doc_id="long", text="string").mapInArrow(score, "doc_id long, score double")
