"""Language identification by language-bitmask n-gram filters.

A bit-sliced Bloom filter holds at each position one bit per language, so the and of an n-gram's probes gives all languages
that contain it. A text's distinct runs are looked up, the bits are counted by language, each count is corrected for the
false positives that the fill of that language's slice lets through, and the language with the most runs left wins.

Runs are of letters, in lower case, with a space before and after each word. Each language is learned from at most ``per_language``
documents (the documented bound of the sample), in the order of a hash of the id; an n-gram counts as a language's own if enough of its
documents have it, and not far fewer than in the language that has it most.

Defined results: ``und`` with score 0 for null texts, texts without a letter, and where nothing was learned; a text none of whose
runs is known goes to the first learned language by code point with score 0, as do ties to the earlier of the tied; a null
``lang`` teaches nothing; repeated rows are alike; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm import _stage, _text

N = 4
PER_LANGUAGE = 1500
HELD_OUT = (4, 2)
#: Positions of the filter (a mask of 64 languages each; more languages take further masks) and probes of an n-gram.
POSITIONS = 1 << 20
PROBES = 3
#: An n-gram is a language's own from this many of its documents on, and from this part of the share in the language that has it most.
LEAST_DOCS = 2
LEAST_PART = 0.1
UNKNOWN = "und"

_NOT_LETTERS = re.compile(r"[\W\d_]+")


def _letters(text: str) -> str:
    return f" {_NOT_LETTERS.sub(' ', text.lower()).strip()} "


def run_hashes(texts: list[str]) -> Iterator[np.ndarray | None]:
    """Hashes of the distinct runs of each text; None for a text without a letter."""
    spaced = [_letters(t) for t in texts]
    units = np.frombuffer("".join(spaced).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    h = _text.runs(_text.mixed(units + np.uint64(1)), N)
    at = 0
    for t in spaced:
        yield np.unique(h[at : max(at, at + len(t) - N + 1)]) if any(map(str.isalpha, t)) else None
        at += len(t)


def _probes(hashes: np.ndarray, positions: int) -> list[np.ndarray]:
    low, high = hashes & np.uint64(0xFFFFFFFF), (hashes >> np.uint64(32)) | np.uint64(1)
    return [((low + np.uint64(k) * high) % np.uint64(positions)).astype(np.int64) for k in range(PROBES)]


class LanguageFilter:
    """``masks``: positions x (languages / 64) words; ``rates``: by language, the chance that an n-gram it lacks passes."""

    def __init__(self, languages: list[str], masks: np.ndarray):
        self.languages, self.masks = languages, masks
        fill = [float(((masks[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean()) for i in range(len(languages))]
        self.rates = np.array(fill) ** PROBES

    def counts(self, hashes: np.ndarray) -> np.ndarray:
        """Of these runs, how many each language contains, corrected for false positives."""
        found = np.bitwise_and.reduce([self.masks[p] for p in _probes(hashes, len(self.masks))], axis=0)
        hits = np.array([int(((found[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).sum()) for i in range(len(self.languages))], dtype=float)
        return np.clip((hits - len(hashes) * self.rates) / np.maximum(1e-9, 1 - self.rates), 0, len(hashes))

    def predict(self, hashes: np.ndarray | None) -> tuple[str, float]:
        if hashes is None or not self.languages:
            return UNKNOWN, 0.0
        if not len(hashes):
            return self.languages[0], 0.0
        counts = self.counts(hashes)
        best = int(counts.argmax())
        return self.languages[best], float(counts[best] / len(hashes))


def learn(docs: DataFrame, held_out: tuple[int, int] = HELD_OUT, per_language: int = PER_LANGUAGE, positions: int = POSITIONS) -> LanguageFilter:
    """The filter of the languages of all rows that are not held out."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where("lang is not null and doc_id is not null")
    rows = rows.where(~_stage.held_out("doc_id", *held_out))
    # the first of each language by hash; a histogram of the hashes' first bits says how far these reach, so no task ranks a whole language
    ids = rows.select("doc_id", "lang", F.xxhash64("doc_id").alias("hash")).withColumn("bin", F.shiftright("hash", 52))
    order = Window.partitionBy("lang").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = ids.groupBy("lang", "bin").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0)))
    reach = bins.where(F.col("before") < per_language).groupBy(F.col("lang").alias("of")).agg(F.max("bin").alias("last"))
    near = ids.join(F.broadcast(reach), F.col("lang") == F.col("of")).where("bin <= last")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("hash", "doc_id"))
    sample = near.withColumn("rank", rank).where(F.col("rank") <= per_language).select("doc_id", "lang").distinct()
    sample = _stage.written(sample, "languages")
    sizes = {r["lang"]: r["n"] for r in sample.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    number = {x: i for i, x in enumerate(languages)}

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: dict[str, list[np.ndarray]] = {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for first, texts in _text.text_groups(batch.column("text")):
                for r, own in enumerate(run_hashes(texts)):
                    if own is not None:
                        have.setdefault(langs[first + r], []).append(own)
        for lang, own in have.items():
            found, n = np.unique(np.concatenate(own), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), number[lang], dtype=np.int32)), pa.array(found.view(np.int64)), pa.array(n)], ["lang", "run", "n"])

    texts = rows.join(F.broadcast(sample), ["doc_id", "lang"]).select("lang", "text")
    counts = texts.mapInArrow(count, "lang int, run long, n long").groupBy("lang", "run").agg(F.sum("n").alias("n"))
    share = F.col("n") / F.element_at(F.array(*[F.lit(float(sizes[x])) for x in languages] or [F.lit(1.0)]), F.col("lang") + 1)
    most = F.max("share").over(Window.partitionBy("run"))
    kept = counts.withColumn("share", share).withColumn("most", most).where((F.col("n") >= LEAST_DOCS) & (F.col("share") >= LEAST_PART * F.col("most")))
    words = max(1, -(-len(languages) // 64))
    block = 1 << 12

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = np.zeros((positions, words), dtype=np.uint64)
        for batch in batches:
            lang = batch.column("lang").to_numpy().astype(np.int64)
            for p in _probes(batch.column("run").to_numpy().view(np.uint64), positions):
                np.bitwise_or.at(masks, (p, lang // 64), np.uint64(1) << (lang % 64).astype(np.uint64))
        for b in range(0, positions, block):
            if masks[b : b + block].any():
                yield pa.RecordBatch.from_pydict({"block": pa.array([b // block], pa.int32()), "bits": pa.array([masks[b : b + block].tobytes()], pa.binary())})

    masks = np.zeros((positions, words), dtype=np.uint64)
    for row in kept.select("lang", "run").coalesce(8).mapInArrow(build, "block int, bits binary").toLocalIterator():
        own = np.frombuffer(bytes(row["bits"]), dtype=np.uint64).reshape(-1, words)
        masks[row["block"] * block :][: len(own)] |= own
    return LanguageFilter(languages, masks)


def identify(docs: DataFrame, held_out: tuple[int, int] = HELD_OUT, per_language: int = PER_LANGUAGE, positions: int = POSITIONS) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every document."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, held_out, per_language, positions))

    def predict(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.predict(own) for _, texts in _text.text_groups(batch.column("text")) for own in run_hashes(texts)]
            langs, scores = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    done = _stage.columns_of(docs, doc_id="long", text="string").mapInArrow(predict, "doc_id long, lang_pred string, score double")
    return done.select("doc_id", _stage.held_out("doc_id", *held_out).alias("held_out"), "lang_pred", "score")
