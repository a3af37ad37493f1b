"""Quality rules: counting rules, and a hashed n-gram log-likelihood ratio between trusted text and all text.

Words and word pairs are hashed into ``buckets`` features. Two multinomials are estimated over them, one from trusted documents, one from
all documents; a text's score is the mean over its features of log(p_trusted / p_all), so it does not depend on its length, and every
document is kept or rejected by comparing it with a fixed threshold. All of it is SQL functions: no Python runs on the executors.

Trusted documents are a bounded sample of ids (``trusted_ids``); the raw counts cover all documents.

Defined results: null and empty texts have no words, fail the base rules and score 0; repeated rows score alike; with no
trusted document, or an empty table, every score is 0 and the threshold rejects none; other columns are ignored, and
``filter_documents`` returns them untouched whatever their names.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import _stage

BUCKETS = 10_000
SMOOTH = 1.0
TRUSTED = 5000
THRESHOLD = -0.2
LEAST_WORDS = 10
MOST_REPEATED_PERCENT = 20
WINDOW = 5


def trusted_ids(labels: DataFrame, most: int = TRUSTED) -> DataFrame:
    """At most ``most`` ids labelled as good, in the order of a hash of the id."""
    good = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def _with_words(docs: DataFrame, *kept: str) -> DataFrame:
    """``hashes`` of the words next to the columns kept."""
    words = F.expr(r"filter(split(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', -1), w -> w != '')")
    return docs.withColumn("words", words).withColumn("hashes", F.expr("transform(words, w -> xxhash64(w))")).select("hashes", "words", *kept)


def _features(buckets: int) -> Column:
    """Buckets of the words and of the word pairs of ``hashes``."""
    pairs = f"if(size(hashes) > 1, transform(sequence(0, size(hashes) - 2), i -> cast(pmod(xxhash64(hashes[i], hashes[i + 1]), {buckets}) as int)), cast(array() as array<int>))"
    return F.expr(f"concat(transform(hashes, h -> cast(pmod(h, {buckets}) as int)), {pairs})")


def log_ratios(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, smooth: float = SMOOTH) -> list[float]:
    """log(p_trusted / p_all) by bucket: one pass over all documents, ``buckets`` rows to the driver."""
    ids = F.broadcast(trusted.select("doc_id", F.lit(1).alias("trusted")))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(ids, "doc_id", "left")
    marked = _with_words(texts, "trusted").select("trusted", F.explode(_features(buckets)).alias("bucket"))
    counts = {r["bucket"]: (r["own"], r["n"]) for r in marked.groupBy("bucket").agg(F.count("trusted").alias("own"), F.count("*").alias("n")).collect()}
    own_total, total = (sum(c[k] for c in counts.values()) for k in (0, 1))
    if not own_total:
        return [0.0] * buckets
    return [log((own + smooth) / (own_total + smooth * buckets)) - log((n + smooth) / (total + smooth * buckets)) for own, n in (counts.get(b, (0, 0)) for b in range(buckets))]


def _repeated_words() -> Column:
    """Words inside any window of WINDOW words that the text has twice or more."""
    window = ", ".join(f"hashes[i + {k}]" for k in range(WINDOW))
    windows = f"if(size(hashes) >= {WINDOW}, transform(sequence(0, size(hashes) - {WINDOW}), i -> xxhash64({window})), cast(array() as array<bigint>))"
    # sorted (hash, place) pairs: a window is repeated if its neighbour has its hash; arrays are bound by transform(array(x), ...) so that each is made once
    places = "filter(transform(s, (e, i) -> if((i > 0 and s[i - 1].h = e.h) or (i < size(s) - 1 and s[i + 1].h = e.h), e.i, null)), p -> p is not null)"
    covered = f"aggregate(sort_array({places}), named_struct('last', -{WINDOW}, 'n', 0L), (a, p) -> named_struct('last', p, 'n', a.n + least({WINDOW}, p - a.last)), a -> a.n)"
    by_place = f"transform(array(sort_array(transform(w, (h, i) -> named_struct('h', h, 'i', i)))), s -> {covered})[0]"
    return F.expr(f"transform(array({windows}), w -> if(size(array_distinct(w)) = size(w), 0L, {by_place}))[0]")


def measured(docs: DataFrame, ratios: list[float], threshold: float = THRESHOLD, *kept: str) -> DataFrame:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, score, base_failed, kept`` next to ``text`` and the columns named."""
    table = F.split(F.lit(",".join(f"{x:.5f}" for x in ratios)), ",").cast("array<double>")
    lines = F.expr(r"filter(split(coalesce(text, ''), '\n', -1), l -> l rlike '[^\\x20\\x09-\\x0D]')")
    base = _with_words(docs, "text", *kept).withColumn("lines", lines)
    counted = base.select(
        *kept,
        F.size("hashes").cast("long").alias("n_words"),
        F.expr("aggregate(words, 0L, (n, w) -> n + char_length(w))").alias("word_chars"),
        F.coalesce(F.regexp_count("text", F.lit(r"[#*$%&|<>]")), F.lit(0)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeated_words().alias("n_repeat_words"),
        F.aggregate(_features(len(ratios)), F.lit(0.0), lambda total, b: total + table[b]).alias("sum"),
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    score = F.when(F.col("n_words") > 0, F.col("sum") / (2 * F.col("n_words") - 1)).otherwise(0.0)
    scored = counted.withColumn("score", score).withColumn("base_failed", failed)
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold)).drop("sum")


def apply_rules(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id`` and what ``measured`` says of every document."""
    texts = _stage.columns_of(docs, doc_id="long", text="string")
    return measured(texts, log_ratios(texts, trusted, buckets), threshold, "doc_id")


def filter_documents(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns.

    The verdict passes through a generator of one element, which no filter is pushed below: pushed into the measuring projection, it
    would have the text cut into words anew for every word.
    """
    texts = docs.select(F.struct("*").alias("row"), F.col("text").cast("string").alias("text"))
    verdicts = measured(texts, log_ratios(docs, trusted, buckets), threshold, "row").select("row", F.explode(F.array("kept")).alias("kept"))
    return verdicts.where("kept").select("row.*")
