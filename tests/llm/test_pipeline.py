"""The pipeline's stages on a small corpus, each against a plain version of its contract over its own input."""

import random
import time
from collections import Counter

import brute
import pytest

from tessera.llm import quality_rules

corpus_pipeline = pytest.importorskip("corpus_pipeline")
WORDS = [f"w{k}" for k in range(300)]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(8)
    prose = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    items = [(k, prose(30)) for k in range(3)]
    texts = [prose(rng.randint(12, 90)) for _ in range(40)]
    texts += [texts[0], texts[1] + " more", "short", None, "", "again " * 50, items[0][1] + " tail", prose(60) + " mail a@b.cd " + prose(5), prose(800) + " " + items[1][1]]
    rows = [(i, t, "en", ("a", "b", None)[i % 3], len(t or ""), "own", 1.5) for i, t in enumerate(texts)]
    where = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row string, kept double").write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(49)], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    return where, items


def test_stages(spark, corpus, tmp_path):
    where, items = corpus
    docs = spark.read.parquet(f"{where}/documents.parquet")
    columns, seen = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, where).write.parquet(str(tmp_path / str(k)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(k)))
        seen[k] = ([(r["doc_id"], r["text"]) for r in before.collect()], [(r["doc_id"], r["text"]) for r in docs.collect()])
        assert docs.columns == columns + ["mix_copy"] * (k == 4), name
    old, new = seen[0]
    assert not [d for d, t in new if brute.rules(t)["base_failed"]]
    rules = quality_rules.apply_rules(spark.read.parquet(f"{where}/documents.parquet"), quality_rules.trusted_ids(spark.read.parquet(f"{where}/labels.parquet")))
    assert {d for d, _ in new} == {r["doc_id"] for r in rules.collect() if r["kept"]} and len(new) >= 40
    old, new = seen[1]
    groups = brute.components(old)
    assert {d for d, _ in new} == {d for d, _ in old if groups[d][1] == d}
    old, new = seen[2]
    hits = brute.decontaminated(old, items)
    assert {d for d, _ in new} == {d for d, _ in old if not hits[d][4]} and len(new) < len(old)
    old, new = seen[3]
    assert {d for d, _ in new} == {d for d, _ in old} and not [d for d, t in new if brute.base_spans(t)]
    assert dict(new) == {d: t if not brute.base_spans(t) else dict(new)[d] for d, t in old}
    old, new = seen[4]
    assert max(Counter(d for d, _ in new).values()) <= 2 and {d for d, _ in new} <= {d for d, _ in old}


def test_run_repeats_itself(spark, corpus):
    where, _ = corpus
    first = sorted(map(tuple, corpus_pipeline.run(spark, where).select("doc_id", "mix_copy").collect()))
    assert first and first == sorted(map(tuple, corpus_pipeline.run(spark, where).select("doc_id", "mix_copy").collect()))
    assert quality_rules.THRESHOLD < 0


def test_stages_with_odd_columns_nulls_and_an_empty_table(spark, corpus, tmp_path):
    """Columns whose names need quoting or clash with the stages' own, null ids and texts, and no rows at all."""
    where, _ = corpus
    own = spark.read.parquet(f"{where}/documents.parquet")
    odd = own.selectExpr("if(doc_id = 5, null, doc_id) as doc_id", "text", "lang", "source", "n_chars", "1 as `my col-x`", "2 as mix_copy", "'s' as spans", "array(1) as item_ids", "named_struct('a b', 1) as `a.b`", "true as kept")
    for at, docs in (("odd", odd), ("none", odd.where("false"))):
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            columns = docs.columns
            stage(spark, docs, where).write.parquet(str(tmp_path / f"{at}{k}"))
            docs = spark.read.parquet(str(tmp_path / f"{at}{k}"))
            assert docs.columns == columns + ["mix_copy_"] * (k == 4), name
        assert (docs.count() > 0) == (at == "odd")
        assert at == "none" or docs.where("mix_copy = 2 and `my col-x` = 1 and spans = 's'").count() == docs.count()


def test_filtering_cuts_a_long_text_into_words_once(spark):
    """The verdict is not pushed into the measuring projection: 30,000 words take a moment, not minutes."""
    text = " ".join(f"w{k}" for k in range(30_000))
    docs = spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string")
    kept = quality_rules.filter_documents(docs, docs.select("doc_id").where("doc_id = 1"), buckets=500)
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert sum(line.count("split(") for line in plan.splitlines() if "Filter" in line) == 0
    began = time.time()
    assert [r["doc_id"] for r in kept.select("doc_id").collect()] == [1]
    assert time.time() - began < 20
