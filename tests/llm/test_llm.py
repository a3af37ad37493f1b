"""The corpus operators against plain versions, with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import random
import time

import brute
import pytest
from pyspark.sql import functions as F

from tessera.llm import _nbsvm, decontam, jaccard_join, langid, lm_bloom, mixing, pii, quality, quality_rules, queries, toxicity, warc

WORDS = [f"w{k}" for k in range(400)]


def _prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def _texts():
    rng = random.Random(5)
    out = [_prose(rng, rng.randint(1, 120)) for _ in range(60)]
    base = _prose(rng, 150).split()
    for k in range(12):  # near copies, some of them beyond the threshold
        own = list(base)
        for at in rng.sample(range(150), k):
            own[at] = f"edit{k}x{at}"
        out.append(" ".join(own))
    out += [out[3], out[3].upper(), None, "", " \t\n", "one", "one two", "ONE two", "a\nb\na\n\nb\n", "spam spam spam spam spam spam spam spam spam spam spam spam", "£ é ß ünï " * 40]
    out.append(" ".join(_prose(rng, 40) for _ in range(200)))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ("en", "de", None)[i % 3], ("a", "b", None)[i % 3], 0, "x", -1) for i, t in enumerate(_texts())]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, kept long, row string, k long").repartition(3).cache()


@pytest.fixture(scope="module")
def plain(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


def _empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")


def test_jaccard_join(docs, plain):
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_join(docs).documents.collect()}
    assert found == brute.components(plain)


def test_jaccard_join_of_repeated_rows_null_ids_and_nothing(spark):
    text = " ".join(WORDS[:30])
    rows = spark.createDataFrame([(7, text), (7, text), (None, text), (None, "else " * 3), (2, None)], "doc_id long, text string")
    found = sorted(((r["doc_id"], r["component_id"]) for r in jaccard_join.jaccard_join(rows).documents.collect()), key=str)
    assert found == sorted([(7, 7), (7, 7), (None, 7), (None, None), (2, 2)], key=str)
    assert jaccard_join.jaccard_join(_empty(spark)).documents.count() == 0


def test_jaccard_join_of_clusters_whose_sizes_differ(spark):
    """x-y and x-z link, y-z does not: whichever of the three is matched first, the rest must be found through the other's size."""
    rows = []
    for k in range(120):
        x = [f"v{k}x{i}" for i in range(11)]
        rows += [(3 * k, " ".join(x)), (3 * k + 1, " ".join(["other", *x[1:]])), (3 * k + 2, " ".join(["front", *x]))]
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).documents.collect()}
    assert found == brute.components(rows) and len({c for _, c in found.values()}) == 120


def _edited(rng, words, n, mark):
    own = list(words)
    for at in rng.sample(range(len(own)), n):
        own[at] = f"{mark}x{at}"
    return own


@pytest.mark.parametrize(("short", "tile"), [(jaccard_join.SHORT, jaccard_join.TILE), (3, 2000), (1, 400)])
def test_jaccard_join_at_the_threshold_and_around_a_hub(spark, short, tile):
    """Copies whose sizes and overlaps lie on either side of the threshold, and a hub of near copies of which many link with others only."""
    rng, rows = random.Random(11), []
    for k in range(60):
        base = [f"b{k}x{i}" for i in range(rng.randint(6, 60))]
        rows.append(base)
        rows += [_edited(rng, base, rng.randint(0, 2), f"e{k}y{j}") for j in range(2)]
        rows += [base + [f"t{k}y{i}" for i in range(rng.randint(0, len(base) // 3 + 1))], base[rng.randint(0, 3) :], [f"f{k}", *base]]
    hub = [f"h{i}" for i in range(80)]
    chain = hub
    for j in range(160):
        rows.append(_edited(rng, hub, rng.randint(0, 5), f"u{j}"))
    for j in range(20):
        chain = _edited(rng, chain, 2, f"c{j}")
        rows.append(chain)
    passage = [f"p{i}" for i in range(12)]  # shared by many that do not link
    rows += [[f"q{j}x{i}" for i in range(rng.randint(8, 30))] + passage for j in range(80)]
    rng.shuffle(rows)
    texts = [(i, " ".join(r)) for i, r in enumerate(rows)]
    joined = jaccard_join.jaccard_join(spark.createDataFrame(texts, "doc_id long, text string").repartition(5), short=short, tile=tile)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in joined.documents.collect()}
    assert found == brute.components(texts)
    keys = {r["k"]: r["n_shingles"] for r in joined.members.collect()}
    assert joined.links.count() < 3 * len(keys) and all(r["a"] in keys and r["b"] in keys for r in joined.links.collect())


def test_a_link_shares_as_many_prefix_shingles_as_asked():
    """The bound by which pairs are left out holds for any order of shingles."""
    import numpy as np

    rng = np.random.default_rng(4)
    up = lambda a, b: -(-a // b)
    for _ in range(2000):
        n1 = int(rng.integers(1, 60))
        n2 = int(rng.integers(n1, 60 * 4 // 3 + 1))
        need = up(75 * (n1 + n2), 175)
        if need > n1:
            continue
        order = rng.permutation(n1 + n2 - need)
        common, own = order[:need], order[need:]
        sets = [np.sort(np.concatenate([common, own[: n1 - need]])), np.sort(np.concatenate([common, own[n1 - need :]]))]
        first = [x[: len(x) - up(75 * len(x), 100) + 1] for x in sets]
        assert len(np.intersect1d(*first)) >= need - up(75 * max(n1, n2), 100) + 1


def test_divide_skip_equals_counting():
    import numpy as np

    rng = np.random.default_rng(3)
    for _ in range(60):
        query = np.unique(rng.integers(0, 300, 80).astype(np.uint64))
        others = [np.unique(np.concatenate([rng.choice(query, rng.integers(1, len(query))), rng.integers(300, 900, rng.integers(0, 30)).astype(np.uint64)])) for _ in range(9)]
        expected = {(j, len(np.intersect1d(query, o))) for j, o in enumerate(others) if 100 * len(np.intersect1d(query, o)) >= 75 * len(np.union1d(query, o))}
        assert set(jaccard_join.divide_skip(query, jaccard_join.InvertedIndex(others), 75, 100)) == expected


def test_decontamination(spark, docs, plain):
    rng = random.Random(9)
    texts = [t for _, t in plain if t and len(t.split()) > 60]
    items = [(1, " ".join(texts[0].split()[5:30])), (2, texts[1].upper()), (3, "one two"), (4, None), (5, ""), (6, _prose(rng, 40)), (7, " ".join(texts[0].split()[8:21]))]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    expected = brute.decontaminated(plain, items)
    for block in (200_000, 7):
        found = decontam.decontaminate(docs, benchmark, block_windows=block)
        got = {r["doc_id"]: (r["n_words"], r["n_hit"], len(r["item_ids"]), hashlib.sha256(",".join(r["item_ids"]).encode()).hexdigest(), r["contaminated"]) for r in found.collect()}
        assert got == expected
    assert decontam.decontaminate(_empty(spark), benchmark).count() == 0
    assert not decontam.decontaminate(docs, benchmark.limit(0)).where("n_hit > 0").count()


def test_quality_rules(spark, docs, plain):
    trusted = docs.select("doc_id").where("doc_id < 20")
    found = {r["doc_id"]: r.asDict() for r in quality_rules.apply_rules(docs, trusted, buckets=500).collect()}
    for d, t in plain:
        expected = brute.rules(t)
        assert {k: found[d][k] for k in expected} == expected
        assert found[d]["kept"] == (not expected["base_failed"] and found[d]["score"] >= quality_rules.THRESHOLD)
    kept = quality_rules.filter_documents(docs, trusted, buckets=500)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.select("doc_id").collect()} == {d for d in found if found[d]["kept"]}
    assert quality_rules.apply_rules(_empty(spark), trusted, buckets=50).count() == 0


def test_quality_score_is_the_mean_log_ratio(spark):
    rows = spark.createDataFrame([(1, "good words here " * 4), (2, "bad stuff there " * 4)], "doc_id long, text string")
    scores = {r["doc_id"]: r["score"] for r in quality_rules.apply_rules(rows, spark.createDataFrame([(1,)], "doc_id long"), buckets=1000).collect()}
    assert scores[1] > 0 > scores[2]


def test_personal_data(spark):
    rng = random.Random(2)
    kinds = ["mail me.x+1@ab-c.example.org now", "ip 10.0.255.1.", "ip 10.0.256.1", "card 4111 1111 1111 1111", "card 4111-1111-1111-1112", "+1 (212) 555-0100", "+12 34", "a@b", "x@y.z_d@e.f", "1.2.3.4.5.6.7.8", "5500005555555559é4111111111111111", "", None, "7" * 6000, "é@é.com ü+49 30 1234567"]
    rows = [(i, t) for i, t in enumerate(kinds)] + [(100 + i, " ".join(rng.choice([*WORDS[:20], *[k for k in kinds if k and len(k) < 99]]) for _ in range(60))) for i in range(30)] + [(None, "a@b.cd"), (3, kinds[3])]
    found = pii.extract(spark.createDataFrame(rows, "doc_id long, text string"))
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, brute.span_text((s["start"], brute.KINDS.index(s["kind"]), s["end"]) for s in r["spans"] if s["base"])) for r in found.collect())
    assert got == sorted((d if d is not None else -1, brute.span_text(brute.base_spans(t))) for d, t in rows)


def test_contexts_find_what_the_patterns_miss(spark):
    rows = [(i, f"please call number {'+1 212 555 01%02d' % i} today") for i in range(20)] + [(50, "please call number 0212-555-0177 today"), (51, "in chapter 0212-555-0177b of it")]
    spans = {r["doc_id"]: r["spans"] for r in pii.extract(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(s["kind"], s["start"], s["end"], s["base"]) for s in spans[50]] == [("phone", 19, 32, False)] and not spans[51]


def test_many_spans_in_one_text_take_time_in_proportion(spark):
    """50,000 addresses in one text: found, and redacted piece by piece, without a look at all others for each."""
    text = " ".join(f"10.{i // 250 % 250}.{i % 250}.7" if i % 2 else f"word{i} a" for i in range(100_000))
    rows = spark.createDataFrame([(1, text), (2, "call +1 555 123 4567 now")], "doc_id long, text string")
    began = time.time()
    found = {r["doc_id"]: r["spans"] for r in pii.extract(rows).select("doc_id", F.size(F.filter("spans", lambda s: s["base"])).alias("spans")).collect()}
    assert found == {1: 50_000, 2: 1} and time.time() - began < 60
    began = time.time()
    clean = {r["doc_id"]: r["text"] for r in pii.redact(rows).collect()}
    assert clean[1] == " ".join("<ip>" if i % 2 else f"word{i} a" for i in range(100_000)) and time.time() - began < 90


def test_redaction_over_the_edges_of_pieces(spark, monkeypatch):
    """Wherever a text is cut, it reads the same."""
    text = "é10.0.0.1, me@here.org then 10.0.0.2 and +44 20 7946 0958x or +44 (20) 7946 0958, 4111 1111 1111 1111 end"
    rows = spark.createDataFrame([(1, text)], "doc_id long, text string")
    whole = pii.redact(rows).first()["text"]
    assert whole.count("<ip>") == 2 and "<email>" in whole and "<card>" in whole and whole.endswith(" end")
    for piece in (3, 7, len(text)):
        monkeypatch.setattr(pii, "PIECE", piece)
        assert pii.redact(rows).first()["text"] == whole


def test_redaction_keeps_rows_and_columns(spark):
    rows = spark.createDataFrame([(1, "mail a@b.cd and +1 212 555 0100!", "x"), (2, None, "y"), (3, "nothing", None)], "doc_id long, text string, row string")
    clean = pii.redact(rows)
    assert clean.columns == rows.columns
    assert sorted(map(tuple, clean.collect()), key=lambda r: r[0]) == [(1, "mail <email> and <phone>!", "x"), (2, None, "y"), (3, "nothing", None)]


def test_lm_scores(spark, docs, plain):
    expected = brute.base_scores(plain)
    for hot in (5, 1 << 19):
        for r in lm_bloom.score_documents(docs, hot_words=hot).collect():
            n, known, total, score = expected[r["doc_id"]]
            assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, total)
            assert r["base_score"] == pytest.approx(score, rel=1e-9) and r["score"] < 0
    assert lm_bloom.score_documents(_empty(spark)).count() == 0


def test_lm_keeps_all_words_and_pairs_at_any_size_of_a_pass(spark):
    import numpy as np

    rng = random.Random(12)
    rows = [(i, " ".join(f"u{rng.randint(0, 900)}" for _ in range(30))) for i in range(150)]
    rows = spark.createDataFrame([*rows, (150, None), (151, "")], "doc_id long, text string")
    own = lambda **bits: {r["doc_id"]: r["score"] for r in lm_bloom.score_documents(rows, **bits).collect()}
    whole, small = own(), own(word_bits=10_000, pair_bits=10_000)
    model, _ = lm_bloom.train(rows, word_bits=10_000, pair_bits=10_000)
    assert len(model.words.groups) > 1 and len(model.pairs.groups) > 1 and len(whole) == 152
    assert small == pytest.approx(whole, rel=1e-9)
    assert own(buckets=1024) == pytest.approx(whole, rel=0.1)  # other filters have other false positives
    once = np.random.default_rng(1).integers(0, 1 << 40, 300_000).astype(np.uint64)
    bits, least = lm_bloom.build_part(once, np.ones(len(once), dtype=np.int64))
    assert least == 1 and len(bits) == 300_000
    assert lm_bloom.train(spark.createDataFrame([(1, "one two three")], "doc_id long, text string"))[0].pairs.table.first()["least"] == 1


def test_pair_counts_beyond_two_bytes_are_whole():
    import numpy as np
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"text": pa.array(["spam " * 300_000, "ham " * 65_536, "one two"])})
    n = lm_bloom.BUCKETS[0]
    table = pa.Table.from_batches(list(lm_bloom._counted([batch], n)))
    parts = {}
    for b in set(table["bucket"].drop_null().to_pylist()):
        own = lm_bloom._pair_part(table.filter(pa.compute.equal(table["bucket"], b)), n)
        parts[b] = (own["bits"][0].as_py(), own["least"][0].as_py())
    own, begins = lm_bloom.tokens(next(iter(lm_bloom._text.blocks(pa.array(["spam spam", "ham ham", "one two"]), lm_bloom._text.SPACED))))
    keys = lm_bloom.pairs(own, begins)[0][begins[:-1] + 1] & np.uint64((1 << 48) - 1)
    assert np.abs(np.log2(lm_bloom.LogFrequencyFilter(parts, n).counts(keys) / np.array([299_999, 65_535, 1]))).max() <= 0.26


def test_filter_counts_are_near():
    import numpy as np

    keys = np.arange(1, 20001, dtype=np.uint64) * np.uint64(2654435761)
    counts = np.maximum(1, 100000 // np.arange(1, 20001))
    parts = {}
    for b in range(256):
        own = keys % np.uint64(256) == b
        parts[b] = lm_bloom.build_part(keys[own], counts[own])
    read = lm_bloom.LogFrequencyFilter(parts, 256).counts(keys)
    assert (np.abs(np.log2(read / counts)) <= 0.26).mean() > 0.95 and (read > 0).all()
    absent = lm_bloom.LogFrequencyFilter(parts, 256).counts(keys + np.uint64(12345))
    assert (absent > 0).mean() < 0.08


def test_language(spark):
    rng = random.Random(4)
    make = {"xx": "alpha omega sigma delta kappa".split(), "yy": "uno dos tres cuatro cinco".split()}
    rows = [(i, " ".join(rng.choice(make[lang]) for _ in range(rng.randint(3, 30))), lang) for i, lang in enumerate(["xx", "yy"] * 60)] + [(900, None, "xx"), (901, "123 !!", "yy"), (902, "a", None), (903, "", None)]
    found = {r["doc_id"]: r for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(found[i]["lang_pred"] == lang for i, t, lang in rows if i < 900)
    assert [found[i]["lang_pred"] for i in (900, 901, 903)] == ["und"] * 3 and found[902]["lang_pred"] in make
    assert all(0 <= r["score"] <= 1 for r in found.values())
    assert langid.identify(_empty(spark)).count() == 0
    assert {r["lang_pred"] for r in langid.identify(spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")).collect()} == {"und"}


@pytest.mark.parametrize("score", [toxicity.score_toxicity, quality.score_quality])
def test_classifiers(spark, score):
    rng = random.Random(6)
    label = "toxic" if score is toxicity.score_toxicity else "quality"
    rows, labels = [], []
    for i in range(240):
        y = i % 3 == 0
        rows.append((i, " ".join([rng.choice(WORDS) for _ in range(20)] + (["dreadful", "horrid"] if y else []))))
        labels.append((i, int(y)))
    rows += [(900, None), (901, ""), (902, "x" * 300_000)]
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, f"doc_id long, {label} int")
    found = {r["doc_id"]: r for r in score(docs, known).collect()}
    held = [i for i in range(240) if found[i]["held_out"]]
    modulus, remainder = (5, 0) if label == "toxic" else (4, 2)
    assert held == [i for i in range(240) if brute.crc(i, modulus) == remainder]
    assert sum((found[i]["score"] >= 0.5) == bool(labels[i][1]) for i in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in found.values()) and len(found) == 243
    assert score(docs, known.limit(0)).count() == 243 and score(docs.limit(0), known).count() == 0


def test_mixing(spark, docs):
    found = [r.asDict() for r in mixing.mix(docs).collect()]
    sizes = {r["doc_id"]: len(brute.SPACED.findall(r["text"] or "")) for r in docs.collect()}
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    assert {r["doc_id"]: r["size"] for r in found} == sizes and all(r["taken"] <= 2 * r["size"] for r in found)
    total, weights, limit = 1.5 * sum(sizes.values()), {"a": 3, "b": 1, None: 2}, {}
    for s in weights:
        limit[s] = 2.0 * sum(n for d, n in sizes.items() if source[d] == s)
    target, open_ = {}, set(weights)
    while open_:
        rate = (total - sum(target.values())) / sum(weights[s] for s in open_)
        over = {s for s in open_ if rate * weights[s] > limit[s]}
        if not over:
            target |= {s: rate * weights[s] for s in open_}
            break
        target |= {s: limit[s] for s in over}
        open_ -= over
    for r in found:
        assert r["target"] == pytest.approx(target[source[r["doc_id"]]])
    assert sorted(map(str, found)) == sorted(map(str, (r.asDict() for r in mixing.mix(docs.repartition(5)).collect())))
    assert mixing.mix(_empty(spark)).count() == 0


def test_mix_takes_near_its_targets(spark):
    """Words taken of a source differ from its target by less than a few of its documents; reruns and other partitions agree."""
    rng = random.Random(6)
    rows = [(i, " ".join("w" * rng.randint(1, 120)) if i % 9 else None, rng.choice(["a", "b", "c", "d", None])) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixing.mix(docs, bucket_rows=200).collect()
    taken, target, largest = {}, {}, {}
    for r, (_, _, s) in zip(sorted(found, key=lambda r: r["doc_id"]), rows, strict=True):
        taken[s] = taken.get(s, 0) + r["taken"]
        target[s], largest[s] = r["target"], max(largest.get(s, 0), r["size"])
    assert all(abs(taken[s] - target[s]) <= 2 * largest[s] + 0.01 * target[s] for s in target)
    again = mixing.mix(docs.repartition(7), bucket_rows=200).collect()
    assert sorted(map(str, found)) == sorted(map(str, again))


def test_lm_scores_against_exact_counts(spark):
    """Counts are read back within a quarter of a doubling; what is left are false positives of the filters."""
    rng = random.Random(14)
    rows = [(i, " ".join(f"v{min(int(rng.expovariate(0.05)), 150)}" for _ in range(rng.randint(1, 80)))) for i in range(300)] + [(900, None), (901, "never seen words")]
    expected = brute.lm_scores(rows)
    found = {r["doc_id"]: r for r in lm_bloom.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    off = [abs(found[d]["score"] - score) / n for d, (n, score) in expected.items()]
    assert max(off) < 0.25 and sum(off) / len(off) < 0.08


def test_quality_verdicts_against_plain_ratios(spark, docs, plain):
    trusted = set(range(20))
    found = {r["doc_id"]: r for r in quality_rules.apply_rules(docs, docs.select("doc_id").where("doc_id < 20"), buckets=500).collect()}
    expected = brute.log_ratio_scores(plain, trusted, 500)
    for d, t in plain:
        assert found[d]["score"] == pytest.approx(expected[d], abs=1e-4)
        assert found[d]["kept"] == (not brute.rules(t)["base_failed"] and expected[d] >= quality_rules.THRESHOLD)


def test_languages_against_exact_sets(spark):
    rng = random.Random(15)
    stems = {"xx": "lorem ipsum dolor sit amet".split(), "yy": "lore ipse dolo sitt amat".split(), "zz": "foo bar baz qux".split()}
    rows = [(i, " ".join(rng.choice(stems[lang]) for _ in range(rng.randint(1, 12))), lang) for i, lang in enumerate(["xx", "yy", "zz"] * 50)] + [(900, "§ 12", "xx"), (901, "lorem foo", None), (902, None, "yy")]
    expected = brute.languages(rows, langid.N, langid.LEAST_DOCS, langid.LEAST_PART)
    for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect():
        lang, score = expected[r["doc_id"]]
        assert r["lang_pred"] == lang and r["score"] == pytest.approx(score, abs=0.02)


def test_hinge_fit_is_optimal_and_its_features_are_plain():
    """Ratios equal plain counts, and the dual and primal objectives of the fitted machine meet."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(["good", "fine", "nice", "bad", "poor", "dull"], 6, p=[0.25, 0.2, 0.2, 0.15, 0.1, 0.1] if k % 2 else [0.1, 0.1, 0.15, 0.2, 0.2, 0.25])) for k in range(120)]
    labels = np.array([k % 2 for k in range(120)])
    makes = _nbsvm.Indicators((3, 5), 14)
    rows = [np.sort(s) for s in makes.of(pa.array(texts))]
    assert all(len(np.unique(s)) == len(s) for s in rows)
    runs = [{f"\n{t}\n"[i : i + n] for n in (3, 5) for i in range(len(t) + 3 - n)} for t in texts]
    assert all(len(s) <= len(x) and len(s) >= len(x) - 2 for s, x in zip(rows, runs, strict=True))  # two runs may share a slot
    ratios = _nbsvm.log_count_ratios(rows, labels, 1 << 14)
    counts = np.stack([np.bincount(np.concatenate([s for s, y in zip(rows, labels, strict=True) if y == k]), minlength=1 << 14) for k in (0, 1)])
    plain = np.log((counts[1] + 1) / (counts[1] + 1).sum()) - np.log((counts[0] + 1) / (counts[0] + 1).sum())
    used = (counts.sum(axis=0) >= 3) & (np.abs(plain) >= 0.4)
    assert np.allclose(ratios, np.where(used, plain, 0.0))
    w, bias = _nbsvm.fit_hinge(rows, labels, ratios, epochs=400)
    scaled = [(s, ratios[s] / max(1e-9, np.sqrt(ratios[s] @ ratios[s]))) for s in rows]
    cost = lambda w, b: 0.5 * (w @ w + b * b) + sum(max(0.0, 1 - (1 if y else -1) * (w[s] @ v + b)) for (s, v), y in zip(scaled, labels, strict=True))
    best = cost(w, bias)
    for _ in range(200):  # a convex objective: no small step in any direction lowers it
        step = rng.normal(size=len(w)) * (ratios != 0) * 0.01
        assert cost(w + step, bias + rng.normal() * 0.01) >= best - 1e-3


def test_personal_data_with_long_tokens_and_long_words_of_context(spark):
    """A token whose first digit comes after 70 letters is an instance, and a word of 100 letters stands whole in a pattern."""
    word = "w" * 100
    seeds = [(i, f"{word} 1 call me at +1 555 01{i:02d} 77{i:02d} now") for i in range(12)]
    hidden = [(100, f"{word} 1 call me at {'x' * 70}5550{1:03d} now"), (101, "y" * 120 + " call me at 555012345 now")]
    found = {r["doc_id"]: r["spans"] for r in pii.extract(spark.createDataFrame([*seeds, *hidden], "doc_id long, text string")).collect()}
    learned = {d: [(s["kind"], s["end"] - s["start"]) for s in found[d] if not s["base"]] for d in (100, 101)}
    assert learned == {100: [("phone", 77)], 101: [("phone", 9)]}
    wide = pii.found_spans(spark.createDataFrame(hidden[:1], "doc_id long, text string")).where("kind = 'token'").first()
    assert wide["before"].split() == ["me", "at"] and wide["after"].split() == ["now"]


def test_segments_carry_the_digest_of_all_before_them(spark):
    """A payload of several slices: each record of the archive says the digest up to its own end, none is longer than a slice."""
    html = "é1" * 5000
    rows = [r["record"] for r in warc.segments(spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string"), chunk=1000).collect()]
    done = b""
    for r in rows:
        head, body = r.split("\r\n\r\n", 1)
        done += body[:-2].encode()
        assert f"X-Running-Digest: sha256:{hashlib.sha256(done).hexdigest()}" in head and len(body[:-2].encode()) <= 1000
    assert len(rows) >= 15 and done == html.encode()


def test_warc_round_trip(spark, tmp_path):
    long = "é" * 150_000 + "WARC/1.0\r\nWARC-Type: response\r\n\r\n"
    pages = [(1, "http://a/", "x" * 200), (2, "http://b/\r\nWARC/1.0", "x" * 200), (3, None, None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"), (7, "u", long), (8, "u", long), (9, "u", "WARC/1.0"), (10, "u", "\r\n\r\n" * 40), (None, "u", "y" * 300), (12, "u", "ends with WARC/1.0\r\nWARC/1.0" * 9)]
    rows = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    found = {r["page_id"]: r for r in warc.round_trip(rows, chunk=1000).collect()}
    for page, url, html in pages:
        body = (html or "").encode()
        first = min(p for p, _, h in pages if h == html and p is not None) if page is not None and len(body) >= 100 else page
        r = found[page]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(body), hashlib.sha256(body).hexdigest())
        assert (r["record_type"], r["refers_to"]) == (("response", None) if first == page else ("revisit", first))
        if url and "\r" not in url:
            assert r["target"] == url
    assert warc.round_trip(rows.limit(0)).count() == 0


def test_queries_are_named_for_their_operators():
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 14))
