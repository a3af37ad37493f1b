"""Fingerprints in vantage-point trees, Merkle manifests and vector codes against plain versions of their contracts."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from itertools import combinations
from math import floor, isfinite

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tessera.llm import _stage, merkle, queries, simhash, vector_codes

WHITE = " \t\n\x0b\x0c\r"


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c if c not in WHITE else " " for c in text or "").split(" ")
    words = [w for w in words if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, linked):
    """The smallest id reachable, by place; ``linked`` are pairs of places."""
    above = list(range(len(ids)))

    def root(i):
        while above[i] != i:
            i = above[i]
        return i

    for a, b in linked:
        above[root(a)] = root(b)
    groups = defaultdict(list)
    for i in range(len(ids)):
        groups[root(i)].append(ids[i])
    return [min((x for x in groups[root(i)] if x is not None), default=None) for i in range(len(ids))]


TEXTS = ["", None, " \t\n", "One", "one", "one two", "ONE\x0btwo", "a b c", "a b c d", "£ é ß ünï " * 40, "x " * 3000, "tail\xa0stays one\x85word here"]


def test_simhash_groups(spark):
    rng = random.Random(3)
    texts = list(TEXTS)
    for _ in range(6):
        base = [f"w{rng.randrange(900)}" for _ in range(300)]
        for n in range(8):
            own = list(base)
            for at in rng.sample(range(300), n):
                own[at] = f"e{rng.randrange(10**6)}"
            texts.append(" ".join(own))
    rows = [(None if i % 11 == 5 else 1000 - i, t, 7, "z") for i, t in enumerate(texts)] + [(1000, "", 0, "")] * 2
    found = simhash.simhash_groups(spark.createDataFrame(rows, "doc_id long, text string, fp int, component_id string").repartition(3))
    own = [plain_fingerprint(r[1]) for r in rows]
    groups = plain_components([r[0] for r in rows], [(a, b) for a, b in combinations(range(len(rows)), 2) if (own[a] ^ own[b]).bit_count() <= 2])
    expected = Counter((r[0], f, g) for r, f, g in zip(rows, own, groups, strict=True))
    assert Counter((r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in found.collect()) == expected
    assert simhash.simhash_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert simhash.deduplicate(spark.createDataFrame(rows[:9], "doc_id long, text string, fp int, component_id string")).count() == len({g for g in plain_components([r[0] for r in rows[:9]], [(a, b) for a, b in combinations(range(9), 2) if (own[a] ^ own[b]).bit_count() <= 2]) if g is not None})


def test_a_long_text_is_cut_into_chunks(monkeypatch):
    text = " ".join(f"w{i % 77}" + "y" * (i % 5) for i in range(4000)).encode()
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "CHUNK", 100)
    assert simhash.fingerprint(text) == whole == plain_fingerprint(text.decode())
    monkeypatch.setattr(simhash, "CHUNK", 1)
    assert [simhash.fingerprint((t or "").encode()) for t in TEXTS] == [plain_fingerprint(t) for t in TEXTS]


def _near(rng, n, centres, most):
    out = []
    for _ in range(n):
        x = rng.choice(centres)
        for b in rng.sample(range(64), rng.randint(0, most)):
            x ^= 1 << b
        out.append(x)
    return sorted(set(out))


@pytest.mark.parametrize("shard", [simhash.SHARD, 300, 40])
def test_links_of_random_and_dense_fingerprints(spark, shard):
    """Balls of near copies that no radius parts, and fingerprints that look random: whatever the shards, the components are those of all pairs."""
    rng = random.Random(shard)
    fps = _near(rng, 900, [rng.getrandbits(64) for _ in range(60)], 4) + _near(rng, 2500, [rng.getrandbits(64)], 2) + [rng.getrandbits(64) for _ in range(900)]
    fps = np.unique(np.array(fps, dtype=np.uint64))
    pairs = np.argwhere(np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2, 1))
    places = {int(f): i for i, f in enumerate(fps.view(np.int64).tolist())}
    found = simhash.links(spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp long"), shard=shard).collect()
    assert all((int(fps[places[r["a"]]]) ^ int(fps[places[r["b"]]])).bit_count() <= 2 for r in found)
    ids = list(range(len(fps)))
    assert plain_components(ids, [(places[r["a"]], places[r["b"]]) for r in found]) == plain_components(ids, pairs.tolist())
    assert len(found) < 3 * len(fps) < len(pairs)


def test_a_tree_routes_both_ends_of_every_link():
    rng = random.Random(9)
    fps = np.array(_near(rng, 3000, [rng.getrandbits(64) for _ in range(200)], 6), dtype=np.uint64)
    tree = simhash.ShardTree(fps[::3], 32, 2)
    met, home = defaultdict(set), Counter()
    for shard, members, visitors in tree.routed(fps):
        home.update(members.tolist())
        for m in members.tolist():
            met[m] |= set(members.tolist()) | set(visitors.tolist())
    assert set(home.values()) == {1} and len(home) == len(fps) and tree.shards > 8
    for a, b in np.argwhere(np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2, 1)).tolist():
        assert int(fps[b]) in met[int(fps[a])] or int(fps[a]) in met[int(fps[b])]


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_manifest(rows, fanout=2):
    """rows: (doc_id, source, lang, n_chars, text); per row what the query returns."""
    leaf = lambda r: _h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))
    order = lambda r: (r[0] is not None, r[0] or 0, leaf(r))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([_h(*out[-1][i : i + fanout]) for i in range(0, len(out[-1]), fanout)])
        return out

    def path(tree, i):
        out = []
        for nodes in tree[:-1]:
            a = i // fanout * fanout
            out += ["".join(nodes[a:i]), "".join(nodes[i + 1 : a + fanout])]
            i //= fanout
        return out

    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: levels([leaf(r) for r in sorted((r for r in rows if r[2] == x), key=order)]) for x in langs}
    top = levels([trees[x][-1][0] for x in langs])
    out = []
    for k, x in enumerate(langs):
        for i, r in enumerate(sorted((r for r in rows if r[2] == x), key=order)):
            own = path(trees[x], i) + path(top, k)
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
            h = leaf((*r[:3], r[3] + 1, r[4]) if bad else r)
            for a, b in zip(own[::2], own[1::2], strict=True):
                h = _h(a, h, b)
            out.append((r[0], leaf(r), trees[x][-1][0], top[-1][0], _h(*own), h, h == top[-1][0]))
    return sorted(out, key=repr)


MANIFEST = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def _documents(n, seed=1):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["a", None, "ß"]), rng.choice(["en", "en", "en", "de", None, "é"]), rng.choice([None, i, 5]), rng.choice([None, "", "text é" * 3, f"t{i}"])) for i in range(n)]
    return rows + [(4, "a", "zz", 1, "alone"), (n, None, None, None, None), (n, None, None, None, None), (None, "a", "en", 1, "b"), (None, "a", "en", 2, "b"), (5, "tie", "en", 1, "b"), (5, "tie", "en", 1, "b")]


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize(("per", "width"), [(merkle.ROWS, merkle.WIDTH), (7, 2), (1, 3), (16, 64)])
def test_manifest_over_partitions_with_unaligned_edges(spark, tmp_path, monkeypatch, per, width):
    rows = _documents(90 if per > 1 else 25)
    own = f"{tmp_path}/documents.parquet"
    spark.createDataFrame([(*r, "x", 0) for r in rows], f"{SCHEMA}, tree string, part int").repartition(3).write.parquet(own)
    whole = merkle.manifest
    monkeypatch.setattr(merkle, "manifest", lambda *a: whole(*a, per=per, width=width))
    found = queries.op12_merkle_manifest(spark, str(tmp_path))
    assert found.columns == MANIFEST
    assert sorted((tuple(r) for r in found.collect()), key=repr) == plain_manifest(rows)


def test_manifest_of_other_fanouts_single_rows_and_nothing(spark):
    of = lambda rows, **how: merkle.manifest(spark.createDataFrame(rows, SCHEMA), F.col("lang"), F.col("doc_id"), merkle.leaf_of(*[F.col(c.split()[0]) for c in SCHEMA.split(", ")]), **how)
    rows = _documents(60, 2)
    for fanout in (3, 5):
        found = of(rows, fanout=fanout, per=9, width=2).proofs
        assert sorted((tuple(r) for r in found.select("key", "leaf", "subroot", "root", "proof_sha256").collect()), key=repr) == [r[:5] for r in plain_manifest(rows, fanout)]
        assert found.where("folded_root != root").count() == 0
    one = of(rows[:1]).proofs.first()
    assert one["leaf"] == one["subroot"] == one["root"] == one["folded_root"] and one["proof_sha256"] == _h()
    assert of([]).proofs.count() == 0
    made = of(rows, per=9, width=2)
    assert {(r["tree"], r["value"]) for r in made.groups.collect()} == {(r["tree"], r["value"]) for r in made.peaks.where("level > 0 or n = 1").collect()} & {(r["tree"], r["value"]) for r in made.groups.collect()}


def test_a_mountain_range_leaves_as_few_peaks_as_digits():
    stack = merkle.MountainRange(10**6, 2)
    for i in range(777, 777 + 5000):
        stack.push(0, i, str(i))
    assert len(stack.peaks) <= 2 * 13 and sum(2**level for level, *_ in stack.peaks) == 5000


def plain_codes(rows):
    """rows: (vec_id, vector, label)."""
    kept = [(i, [floor(1024 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    d = len(kept[0][1]) // 4
    cut = [[r[1][k * d : k * d + d] for k in range(4)] for r in kept]
    books = [[list(c[k]) for c in cut[:256]] for k in range(4)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for step in range(5):
        near = [[min((far(c[k], e), n) for n, e in enumerate(books[k])) for k in range(4)] for c in cut]
        if step < 4:
            for k in range(4):
                held = defaultdict(list)
                for c, m in zip(cut, near, strict=True):
                    held[m[k][1]].append(c[k])
                for n, parts in held.items():
                    books[k][n] = [sum(x) // len(parts) for x in zip(*parts, strict=True)]
    errors = [sum(m[k][0] for k in range(4)) for m in near]
    labels = defaultdict(int)
    for r, e in zip(kept, errors, strict=True):
        labels[r[2]] += e
    digest = _h(",".join(str(x) for b in books for e in b for x in e))
    return sorted(((r[0], "".join(f"{m[k][1]:02x}" for k in range(4)), e, labels[r[2]], digest) for r, m, e in zip(kept, near, errors, strict=True)), key=repr)


def _vectors(spark, tmp_path, rows):
    spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, code string, n int").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    return queries.op13_vector_codes(spark, str(tmp_path))


def test_vector_codes(spark, tmp_path):
    rng = random.Random(4)
    vector = lambda: [float(np.float32(rng.gauss(0, 0.3))) for _ in range(8)]
    hot = vector()
    rows = [(i, hot if i % 3 == 0 else vector(), rng.choice([0, 1, None])) for i in range(700)]
    rows += [(701, None, 1), (702, [None] + hot[1:], 1), (703, [float("nan")] + hot[1:], 1), (704, [float("inf")] + hot[1:], 1), (3, vector(), 1), (3, hot, 1), (None, vector(), 2)]
    found = _vectors(spark, tmp_path, rows)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == plain_codes(rows)


def test_vector_codes_of_few_odd_and_no_vectors(spark, tmp_path):
    few = [(5, [0.5, -0.25, 1.0, 2.0], None), (9, [0.5, -0.25, 1.0, 2.0], None), (2, [9.0, 9.0, 9.0, 9.0], 1)]
    assert sorted((tuple(r) for r in _vectors(spark, tmp_path / "few", few).collect()), key=repr) == plain_codes(few)
    assert _vectors(spark, tmp_path / "none", []).count() == 0
    odd = [(1, [1.0, 2.0, 3.0], 0), (2, [1.0, 2.0, 3.0, 4.0, 5.0], 0), (3, [], 0), (4, [3e38] * 5, 0)]
    filled = [(i, [min(x, 2.0**17) for x in v] + [0.0] * (8 - len(v)), label) for i, v, label in odd]
    assert sorted((tuple(r) for r in _vectors(spark, tmp_path / "odd", odd).collect()), key=repr) == plain_codes(filled)


def test_nearest_is_exact_in_doubles_and_in_integers():
    rng = np.random.default_rng(1)
    for most in (50, 1 << 26):
        x, book = rng.integers(-most, most, (300, 16)), rng.integers(-most, most, (256, 16))
        book[7] = book[3]
        x[0] = book[3]
        code, error = vector_codes.nearest(x, book)
        far = ((x[:, None, :] - book[None]) ** 2).sum(axis=2)
        assert (code == far.argmin(axis=1)).all() and (error == far.min(axis=1)).all() and code[0] == 3


def test_sql_of_the_queries(spark):
    sf = "/root/testdata/sf0.001"
    duck = duckdb.connect()
    for t in ("documents", "embeddings"):
        duck.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    for name in ("op12_merkle_manifest", "op13_vector_codes"):
        expected = duck.execute(queries.ORACLE_SQL[name])
        columns = [c[0] for c in expected.description]
        assert Counter(expected.fetchall()) == Counter(tuple(r) for r in queries.QUERIES[name](spark, sf).select(*columns).collect())


def test_hot_keys_are_joined_where_they_are(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id")).alias("k"), "id")
    by_key = rows.groupBy("k").agg(F.count("*").alias("n")).withColumn("v", F.col("k") * 3)
    found = _stage.spread_join(rows, by_key, ["k"], 5000)
    assert found.count() == 5000 and found.where("v != 3 * k").count() == 0
