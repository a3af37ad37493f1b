"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import _stage, decontam, jaccard_join, langid, lm_bloom, merkle, mixing, pii, quality, quality_rules, simhash, toxicity, vector_codes, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("item_ids"), ","), 256).alias("items_sha256"), "contaminated")


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(table(spark, sf_dir, "documents")).documents.drop("row_key")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_bloom.score_documents(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = quality_rules.trusted_ids(table(spark, sf_dir, "labels"))
    return quality_rules.apply_rules(table(spark, sf_dir, "documents"), trusted)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.extract(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    counts = [F.size(F.array_remove(base["kind"], k)) for k in pii.KINDS]
    counts = [(F.size(base) - n).cast("long").alias(f"n_{k}") for k, n in zip(pii.KINDS, counts, strict=True)]
    return found.select("doc_id", *counts, F.sha2(pii.as_text(base), 256).alias("base_sha256"), pii.as_text(F.col("spans")).alias("spans"))


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).drop("target")


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _stage.columns_of(table(spark, sf_dir, "documents"), doc_id="long", source="string", lang="string", n_chars="long", text="string")
    fields = lambda n_chars: merkle.leaf_of(F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text"))
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, fields(F.col("n_chars") + 1))
    proofs = merkle.manifest(docs, F.col("lang"), F.col("doc_id"), fields(F.col("n_chars")), tampered).proofs
    return proofs.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    code = F.concat(*[F.lower(F.lpad(F.hex(F.col("codes")[k]), 2, "0")) for k in range(vector_codes.PARTS)])
    rows = vector_codes.with_label_errors(found.codes)
    return rows.select("vec_id", code.alias("code"), "error", "label_error", F.lit(found.digest()).alias("codebooks_sha256"))


QUERIES = {
    "op11_simhash": op11_simhash,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_vector_codes": op13_vector_codes,
    "op1_warc": op1_warc,
    "op3_pii": op3_pii,
    "op9_quality_rules": op9_quality_rules,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_language_id": op8_language_id,
    "op5_mixing_sources": op5_mixing_sources,
    "op2_toxicity": op2_toxicity,
    "op4_quality_classifier": op4_quality_classifier,
    "op10_ngram_jaccard_join": op10_ngram_jaccard_join,
    "op6_benchmark_decontamination": op6_benchmark_decontamination,
}

_CRC32 = """crc as materialized (select list(list_reduce(range(0, 8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, n) order by n) as t from range(256) x(n))"""
_CRC32_OF = "xor(list_reduce(list_transform(string_split({0}, ''), lambda d: cast(ascii(d) as bigint)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)"
_FIELD = "coalesce(octet_length(encode(cast({0} as varchar))) || ':' || cast({0} as varchar), '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "{0}", "text")) + ")"
_LEVELS = """select *, 0 as level from ({0}) x({1}, nodes) union all select {1}, list_transform(range(0, (len(nodes) + 1) // 2), lambda i: sha256(nodes[2 * i + 1] || coalesce(nodes[2 * i + 2], ''))), level + 1 from {2} where len(nodes) > 1"""


def _codes_sql(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """The rounds of op13, unrolled."""
    usable = "embedding is not null and not list_bool_or(list_transform(embedding, lambda x: x is null or not isfinite(x)))"
    steps = [
        f"v as materialized (select row_number() over (order by vec_id) as r, vec_id, label, list_transform(embedding, lambda x: floor(1024 * cast(x as double))) as x from embeddings where coalesce({usable}, true) and embedding is not null)",
        f"p as materialized (select r, pos, x[pos * (len(x) // {parts}) + 1 : (pos + 1) * (len(x) // {parts})] as x from v, range({parts}) t(pos))",
        f"b0 as materialized (select pos, r - 1 as entry, x from p where r <= {entries})",
    ]
    for k in range(rounds + 1):
        steps.append(f"a{k} as materialized (select p.r, p.pos, any_value(p.x) as x, min({{'d': list_inner_product(p.x, p.x) - 2 * list_inner_product(p.x, b.x) + list_inner_product(b.x, b.x), 'e': b.entry}}) as m from p join b{k} b on p.pos = b.pos group by p.r, p.pos)")
        if k < rounds:
            steps.append(f"m{k} as (select pos, entry, list(c order by i) as x from (select pos, m.e as entry, i, floor(sum(x[i]) / count(*)) as c from a{k}, range(1, len(x) + 1) t(i) group by pos, m.e, i) group by pos, entry)")
            steps.append(f"b{k + 1} as materialized (select b.pos, b.entry, coalesce(m.x, b.x) as x from b{k} b left join m{k} m on b.pos = m.pos and b.entry = m.entry)")
    return f"""with {", ".join(steps)},
        c as (select r, string_agg(printf('%02x', cast(m.e as integer)), '' order by pos) as code, cast(sum(m.d) as bigint) as error from a{rounds} group by r),
        s as (select sha256(string_agg(array_to_string(list_transform(x, lambda i: cast(cast(i as bigint) as varchar)), ','), ',' order by pos, entry)) as digest from b{rounds})
        select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, (select digest from s) as codebooks_sha256 from v join c on v.r = c.r"""


ORACLE_SQL: dict[str, str] = {
    "op1_warc": """
        with p as (select page_id, coalesce(html, '') as payload from pages),
        d as (select page_id, cast(octet_length(encode(payload)) as bigint) as payload_bytes, sha256(payload) as payload_digest from p),
        f as (select payload_digest as g, min(page_id) as first_id from d where payload_bytes >= 100 group by payload_digest)
        select page_id, payload_bytes, payload_digest,
               case when first_id is null or first_id = page_id then 'response' else 'revisit' end as record_type,
               case when first_id <> page_id then first_id end as refers_to
        from d left join f on payload_digest = g
    """,
    "op12_merkle_manifest": f"""
        with recursive {_CRC32},
        d as materialized (select doc_id, lang, {_LEAF.format("n_chars")} as leaf, case when {_CRC32_OF.format("cast(doc_id as varchar)")} % 7 = 0 then {_LEAF.format("n_chars + 1")} end as claimed from documents, crc),
        r as materialized (select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as i from d),
        lv as ({_LEVELS.format("select lang, list(leaf order by i) from r group by lang", "lang", "lv")}),
        sub as materialized (select lang, nodes[1] as subroot, row_number() over (order by lang nulls first) - 1 as i from lv where len(nodes) = 1),
        tlv as ({_LEVELS.format("select 0, list(subroot order by i) from sub", "one", "tlv")}),
        sib as materialized (select r.doc_id, r.leaf, r.claimed, sub.subroot, r.lang, r.i, sub.i as si from r join sub on r.lang is not distinct from sub.lang),
        low as (select s.lang, s.i, list({{'s': coalesce(nodes[xor(s.i >> level, 1) + 1], ''), 'l': (s.i >> level) & 1}} order by level) as path
            from sib s join lv on s.lang is not distinct from lv.lang where len(nodes) > 1 group by s.lang, s.i),
        high as (select sub.i, list({{'s': coalesce(nodes[xor(sub.i >> level, 1) + 1], ''), 'l': (sub.i >> level) & 1}} order by level) as path from sub, tlv where len(nodes) > 1 group by sub.i),
        p as materialized (select s.*, list_concat(coalesce(low.path, []), coalesce(high.path, [])) as path, (select nodes[1] from tlv where len(nodes) = 1) as root
            from sib s left join low on s.lang is not distinct from low.lang and s.i = low.i left join high on s.si = high.i),
        fold as (select lang, i, coalesce(claimed, leaf) as h, path, 1 as k from p
            union all select lang, i, sha256(case when path[k].l = 1 then path[k].s || h else h || path[k].s end), path, k + 1 from fold where k <= len(path))
        select doc_id, leaf, subroot, root, sha256(coalesce(array_to_string(list_transform(p.path, lambda x: x.s), ''), '')) as proof_sha256, h as folded_root, h = root as verified
        from p join fold on p.lang is not distinct from fold.lang and p.i = fold.i where k = len(fold.path) + 1
    """,
    "op13_vector_codes": _codes_sql(),
}
