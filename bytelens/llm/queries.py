"""Registered queries of this subpackage: each applies an operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from bytelens.llm import alignment, decontaminate, hard_negatives, jaccard_join, license_scan, media, mixing, pii, quality, suffix_dedup, token_counts
from bytelens.llm.records import Records, digest as records_digest
from bytelens.llm.sharding import Dataset, digest as sharded_digest
from bytelens.runtime import file_keys, fresh_path


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, bench = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark")
    return decontaminate.digest(decontaminate.decontaminate(docs, bench, keep_columns=["doc_id"]))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(mixing.mix(file_keys(_read(spark, sf_dir, "documents"))))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.digest(token_counts.count_tokens(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(file_keys(_read(spark, sf_dir, "documents")), k=4, percent=85)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan_licenses(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.size("matches").cast("long").alias("n_matches"), F.array_join(F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["template"]))), ",").alias("templates"), F.array_max(F.transform("matches", lambda m: m["containment"])).alias("best"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_read(spark, sf_dir, "documents"), keep_columns=["doc_id"])


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(suffix_dedup.remove_repeats(file_keys(_read(spark, sf_dir, "documents"))))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_pii(_read(spark, sf_dir, "documents"), pii.labelled_table(spark)))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files arrive in up to eight groups; tiers are compacted after each arrival, and what is left at the end."""
    # the one writer: nobody reads a version that is out of date
    ds, docs = Dataset(spark, fresh_path(spark, "op9-dataset"), keep=1), _read(spark, sf_dir, "documents")
    files = sorted(docs.inputFiles())
    arrivals = [spark.read.schema(docs.schema).parquet(*files[i::8]) for i in range(min(8, len(files)))]
    for arrival in arrivals or [docs]:
        ds.append(arrival)
        ds.compact()
    ds.compact(everything=True)
    return sharded_digest(ds)


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digest(_read(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = file_keys(_read(spark, sf_dir, "embeddings"))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", moved), F.col("vec_id") % 50 == 0)


def op12_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = fresh_path(spark, "op12-records")
    written = Records.write(file_keys(_read(spark, sf_dir, "documents")), path, public_tokenizers.path("byte_bpe_50k.json"))
    return records_digest(written.read())


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    a, b = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return alignment.digest(alignment.align(_read(spark, sf_dir, "documents"), a, b)[0])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_decontaminate": op2_decontaminate,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_mix_sources": op4_mix_sources,
    "op5_token_counts": op5_token_counts,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_pii": op7_pii,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_sharding": op9_sharding,
    "op10_media_columns": op10_media_columns,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_token_records": op12_token_records,
    "op13_token_alignment": op13_token_alignment,
}

_WORDS = r"regexp_extract_all(translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL: dict[str, str] = {
    "op2_decontaminate": f"""
WITH d AS (SELECT doc_id, coalesce({_WORDS.format(t="text")}, []) AS w FROM documents),
b AS (SELECT item_id, {_WORDS.format(t="text")} AS w FROM benchmark WHERE text IS NOT NULL),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS m, array_to_string(list_slice(w, i, i + least(10, len(w)) - 1), ' ') AS s
       FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, m, i, array_to_string(list_slice(w, i, i + m - 1), ' ') AS s
       FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM bw) WHERE len(w) >= m)),
hit AS (SELECT dw.doc_id, dw.m, dw.i, bw.item_id FROM dw JOIN bw ON dw.m = bw.m AND dw.s = bw.s),
pos AS (SELECT DISTINCT doc_id, unnest(range(i, i + m)) AS p FROM (SELECT DISTINCT doc_id, i, m FROM hit)),
n AS (SELECT doc_id, count(*) AS n_hit FROM pos GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS xs FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(it.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(it.xs, '')) AS items_sha256, coalesce(n.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN it USING (doc_id)
""",
    "op11_hard_negatives": """
WITH v AS (SELECT row_number() OVER () AS row, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.row AS anchor, a.vec_id AS anchor_id, v.row AS other, v.vec_id AS other_id, a.label = v.label AS alike, CAST(list_dot_product(a.e, v.e) AS BIGINT) AS score
      FROM v AS a, v WHERE a.vec_id % 50 = 0 AND a.row <> v.row),
p AS (SELECT anchor, anchor_id, other AS positive, other_id AS positive_id, score AS positive_score FROM s WHERE alike
      QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, other_id, other) <= 5)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.other_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor = p.anchor AND NOT s.alike AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
WINDOW w AS (PARTITION BY p.anchor, p.positive ORDER BY s.score DESC, s.other_id, s.other)
QUALIFY row_number() OVER w <= 3
""",
    "op9_sharding": "SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes, sha256(coalesce(text, '')) AS text_sha256 FROM documents",
}
