"""The registered queries of these operators, over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from causeway.llm import (
    clustering,
    exact_dedup,
    fingerprints,
    infilling,
    language,
    licenses,
    packing,
    planes,
    quality,
    sharding,
    simhash,
    token_counts,
    tree_bpe,
)
from causeway.llm.token_ids import public_tokenizer


def _table(spark: SparkSession, folder: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_document_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.fingerprint_documents(_table(spark, folder))


def op2_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, folder))


def op3_bit_planes(spark: SparkSession, folder: str) -> DataFrame:
    path = planes.write_planes(_table(spark, folder), public_tokenizer("word_bpe_49k.json"), end_id=2)
    return planes.read_planes(spark, path)


def op4_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, folder))


def op5_tree_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return tree_bpe.encode_decode(_table(spark, folder), public_tokenizer("word_bpe_49k.json"))


def op6_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_groups(_table(spark, folder), words=4, bits=4)


def op7_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, folder), public_tokenizer("byte_bpe_50k.json"), limit=512)


def op8_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.score_quality(_table(spark, folder), _table(spark, folder, "labels"))


def op9_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(_table(spark, folder), public_tokenizer("byte_bpe_50k.json"), capacity=2048, end_id=1)


def op10_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.assign_shards(_table(spark, folder), shards=40)


def op11_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    return infilling.digests(infilling.fill_in_middle(_table(spark, folder), seed=1))


def op12_pivot_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return clustering.cluster_vectors(_table(spark, folder, "embeddings"), k=16, rounds=3).drop("compared")


def op13_language_codes(spark: SparkSession, folder: str) -> DataFrame:
    return language.identify_languages(_table(spark, folder))


QUERIES = {
    f.__name__: f
    for f in (
        op1_document_fingerprints, op2_exact_dedup, op3_bit_planes, op4_license_scan, op5_tree_bpe,
        op6_simhash, op7_token_counts, op8_quality, op9_packing, op10_sharding, op11_fill_in_middle,
        op12_pivot_clusters, op13_language_codes,
    )
}

ORACLES = {
    "op2_exact_dedup": r"""
WITH t AS (
    SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
    FROM documents
), n AS (
    SELECT *, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
        count(*) OVER (PARTITION BY text_sha256) AS group_size,
        row_number() OVER (PARTITION BY text_sha256, doc_id) AS copy
    FROM t
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AND copy = 1 AS kept, text_sha256 FROM n
""",
    "op11_fill_in_middle": r"""
WITH t AS (
    SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || doc_id) AS h,
        regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u
    FROM documents
), d AS (
    SELECT *, len(u) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(u) + 1) AS x,
        CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(u) + 1) AS y,
        CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 90 THEN 'plain'
            WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
    FROM t
), p AS (
    SELECT doc_id, n, form, text, array_to_string(u[1:least(x, y)], '') AS a,
        array_to_string(u[least(x, y) + 1:greatest(x, y)], '') AS b, array_to_string(u[greatest(x, y) + 1:], '') AS c
    FROM d
), o AS (
    SELECT *, CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || a || '<S>' || c || '<M>' || b
        ELSE '<S>' || c || '<P>' || a || '<M>' || b END AS output
    FROM p
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
    CASE WHEN form <> 'plain' THEN CAST(length(a) AS BIGINT) END AS prefix_chars,
    CASE WHEN form <> 'plain' THEN CAST(length(b) AS BIGINT) END AS middle_chars,
    sha256(output) AS output_sha256,
    sha256(CASE form WHEN 'plain' THEN output
        WHEN 'psm' THEN regexp_replace(output, '^<P>(.*)<S>(.*)<M>(.*)$', '\1\3\2', 's')
        ELSE regexp_replace(output, '^<S>(.*)<P>(.*)<M>(.*)$', '\2\3\1', 's') END) AS restored_sha256
FROM o
""",
}


def _clusters_sql(k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64) -> str:
    """The rounds of the clustering one after another, each vector against every centroid."""
    far = "sum((v.x - c.x) * (v.x - c.x))"
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS (
    SELECT r, cluster, distance FROM (
        SELECT v.r, c.cluster, {far} AS distance,
            row_number() OVER (PARTITION BY v.r ORDER BY {far}, c.cluster) AS place
        FROM v JOIN c{i} c USING (i) GROUP BY v.r, c.cluster
    ) WHERE place = 1
)""")
        if i < rounds:
            steps.append(f"""c{i + 1} AS (
    SELECT c.cluster, c.i, coalesce(m.x, c.x) AS x FROM c{i} c LEFT JOIN (
        SELECT cluster, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n, (s - ((s % n) + n) % n) // n AS x
        FROM a{i} JOIN v USING (r) GROUP BY cluster, i
    ) m USING (cluster, i)
)""")
    return f"""
WITH k AS (
    SELECT vec_id, row_number() OVER () AS r,
        list_transform(embedding, lambda e: CAST(floor({scale} * CAST(e AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
), v AS MATERIALIZED (
    SELECT r, unnest(v) AS x, unnest(range({dim})) AS i FROM k
), s AS (
    SELECT r, row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS cluster FROM k
), c0 AS (
    SELECT cluster, i, x FROM s JOIN v USING (r) WHERE cluster < {k}
), {", ".join(steps)}, e AS (
    SELECT cluster, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY cluster
)
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, CAST(distance AS BIGINT) AS distance,
    CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
    CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a{rounds} JOIN k USING (r) JOIN e USING (cluster)
"""


ORACLES["op12_pivot_clusters"] = _clusters_sql()


def _license_sql(least: float = 0.7) -> str:
    """The licence scan over whole word lists, without an index."""
    words = sorted({w for _, text, _ in licenses.TEMPLATES for w in text.split()} | {w for p in licenses.BASE for w in p.split()})
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

    def places(phrase: str) -> str:
        same = " AND ".join(f"w[i + {n + 1}] = '{word}'" for n, word in enumerate(phrase.split()))
        return f"list_filter(range(len(w)), lambda i: {same})"

    def cover(text: str, key: str) -> str:
        own = text.split()
        at = next(n for n in range(len(own)) if own[n:][: len(key.split())] == key.split())
        total = " + ".join(f"idf['{x}']" for x in own)
        parts = " + ".join(
            f"CASE WHEN b + {n - at} >= 0 AND w[greatest(b + {n - at}, 0) + 1] = '{x}' THEN idf['{x}'] / ({total}) ELSE 0 END"
            for n, x in enumerate(own)
        )
        return f"coalesce(list_max(list_transform({places(key)}, lambda b: {parts})), 0)"

    base = list(licenses.BASE.items())
    covers = ", ".join(f"{cover(t[1], t[2])} AS c{n}" for n, t in enumerate(licenses.TEMPLATES))
    found = ", ".join(f"{places(p)} AS p{n}" for n, (p, _) in enumerate(base))
    labels = [f"CASE WHEN len(p{n}) > 0 THEN '{label}' END" for n, (_, label) in enumerate(base)]
    more = [f"CASE WHEN c{n} >= {least} THEN '{t[0]}' END" for n, t in enumerate(licenses.TEMPLATES)]
    every = " || ".join(f"p{n}" for n in range(len(base)))

    def listed(parts: list[str]) -> str:
        return f"array_to_string(list_sort(list_distinct([{', '.join(parts)}])), ',')"

    return f"""
WITH t AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '{licenses.WORD}') AS w
    FROM documents
), df AS (
    SELECT word, count(*) AS n FROM (SELECT unnest(list_distinct(w)) AS word FROM t) GROUP BY word
), v AS (
    SELECT map_from_entries(list((word, ln(((SELECT count(*) FROM t) + 1) / (coalesce(n, 0) + 1)) + 1))) AS idf
    FROM (SELECT unnest({words}) AS word) LEFT JOIN df USING (word)
), f AS (
    SELECT doc_id, w, {found}, {covers} FROM t, v
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len({every}) AS BIGINT) AS n_base,
    CAST(list_min({every}) AS BIGINT) AS first_word, CAST(list_max({every}) AS BIGINT) AS last_word,
    {listed(labels)} AS base_labels, {listed(labels + more)} AS labels,
    least(1.0, round(CAST(greatest({', '.join(f'c{n}' for n in range(len(licenses.TEMPLATES)))}) AS DOUBLE), 9))::DOUBLE AS score
FROM f
"""


ORACLES["op4_license_scan"] = _license_sql()
