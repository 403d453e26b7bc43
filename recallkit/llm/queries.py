"""Registered queries of the operators: one ``opN_<name>`` each, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallkit.llm import (
    centroids,
    decontaminate,
    langid,
    lattice,
    licenses,
    mixing,
    pii,
    prefix_trie,
    quality,
    simhash,
    substrings,
    tokens,
    toxicity,
)
from recallkit.llm.common import read_table

#: Key of the registered query over test data; real data need a secret one.
PII_KEY = "key of the test query"
Query = Callable[[SparkSession, str], DataFrame]


def vocabulary() -> str:
    """Path of the byte-level vocabulary that operator 1 encodes with."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.tokenized(read_table(spark, sf_dir, "documents"), vocabulary())


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    scored = toxicity.score_toxicity(docs, labels, held_out, keep=["doc_id"])
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted")


def op3_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    return quality.compression_bands(docs, keep=["doc_id"], bands=quality.fit_bands(docs, labels))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, docs = read_table(spark, sf_dir, "pages"), read_table(spark, sf_dir, "documents")
    return langid.identify_languages(pages, docs)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return groups.select("doc_id", simhash.hex16(F.col("fp")).alias("fingerprint"), "component_id")


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.remove_repeats(read_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op7_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.checked_surrogates(read_table(spark, sf_dir, "documents"), PII_KEY, keep=["doc_id"])


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = mixing.quality_weights(read_table(spark, sf_dir, "labels"))
    return mixing.mixture(read_table(spark, sf_dir, "documents"), weights)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(read_table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")
    return decontaminate.find_leaks(docs, items).withColumn("contaminated", F.lit(True))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_vectors(read_table(spark, sf_dir, "embeddings"), keep=["vec_id"])


def pieces_vocabulary() -> str:
    """Path of the piece vocabulary that operator 12 weighs segmentations with."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op12_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    return lattice.score_texts(read_table(spark, sf_dir, "documents"), pieces_vocabulary(), held_out, keep=["doc_id"])


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(read_table(spark, sf_dir, "conversations"))


#: Windows of op6 as joined words; the first document of each window is found by one grouping.
OP6_SQL = r"""
WITH split AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), words AS (
  SELECT row, doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS place FROM split
), windows AS (
  SELECT *, CASE WHEN count(*) OVER w = 50 THEN md5(string_agg(word, ' ') OVER w) END AS win
  FROM words WINDOW w AS (PARTITION BY row ORDER BY place ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)
), firsts AS (
  SELECT win, min(doc_id) AS earliest FROM windows WHERE win IS NOT NULL GROUP BY win
), covered AS (
  SELECT row, word, place, coalesce(bool_or(earliest < doc_id)
           OVER (PARTITION BY row ORDER BY place ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), false) AS gone
  FROM windows LEFT JOIN firsts USING (win)
), kept AS (
  SELECT row, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY place) FILTER (NOT gone) AS text
  FROM covered GROUP BY row
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(text, '')) AS kept_sha256
FROM split LEFT JOIN kept USING (row)
"""

#: The words, targets and keys of op8 in one statement; windows sort whole sources here.
OP8_SQL = r"""
WITH sizes AS (
  SELECT d.doc_id, d.source, CAST(coalesce(len(regexp_extract_all(d.text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         coalesce(q.w, 1.0::DOUBLE) AS weight
  FROM documents d
  LEFT JOIN (SELECT doc_id, max(CASE quality WHEN 1 THEN 1.0::DOUBLE WHEN 0 THEN 0.25::DOUBLE END) AS w
             FROM labels WHERE quality IN (0, 1) GROUP BY doc_id) q USING (doc_id)
), totals AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         row_number() OVER (ORDER BY source NULLS LAST) AS place
  FROM sizes GROUP BY source
), ranked AS (
  SELECT *, ([3.0, 1.0, 2.0]::DOUBLE[])[CAST((place - 1) % 3 + 1 AS INT)] AS weight, CAST(2 * source_size AS DOUBLE) AS cap FROM totals
), levels AS (
  SELECT *, cap / weight AS level FROM ranked
), rests AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()
             - coalesce(sum(cap) OVER (ORDER BY level, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
          / (sum(weight) OVER ()
             - coalesce(sum(weight) OVER (ORDER BY level, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) AS rest
  FROM levels
), targets AS (
  SELECT source, source_size,
         least(cap, coalesce(weight * max(CASE WHEN level >= rest THEN rest END) OVER (), cap)) AS target
  FROM rests
), keyed AS (
  SELECT s.*, t.source_size, t.target, CAST(round(t.target) AS BIGINT) AS budget,
         -ln((CAST('0x' || substr(md5('mix-1|' || s.doc_id || '|' || s.size), 1, 13) AS BIGINT) + 0.5::DOUBLE)
             / 4503599627370496.0::DOUBLE) / s.weight AS key
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), placed AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id
                                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs
  FROM keyed
)
SELECT doc_id, source, size, source_size, target,
       CAST(epochs * size + greatest(0, least(size, budget - epochs * source_size - before)) AS BIGINT) AS taken
FROM placed
"""

#: Squared distances and floors of means in integers, one step of the three as the next one's input.
_OP11_STEP = """near{n} AS (
  SELECT row, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS distance FROM (
    SELECT k.row, s.cluster, CAST(list_sum(list_transform(range(1, 65), lambda i: (k.p[i] - s.c[i]) * (k.p[i] - s.c[i]))) AS BIGINT) AS d
    FROM kept k CROSS JOIN start{n} s) GROUP BY row
), sums{n} AS (
  SELECT cluster, i, CAST(sum(p[i]) AS BIGINT) AS total, count(*) AS n
  FROM near{n} JOIN kept USING (row), unnest(range(1, 65)) AS u(i) GROUP BY cluster, i
), start{m} AS (
  SELECT s.cluster, coalesce(m.c, s.c) AS c FROM start{n} s LEFT JOIN (
    SELECT cluster, list((total - ((total % n) + n) % n) // n ORDER BY i) AS c FROM sums{n} GROUP BY cluster) m USING (cluster)
)"""
OP11_SQL = (
    """
WITH kept AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS p
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
), start0 AS (
  SELECT row_number() OVER (ORDER BY mark, p) - 1 AS cluster, p AS c
  FROM (SELECT sha256('1:' || vec_id) AS mark, p FROM kept ORDER BY mark, p LIMIT 16)
), """
    + ", ".join(_OP11_STEP.format(n=n, m=n + 1) for n in range(4))
    + """, inertias AS (
  SELECT cluster, CAST(sum(distance) AS BIGINT) AS cluster_inertia FROM near3 GROUP BY cluster
)
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, distance, cluster_inertia,
       (SELECT CAST(sum(cluster_inertia) AS BIGINT) FROM inertias) AS inertia,
       sha256(array_to_string(c, ',')) AS centroid_sha256
FROM near3 JOIN kept USING (row) JOIN start3 USING (cluster) JOIN inertias USING (cluster)
"""
)

#: Paths as joined digests of the turns, subtrees by their prefix; CRC-32 from its table of 256 remainders.
OP13_SQL = """
WITH crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce(CAST([n, 0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[]),
           lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), original AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i,
         md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS d, strlen(coalesce(text, '')) AS bytes
  FROM conversations WHERE conv_id IS NOT NULL
), heads AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base,
         xor(list_reduce(list_prepend(4294967295, list_transform(range(1, len(CAST(conv_id AS VARCHAR)) + 1),
               lambda i: CAST(ascii(substr(CAST(conv_id AS VARCHAR), i, 1)) AS BIGINT))),
             lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM original), crc
), rebuilt AS (
  SELECT h.conv_id, row_number() OVER (PARTITION BY h.conv_id ORDER BY o.conv_id <> h.base OR o.i > h.h, o.i) AS depth, o.d, o.bytes
  FROM heads h JOIN original o ON (o.conv_id = h.base AND o.i <= h.h) OR (o.conv_id = h.conv_id AND o.i > h.h)
), steps AS (
  SELECT conv_id, depth, string_agg(d, '') OVER (PARTITION BY conv_id ORDER BY depth) AS path, bytes FROM rebuilt
  UNION ALL SELECT conv_id, 0, '', 0 FROM heads
), nodes AS (
  SELECT path, min(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, min(bytes) AS bytes FROM steps GROUP BY path
), family AS (
  SELECT n.*, left(path, -32) AS above, (SELECT count(*) FROM nodes k WHERE k.depth = n.depth + 1 AND starts_with(k.path, n.path)) AS n_children FROM nodes n
), ends AS (
  SELECT path, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids
  FROM (SELECT conv_id, arg_max(path, depth) AS path FROM steps GROUP BY conv_id) GROUP BY path
), below AS (
  SELECT v.path, count(*) FILTER (u.n_children = 0) AS n_leaves, CAST(sum((u.n_convs - 1) * u.bytes) AS BIGINT) AS saved_tokens
  FROM nodes v JOIN family u ON starts_with(u.path, v.path) GROUP BY v.path
)
SELECT f.conv_id, CAST(f.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves, saved_tokens,
       sha256(coalesce(ids, '')) AS ends_sha256
FROM family f JOIN below USING (path) LEFT JOIN ends USING (path) LEFT JOIN nodes p ON f.depth > 0 AND p.path = f.above
"""


def queries() -> dict[str, Query]:
    return {
        "op1_token_ids": op1_token_ids,
        "op2_toxicity": op2_toxicity,
        "op3_compression_bands": op3_compression_bands,
        "op4_language_id": op4_language_id,
        "op5_simhash": op5_simhash,
        "op6_substrings": op6_substrings,
        "op7_surrogates": op7_surrogates,
        "op8_mixing": op8_mixing,
        "op9_license_scan": op9_license_scan,
        "op10_decontamination": op10_decontamination,
        "op11_centroids": op11_centroids,
        "op12_lattice": op12_lattice,
        "op13_prefix_trie": op13_prefix_trie,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_substrings": OP6_SQL, "op8_mixing": OP8_SQL, "op11_centroids": OP11_SQL, "op13_prefix_trie": OP13_SQL}
