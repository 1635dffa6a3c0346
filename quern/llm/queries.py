"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import avi_media, bpe_count, chat_parts, curriculum, drift_means, license_scan, mil_quality, packing, quality_llr, secrets, token_align, token_join, warc_zstd
from quern.llm.words import n_words


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_quality_llr(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1").select("doc_id")
    return quality_llr.quality_rules(documents(spark, sf_dir), trusted)


def op2_avi_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = avi_media.read_back(avi_media.store(documents(spark, sf_dir), "text"))
    return read.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op3_random_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(documents(spark, sf_dir)))


def op4_token_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_join.jaccard_components(documents(spark, sf_dir))


def op5_bpe_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_count.bpe_counts(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op6_license_diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(documents(spark, sf_dir))


def op7_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = mil_quality.score(docs, mil_quality.train(docs, labels))
    predicted = (F.col("score") >= 0.5).cast("int").alias("predicted")
    return scored.select("doc_id", mil_quality.held_out(F.col("doc_id")).alias("held_out"), "score", predicted)


def op8_linear_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.token_pieces(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack(pieces)


def op9_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = documents(spark, sf_dir).select("doc_id", "source", n_words(F.col("text")).alias("size"))
    mixed = curriculum.in_training_order(curriculum.curriculum_mix(sizes))
    return mixed.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken", F.round("position", 9).alias("position"))


def op10_chat_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = rows.unionByName(extra).withColumn("parts", chat_parts.text_parts(F.col("text")))
    return chat_parts.digest(chat_parts.format_turns(rows))


def op11_seekable_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    bundles = warc_zstd.write(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    read = warc_zstd.read_back(bundles)
    return read.select(F.col("id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


def op12_drift_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centroids, _ = drift_means.cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return drift_means.digest(found, centroids)


def op13_pointer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_align.align(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {
    "op1_quality_llr": op1_quality_llr,
    "op2_avi_media": op2_avi_media,
    "op3_random_secrets": op3_random_secrets,
    "op4_token_join": op4_token_join,
    "op5_bpe_count": op5_bpe_count,
    "op6_license_diagonals": op6_license_diagonals,
    "op7_attention_quality": op7_attention_quality,
    "op8_linear_grouping": op8_linear_grouping,
    "op9_curriculum_mix": op9_curriculum_mix,
    "op10_chat_parts": op10_chat_parts,
    "op11_seekable_warc": op11_seekable_warc,
    "op12_drift_clusters": op12_drift_clusters,
    "op13_pointer_alignment": op13_pointer_alignment,
}

_OP4 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i : i + 4], ' ') END AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
h AS (SELECT doc_id, hash(g) AS g FROM s),
n AS (SELECT doc_id, count(*)::BIGINT AS n FROM h GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM h a JOIN h b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
z AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT a AS doc_id, a AS c FROM z UNION SELECT z.b, r.c FROM r JOIN z ON z.a = r.doc_id)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(m.c, w.doc_id) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id
LEFT JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY 1) m ON m.doc_id = w.doc_id
"""

_OP9 = r"""
WITH s AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS k
  FROM documents),
n AS (SELECT source, sum(size)::BIGINT AS source_size FROM s GROUP BY 1),
w AS (
  SELECT source, source_size, 3.0::DOUBLE * source_size AS cap,
         [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w,
         [-0.5, 0.0, 0.5][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS tilt
  FROM n),
l AS (
  SELECT *, row_number() OVER (ORDER BY cap / w, source NULLS LAST) AS pos,
         (sum(source_size::DOUBLE) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w),
t AS (
  SELECT source, source_size, tilt,
         CASE WHEN cap <= w * level THEN cap
              ELSE w * (SELECT arg_min(level, pos) FROM l WHERE cap > w * level) END AS target
  FROM l),
c AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, t.tilt, round(t.target)::BIGINT AS goal,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.k, s.doc_id, s.size
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source),
o AS (
  SELECT doc_id, size, source_size, target, tilt, goal, before,
         list_sum([greatest(least(size, goal - (e * source_size + before)), 0) FOR e IN range(4)])::BIGINT AS taken
  FROM c)
SELECT doc_id, size, source_size, round(target, 6) AS target, taken,
       CASE WHEN taken > 0 THEN round(least(greatest(2 * (before::DOUBLE / goal)
         / ((1 - tilt) + sqrt(greatest((1 - tilt) * (1 - tilt) + 4 * tilt * (before::DOUBLE / goal), 0))), 0), 1), 9) END AS position
FROM o
"""

_OP10 = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (
  SELECT *, 22 + 2 * length(role) + 2 * length(text)
    - length(replace(replace(replace(role, '\', ''), '<', ''), '[', ''))
    - length(replace(replace(replace(text, '\', ''), '<', ''), '[', '')) AS formatted
  FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(formatted)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

_OP11 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS x, h FROM p),
b AS (
  SELECT *, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(x, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT + 1, 1)
                             FOR i IN range(32)], '') AS payload_digest,
         max(page_id) OVER (PARTITION BY h) AS most
  FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = most THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> most THEN most END AS refers_to
FROM b
"""


def _op12(k: int = 40, rounds: int = 5) -> str:
    """Lloyd's rounds in whole numbers."""
    near = "SELECT vec_id, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT v.vec_id, z.c, list_sum([(v.v[i] - z.v[i]) * (v.v[i] - z.v[i]) FOR i IN range(1, 65)])::BIGINT AS d FROM v, {t} z) GROUP BY 1"
    parts = [
        "v AS (SELECT vec_id, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings WHERE len(embedding) = 64 AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0)",
        f"c0 AS (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS c, v FROM v ORDER BY sha256('2:' || vec_id) LIMIT {k})",
    ]
    for n in range(rounds):
        parts.append(f"a{n} AS MATERIALIZED ({near.format(t=f'c{n}')})")
        parts.append(f"m{n} AS (SELECT c, list(floor_mean ORDER BY i) AS v FROM (SELECT c, i, ((sum(x) - (((sum(x) % count(*)) + count(*)) % count(*))) // count(*))::BIGINT AS floor_mean FROM (SELECT a{n}.c, unnest(range(1, 65)) AS i, unnest(v.v) AS x FROM a{n} JOIN v USING (vec_id)) GROUP BY 1, 2) GROUP BY 1)")
        parts.append(f"c{n + 1} AS MATERIALIZED (SELECT z.c, coalesce(m.v, z.v) AS v FROM c{n} z LEFT JOIN m{n} m USING (c))")
    last = f"f AS ({near.format(t=f'c{rounds}')})"
    return f"WITH {', '.join([*parts, last])} SELECT vec_id, c::INT AS cluster, d AS distance, sum(d) OVER (PARTITION BY c)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia, sha256(array_to_string(z.v, ',')) AS centroid_sha256 FROM f JOIN c{rounds} z USING (c)"


ORACLE_SQL = {"op4_token_join": _OP4, "op9_curriculum_mix": _OP9, "op10_chat_parts": _OP10, "op11_seekable_warc": _OP11, "op12_drift_clusters": _op12()}
