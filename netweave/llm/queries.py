"""The dealt queries, thin views of the operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from netweave.plans.session import scratch_path, tables


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from netweave.llm.mixing import mix_sources

    return mix_sources(tables(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_warc_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from netweave.llm.warc import plan_records, read_warc, write_warc

    archive = write_warc(plan_records(tables(spark, sf_dir, "pages")), scratch_path(spark, "warc"))
    head = F.col("headers")
    revisit = head["warc-type"] == "revisit"
    return read_warc(spark, archive).select(
        head["x-page"].cast("long").alias("page_id"),
        F.when(revisit, head["x-payload-bytes"].cast("long")).otherwise(F.octet_length("payload")).cast("long").alias("payload_bytes"),
        F.when(revisit, F.replace(head["warc-payload-digest"], F.lit("sha256:"), F.lit(""))).otherwise(F.sha2("payload", 256)).alias("payload_digest"),
        head["warc-type"].alias("record_type"),
        head["x-refers-to-page"].cast("long").alias("refers_to"),
    )


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from netweave.llm.minhash import near_duplicates

    return near_duplicates(tables(spark, sf_dir, "documents"))


def op2_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    from netweave.llm.packing import pack_documents

    return pack_documents(tables(spark, sf_dir, "documents")).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from netweave.llm.pii import BASE_KINDS, find_pii

    base = F.filter("spans", lambda s: s["base"])
    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long")
    return find_pii(tables(spark, sf_dir, "documents")).select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in BASE_KINDS],
        F.sha2(shown(base), 256).alias("base_sha256"),
        shown(F.col("spans")).alias("spans"),
    )


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from netweave.llm.quality import fit_quality, score_quality

    docs = tables(spark, sf_dir, "documents").select("doc_id", "text")
    return score_quality(docs, fit_quality(docs, tables(spark, sf_dir, "labels"))).select("doc_id", "held_out", "score", "predicted")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from netweave.llm.line_dedup import dedup_lines

    docs = tables(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from netweave.llm.ann import nearest_neighbours

    vectors = tables(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest_neighbours(vectors, vectors.where(F.col("vec_id") % 20 == 0), k=20)


def op10_near_duplicate_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from netweave.llm.embedding_dedup import near_duplicate_vectors

    return near_duplicate_vectors(tables(spark, sf_dir, "embeddings"))


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from netweave.llm.repeats import remove_repeats

    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return remove_repeats(tables(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


QUERIES = {"op9_repeats": op9_repeats, "op4_nearest": op4_nearest, "op10_near_duplicate_vectors": op10_near_duplicate_vectors, "op1_near_duplicates": op1_near_duplicates, "op8_line_dedup": op8_line_dedup, "op2_pack": op2_pack, "op5_quality": op5_quality, "op3_pii": op3_pii, "op6_mix_sources": op6_mix_sources, "op7_warc_roundtrip": op7_warc_roundtrip}

_VECTORS = """
WITH RECURSIVE v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id AS id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(embedding, lambda e: e <> 0)) > 0)"""

ORACLES = {
    "op4_nearest": _VECTORS + """,
s AS (SELECT q.r AS q, q.id AS query_id, c.id AS vec_id, list_inner_product(q.x, c.x) AS score FROM v q JOIN v c ON q.id % 20 = 0 AND q.r <> c.r),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20""",
    "op10_near_duplicate_vectors": _VECTORS + """,
l AS (SELECT a.r AS a, b.r AS b FROM v a JOIN v b ON a.r <> b.r AND list_cosine_similarity(a.x, b.x) >= 0.9),
reach AS (SELECT r, r AS other FROM v UNION SELECT reach.r, l.b FROM reach JOIN l ON l.a = reach.other),
c AS (SELECT reach.r, min(v.id) AS component_id FROM reach JOIN v ON v.r = reach.other GROUP BY reach.r),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT v.id AS vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, c.component_id, v.id = c.component_id AS kept
FROM v JOIN c ON c.r = v.r LEFT JOIN n ON n.a = v.r
UNION ALL
SELECT vec_id, CAST(0 AS BIGINT), vec_id, true FROM embeddings
WHERE NOT coalesce(vec_id IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(embedding, lambda e: e <> 0)) > 0, false)""",
    "op7_warc_roundtrip": """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
r AS (
  SELECT *, first_value(page_id) OVER w AS head, row_number() OVER w AS n
  FROM p WINDOW w AS (PARTITION BY payload_digest ORDER BY page_id NULLS LAST))
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND n > 1 THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND n > 1 THEN head END AS refers_to
FROM r""",
    "op6_mix_sources": r"""
WITH d AS (
  SELECT doc_id, coalesce('s' || source, 't') AS src,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('17:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS k
  FROM documents),
s AS (SELECT src, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY src),
r AS (SELECT *, row_number() OVER (ORDER BY src) - 1 AS i FROM s),
w AS (SELECT *, CASE i % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, source_size * 3.0::DOUBLE AS cap FROM r),
c AS (SELECT *, sum(source_size) OVER () * 1.0::DOUBLE AS total,
         coalesce(sum(cap) OVER (ORDER BY cap / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cap_before,
         coalesce(sum(w) OVER (ORDER BY cap / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w_before,
         sum(w) OVER () AS w_all FROM w),
f AS (SELECT *, cap * (w_all - w_before) < (total - cap_before) * w AS capped FROM c),
t AS (SELECT src, source_size, CASE WHEN capped THEN cap ELSE
         (total - coalesce(sum(CASE WHEN capped THEN cap END) OVER (), 0)) * w / sum(CASE WHEN capped THEN 0 ELSE w END) OVER () END AS target FROM f),
p AS (SELECT d.*, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS budget,
         CAST(coalesce(sum(size) OVER (PARTITION BY src ORDER BY k, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
      FROM d JOIN t USING (src))
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN source_size = 0 THEN 0 ELSE budget // source_size * size + greatest(0, least(size, budget - budget // source_size * source_size - start)) END AS BIGINT) AS taken
FROM p""",
}
