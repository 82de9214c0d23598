"""The thin queries over the operators of this subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import htmltext, jaccard, langid, mixing, pieces, postings, quality, quantized, secrets, toxicity
from .common import table


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "source")
    return mixing.copies(docs).select(
        "doc_id",
        F.col("mix_size").alias("size"),
        F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"),
        (F.col("mix_size") * F.col("mix_copies")).alias("taken"),
    )


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, (CASE (row_number() OVER (ORDER BY source COLLATE "binary" NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END)::DOUBLE AS weight,
    source_size * 3.0::DOUBLE AS cap
  FROM s
), f AS (
  SELECT *, (sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remain,
    sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open
  FROM w
), l AS (
  SELECT remain, open FROM f WHERE cap * open > remain * weight ORDER BY cap / weight, source NULLS LAST LIMIT 1
), t AS (
  SELECT source, source_size,
    CASE WHEN cap * f.open <= f.remain * weight OR l.open IS NULL THEN cap ELSE weight * l.remain / l.open END AS target
  FROM f LEFT JOIN l ON true
), r AS (
  SELECT doc_id, size, source_size, target, coalesce(target / nullif(source_size, 0), 0) AS rate,
    ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS draw
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM r
"""


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    spans = F.col("secret_spans")
    n = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
    base = F.filter(spans, lambda s: s["kind"] != secrets.GUESS)
    return secrets.scan(docs, keep_text=False).select(
        "doc_id",
        n(secrets.ASSIGN).alias("n_assign"),
        n(secrets.ACCESS).alias("n_access"),
        n(secrets.HEX).alias("n_hex"),
        F.sha2(secrets.listed(base), 256).alias("base_sha256"),
        secrets.listed(spans).alias("spans"),
    )


def held_out(parts: int, part: int) -> Column:
    """Whether a document is kept from learning: by its id's checksum; without an id, it isn't."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts == part, F.lit(False))


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quantized.near_duplicates(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))
    return found.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels", "doc_id", "toxic").where(~held_out(4, 2)))
    score = F.col("toxic_score")
    return toxicity.score(docs, model, keep_text=False).select("doc_id", held_out(4, 2).alias("held_out"), score.alias("score"), (score >= 0.3).cast("int").alias("predicted"))


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages", "page_id", "url", "html")
    text = F.col("main_text")
    return htmltext.main_text(pages, htmltext.fit(pages), keep_page=False).select("page_id", "url", text.alias("text"), F.length(text).cast("long").alias("n_chars"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels", "doc_id", "quality").where(~held_out(5, 0)))
    score = F.col("quality_score")
    return quality.score(docs, model, keep_text=False).select("doc_id", held_out(5, 0).alias("held_out"), score.alias("score"), (score >= 0.3).cast("int").alias("predicted"))


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return postings.nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = pieces.model_bytes(public_tokenizers.path("piece_bpe_32k.model"))
    return pieces.encode(docs, model, keep_text=False).select(
        "doc_id",
        F.size("piece_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("piece_ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        F.coalesce(F.array_max("piece_ends"), F.lit(0)).cast("long").alias("bytes_covered"),
        F.col("piece_spans_sha256").alias("spans_sha256"),
    )


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    filters = langid.fit(docs.where(~held_out(4, 2)))
    return langid.predict(docs.select("doc_id", "text"), filters, keep_text=False).select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id", "n_shingles", "component_id")


OP3_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
), u AS (
  SELECT vec_id, x, sqrt(list_dot_product(x, x)) AS size FROM v
  WHERE x IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0 AND list_dot_product(x, x) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND list_dot_product(a.x, b.x) / (a.size * b.size) >= 0.9
), r AS (
  SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
), n AS (
  SELECT a, count(*) AS n FROM l GROUP BY a
), m AS (
  SELECT a, min(b) AS least FROM r GROUP BY a
)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(vec_id, coalesce(m.least, vec_id)) AS component_id, vec_id <= coalesce(m.least, vec_id) AS kept
FROM v LEFT JOIN n ON n.a = vec_id LEFT JOIN m ON m.a = vec_id
"""

OP10_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS shingle FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)
), r AS (
  SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
), m AS (
  SELECT a, min(b) AS least FROM r GROUP BY a
)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(m.least, w.doc_id)) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN m ON m.a = w.doc_id
"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_mix_sources, op2_secret_scan, op3_embedding_near_dedup, op4_toxicity, op5_main_text, op6_quality, op7_nearest_neighbours, op8_sentencepiece, op9_language_id, op10_jaccard_join, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {"op1_mix_sources": OP1_SQL, "op3_embedding_near_dedup": OP3_SQL, "op10_jaccard_join": OP10_SQL}
