"""The operators as registered queries with production parameters, and DuckDB text where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from gatewise.llm import bpe, decontaminate, embeddings, hmm, infill, language, lexical, licenses, lines, mixing, ngram_join, toxicity, urls
from gatewise.llm.common import remainder, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return register


@query("op1_url_filter")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judge_urls(table(spark, folder, "pages"))


@query("op2_line_dedup", sql=r"""
WITH l AS (
  SELECT doc_id, coalesce(source, '') AS site, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
t AS (SELECT *, trim(line, ' ' || chr(9) || chr(13)) AS body FROM l),
b AS (SELECT body, min(doc_id) AS keeper FROM t WHERE body <> '' GROUP BY body HAVING count(DISTINCT site) >= 3),
k AS (
  SELECT t.doc_id, string_agg(t.line, chr(10) ORDER BY t.pos) FILTER (WHERE keeper IS NULL OR t.doc_id <= keeper) AS text,
         count(*) AS n_lines, count(*) FILTER (WHERE t.doc_id > keeper) AS n_removed
  FROM t LEFT JOIN b ON t.body = b.body GROUP BY t.doc_id)
SELECT doc_id, n_lines, n_removed, coalesce(text, '') AS text FROM k
""")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = lines.dedup_lines(table(spark, folder, "documents").select("doc_id", "source", "text"))
    return cleaned.selectExpr("doc_id", "_n_lines AS n_lines", "_n_removed AS n_removed", "text")


@query("op5_mix_sources", sql=r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 5) AS h FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS w FROM d GROUP BY source),
r AS (
  SELECT *, 3 * source_size AS cap, (sum(source_size) OVER ())::BIGINT AS total, (sum(w) OVER ())::BIGINT AS weights,
         coalesce((sum(3 * source_size) OVER below)::BIGINT, 0) AS held, coalesce((sum(w) OVER below)::BIGINT, 0) AS gone
  FROM s WINDOW below AS (ORDER BY 3.0 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT level FROM (SELECT source, (total - held) / (weights - gone)::DOUBLE AS level, cap, w FROM r) WHERE cap >= level * w ORDER BY cap::DOUBLE / w, source NULLS LAST LIMIT 1),
t AS (SELECT source, source_size, least(cap::DOUBLE, coalesce((SELECT level FROM f), 0) * w) AS target FROM r),
q AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t),
g AS (SELECT source, h, sum(size) AS words FROM d GROUP BY source, h),
c AS (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY h) AS after FROM g),
x AS (
  SELECT q.source, max(c.h) AS last_h FROM q JOIN c ON q.source IS NOT DISTINCT FROM c.source
  WHERE c.after - c.words + c.after <= 2 * (target - whole * source_size) GROUP BY q.source)
SELECT d.doc_id, d.size, q.source_size, q.target,
       CASE WHEN d.size = 0 THEN 0 ELSE d.size * least(3, whole + CASE WHEN target > whole * source_size AND d.h <= x.last_h THEN 1 ELSE 0 END) END::BIGINT AS taken
FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source LEFT JOIN x ON d.source IS NOT DISTINCT FROM x.source
""")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_sources(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op9_license_scan")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, folder, "documents"))


@query("op4_ngram_jaccard", sql=None)
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.ngram_components(table(spark, folder, "documents"))


@query("op3_embedding_near_dedup")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, folder, "embeddings"))


@query("op7_language_id")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = language.identify_languages(docs, learn=remainder(F.col("doc_id"), 4) != 2)
    return found.select("doc_id", F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


@query("op10_hmm_score")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    scored = hmm.score_texts(docs, learn=remainder(F.col("doc_id"), 7) != 2)
    return scored.select("doc_id", F.coalesce(remainder(F.col("doc_id"), 7) == 2, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op6_decontaminate")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op8_toxicity")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    scored = toxicity.score_toxicity(docs, table(spark, folder, "labels"), learn=remainder(F.col("doc_id"), 4) != 2)
    held = F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out")
    score = F.col(toxicity.SCORE_COLUMN)
    return scored.select("doc_id", held, score.alias("score"), (score >= 0.3).cast("int").alias("predicted"))


@query("op11_lexical_search", sql=r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
g AS (SELECT count(*) AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM d WHERE len(terms) > 0),
c AS (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM i) GROUP BY row, term),
w AS (SELECT term, floor(1000 * ln((2::DOUBLE * n_docs + 2) / (2::DOUBLE * count(*) + 1)))::BIGINT AS weight FROM c, g GROUP BY term, n_docs),
m AS (SELECT row, doc_id, 50 + (50 * len(terms)::BIGINT * n_docs) // n_terms AS m FROM d, g WHERE len(terms) > 0),
s AS (
  SELECT item_id, doc_id, row, sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
  FROM c JOIN m USING (row) JOIN w USING (term) JOIN i USING (term) GROUP BY item_id, doc_id, row),
r AS (SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST))::INTEGER AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= 50
""")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.rank_documents(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op12_byte_bpe")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.round_trip_digests(table(spark, folder, "documents"), path, public_tokenizers.PATTERN)


@query("op13_fill_in_middle")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    filled = infill.fill_in_middle(infill.pack_texts(table(spark, folder, "documents")))
    return filled.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")
