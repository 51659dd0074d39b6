"""Queries of the training-data operators: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from speechjobs.llm.ctw import score_corpus
from speechjobs.llm.fingerprints import fingerprint_edits
from speechjobs.llm.hard_negatives import hard_negatives
from speechjobs.llm.langid import identify, train
from speechjobs.llm.line_dedup import drop_common_lines
from speechjobs.llm.mixing import merit_of_length, mix_sources
from speechjobs.llm.near_dedup import near_duplicates
from speechjobs.llm.packing import pack_documents
from speechjobs.llm.sharding import assign_shards
from speechjobs.llm.spelling import count_words, group_spellings
from speechjobs.llm.suffix_dedup import digest, remove_repeats
from speechjobs.llm.topk import exact_top_k
from speechjobs.llm.url_filters import filter_captures, host_of, url_keys


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_ctw_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_corpus(documents(spark, sf_dir), F.crc32(F.col("doc_id").cast("string")) % 7 == 2)


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(remove_repeats(documents(spark, sf_dir).select("doc_id", "text")))


def op3_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(documents(spark, sf_dir))


def _number(text, most: int):
    """A number below ``most`` from the MD5 of a string, the same in every SQL engine."""
    return F.conv(F.substring(F.md5(text), 1, 7), 16, 10).cast("bigint") % most


def dated_list(pages: DataFrame) -> DataFrame:
    """List entries for the hosts, domains and first path parts of a table of pages: two of five patterns are listed,
    with one to four additions and removals in turn on days of 2024."""
    patterns = pages.select(F.explode(url_keys(F.col("url"))).alias("pattern")).distinct().filter(_number(F.col("pattern"), 5) < 2)
    turns = patterns.withColumn("seq", F.explode(F.sequence(F.lit(0), _number(F.concat(F.lit("n "), "pattern"), 4).cast("int"))))
    day = _number(F.concat_ws(" ", "seq", "pattern"), 366).cast("int")
    return turns.select(
        F.element_at(F.array(*[F.lit(x) for x in ("adult", "malware", "spam")]), (_number(F.concat(F.lit("list "), "pattern"), 3) + 1).cast("int")).alias("list"), "pattern",
        F.when(F.col("seq") % 2 == 0, "add").otherwise("remove").alias("action"), F.date_add(F.to_date(F.lit("2024-01-01")), day).alias("dated"), "seq",
    )


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    captures = pages.select("page_id", "url", F.date_add(F.to_date(F.lit("2024-01-01")), _number(F.col("url"), 366).cast("int")).alias("fetched"))
    return filter_captures(captures, dated_list(pages), "page_id", "url", "fetched")


OP4_SQL = r"""
WITH captures AS (
  SELECT page_id, url, DATE '2024-01-01' + (('0x' || substr(md5(url), 1, 7))::BIGINT % 366)::INT AS fetched,
         nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '') AS host,
         nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^/?#]+)', 1), '') AS part
  FROM pages),
keyed AS (
  SELECT page_id, url, fetched, array_to_string(string_split(host, '.')[i:], '.') AS pattern
  FROM captures, unnest(generate_series(1, greatest(1, len(string_split(host, '.')) - 1))) AS t(i) WHERE host IS NOT NULL
  UNION ALL SELECT page_id, url, fetched, host || '/' || part FROM captures WHERE host IS NOT NULL AND part IS NOT NULL),
patterns AS (SELECT DISTINCT pattern FROM keyed WHERE ('0x' || substr(md5(pattern), 1, 7))::BIGINT % 5 < 2),
entries AS (
  SELECT pattern, seq, ['adult', 'malware', 'spam'][('0x' || substr(md5('list ' || pattern), 1, 7))::BIGINT % 3 + 1] AS list,
         DATE '2024-01-01' + (('0x' || substr(md5(seq || ' ' || pattern), 1, 7))::BIGINT % 366)::INT AS dated
  FROM patterns, unnest(generate_series(0, ('0x' || substr(md5('n ' || pattern), 1, 7))::BIGINT % 4)) AS t(seq)),
spans AS (
  SELECT *, lead(dated) OVER (PARTITION BY list, pattern ORDER BY dated, seq) AS until FROM entries),
hits AS (
  SELECT k.page_id, k.fetched, s.pattern, s.list, s.dated AS since
  FROM keyed k JOIN spans s ON k.pattern = s.pattern AND k.fetched >= s.dated AND (s.until IS NULL OR k.fetched < s.until)
  WHERE s.seq % 2 = 0 AND (s.until IS NULL OR s.until > s.dated)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY length(pattern) DESC, list) AS nth, count(*) OVER (PARTITION BY page_id) AS n FROM hits)
SELECT c.page_id, c.host, c.fetched, r.pattern IS NOT NULL AS blocked, r.pattern, r.list, r.since, coalesce(r.n, 0) AS matches
FROM captures c LEFT JOIN ranked r ON c.page_id = r.page_id AND r.nth = 1
"""


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(documents(spark, sf_dir), merit=merit_of_length())
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")


def op7_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = documents(spark, sf_dir).select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit(""))).alias("text_crc32"), F.lit("key").alias("law")
    )
    return assign_shards(facts, 24, text_col="text_crc32", ties=("size", "text_crc32")).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0, 5)


OP5_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS c FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(q.c::DOUBLE[], v.c::DOUBLE[])::BIGINT AS score
  FROM v AS q JOIN v ON q.vec_id <> v.vec_id AND len(q.c) = len(v.c) WHERE q.vec_id % 50 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM scored
QUALIFY rank <= 5
"""


def op8_sequence_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)).alias("held_out"))
    model = train(docs.filter(~F.col("held_out")))
    return identify(docs, model, keep=("held_out",)).select("doc_id", "held_out", "lang_pred", "score", F.size("spans").alias("n_spans"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0, moved)


OP11_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS c FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, v.vec_id, a.label = v.label AS same, list_dot_product(a.c, v.c)::BIGINT AS score
  FROM v AS a JOIN v ON a.vec_id <> v.vec_id AND len(a.c) = len(v.c) WHERE a.vec_id % 100 = 0),
best AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM best JOIN scored USING (anchor_id) WHERE NOT same AND 100 * score BETWEEN 30 * positive_score AND 90 * positive_score
QUALIFY rank <= 10
"""


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_spellings(count_words(documents(spark, sf_dir), typo_every=97))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = drop_common_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return left.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


OP13_SQL = r"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
numbered AS (SELECT doc_id, unnest(parts) AS line, unnest(generate_series(1, len(parts))) AS nth FROM split),
lines AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM numbered),
common AS (SELECT key, max(doc_id) AS keeper FROM lines WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE keeper <> doc_id) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY nth) FILTER (WHERE keeper IS NULL OR keeper = doc_id), '')) AS kept_sha256
FROM lines LEFT JOIN common USING (key) GROUP BY doc_id
"""

QUERIES = {
    f.__name__: f
    for f in (op1_ctw_scores, op2_suffix_array_dedup, op3_document_fingerprints, op4_url_filters, op5_exact_top_k, op6_source_mix, op7_shards, op8_sequence_packing, op9_language_id, op10_minhash_near_dedup, op11_hard_negatives, op12_spelling_variants, op13_line_dedup)
}
ORACLE_SQL = {"op4_url_filters": OP4_SQL, "op5_exact_top_k": OP5_SQL, "op11_hard_negatives": OP11_SQL, "op13_line_dedup": OP13_SQL}
