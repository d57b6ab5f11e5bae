"""Registered queries: corpus scan, tokenize, stats, budget, splits, shards."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import corpus as cp
from quire.functions.columns import SHARD_NAME_FORMAT
from quire.plans.registry import register
from quire.sources import corpus as csrc
from quire.sources import fixtures as fx
from quire.sources.logs import landing_dir

BUDGET = 5000
VAL = 3000  # validation tokens per domain; train is the rest of the stream
SHARD = 4096
CLIP = 4096
DOMAINS = ["src1", "src3", "src5", "src7"]

# DuckDB: the default tokenizer over a text column, as a list
TOK_SQL = ("list_concat([50256], list_transform(regexp_extract_all(coalesce(text, ''), '[^ \t\n\r]+'), "
           "lambda w: CAST(('0x' || substr(md5(w), 1, 4))::INTEGER % 50256 AS INTEGER)))")
DOCS_SQL = f"""
WITH docs AS (SELECT domain, doc_pos, doc_id, {TOK_SQL} AS tokens FROM corpus WHERE length(coalesce(text, '')) > 0),
lens AS (SELECT domain, doc_pos, doc_id, CAST(len(tokens) AS BIGINT) AS n_tokens FROM docs),
pos AS (SELECT *, CAST(coalesce(sum(n_tokens) OVER (PARTITION BY domain ORDER BY doc_pos
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start,
               row_number() OVER (PARTITION BY domain ORDER BY doc_pos) - 1 AS doc_no FROM lens)"""


def doc_tokens(spark, d):
    return cp.tokenize(fx.corpus(spark, d))


def positions(spark, d):
    return cp.stream_positions(cp.token_counts(fx.corpus(spark, d)))


@register("scan_corpus", """
SELECT domain, shard_idx, row_number() OVER (PARTITION BY domain, shard_idx ORDER BY doc_pos) AS line_no,
       coalesce(text, '') AS text FROM corpus""",
          ("corpus",))
def q_scan_corpus(spark, d):
    dest = landing_dir(spark, "corpus")
    csrc.land_corpus(fx.corpus(spark, d), dest).count()  # the sink runs here
    return csrc.scan_corpus(spark, dest)


@register("domain_catalog", f"""
SELECT DISTINCT domain, source_idx, shard_idx, domain || '/' || printf('%04d', shard_idx) || '.jsonl.gz' AS path
FROM corpus WHERE domain IN ({", ".join(f"'{x}'" for x in DOMAINS)}) AND shard_idx < 2""", ("corpus",))
def q_domain_catalog(spark, d):
    cat = fx.corpus(spark, d).select("domain", "source_idx", "shard_idx").distinct().withColumn(
        "path", F.format_string("%s/%04d.jsonl.gz", F.col("domain"), F.col("shard_idx")))
    return cp.domain_catalog(cat, DOMAINS, 2)


@register("tokenize", DOCS_SQL + """
SELECT domain, doc_pos, CAST(len(tokens) AS BIGINT) AS n_tokens, array_to_string(tokens, ',') AS tokens_text
FROM docs""", ("corpus",))
def q_tokenize(spark, d):
    t = doc_tokens(spark, d)
    return t.select("domain", "doc_pos", F.size("tokens").cast("bigint").alias("n_tokens"),
                    F.array_join("tokens", ",").alias("tokens_text"))


@register("clip_docs", DOCS_SQL + f""",
c AS (SELECT domain, doc_pos, list_slice(tokens, 1, {CLIP + 1}) AS t FROM docs)
SELECT domain, doc_pos, CAST(len(t) AS BIGINT) AS n_tokens, CAST(list_sum(t) AS BIGINT) AS tok_sum,
       t[len(t)] AS last_token FROM c""", ("corpus",))
def q_clip_docs(spark, d):
    t = cp.clip_docs(doc_tokens(spark, d), CLIP)
    return t.select("domain", "doc_pos", F.size("tokens").cast("bigint").alias("n_tokens"),
                    F.aggregate("tokens", F.lit(0).cast("bigint"), lambda a, b: a + b).alias("tok_sum"),
                    F.element_at("tokens", -1).alias("last_token"))


@register("seq_len_stats", DOCS_SQL + """,
l AS (SELECT *, max(doc_pos) OVER (PARTITION BY domain) AS last_pos, count(*) OVER (PARTITION BY domain) AS n_bos,
             sum(n_tokens) OVER (PARTITION BY domain) AS total FROM lens),
s AS (SELECT domain, max(n_bos) AS n_bos, CAST(max(total) AS BIGINT) AS total_tokens,
        count(CASE WHEN doc_pos < last_pos THEN 1 END) AS num_sequences,
        quantile_cont(CASE WHEN doc_pos < last_pos THEN CAST(n_tokens AS DOUBLE) END, 0.5) AS md,
        avg(CASE WHEN doc_pos < last_pos THEN n_tokens END) AS mn,
        quantile_cont(CASE WHEN doc_pos < last_pos THEN CAST(n_tokens AS DOUBLE) END, 0.25) AS p25,
        quantile_cont(CASE WHEN doc_pos < last_pos THEN CAST(n_tokens AS DOUBLE) END, 0.75) AS p75,
        quantile_cont(CASE WHEN doc_pos < last_pos THEN CAST(n_tokens AS DOUBLE) END, 0.95) AS p95,
        max(CASE WHEN doc_pos < last_pos THEN n_tokens END) AS mx
      FROM l GROUP BY domain)
SELECT domain, CASE WHEN n_bos >= 2 THEN num_sequences END AS num_sequences, total_tokens,
  CASE WHEN n_bos >= 2 THEN CAST(trunc(md) AS BIGINT) END AS median_len,
  CASE WHEN n_bos >= 2 THEN CAST(trunc(mn) AS BIGINT) END AS mean_len,
  CASE WHEN n_bos >= 2 THEN CAST(trunc(p25) AS BIGINT) END AS p25_len,
  CASE WHEN n_bos >= 2 THEN CAST(trunc(p75) AS BIGINT) END AS p75_len,
  CASE WHEN n_bos >= 2 THEN CAST(trunc(p95) AS BIGINT) END AS p95_len,
  CASE WHEN n_bos >= 2 THEN CAST(mx AS BIGINT) END AS max_len
FROM s""", ("corpus",))
def q_seq_len_stats(spark, d):
    return cp.seq_len_stats(cp.token_counts(fx.corpus(spark, d)))


@register("corpus_summary", DOCS_SQL + """
SELECT domain, count(*) AS n_docs, CAST(sum(n_tokens) AS BIGINT) AS n_tokens FROM lens GROUP BY domain
UNION ALL
SELECT 'TOTAL', count(*), CAST(sum(n_tokens) AS BIGINT) FROM lens""", ("corpus",))
def q_corpus_summary(spark, d):
    return cp.corpus_summary(cp.token_counts(fx.corpus(spark, d)))


@register("token_budget", DOCS_SQL + f"""
SELECT domain, doc_pos, start, least(n_tokens, {BUDGET} - start) AS keep FROM pos WHERE start < {BUDGET}""",
          ("corpus",))
def q_token_budget(spark, d):
    return cp.token_budget(positions(spark, d), BUDGET).select("domain", "doc_pos", "start", "keep")


SPLIT_COLS = ["domain", "doc_pos", "split", "from_tok", "to_tok", "split_pos"]
CONTIG_SQL = DOCS_SQL + f""",
sp AS (
  SELECT domain, doc_pos, 'val' AS split, greatest(start, 0) - start AS from_tok,
         least(start + n_tokens, {VAL}) - start AS to_tok, greatest(start, 0) AS split_pos
  FROM pos WHERE start + n_tokens > 0 AND start < {VAL}
  UNION ALL
  SELECT domain, doc_pos, 'train', greatest(start, {VAL}) - start, n_tokens, greatest(start, {VAL}) - {VAL}
  FROM pos WHERE start + n_tokens > {VAL})"""


@register("split_contiguous", CONTIG_SQL + "\nSELECT * FROM sp", ("corpus",))
def q_split_contiguous(spark, d):
    return cp.split_contiguous(positions(spark, d), VAL).select(*SPLIT_COLS)


@register("split_by_doc", DOCS_SQL + f""",
cut AS (SELECT domain, min(start + n_tokens) AS t0 FROM pos WHERE start + n_tokens >= {VAL} GROUP BY domain)
SELECT domain, doc_pos, 'val' AS split, CAST(0 AS BIGINT) AS from_tok, least(n_tokens, {VAL} - start) AS to_tok,
       start AS split_pos
FROM pos WHERE start < {VAL}
UNION ALL
SELECT p.domain, p.doc_pos, 'train', 0, p.n_tokens, p.start - c.t0
FROM pos p JOIN cut c USING (domain) WHERE p.start >= c.t0""", ("corpus",))
def q_split_by_doc(spark, d):
    return cp.split_by_doc(positions(spark, d), VAL).select(*SPLIT_COLS)


@register("assign_shards", CONTIG_SQL + f""",
r AS (SELECT *, to_tok - from_tok AS ln FROM sp WHERE to_tok - from_tok > 0),
e AS (SELECT r.*, UNNEST(range(split_pos // {SHARD}, (split_pos + ln - 1) // {SHARD} + 1)) AS shard FROM r)
SELECT domain, doc_pos, split, shard,
       from_tok + greatest(split_pos, shard * {SHARD}) - split_pos AS shard_from,
       from_tok + least(split_pos + ln, (shard + 1) * {SHARD}) - split_pos AS shard_to,
       printf('{SHARD_NAME_FORMAT}', split, domain, shard) AS name
FROM e""", ("corpus",))
def q_assign_shards(spark, d):
    a = cp.assign_shards(cp.split_contiguous(positions(spark, d), VAL), SHARD)
    return a.select("domain", "doc_pos", "split", "shard", "shard_from", "shard_to",
                    cp.shard_name(F.col("split"), F.col("domain"), F.col("shard")).alias("name"))


@register("shuffle_docs", f"""
WITH docs AS (SELECT domain, doc_id, {TOK_SQL} AS tokens FROM corpus WHERE length(coalesce(text, '')) > 0),
k AS (SELECT domain, doc_id, CAST(len(tokens) AS BIGINT) AS n_tokens,
             CAST(('0x' || substr(md5('42:' || CAST(doc_id AS VARCHAR)), 1, 15))::BIGINT AS BIGINT) AS shuffle_key
      FROM docs)
SELECT domain, doc_id, shuffle_key,
       CAST(coalesce(sum(n_tokens) OVER (PARTITION BY domain ORDER BY shuffle_key, doc_id
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
FROM k""", ("corpus",))
def q_shuffle_docs(spark, d):
    lens = cp.token_counts(cp.shuffle_docs(fx.corpus(spark, d)), keys=("domain", "shuffle_key"), order="doc_id")
    return cp.stream_positions(lens, order=["shuffle_key", "doc_id"]).select("domain", "doc_id", "shuffle_key", "start")


@register("bos_positions", DOCS_SQL + "\nSELECT domain, doc_pos, start AS bos_pos FROM pos", ("corpus",))
def q_bos_positions(spark, d):
    return cp.bos_positions(cp.token_counts(fx.corpus(spark, d)))


@register("doc_of_token", DOCS_SQL + """
SELECT p.domain, p.doc_no + 1 AS doc_no, p.n_tokens AS n, p.start AS min_pos, p.start + p.n_tokens - 1 AS max_pos,
       CAST(list_sum(d.tokens) AS BIGINT) AS tok_sum
FROM pos p JOIN docs d USING (domain, doc_pos)""", ("corpus",))
def q_doc_of_token(spark, d):
    tok = cp.doc_of_token(doc_tokens(spark, d), positions(spark, d))  # lengths need no tokens
    return tok.groupBy("domain", "doc_no").agg(
        F.count(F.lit(1)).alias("n"), F.min("pos").alias("min_pos"), F.max("pos").alias("max_pos"),
        F.sum("token").cast("bigint").alias("tok_sum"))
