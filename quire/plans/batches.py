"""Registered queries: training batches over the contiguous-split shards."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import batches as bt
from quire.operators import corpus as cp
from quire.plans.corpus import CONTIG_SQL, DOCS_SQL, SHARD, VAL, doc_tokens, positions
from quire.functions.columns import SHARD_NAME_FORMAT
from quire.plans.registry import register

B, R = 1024, 2
L = B // R
SEQ = 1024
MAX_SEQ = 300
KEY = list(bt.SHARD_KEY)

# DuckDB: tokens of every shard position (split, domain, shard, pos, token)
SHARD_TOKENS_SQL = CONTIG_SQL + f""",
r AS (SELECT *, to_tok - from_tok AS ln FROM sp WHERE to_tok - from_tok > 0),
e AS (SELECT r.*, UNNEST(range(split_pos // {SHARD}, (split_pos + ln - 1) // {SHARD} + 1)) AS shard FROM r),
pc AS (SELECT domain, doc_pos, split, shard, from_tok, split_pos,
              from_tok + greatest(split_pos, shard * {SHARD}) - split_pos AS shard_from,
              from_tok + least(split_pos + ln, (shard + 1) * {SHARD}) - split_pos AS shard_to FROM e),
st AS (SELECT pc.split, pc.domain, pc.shard,
              pc.split_pos + (pc.shard_from - pc.from_tok) - pc.shard * {SHARD} + u.i AS pos, u.token
       FROM pc JOIN docs d USING (domain, doc_pos),
       LATERAL (SELECT unnest(list_slice(d.tokens, pc.shard_from + 1, pc.shard_to)) AS token,
                       generate_subscripts(list_slice(d.tokens, pc.shard_from + 1, pc.shard_to), 1) - 1 AS i) u),
sizes AS (SELECT split, domain, shard, count(*) AS n FROM st GROUP BY ALL),
rng AS (SELECT split, domain, shard, b.batch, rk.rank, b.batch * {B} + rk.rank * {L} AS start,
               b.batch * {B} + rk.rank * {L} + {L + 1} AS "end"
        FROM sizes, LATERAL (SELECT unnest(range(0, CAST(ceil((n - {B} - 1) / {B}) AS BIGINT))) AS batch) b,
             LATERAL (SELECT unnest(range(0, {R})) AS rank) rk
        WHERE n - {B} - 1 > 0)"""


def shard_rows(spark, d):
    """Which tokens of which documents make up each shard: positions only, no token."""
    return cp.assign_shards(cp.split_contiguous(positions(spark, d), VAL), SHARD)


def shard_layout(rows, shard=SHARD):
    """Where each document piece lies in its shard, without tokens, and the shards' sizes."""
    length = (F.col("shard_to") - F.col("shard_from")).alias("size")
    # the position in the stream at which the piece begins, from the shard's begin
    at = (F.col("split_pos") + F.col("shard_from") - F.col("from_tok") - F.col("shard") * shard).alias("shard_pos")
    pieces = rows.select(*KEY, at, length, (F.col("shard_from") == 0).alias("bos_start"))
    return pieces, pieces.groupBy(*KEY).agg(F.sum("size").alias("n"))


def land_shards(spark, d, rows=None):
    """K1: the corpus as shard files, tokenized once on the way; returns their folder."""
    from quire.sources import token_bin
    from quire.sources.logs import landing_dir
    rows = shard_rows(spark, d) if rows is None else rows
    name = cp.shard_name(F.col("split"), F.col("domain"), F.col("shard")).alias("name")
    counts = shard_layout(rows)[1].select(name, F.col("n").alias("n_tokens"))
    pieces = bt.shard_pieces(rows, doc_tokens(spark, d), SHARD)
    dest = landing_dir(spark, "shards")
    token_bin.write_shards(pieces.select(name, "shard_pos", "tokens"), dest, counts)
    return dest


def from_shards(dest, ranges, spans):
    """Tokens of ranges (shard key, ...) from the files: one ranged read each."""
    from quire.sources import token_bin
    name = cp.shard_name(F.col("split"), F.col("domain"), F.col("shard"))
    placed = ranges.withColumn("path", F.concat(F.lit(dest + "/"), name)).withColumn("spans", spans)
    return token_bin.read_ranges(placed).drop("path", "spans")


def one_span():
    return F.array(F.struct(F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end")))


def contiguous_buffers(spark, d):
    rows = shard_rows(spark, d)
    ranges = bt.batches_contiguous(shard_layout(rows)[1], B, R)
    return from_shards(land_shards(spark, d, rows), ranges, one_span()).drop("end")


@register("batches_contiguous", SHARD_TOKENS_SQL + """
SELECT r.split, r.domain, r.shard, r.batch, CAST(r.rank AS INTEGER) AS rank, r.start, count(*) AS n,
       CAST(sum(t.token) AS BIGINT) AS tok_sum, arg_min(t.token, t.pos) AS first_tok, arg_max(t.token, t.pos) AS last_tok
FROM rng r JOIN st t ON t.split = r.split AND t.domain = r.domain AND t.shard = r.shard
  AND t.pos >= r.start AND t.pos < r."end"
GROUP BY ALL""", ("corpus",))
def q_batches_contiguous(spark, d):
    b = contiguous_buffers(spark, d)
    return b.select(*KEY, "batch", "rank", "start", F.size("tokens").cast("bigint").alias("n"),
                    F.aggregate("tokens", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("tok_sum"),
                    F.element_at("tokens", 1).alias("first_tok"), F.element_at("tokens", -1).alias("last_tok"))


@register("batch_pairs", SHARD_TOKENS_SQL + """
SELECT r.split, r.domain, r.shard, r.batch, CAST(r.rank AS INTEGER) AS rank,
       CAST(sum(t.token) FILTER (WHERE t.pos < r."end" - 1) AS BIGINT) AS inputs_sum,
       CAST(sum(t.token) FILTER (WHERE t.pos > r.start) AS BIGINT) AS targets_sum,
       count(*) FILTER (WHERE t.pos < r."end" - 1) AS n_inputs
FROM rng r JOIN st t ON t.split = r.split AND t.domain = r.domain AND t.shard = r.shard
  AND t.pos >= r.start AND t.pos < r."end"
GROUP BY ALL""", ("corpus",))
def q_batch_pairs(spark, d):
    b = bt.batch_pairs(contiguous_buffers(spark, d))
    s = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return b.select(*KEY, "batch", "rank", s(F.col("inputs")).alias("inputs_sum"),
                    s(F.col("targets")).alias("targets_sum"), F.size("inputs").cast("bigint").alias("n_inputs"))


M = bt.BIGRAM_VOCAB


def _wrap(x):
    return f"((({x}) + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648"


@register("bigram_buckets", SHARD_TOKENS_SQL + f""",
inp AS (SELECT r.split, r.domain, r.shard, r.batch, r.rank, t.pos - r.start AS j, t.token
        FROM rng r JOIN st t ON t.split = r.split AND t.domain = r.domain AND t.shard = r.shard
          AND t.pos >= r.start AND t.pos < r."end" - 1),
lg AS (SELECT *, lag(token) OVER (PARTITION BY split, domain, shard, batch, rank ORDER BY j) AS prev FROM inp),
h AS (SELECT *, CASE WHEN j = 0 THEN {M}
        ELSE ((xor(CAST({_wrap(f"CAST(token AS BIGINT) * {bt.BIGRAM_MUL_CUR}")} AS BIGINT),
                   CAST({_wrap(f"CAST(CASE WHEN j = 1 THEN {M} ELSE prev END AS BIGINT) * {bt.BIGRAM_MUL_PREV}")} AS BIGINT))
               % {M}) + {M}) % {M} END AS bg FROM lg)
SELECT split, domain, shard, batch, CAST(rank AS INTEGER) AS rank, CAST(sum(bg) AS BIGINT) AS bigram_sum,
       string_agg(CAST(bg AS VARCHAR), ',' ORDER BY j) AS bigram_text
FROM h GROUP BY split, domain, shard, batch, rank""", ("corpus",))
def q_bigram_buckets(spark, d):
    b = bt.batch_pairs(contiguous_buffers(spark, d)).withColumn("bigram", bt.bigram_hash(F.col("inputs")))
    return b.select(*KEY, "batch", "rank",
                    F.aggregate("bigram", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("bigram_sum"),
                    F.array_join("bigram", ",").alias("bigram_text"))


@register("batch_seqlens_unaligned", SHARD_TOKENS_SQL + f""",
inp AS (SELECT r.split, r.domain, r.shard, r.batch, r.rank, t.pos - r.start AS j, t.token
        FROM rng r JOIN st t ON t.split = r.split AND t.domain = r.domain AND t.shard = r.shard
          AND t.pos >= r.start AND t.pos < r."end" - 1),
b AS (SELECT split, domain, shard, batch, rank, list(j ORDER BY j) FILTER (WHERE token = 50256) AS bl
      FROM inp GROUP BY ALL)
SELECT split, domain, shard, batch, CAST(rank AS INTEGER) AS rank,
       array_to_string(list_resize(list_concat([0], coalesce(bl, [])), {bt.max_num_docs(L)}, {L}), ',') AS cum_seqlens
FROM b""", ("corpus",))
def q_batch_seqlens_unaligned(spark, d):
    b = bt.batch_pairs(contiguous_buffers(spark, d))
    return b.select(*KEY, "batch", "rank",
                    F.array_join(bt.batch_seqlens_unaligned(F.col("inputs"), L), ",").alias("cum_seqlens"))


@register("fixed_sequences", SHARD_TOKENS_SQL + f""",
fs AS (SELECT split, domain, shard, s.seq, s.seq * {SEQ} AS start FROM sizes,
       LATERAL (SELECT unnest(range(0, n // {SEQ})) AS seq) s)
SELECT f.split, f.domain, f.shard, f.seq, f.start, CAST(sum(t.token) AS BIGINT) AS tok_sum, count(*) AS n
FROM fs f JOIN st t ON t.split = f.split AND t.domain = f.domain AND t.shard = f.shard
  AND t.pos >= f.start AND t.pos < f.start + {SEQ}
GROUP BY ALL""", ("corpus",))
def q_fixed_sequences(spark, d):
    rows = shard_rows(spark, d)
    g = from_shards(land_shards(spark, d, rows), bt.fixed_sequences(shard_layout(rows)[1], SEQ), one_span())
    return g.select(*KEY, "seq", "start", F.aggregate("tokens", F.lit(0).cast("bigint"), lambda a, x: a + x)
                    .alias("tok_sum"), F.size("tokens").cast("bigint").alias("n"))


BOUNDARY_SQL = DOCS_SQL + f""",
cut AS (SELECT domain, min(start + n_tokens) AS t0 FROM pos WHERE start + n_tokens >= {VAL} GROUP BY domain),
sd AS (
  SELECT p.domain, 'val' AS split, p.start AS start, list_slice(d.tokens, 1, least(p.n_tokens, {VAL} - p.start)) AS t
  FROM pos p JOIN docs d USING (domain, doc_pos) WHERE p.start < {VAL}
  UNION ALL
  SELECT p.domain, 'train', p.start - c.t0, d.tokens
  FROM pos p JOIN cut c USING (domain) JOIN docs d USING (domain, doc_pos)
  WHERE p.start >= c.t0)"""


def boundary_docs(spark, d):
    t = doc_tokens(spark, d)
    sp = cp.split_by_doc(positions(spark, d), VAL)
    return sp.join(t.select("domain", "doc_pos", "tokens"), ["domain", "doc_pos"]).select(
        "domain", "split", F.col("split_pos").alias("start"),
        F.slice("tokens", 1, F.col("to_tok").cast("int")).alias("tokens"))


@register("boundary_dataset", BOUNDARY_SQL + """
SELECT domain, split, CAST(sum(len(t)) AS BIGINT) AS n_tokens, count(*) AS n_docs,
       CAST(sum(len(t)) // 2049 AS BIGINT) AS num_seqs, min(start) AS first_start,
       bool_and(t[1] = 50256) AS starts_are_bos, true AS ok
FROM sd GROUP BY domain, split""", ("corpus",))
def q_boundary_dataset(spark, d):
    return bt.boundary_dataset(boundary_docs(spark, d))


@register("boundary_write", BOUNDARY_SQL + """
SELECT domain, split, count(*) AS n_docs, CAST(sum(len(t)) AS BIGINT) AS n_tokens, CAST(sum(list_sum(t)) AS BIGINT) AS tok_sum,
       CAST(sum(start) AS BIGINT) AS start_sum
FROM sd GROUP BY domain, split""", ("corpus",))
def q_boundary_write(spark, d):
    """K2 as a sink: the dataset is written, then read back."""
    from quire.sources.logs import landing_dir
    dest = landing_dir(spark, "boundary")
    bt.write_boundary_dataset(boundary_docs(spark, d), dest)
    return spark.read.parquet(f"{dest}/data").groupBy("domain", "split").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum(F.size("tokens")).cast("bigint").alias("n_tokens"),
        F.sum(F.aggregate("tokens", F.lit(0).cast("bigint"), lambda a, x: a + x)).cast("bigint").alias("tok_sum"),
        F.sum("doc_start").cast("bigint").alias("start_sum"))


#: B2 reads the corpus as one stream ('all') in shards of this many tokens; the per-rank buffer is as
#: long as the longest document, so that a window of two batches always holds enough starts, and a shard
#: is long enough for several such windows.
ALIGNED_SHARD = 1 << 19
ALIGNED_DOCS = 16

BOS_ALIGNED_SQL = DOCS_SQL.replace("WITH docs AS (SELECT domain,", "WITH docs AS (SELECT 'all' AS domain,") + f""",
span AS (SELECT max(n_tokens) AS l, greatest({ALIGNED_SHARD}, {ALIGNED_DOCS} * max(n_tokens)) AS size FROM lens),
bos2 AS (SELECT start // span.size AS shard, start % span.size AS pos FROM pos, span),
total AS (SELECT sum(n_tokens) AS n FROM lens),
sizes AS (SELECT shard, least(span.size, total.n - shard * span.size) AS n
          FROM (SELECT DISTINCT shard FROM bos2), total, span),
nx AS (SELECT shard, pos AS s, (SELECT min(b.pos) FROM bos2 b WHERE b.shard = a.shard AND b.pos >= a.pos + span.l) AS nxt
       FROM bos2 a, span),
chain AS (
  SELECT shard, 0 AS k, min(pos) AS s FROM bos2 GROUP BY shard
  UNION ALL
  SELECT c.shard, c.k + 1, n.nxt FROM chain c JOIN nx n ON n.shard = c.shard AND n.s = c.s WHERE n.nxt IS NOT NULL),
kb AS (SELECT *, k // {R} AS batch, k % {R} AS rank FROM chain),
bp AS (SELECT shard, batch, CASE WHEN batch = 0 THEN 0 ELSE min(s) END AS pos FROM kb GROUP BY shard, batch)
SELECT 'train' AS split, 'all' AS domain, CAST(kb.shard AS BIGINT) AS shard, CAST(kb.batch AS BIGINT) AS batch,
       CAST(kb.rank AS INTEGER) AS rank, kb.s AS start, kb.s + span.l + 1 AS "end"
FROM kb JOIN bp USING (shard, batch) JOIN sizes z USING (shard), span
WHERE bp.pos + {2 * R} * span.l + 1 < z.n"""


@register("batches_bos_aligned", BOS_ALIGNED_SQL, ("corpus",), recursive=True)
def q_batches_bos_aligned(spark, d):
    from quire.session import materialize
    from quire.sources import fixtures as fx
    lens = materialize(cp.token_counts(fx.corpus(spark, d).withColumn("domain", F.lit("all"))))
    return aligned_batches(lens)


def aligned_batches(lens):
    """B2 over a whole stream of documents (domain, doc_pos, n_tokens)."""
    longest = lens.agg(F.max("n_tokens")).first()[0] or 1  # one number
    shard = max(ALIGNED_SHARD, ALIGNED_DOCS * longest)
    rows = cp.assign_shards(cp.split_contiguous(cp.stream_positions(lens), 0), shard)
    pieces, sizes = shard_layout(rows, shard)
    return bt.batches_bos_aligned(pieces, sizes, longest * R, R).select(*KEY, "batch", "rank", "start", "end")


def packed_segments(rows):
    p, sz = shard_layout(rows)
    return bt.batches_packed(p, sz, B, MAX_SEQ, R)


PACK_SQL = SHARD_TOKENS_SQL + f""",
bos AS (SELECT split, domain, shard, pos AS s,
               row_number() OVER (PARTITION BY split, domain, shard ORDER BY pos) - 1 AS i,
               lead(pos) OVER (PARTITION BY split, domain, shard ORDER BY pos) AS nxt
        FROM st WHERE token = 50256),
pdocs AS (SELECT b.split, b.domain, b.shard, b.i, b.s, coalesce(b.nxt, z.n) AS e
         FROM bos b JOIN sizes z USING (split, domain, shard)),
rec AS (
  SELECT split, domain, shard, i, CAST(0 AS BIGINT) AS batch, 0 AS rank, 0 AS seg, s AS start,
         least(e, s + {MAX_SEQ}, s + {L + 1}) AS "end", least(e, s + {MAX_SEQ}, s + {L + 1}) - s AS cur
  FROM pdocs WHERE i = 0
  UNION ALL
  SELECT d.split, d.domain, d.shard, d.i,
         CASE WHEN r.cur = {L + 1} AND r.rank = {R - 1} THEN r.batch + 1 ELSE r.batch END,
         CASE WHEN r.cur = {L + 1} THEN (r.rank + 1) % {R} ELSE r.rank END,
         CASE WHEN r.cur = {L + 1} THEN 0 ELSE r.seg + 1 END,
         d.s,
         least(d.e, d.s + {MAX_SEQ}, d.s + {L + 1} - CASE WHEN r.cur = {L + 1} THEN 0 ELSE r.cur END),
         CASE WHEN r.cur = {L + 1} THEN 0 ELSE r.cur END
           + least(d.e, d.s + {MAX_SEQ}, d.s + {L + 1} - CASE WHEN r.cur = {L + 1} THEN 0 ELSE r.cur END) - d.s
  FROM rec r JOIN pdocs d ON d.split = r.split AND d.domain = r.domain AND d.shard = r.shard AND d.i = r.i + 1),
full_batches AS (SELECT split, domain, shard, count(*) AS nb FROM rec WHERE rank = {R - 1} AND cur = {L + 1}
                 GROUP BY ALL),
segs AS (SELECT r.* FROM rec r JOIN full_batches f USING (split, domain, shard) WHERE r.batch < f.nb)"""


@register("batches_packed", PACK_SQL + """
SELECT g.split, g.domain, g.shard, g.batch, CAST(g.rank AS INTEGER) AS rank, count(*) AS n,
       CAST(sum(t.token) AS BIGINT) AS tok_sum
FROM segs g JOIN st t ON t.split = g.split AND t.domain = g.domain AND t.shard = g.shard
  AND t.pos >= g.start AND t.pos < g."end"
GROUP BY ALL""", ("corpus",), recursive=True)
def q_batches_packed(spark, d):
    rows = shard_rows(spark, d)
    buf = from_shards(land_shards(spark, d, rows), bt.buffer_spans(packed_segments(rows)), F.col("spans"))
    return buf.select(*KEY, "batch", "rank", F.size("tokens").cast("bigint").alias("n"),
                      F.aggregate("tokens", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("tok_sum"))


@register("batch_seqlens", PACK_SQL + f""",
c AS (SELECT split, domain, shard, batch, rank, seg,
             sum("end" - start) OVER (PARTITION BY split, domain, shard, batch, rank ORDER BY seg) AS cum,
             max(seg) OVER (PARTITION BY split, domain, shard, batch, rank) AS last_seg
      FROM segs)
SELECT split, domain, shard, batch, CAST(rank AS INTEGER) AS rank,
       array_to_string(list_resize(list_concat([0], list(CAST(cum - CASE WHEN seg = last_seg THEN 1 ELSE 0 END AS INTEGER)
                                                     ORDER BY seg)), {bt.max_num_docs(L)}, {L}), ',') AS cum_seqlens
FROM c GROUP BY split, domain, shard, batch, rank""", ("corpus",), recursive=True)
def q_batch_seqlens(spark, d):
    return bt.batch_seqlens(packed_segments(shard_rows(spark, d)), L, [*KEY, "batch", "rank"]).withColumn(
        "cum_seqlens", F.array_join("cum_seqlens", ","))


# ---- token_bin shards (K1 write, S3 read, S4 header inventory) -------------

NAME_RX = r"^[^_]+_([^_]+)_(.+)_(\d{4})\.bin$"  # SHARD_NAME_FORMAT parsed back
SHARD_SIZES_SQL = SHARD_TOKENS_SQL + f"""
SELECT split, domain, shard, count(*) AS n, CAST(sum(token) AS BIGINT) AS tok_sum,
       printf('{SHARD_NAME_FORMAT}', split, domain, shard) AS name
FROM st GROUP BY split, domain, shard"""


@register("shard_write", "SELECT name, n AS num_tokens, true AS valid FROM (" + SHARD_SIZES_SQL.replace(
    "WITH ", "WITH ", 1) + ")", ("corpus",))
def q_shard_write(spark, d):
    from quire.sources import token_bin
    dest = land_shards(spark, d)
    inv = token_bin.shard_inventory(spark, dest)
    return inv.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "num_tokens", "valid")


@register("shard_read", "SELECT split, domain, shard, n, tok_sum FROM (" + SHARD_SIZES_SQL + ")", ("corpus",))
def q_shard_read(spark, d):
    from quire.sources import token_bin
    dest = land_shards(spark, d)
    rows = token_bin.read_shards(spark, dest)
    per = rows.groupBy("path").agg(
        F.sum(F.size("tokens")).cast("bigint").alias("n"),
        F.sum(F.aggregate("tokens", F.lit(0).cast("bigint"), lambda a, x: a + x)).cast("bigint").alias("tok_sum"))
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return per.select(F.regexp_extract(name, NAME_RX, 1).alias("split"), F.regexp_extract(name, NAME_RX, 2).alias("domain"),
                      F.regexp_extract(name, NAME_RX, 3).cast("bigint").alias("shard"), "n", "tok_sum")


@register("shard_inventory", "SELECT split, domain, CAST(sum(n) AS BIGINT) AS total_tokens, count(*) AS n_files FROM ("
          + SHARD_SIZES_SQL + ") GROUP BY split, domain", ("corpus",))
def q_shard_inventory(spark, d):
    from quire.sources import token_bin
    dest = land_shards(spark, d)
    inv = token_bin.shard_inventory(spark, dest)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return inv.groupBy(F.regexp_extract(name, NAME_RX, 1).alias("split"),
                       F.regexp_extract(name, NAME_RX, 2).alias("domain")).agg(
        F.sum("num_tokens").cast("bigint").alias("total_tokens"), F.count(F.lit(1)).alias("n_files"))
