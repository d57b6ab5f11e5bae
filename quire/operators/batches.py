"""Training batches from token shards.

A shard is a key (split, domain, shard) and its token stream, held as
*pieces*: rows (key, shard_pos, tokens, bos_start) of document pieces.  Batch
layouts are computed from positions only (arithmetic, or per shard by sorted
searches over its document starts in ``applyInPandas``); tokens are
attached afterwards by :func:`gather`, an equi join on fixed-width position
buckets -- each piece is pre-cut into bucket-aligned chunks, so every token
travels once and every output range is bounded by its own length.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.columns import BIGRAM_VOCAB, GPT2_BOS, int32_wrap

SHARD_KEY = ("split", "domain", "shard")
# Per-rank document slots by local batch size.
TRAIN_MAX_NUM_DOCS = {16384: 64, 32768: 96, 49152: 128}
BIGRAM_MUL_CUR, BIGRAM_MUL_PREV = 36313, 27191


def shard_pieces(shard_rows: DataFrame, doc_tokens: DataFrame, shard_size: int,
                 doc_key=("domain", "doc_pos")) -> DataFrame:
    """Pieces of documents inside shards from :func:`quire.operators.corpus.assign_shards`
    rows: (split, domain, shard, shard_pos, tokens, bos_start)."""
    j = shard_rows.join(doc_tokens.select(*doc_key, "tokens"), list(doc_key))
    stream_lo = F.col("split_pos") + (F.col("shard_from") - F.col("from_tok"))
    return j.select(
        *SHARD_KEY,
        (stream_lo - F.col("shard") * shard_size).alias("shard_pos"),
        F.slice("tokens", (F.col("shard_from") + 1).cast("int"),
                (F.col("shard_to") - F.col("shard_from")).cast("int")).alias("tokens"),
        (F.col("shard_from") == 0).alias("bos_start"),
    )


def shard_sizes(pieces: DataFrame, key=SHARD_KEY) -> DataFrame:
    return pieces.groupBy(*key).agg(F.sum(F.size("tokens")).cast("bigint").alias("n"))


def gather(pieces: DataFrame, ranges: DataFrame, rid: list[str], width: int, key=SHARD_KEY) -> DataFrame:
    """Tokens of every range [start, end) of a shard: (key, rid..., tokens).

    ``width`` is the bucket size (about the range length).  Ranges and piece
    chunks meet on (key, bucket); each range collects at most
    ``end - start`` tokens, whatever the shard size.
    """
    key = list(key)
    plen = F.size("tokens")
    b0 = F.floor(F.col("shard_pos") / width)
    b1 = F.floor((F.col("shard_pos") + plen - 1) / width)
    ch = pieces.where(plen > 0).select(*key, "shard_pos", "tokens",
                                       F.explode(F.sequence(b0, b1)).alias("_b"))
    c_lo = F.greatest(F.col("shard_pos"), F.col("_b") * width)
    c_hi = F.least(F.col("shard_pos") + plen, (F.col("_b") + 1) * width)
    ch = ch.select(*key, "_b", c_lo.alias("c_lo"),
                   F.slice("tokens", (c_lo - F.col("shard_pos") + 1).cast("int"),
                           (c_hi - c_lo).cast("int")).alias("chunk"))
    r = ranges.select(*key, *rid, "start", "end",
                      F.explode(F.sequence(F.floor(F.col("start") / width),
                                           F.floor((F.col("end") - 1) / width))).alias("_b"))
    j = r.join(ch, [*key, "_b"])
    lo = F.greatest(F.col("start"), F.col("c_lo"))
    hi = F.least(F.col("end"), F.col("c_lo") + F.size("chunk"))
    j = j.where(lo < hi).select(*key, *rid, lo.alias("_lo"),
                                F.slice("chunk", (lo - F.col("c_lo") + 1).cast("int"), (hi - lo).cast("int")).alias("_t"))
    g = j.groupBy(*key, *rid).agg(F.array_sort(F.collect_list(F.struct("_lo", "_t"))).alias("_parts"))
    return g.select(*key, *rid, F.flatten(F.transform("_parts", lambda x: x["_t"])).alias("tokens"))


def batches_contiguous(sizes: DataFrame, batch_tokens: int, ranks: int, key=SHARD_KEY) -> DataFrame:
    """B1: batch k of a shard starts at k*B while k*B + B + 1 < n, i.e.
    ceil((n-B-1)/B) batches (none if n <= B+1); rank r reads
    [k*B + r*L, k*B + r*L + L + 1) with L = B/R; the shard tail is dropped.
    Positions only: ``sequence`` explode, no scan loop."""
    if batch_tokens % ranks:
        raise ValueError("batch size must divide by the number of ranks")
    L = batch_tokens // ranks
    nb = F.greatest(F.ceil((F.col("n") - batch_tokens - 1) / batch_tokens), F.lit(0))
    b = sizes.where(nb > 0).select(*key, F.explode(F.sequence(F.lit(0).cast("bigint"), (nb - 1).cast("bigint")))
                                   .alias("batch"))
    b = b.select(*key, "batch", F.explode(F.sequence(F.lit(0), F.lit(ranks - 1))).alias("rank"))
    start = F.col("batch") * batch_tokens + F.col("rank") * L
    return b.select(*key, "batch", "rank", start.alias("start"), (start + L + 1).alias("end"))


def fixed_sequences(sizes: DataFrame, seq_len: int, key=SHARD_KEY) -> DataFrame:
    """Windows [k*len, (k+1)*len) for k < n // len; the short tail is dropped."""
    ns = (F.col("n") / seq_len).cast("bigint")
    s = sizes.where(ns > 0).select(*key, F.explode(F.sequence(F.lit(0).cast("bigint"), ns - 1)).alias("seq"))
    return s.select(*key, "seq", (F.col("seq") * seq_len).alias("start"), ((F.col("seq") + 1) * seq_len).alias("end"))


def batch_pairs(buffers: DataFrame, col: str = "tokens") -> DataFrame:
    """inputs = buffer[:-1], targets = buffer[1:]."""
    n = F.size(col)
    return buffers.withColumn("inputs", F.slice(col, 1, n - 1)).withColumn("targets", F.slice(col, 2, n - 1))


def bigram_hash(x: Column, vocab: int = BIGRAM_VOCAB) -> Column:
    """Position 0 -> vocab; position 1 hashes with prev = vocab (slot 0 is
    overwritten before the shifted multiply reads it); later positions with
    the previous token.  (36313*cur XOR 27191*prev) with int32 wrap, then a
    non-negative modulo."""
    def h(cur, prev):
        a = int32_wrap(cur.cast("bigint") * BIGRAM_MUL_CUR)
        b = int32_wrap(prev.cast("bigint") * BIGRAM_MUL_PREV)
        return F.pmod(a.bitwiseXOR(b), F.lit(vocab)).cast("int")
    return F.transform(x, lambda v, i: F.when(i == 0, F.lit(vocab)).when(
        i == 1, h(v, F.lit(vocab))).otherwise(h(v, F.element_at(x, i))))


def max_num_docs(local_tokens: int) -> int:
    """Document slots per rank: table value, else ceil((L // 300) / 128) * 128."""
    if local_tokens in TRAIN_MAX_NUM_DOCS:
        return TRAIN_MAX_NUM_DOCS[local_tokens]
    return math.ceil((local_tokens // 300) / 128) * 128


def pad_seqlens(cum: Column, local_tokens: int) -> Column:
    """``[0] + cum`` padded with L up to the document slots; too many -> error."""
    slots = max_num_docs(local_tokens)
    body = F.concat(F.array(F.lit(0)), cum.cast("array<int>"))
    pad = F.array_repeat(F.lit(local_tokens), F.greatest(F.lit(slots) - F.size(body), F.lit(0)))
    return F.when(F.size(body) <= slots, F.concat(body, pad)).otherwise(
        F.raise_error(F.lit(f"more documents than {slots} slots")).cast("array<int>"))


def batch_seqlens_unaligned(inputs: Column, local_tokens: int, bos: int = GPT2_BOS) -> Column:
    """Positions of BOS within the inputs, padded (validation batches)."""
    idx = F.filter(F.transform(inputs, lambda v, i: F.when(v == bos, i)), lambda p: p.isNotNull())
    return pad_seqlens(idx, local_tokens)


def batch_seqlens(segments: DataFrame, local_tokens: int, rid: list[str]) -> DataFrame:
    """Cumulative segment lengths of each packed buffer (the last segment
    shortened by 1 for the target shift), padded to the document slots.  The
    running sum is a window over one buffer's segments."""
    w = Window.partitionBy(*rid).orderBy("seg")
    last = F.lead("seg").over(w).isNull().cast("bigint")
    s = segments.select(*rid, "seg", (F.sum(F.col("end") - F.col("start")).over(w) - last).alias("_cum"))
    g = s.groupBy(*rid).agg(F.array_sort(F.collect_list(F.struct("seg", "_cum"))).alias("_s"))
    return g.select(*rid, pad_seqlens(F.transform("_s", lambda x: x["_cum"]), local_tokens).alias("cum_seqlens"))


def bos_index(pieces: DataFrame, key=SHARD_KEY) -> DataFrame:
    """BOS positions of each shard (a piece that starts a document)."""
    return pieces.where("bos_start").select(*key, F.col("shard_pos").alias("bos_pos"))


def chain_from_start(follow: np.ndarray) -> np.ndarray:
    """Indexes reached from index 0 when ``i`` leads to ``follow[i]`` > i (the
    length of ``follow`` ends the chain), by pointer doubling."""
    n = len(follow)
    hop = np.append(follow, n)
    seen = np.zeros(n + 1, dtype=bool)
    seen[0] = True
    for _ in range(n.bit_length()):
        seen[hop[seen]] = True
        hop = hop[hop]
    return np.flatnonzero(seen[:n])


def aligned_starts(bos: np.ndarray, n: int, local_batch: int, ranks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """B2 in one shard of ``n`` tokens with document starts ``bos``: (batch, rank, start).

    A start is followed by the first document start at least ``local_batch``
    later, found for all of them by one sorted search; the buffers' starts are
    the chain of followers, R of them a batch.  A batch is due while
    its window of 2B tokens and one more lie inside the shard, and must be
    complete within that window."""
    bos = np.sort(bos)
    chain = bos[chain_from_start(np.searchsorted(bos, bos + local_batch))]
    window = 2 * local_batch * ranks
    begin = np.append(0, chain[ranks::ranks])
    due = int(np.searchsorted(begin + window + 1, n))
    end = chain[ranks::ranks][:due]
    if len(end) < due or (end >= begin[:due] + window).any():
        raise RuntimeError("a batch window holds too few document starts; raise the span")
    k = np.arange(due * ranks)
    return k // ranks, k % ranks, chain[k]


def batches_bos_aligned(pieces: DataFrame, sizes: DataFrame, batch_tokens: int, ranks: int,
                        key=SHARD_KEY) -> DataFrame:
    """B2: each rank's buffer starts at a BOS: from the first BOS, a start is
    confirmed by the first later BOS at least L away; R starts make a batch
    and the next batch begins at the confirming BOS.  Buffer = L+1 tokens from
    the start.  Runs per shard over BOS positions only (``applyInPandas``)."""
    key = list(key)
    L = batch_tokens // ranks
    b = bos_index(pieces, key).join(sizes, key)

    def per_shard(pdf: pd.DataFrame) -> pd.DataFrame:
        batch, rank, start = aligned_starts(pdf["bos_pos"].to_numpy(dtype=np.int64), int(pdf["n"].iloc[0]), L, ranks)
        return pd.DataFrame({**{k: pdf[k].iloc[0] for k in key}, "batch": batch, "rank": rank, "start": start,
                             "end": start + L + 1}, columns=[*key, "batch", "rank", "start", "end"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in b.schema.fields if f.name in key)
    return b.groupBy(*key).applyInPandas(per_shard, f"{schema}, batch long, rank int, start long, end long")


def packed_segments(starts: np.ndarray, n: int, local_tokens: int, max_seq: int,
                    ranks: int) -> dict[str, np.ndarray]:
    """B3 in one shard: batch, rank, seg, start, end of every segment.

    With documents clipped to ``max_seq``, the buffer that begins at document i
    ends in the document where the prefix sum of clipped lengths first reaches
    ``local_tokens + 1`` more -- one sorted search for all i; the buffers are the
    chain of those ends, and the document that fills one gives only what is
    missing.  Buffers that stay open, and those of an open batch, are dropped."""
    starts = np.sort(starts)
    clipped = np.minimum(np.append(starts[1:], n) - starts, max_seq)
    before = np.append(0, np.cumsum(clipped))
    full = local_tokens + 1
    after = np.searchsorted(before, before[:-1] + full)  # the document after the filling one
    first = chain_from_start(np.minimum(after, len(starts)))
    first = first[after[first] <= len(starts)]
    first = first[:len(first) // ranks * ranks]
    count = after[first] - first
    buffer = np.repeat(np.arange(len(first)), count)
    seg = np.arange(len(buffer)) - np.repeat(np.cumsum(count) - count, count)
    doc = first[buffer] + seg
    room = full - (before[doc] - before[first[buffer]])
    return {"batch": buffer // ranks, "rank": buffer % ranks, "seg": seg, "start": starts[doc],
            "end": starts[doc] + np.minimum(clipped[doc], room)}


def batches_packed(pieces: DataFrame, sizes: DataFrame, batch_tokens: int, max_seq_len: int,
                   ranks: int, key=SHARD_KEY) -> DataFrame:
    """Per rank a buffer of exactly L+1 tokens; each document used once,
    clipped to ``max_seq_len`` and to the space left (remainder dropped);
    an incomplete batch at the shard end is dropped.  Per shard over BOS
    positions only; output segments (key, batch, rank, seg, start, end)."""
    key = list(key)
    L = batch_tokens // ranks
    b = bos_index(pieces, key).join(sizes, key)

    def per_shard(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = packed_segments(pdf["bos_pos"].to_numpy(dtype=np.int64), int(pdf["n"].iloc[0]), L, max_seq_len, ranks)
        return pd.DataFrame({**{k: pdf[k].iloc[0] for k in key}, **rows},
                            columns=[*key, "batch", "rank", "seg", "start", "end"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in b.schema.fields if f.name in key)
    return b.groupBy(*key).applyInPandas(per_shard,
                                         f"{schema}, batch long, rank int, seg int, start long, end long")


def packed_buffers(pieces: DataFrame, segments: DataFrame, width: int, key=SHARD_KEY) -> DataFrame:
    """Tokens of packed buffers: gather every segment, concatenate by ``seg``."""
    key = list(key)
    t = gather(pieces, segments, ["batch", "rank", "seg"], width, key)
    g = t.groupBy(*key, "batch", "rank").agg(F.array_sort(F.collect_list(F.struct("seg", "tokens"))).alias("_s"))
    return g.select(*key, "batch", "rank", F.flatten(F.transform("_s", lambda x: x["tokens"])).alias("tokens"))


def buffer_spans(segments: DataFrame, key=SHARD_KEY) -> DataFrame:
    """The token ranges of each packed buffer in order: (key, batch, rank, spans), one row per buffer; a
    buffer has at most its own length of segments."""
    g = segments.groupBy(*key, "batch", "rank").agg(F.array_sort(F.collect_list(F.struct("seg", "start", "end"))).alias("_s"))
    return g.select(*key, "batch", "rank", F.transform("_s", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))).alias("spans"))


def boundary_dataset(stream_docs: DataFrame, bos: int = GPT2_BOS, seq_size: int = 2049,
                     keys=("domain", "split"), streams: DataFrame | None = None) -> DataFrame:
    """K2: properties of a (tokens, doc_starts) dataset per stream, refusing --
    by an error -- an empty stream, a first start other than 0 and a document
    that does not start with BOS; ``num_seqs = n // seq``.

    ``stream_docs``: keys, start (stream position), tokens (kept piece);
    ``streams``: the streams that must be there (one without documents is empty)."""
    g = stream_docs.groupBy(*keys).agg(
        F.sum(F.size("tokens")).cast("bigint").alias("n_tokens"),
        F.count(F.lit(1)).alias("n_docs"),
        F.min("start").alias("first_start"),
        F.bool_and(F.coalesce(F.try_element_at("tokens", F.lit(1)), F.lit(-1)) == bos).alias("starts_are_bos"))
    if streams is not None:
        g = streams.select(*keys).distinct().join(g, list(keys), "left")
    n = F.coalesce("n_tokens", F.lit(0).cast("bigint"))
    refuse = lambda why: F.raise_error(F.lit(why)).cast("boolean")
    return g.select(*keys, n.alias("n_tokens"), F.coalesce("n_docs", F.lit(0).cast("bigint")).alias("n_docs"),
                    F.floor(n / seq_size).alias("num_seqs"), "first_start", "starts_are_bos",
                    F.when(n == 0, refuse("refusing to write an empty token stream"))
                    .when(F.col("first_start") != 0, refuse("the first document must start at 0"))
                    .when(~F.col("starts_are_bos"), refuse("a document does not start with BOS"))
                    .otherwise(F.lit(True)).alias("ok"))


def write_boundary_dataset(stream_docs: DataFrame, dest: str, bos: int = GPT2_BOS, seq_size: int = 2049,
                           keys=("domain", "split"), streams: DataFrame | None = None) -> DataFrame:
    """K2 as a sink: checks first, then ``dest/data`` (keys, doc_start, tokens; Parquet partitioned by
    the keys, ascending starts in a file) and ``dest/properties``.  Returns the properties."""
    spark = stream_docs.sparkSession
    boundary_dataset(stream_docs, bos, seq_size, keys, streams).write.mode("errorifexists").parquet(f"{dest}/properties")
    (stream_docs.select(*keys, F.col("start").alias("doc_start"), "tokens")
     .repartitionByRange(*keys, "doc_start").sortWithinPartitions(*keys, "doc_start")
     .write.mode("errorifexists").partitionBy(*keys).parquet(f"{dest}/data"))
    return spark.read.parquet(f"{dest}/properties")
