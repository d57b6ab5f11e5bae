"""Corpus -> token stream: tokenize, clip, budget, split, shard, stats
(S2, P6-P9, A6, A7, W7-W12).

Documents stay rows with an ``ARRAY<INT>`` of tokens; stream positions come
from prefix sums of document *lengths* (:mod:`quire.plans.prefix`), never from
exploding tokens or a per-domain window.  A domain's stream order is
``doc_pos``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.columns import GPT2_BOS, SHARD_NAME_FORMAT, SHARD_SIZE, tokenize_text, words
from quire.plans.prefix import prefix_sums


def domain_catalog(catalog: DataFrame, domains: list[str] | None = None,
                   max_shards: int | None = None) -> DataFrame:
    """(domain, source_idx, shard_idx, path) restricted to ``domains`` and
    to the first ``max_shards`` shards of each source, in read order."""
    c = catalog
    if domains:
        c = c.where(F.col("domain").isin(domains))
    if max_shards is not None:
        c = c.where(F.col("shard_idx") < max_shards)
    return c


def tokenize(corpus: DataFrame, bos: int = GPT2_BOS, keep_empty: bool = False,
             tokenizer: Callable[[Column], Column] | None = None) -> DataFrame:
    """Text -> ``[BOS] + tokens``.

    Empty or missing text is dropped (blend) unless ``keep_empty`` (the
    boundary dataset keeps it as ``[BOS]``).  ``tokenizer`` maps a text column
    to an ``ARRAY<INT>`` column; the default is the native word tokenizer.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    src = corpus if keep_empty else corpus.where(F.length(text) > 0)
    tok = (tokenizer or tokenize_text)(text)
    return src.withColumn("tokens", F.concat(F.array(F.lit(bos)), tok)).drop("text")


def clip_docs(doc_tokens: DataFrame, max_doc_tokens: int = 4096) -> DataFrame:
    """Clip each document's tokens (after BOS) to ``max_doc_tokens``;
    stored length <= max + 1.  0 disables."""
    if not max_doc_tokens:
        return doc_tokens
    return doc_tokens.withColumn("tokens", F.slice("tokens", 1, max_doc_tokens + 1))


def token_counts(corpus: DataFrame, keep_empty: bool = False, keys=("domain",),
                 order: str = "doc_pos") -> DataFrame:
    """Token counts of the default word tokenizer (one token per word, plus
    BOS) without building the token arrays: what positions, budgets, splits
    and length statistics need.  Equal to ``doc_lengths(tokenize(corpus))``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    src = corpus if keep_empty else corpus.where(F.length(text) > 0)
    return src.select(*keys, order, (F.size(words(text)) + 1).cast("bigint").alias("n_tokens"))


def doc_lengths(doc_tokens: DataFrame, keys=("domain",), order: str = "doc_pos") -> DataFrame:
    return doc_tokens.select(*keys, order, F.size("tokens").cast("bigint").alias("n_tokens"))


def stream_positions(lengths: DataFrame, keys=("domain",), order="doc_pos") -> DataFrame:
    """Per document: ``start`` (stream position of its BOS) and ``doc_no``
    (documents before it), by distributed prefix sums.  ``order`` is a column
    name or a list of names (unique within a key)."""
    from quire.session import materialize
    order = [order] if isinstance(order, str) else list(order)
    lengths = materialize(lengths)  # narrow; the quantiles, block totals and running sums read it, not the texts
    pos = prefix_sums(lengths.withColumn("_one", F.lit(1).cast("bigint")), list(keys), order,
                      {"n_tokens": "start", "_one": "doc_no"}).drop("_one")
    return materialize(pos)  # the position table: narrow, read by every split/shard branch


def bos_positions(lengths: DataFrame, keys=("domain",), order: str = "doc_pos") -> DataFrame:
    """Index of every BOS in the stream = start of each document."""
    return stream_positions(lengths, keys, order).select(*keys, order, F.col("start").alias("bos_pos"))


def doc_of_token(doc_tokens: DataFrame, positions: DataFrame, keys=("domain",),
                 order: str = "doc_pos") -> DataFrame:
    """Every token with its stream position and document number
    (cumulative BOS count, 1-based).  Token-level output by nature."""
    j = doc_tokens.join(positions, [*keys, order])
    e = j.select(*keys, order, "start", "doc_no", F.posexplode("tokens").alias("i", "token"))
    return e.select(*keys, (F.col("start") + F.col("i")).alias("pos"), "token",
                    (F.col("doc_no") + 1).alias("doc_no"))


def seq_len_stats(positions: DataFrame, keys=("domain",), order: str = "doc_pos") -> DataFrame:
    """Lengths between consecutive BOS -- every document but the last of
    each stream -- with median, mean, p25, p75, p95, max (truncated to int);
    NULL statistics with fewer than 2 BOS; total tokens counts everything."""
    last = positions.groupBy(*keys).agg(F.max(order).alias("_last"),
                                        F.sum("n_tokens").alias("total_tokens"),
                                        F.count(F.lit(1)).alias("n_bos"))
    j = positions.join(last, list(keys))
    L = F.when(F.col(order) < F.col("_last"), F.col("n_tokens"))
    trunc = lambda c: F.when(F.col("n_bos") >= 2, c.cast("bigint"))
    agg = j.groupBy(*keys).agg(
        F.first("total_tokens").alias("total_tokens"), F.first("n_bos").alias("n_bos"),
        F.count(L).alias("num_sequences"),
        F.percentile(L, [0.25, 0.5, 0.75, 0.95]).alias("_q"),  # one exact percentile buffer
        F.avg(L).alias("_mean"), F.max(L).alias("_max"))
    agg = agg.select("*", *[F.col("_q")[i].alias(n) for i, n in enumerate(["_p25", "_median", "_p75", "_p95"])])
    return agg.select(*keys, F.when(F.col("n_bos") >= 2, F.col("num_sequences")).alias("num_sequences"),
                      "total_tokens",
                      trunc(F.col("_median")).alias("median_len"), trunc(F.col("_mean")).alias("mean_len"),
                      trunc(F.col("_p25")).alias("p25_len"), trunc(F.col("_p75")).alias("p75_len"),
                      trunc(F.col("_p95")).alias("p95_len"), trunc(F.col("_max")).alias("max_len"))


def corpus_summary(lengths: DataFrame, keys=("domain",)) -> DataFrame:
    """Documents and tokens per domain plus one TOTAL row (the total is a
    second aggregate over the per-domain rows)."""
    per = lengths.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_docs"),
                                     F.sum("n_tokens").cast("bigint").alias("n_tokens"))
    total = per.agg(F.sum("n_docs").cast("bigint").alias("n_docs"),
                    F.sum("n_tokens").cast("bigint").alias("n_tokens"))
    total = total.select(*[F.lit("TOTAL").alias(k) for k in keys], "n_docs", "n_tokens")
    return per.unionByName(total)


def token_budget(positions: DataFrame, budget: int) -> DataFrame:
    """Documents in stream order until the total reaches ``budget``; the
    last one is cut.  Adds ``keep`` (tokens kept) and drops later documents."""
    kept = positions.where(F.col("start") < budget)
    return kept.withColumn("keep", F.least(F.col("n_tokens"), F.lit(budget) - F.col("start")))


def split_contiguous(positions: DataFrame, val_tokens: int, train_tokens: int | None = None) -> DataFrame:
    """val = stream tokens [0, V), train = [V, V+T), or the rest of the
    stream without ``train_tokens``; a document on the boundary is cut in two
    (train may start inside a document).  Returns one row per (document, split)
    with the token range inside the document."""
    s, e = F.col("start"), F.col("start") + F.col("n_tokens")

    def part(name, lo, hi):
        a = F.greatest(s, F.lit(lo))
        b = e if hi is None else F.least(e, F.lit(hi))
        inside = e > lo if hi is None else (e > lo) & (s < hi)
        return positions.where(inside).select(
            "*", F.lit(name).alias("split"), (a - s).alias("from_tok"), (b - s).alias("to_tok"),
            (a - F.lit(lo)).alias("split_pos"))

    end = None if train_tokens is None else val_tokens + train_tokens
    return part("val", 0, val_tokens).unionByName(part("train", val_tokens, end))


def split_by_doc(positions: DataFrame, val_tokens: int, train_tokens: int | None = None,
                 keys=("domain",)) -> DataFrame:
    """One iterator, val first: documents until V tokens (the last cut,
    its remainder **lost**), then train from the next document until T (to the
    end of the stream without ``train_tokens``)."""
    s, e = F.col("start"), F.col("start") + F.col("n_tokens")
    val = positions.where(s < val_tokens).select(
        "*", F.lit("val").alias("split"), F.lit(0).cast("bigint").alias("from_tok"),
        F.least(F.col("n_tokens"), F.lit(val_tokens) - s).alias("to_tok"), s.alias("split_pos"))
    # train starts at the document after the one that completed the val budget
    cut = positions.where(e >= val_tokens).groupBy(*keys).agg(F.min(e).alias("_t0"))
    t = positions.join(cut, list(keys)).where(s >= F.col("_t0"))
    ts = s - F.col("_t0")
    left = F.col("n_tokens") if train_tokens is None else F.least(F.col("n_tokens"), F.lit(train_tokens) - ts)
    train = (t if train_tokens is None else t.where(ts < train_tokens)).select(
        *positions.columns, F.lit("train").alias("split"), F.lit(0).cast("bigint").alias("from_tok"),
        left.alias("to_tok"), ts.alias("split_pos"))
    return val.unionByName(train)


def assign_shards(split_rows: DataFrame, shard_size: int = SHARD_SIZE) -> DataFrame:
    """W9/K1 naming: cut a split's stream every ``shard_size`` tokens; a
    document piece may straddle shards, so it becomes one row per shard it
    touches: (…, shard, shard_from, shard_to) token offsets within the piece."""
    length = F.col("to_tok") - F.col("from_tok")
    p0 = F.col("split_pos")
    # whole-number division (``div``): positions pass 2^53 in no double
    first, last = (F.expr(f"({c}) div {int(shard_size)}") for c in ("split_pos", "split_pos + to_tok - from_tok - 1"))
    r = split_rows.where(length > 0).withColumn("shard", F.explode(F.sequence(first, last)))
    lo = F.greatest(p0, F.col("shard") * shard_size)
    hi = F.least(p0 + length, (F.col("shard") + 1) * shard_size)
    return r.withColumn("shard_from", F.col("from_tok") + lo - p0).withColumn("shard_to", F.col("from_tok") + hi - p0)


def shard_name(split: Column, domain: Column, shard: Column) -> Column:
    """Shard file name (``SHARD_NAME_FORMAT``: split, domain, 4-digit number)."""
    return F.format_string(SHARD_NAME_FORMAT, split, domain, shard.cast("int"))


def shuffle_docs(corpus: DataFrame, seed: int = 42, id_col: str = "doc_id") -> DataFrame:
    """Deterministic seeded permutation of documents: the stream order
    becomes (``shuffle_key``, id) with ``shuffle_key`` = first 60 bits of
    md5("seed:id").  Positions follow from :func:`stream_positions` with
    ``order=["shuffle_key", id_col]`` -- no per-domain window.  (Not numpy's
    permutation: same seed, different order.)"""
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))
    return corpus.withColumn("shuffle_key", F.conv(F.substring(h, 1, 15), 16, 10).cast("bigint"))
