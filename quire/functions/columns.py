"""Reusable column expressions.  All JVM-side (no Python per row)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the source system's for equal answers.
# ---------------------------------------------------------------------------
DEFAULT_GPU_TYPE = "H100"
NO_HASH_PREFIX = "_no_hash_"
GPT2_BOS = 50256
VOCAB_MOD = 50256
BIGRAM_VOCAB = 251519  # 50,304 x 5 - 1 (the table has one extra slot)
SHARD_MAGIC = 20240520
SHARD_VERSION = 1
SHARD_HEADER_INTS = 256
SHARD_SIZE = 100_000_000
SHARD_NAME_FORMAT = "dolma_%s_%s_%04d.bin"  # split, domain, shard number
JOB_ID_ENV_KEY = "_iris_job_id"  # env var carrying a run's external job id


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def live(deleted="deleted") -> Column:
    """Row is not soft-deleted: ``COALESCE(deleted, 0) = 0``."""
    return F.coalesce(col(deleted), F.lit(0)) == 0


def primary_loss(val="val_loss", train="train_loss") -> Column:
    """Primary loss of a metric row: validation wins when both are present."""
    return F.coalesce(col(val), col(train))


def gpu_type_or_default(c="gpu_type") -> Column:
    return F.coalesce(F.nullif(col(c), F.lit("")), F.lit(DEFAULT_GPU_TYPE))


def group_hash(code_hash="code_hash", run_id="id") -> Column:
    """A NULL code hash is a group of its own."""
    return F.coalesce(col(code_hash), F.concat(F.lit(NO_HASH_PREFIX), col(run_id).cast("string")))


def lenient_int(c, default=None) -> Column:
    """int, else int(float), else ``default``."""
    c = F.trim(col(c).cast("string"))
    return F.coalesce(
        c.try_cast("bigint"),
        c.try_cast("double").try_cast("bigint"),
        F.lit(default).cast("bigint"),
    )


def int32_wrap(c) -> Column:
    """Two's-complement wrap of a BIGINT into the int32 range (no ANSI error)."""
    c = col(c)
    return F.pmod(c + F.lit(2 ** 31), F.lit(2 ** 32)) - F.lit(2 ** 31)


def words(text) -> Column:
    """Whitespace words (space, tab, newline, carriage return)."""
    return F.regexp_extract_all(col(text), F.lit("[^ \t\n\r]+"), 0)


def word_token(w: Column) -> Column:
    """Default offline tokenizer: first 16 bits of md5(word) modulo 50,256."""
    return F.pmod(F.conv(F.substring(F.md5(w), 1, 4), 16, 10).cast("int"), F.lit(VOCAB_MOD))


def tokenize_text(text) -> Column:
    """text -> ARRAY<INT> of token ids (no special tokens)."""
    return F.transform(words(text), word_token)


def utf8_window(text, start, length: int, strip_head: bool = True, strip_tail: bool = True) -> Column:
    """Text of bytes ``[start, start+length)`` (1-based ``start``) of the UTF-8
    encoding of ``text``, with characters cut by the window dropped.

    Like decoding a byte slice with ``errors='ignore'``: partial characters at
    the edges are removed (via their hex form, so it stays JVM-side).  With
    ``strip_tail`` a complete non-ASCII character at the very end is removed
    too, which never changes a search for an ASCII pattern.
    """
    b = F.substring(F.encode(col(text), "UTF-8"), start, length)
    h = F.hex(b)
    if strip_head:
        h = F.regexp_replace(h, "^([89AB][0-9A-F])+", "")
    if strip_tail:
        h = F.regexp_replace(h, "([C-F][0-9A-F])([89AB][0-9A-F])*$", "")
    return F.decode(F.unhex(h), "UTF-8")
