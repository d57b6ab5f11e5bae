"""URL filter: a blocked Bloom filter of the listed URLs, then an exact hash join.

A listed entry is a host and a path prefix; it fits a URL whose host is that host or a subdomain of
it and whose path starts with the prefix.  A URL therefore can only match the keys (host suffix,
path prefix), a few per URL.  Those keys are tested against a blocked Bloom filter -- one 64-bit
word per block, built by a ``bit_or`` aggregate over the list -- and only keys that may be listed
reach the hash join on the exact (host, path) pair, which removes the filter's false positives.

Scale.  URLs are judged once per distinct (host, path), so a hot host or a URL that holds a third
of the rows costs one partial aggregate.  The filter has at most ``MAX_BLOCKS`` words (16 MB as
rows), whatever the list, so broadcasting it is safe; a longer list only lets more keys through to
the exact join.  The list itself is never hinted: Spark picks the join by measured size.

Defined cases.  A null URL, or one without ``://``, has an empty host and path and fits nothing.
An empty path fits only entries with an empty prefix.  Longest entry text wins; among equal lengths
the longer host, then block before allow.  A rule beats the block list.  Repeated pages are each
judged; repeated entries count once.  Extra input columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import ASCII_LOWER, ASCII_UPPER

#: Words of the Bloom filter at most: 2^20 rows of (block, word), 16 MB, is what may be broadcast.
MAX_BLOCKS = 1 << 20
BITS_PER_KEY = 16
PROBES = 5


def host_of(url):
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1)
    return F.translate(host, ASCII_UPPER, ASCII_LOWER)


def path_of(url):
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def _key(host, path):
    return F.xxhash64(host, F.lit("|"), path)


def _block(key, blocks: int):
    return F.pmod(key, F.lit(blocks).cast("bigint"))


def _mask(key):
    """PROBES bits of the key's 64-bit word, from a second hash."""
    h = F.xxhash64(key, F.lit(7))
    mask = F.lit(0).cast("bigint")
    for i in range(PROBES):
        bit = F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63).cast("bigint")).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit))
    return mask


def bloom_blocks(entries: DataFrame, blocks: int) -> DataFrame:
    """(block, word): one row per non-empty block of the filter; ``entries`` has host and path."""
    k = entries.select(_key(F.col("host"), F.col("path")).alias("k"))
    return k.groupBy(_block(F.col("k"), blocks).alias("block")).agg(F.bit_or(_mask(F.col("k"))).alias("word"))


def _suffixes(host):
    """The host and every parent domain of it."""
    labels = F.split(host, "\\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)),
                       lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def url_verdicts(pages: DataFrame, entries: DataFrame) -> DataFrame:
    """Judge ``pages(page_id, url)`` by ``entries(host, path, rule, verdict, listed)``.

    ``listed`` false: a rule, reported in ``rule``; true: an entry of the block list, which decides
    only where no rule fits (``rule`` stays null).  Returns page_id, host, path, rule, verdict,
    by_list (whether the block list decided).  Two small jobs read the list first: its size (for
    the filter) and its distinct prefix lengths (at most the longest path, a few thousand).
    """
    entries = (entries.select("host", "path", "rule", "verdict", "listed")
               .filter(F.col("host").isNotNull() & F.col("path").isNotNull() & (F.col("host") != ""))
               .dropDuplicates())
    lengths = sorted(r[0] for r in entries.select(F.length("path")).distinct().collect())
    n = entries.count()
    blocks = min(MAX_BLOCKS, 1 << max(6, math.ceil(math.log2(max(1, n) * BITS_PER_KEY / 64))))

    judged = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    distinct = judged.select("host", "path").filter(F.col("host") != "").distinct()
    prefixes = F.filter(F.array(*[F.when(F.length("path") >= k, F.substring("path", 1, k)) for k in lengths]
                                or [F.lit(None).cast("string")]), lambda x: x.isNotNull())
    keys = (distinct.select("host", "path", F.explode(_suffixes(F.col("host"))).alias("e_host"))
            .select("host", "path", "e_host", F.explode(prefixes).alias("e_path"))
            .withColumn("k", _key(F.col("e_host"), F.col("e_path"))))
    maybe = (keys.withColumn("block", _block(F.col("k"), blocks))
             .join(F.broadcast(bloom_blocks(entries, blocks)), "block")
             .filter(F.col("word").bitwiseAND(_mask(F.col("k"))) == _mask(F.col("k"))))
    fits = maybe.join(entries.select(F.col("host").alias("e_host"), F.col("path").alias("e_path"),
                                     "rule", "verdict", "listed"), ["e_host", "e_path"])
    size = F.length("e_host") + F.length("e_path")
    best = fits.groupBy("host", "path").agg(
        F.max_by(F.struct("rule", "verdict", "listed"),
                 F.struct(~F.col("listed"), size, F.length("e_host"),
                          (F.col("verdict") == "block"))).alias("best"))
    out = judged.join(best, ["host", "path"], "left")
    return out.select(
        "page_id", "host", "path",
        F.when(~F.col("best.listed"), F.col("best.rule")).alias("rule"),
        F.coalesce(F.col("best.verdict"), F.lit("allow")).alias("verdict"),
        F.coalesce(F.col("best.listed"), F.lit(False)).alias("by_list"))


#: The rules of the registered query and its block list (host, path prefix).
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"),
         ("block", "net/es/"), ("block", "net/fr/"))
BLOCK_LIST = ("spam-farm.example.org", "cheap-pills.example.com")


def split_entry(text: str) -> tuple[str, str]:
    """``host/path`` -> (host, /path); no slash: an empty prefix."""
    i = text.find("/")
    return (text, "") if i < 0 else (text[:i], text[i:])


def entry_table(spark, rules=RULES, block_list=BLOCK_LIST) -> DataFrame:
    rows = [(*split_entry(t), t, v, False) for v, t in rules]
    rows += [(*split_entry(t), None, "block", True) for t in block_list]
    return spark.createDataFrame(rows, "host string, path string, rule string, verdict string, listed boolean")


def op1_url_filter(spark, sf_dir: str) -> DataFrame:
    from quire.llm.common import table
    return url_verdicts(table(spark, sf_dir, "pages"), entry_table(spark))


ORACLE = """
WITH p AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
e(host, path, rule, verdict, listed) AS (VALUES
  ('com', '/', 'com/', 'allow', false), ('example.com', '/en/', 'example.com/en/', 'block', false),
  ('www.example.com', '/en/', 'www.example.com/en/', 'allow', false), ('net', '/es/', 'net/es/', 'block', false),
  ('net', '/fr/', 'net/fr/', 'block', false), ('spam-farm.example.org', '', NULL, 'block', true),
  ('cheap-pills.example.com', '', NULL, 'block', true)),
hp AS (SELECT DISTINCT host, path FROM p),
m AS (
  SELECT hp.host, hp.path, e.rule, e.verdict, e.listed,
         row_number() OVER (PARTITION BY hp.host, hp.path
                            ORDER BY e.listed, length(e.host) + length(e.path) DESC, length(e.host) DESC) AS rn
  FROM hp JOIN e ON (hp.host = e.host OR ends_with(hp.host, '.' || e.host)) AND starts_with(hp.path, e.path))
SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.verdict, 'allow') AS verdict, coalesce(m.listed, false) AS by_list
FROM p LEFT JOIN m ON m.host = p.host AND m.path = p.path AND m.rn = 1
"""
