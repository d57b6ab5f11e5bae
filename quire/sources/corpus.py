"""JSONL(.gz) corpus shards: land (one file per domain shard) and scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.sources.logs import land_text
from quire.sources.text_files import gzip_lines


def land_corpus(corpus: DataFrame, dest: str) -> DataFrame:
    """Write ``<dest>/<domain>/<shard_idx:04d>.jsonl.gz``: one gzip JSONL file
    per (domain, shard), documents in ``doc_pos`` order, streamed by one writer
    task per hash partition of shards.  A null text is written as null."""
    rows = corpus.select(F.format_string("%s/%04d.jsonl.gz", "domain", "shard_idx").alias("relpath"), "doc_pos",
                         F.to_json(F.struct("text"), {"ignoreNullFields": "false"}).alias("line"))
    out = land_text(rows, dest, order="doc_pos", compress=True)
    return out.select(F.regexp_extract("relpath", "^(.*)/", 1).alias("domain"),
                      F.regexp_extract("relpath", r"/(\d+)\.jsonl", 1).cast("int").alias("shard_idx"),
                      F.concat(F.lit(dest.rstrip("/") + "/"), "relpath").alias("path"), F.col("n_lines").alias("n_docs"))


def scan_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """``<folder>/<domain>/<shard>.jsonl.gz`` -> (domain, shard_idx, line_no, text).

    gzip is not splittable: a file is one task, decompressed as a stream
    (:func:`quire.sources.text_files.gzip_lines`), so its size does not matter;
    the result is repartitioned so later stages are not bound to the file
    count.  Bad JSON fails the job (FAILFAST); a missing ``text`` reads as ''.
    Undecodable bytes are replaced.
    """
    lines = gzip_lines(spark, folder, "*.jsonl.gz").hint("rebalance")  # later stages are not bound to the files
    doc = F.from_json("line", "text string", {"mode": "FAILFAST"})
    return lines.select(F.regexp_extract("path", r"([^/]+)/[^/]+\.jsonl\.gz$", 1).alias("domain"),
                        F.regexp_extract("path", r"/(\d+)\.jsonl\.gz$", 1).cast("int").alias("shard_idx"),
                        "line_no", F.coalesce(doc["text"], F.lit("")).alias("text"))
